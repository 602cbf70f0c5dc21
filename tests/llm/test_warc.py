import base64
import gzip
import hashlib

import pytest
from corpus import prose

from motionloom.llm import warc
from motionloom.llm._common import local_path


def brute(rows):
    last = {}
    for i, html in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    found = []
    for i, html in rows:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        original = last.get(html or "")
        revisit = original is not None and i != original
        found.append((str(i), len(raw), digest, "revisit" if revisit else "response", str(original) if revisit else "None"))
    return sorted(found)


def told(df):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in df.collect())


def pages(spark):
    fake = warc.MAGIC.decode("latin-1") + "WARC/1.1 not a record"
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "ü中" * 1000), (6, fake * 50), (7, prose(1, 20000)), (8, prose(1, 20000)), (None, "a"), (9, "\r\n\r\nWARC/1.1\r\n\r\n")]
    return rows, spark.createDataFrame([(i, None if i == 1 else f"http://h/{i}\r\nX: y", h) for i, h in rows], "page_id long, url string, html string")


def test_round_trip(spark):
    rows, df = pages(spark)
    assert told(warc.op4_round_trip(df)) == brute(rows)


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert told(warc.op4_round_trip(df)) == brute([(r.page_id, r.html) for r in df.select("page_id", "html").collect()])


@pytest.mark.parametrize("range_bytes", [97, 4096, 1 << 24])
def test_each_range_owns_what_starts_in_it(spark, tmp_path, range_bytes):
    rows, df = pages(spark)
    path = f"file://{tmp_path}/{range_bytes}"
    warc.write(df.coalesce(1), path)
    got = sorted((str(r.page_id), r.record_type) for r in warc.read(spark, path, range_bytes).collect())
    assert got == sorted((r[0], r[3]) for r in brute(rows))


def test_archives_are_gzip_members(spark, tmp_path):
    rows, df = pages(spark)
    warc.write(df, f"file://{tmp_path}/w")
    content = b"".join(gzip.decompress(f.read_bytes()) for f in tmp_path.glob("w/part-*") if f.stat().st_size)
    assert content.count(b"WARC-Record-ID: <urn:page:") == len(rows)
    assert local_path(f"file://{tmp_path}") == str(tmp_path)


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows, df = pages(spark)
    warc.write(df, f"file://{tmp_path}/m", min_revisit_bytes=10)
    kinds = {r.page_id: r.record_type for r in warc.read(spark, f"file://{tmp_path}/m").where("page_id <> ''").collect()}
    assert kinds["1"] == kinds["2"] == "response" and kinds["7"] == "revisit"


def test_changed_payload_is_told(spark):
    content = warc.record(1, None, b"abc", None, "1970-01-01T00:00:00Z").replace(b"abc", b"abd")
    with pytest.raises(ValueError):
        warc.parse(content)


def test_damage_behind_a_header_raises(tmp_path):
    members = [gzip.compress(warc.record(n, "http://x/", prose(n, 300).encode(), None, "1970-01-01T00:00:00Z")) for n in range(3)]
    name = tmp_path / "w"

    def contents(raw):
        name.write_bytes(raw)
        return [warc.parse(c)["page_id"] for c in warc.scan(warc.Ranged(f"file://{name}"), 0, len(raw))]

    whole = b"".join(members)
    assert contents(whole) == ["0", "1", "2"]
    at = len(members[0]) + len(members[1]) - 60  # in the block of the second
    with pytest.raises(ValueError, match="damaged"):
        contents(whole[:at] + bytes(b ^ 255 for b in whole[at : at + 2]) + whole[at + 2 :])
    with pytest.raises(ValueError, match="cut off"):
        contents(whole[:-20])
    other = gzip.compress(b"WARC/1.1\r\nno: fields of a record\r\n\r\nabc") + gzip.compress(b"anything") + warc.MAGIC
    assert contents(other + whole + other) == ["0", "1", "2"]  # these are no records
