"""WARC archives: one gzip member per record, written by Spark's own committer, read by byte ranges.

Method of the reader: splittable. Tasks get byte ranges of the archives, scan their range for gzip
magic, validate each candidate by inflating and decoding its header lines, and own the records whose
member starts inside the range; a record may end beyond it. A record that is damaged or cut off behind
its header raises; none is left out silently.

The writer deduplicates payloads. Of records with equal payloads of at least `min_revisit_bytes`
bytes the one with the largest id is the response, the others are revisits of it without a body.
Which record is which is found on (id, digest) alone; pages move only to meet that small table.

Edge cases: a null payload is empty; repeated rows with one id and payload are each a response if the
id is the largest; a null id is written as such and refers to the largest non-null id; a null URL is
left out; an empty table gives no records; extra columns are ignored. Members over 16 MB are followed by
an empty member. Archives lie where pyarrow's file systems reach (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpoint_dir, cut, drop_folder, local_path, ready

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
#: Bytes in which a record's header lines must end.
MOST_HEADER = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
#: Below so many revisits (a few MB) their table is sent to every task; beyond, pages are joined by id.
BROADCAST_ROWS = 100_000
#: Ranges are dealt to so many tasks at most; beyond, a task takes several.
MOST_TASKS = 20_000


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = refers_to is not None
    body = b"" if revisit else payload
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + body
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, sha, refers_to of every record whose payload a record with a larger id has too. pages: page_id, payload, sha."""
    thin = cut(pages.where(F.length("payload") >= min_revisit_bytes).select("page_id", "sha"))
    shared = thin.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return thin.join(cut(shared), "sha").where("refers_to is not null and not page_id <=> refers_to").select("page_id", "sha", "refers_to")


def write(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    level: int = 3,
) -> None:
    """Writes archives under `path`, a folder that all executors share.

    Members go out through the text writer. The last byte of a member is the highest byte of its length, zero below
    16 MB; it is left out here and put back as the line separator, so that a file is gzip members and nothing else.
    """
    ready(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload")
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload)
    pages = pages.withColumn("sha", F.sha1("payload"))
    older = cut(revisits(pages, min_revisit_bytes).distinct())
    older = F.broadcast(older) if older.count() <= BROADCAST_ROWS else older
    same = pages["page_id"].eqNullSafe(older["page_id"]) & (pages["sha"] == older["sha"])
    told = pages.join(older, same, "left").select(pages["page_id"], "url", "payload", "refers_to")

    def members(batches):
        for batch in batches:
            out = []
            for page in batch.to_pylist():
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = record(page["page_id"], page["url"], page["payload"], page["refers_to"], date)
                member = pack.compress(data) + pack.flush()
                out.append((member if member[-1] == 0 else member + EMPTY_MEMBER)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    packed = told.mapInArrow(members, "member binary")
    packed.select(F.col("member").cast("string")).write.option("lineSep", "\x00").text(path)


class Ranged:
    """Reads a file at any place, through the local file system or whatever store pyarrow knows."""

    def __init__(self, path: str):
        from pyarrow import fs

        if path.startswith("file:"):
            store, name = fs.LocalFileSystem(), local_path(path)
        else:
            store, name = fs.FileSystem.from_uri(path)
        self.path, self.file = path, store.open_input_file(name)

    def at(self, start: int, size: int = BLOCK) -> bytes:
        self.file.seek(start)
        return self.file.read(size)


def is_record(head: bytes) -> bool:
    """Whether these are the header lines of a WARC record, with the fields that every record has."""
    first, *lines = head.split(b"\r\n")
    names = {line.partition(b":")[0].strip().lower() for line in lines}
    return first.startswith(b"WARC/1.") and {b"warc-type", b"warc-record-id", b"content-length"} <= names


def inflate(source: Ranged, start: int) -> tuple[bytes, int] | None:
    """The content of the member that starts at `start` and where it ends; None if no WARC record starts there.

    What does not decode to a whole record header is no record. What fails behind one is damage, and raises."""
    unpack, head, at = zlib.decompressobj(31), b"", start
    block = source.at(at, 1 << 14)
    at += len(block)
    try:
        while b"\r\n\r\n" not in head:  # little by little, as what comes behind may be damaged
            if unpack.eof or len(head) > MOST_HEADER or not head.startswith(b"WARC/1."[: len(head)]):
                return None
            more = unpack.decompress(block, 256)
            head, block = head + more, b"" if unpack.eof else unpack.unconsumed_tail
            if not more and not block and not unpack.eof:
                at += len(block := source.at(at))
                if not block:
                    return None
    except zlib.error:
        return None
    if not is_record(head.partition(b"\r\n\r\n")[0]):
        return None
    parts = [head]
    try:
        parts.append(unpack.decompress(block))
        while not unpack.eof:
            at += len(block := source.at(at))
            if not block:
                raise ValueError(f"the record at byte {start} of {source.path} is cut off")
            parts.append(unpack.decompress(block))
    except zlib.error as error:
        raise ValueError(f"the record at byte {start} of {source.path} is damaged: {error}") from error
    return b"".join(parts), at - len(unpack.unused_data)


def scan(source: Ranged, start: int, end: int):
    """Contents of the records whose member starts in [start, end)."""
    at = start
    while at < end:
        block = source.at(at, min(BLOCK, end - at) + len(MAGIC) - 1)
        found = block.find(MAGIC)
        if found < 0:
            at += max(1, len(block) - len(MAGIC) + 1)
            continue
        if at + found >= end:
            return
        if (member := inflate(source, at + found)) is None:
            at += found + 1
        else:
            yield member[0]
            at = member[1]


def parse(content: bytes) -> dict:
    head, _, rest = content.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(named["Content-Length"])]
    if len(block) < int(named["Content-Length"]):
        raise ValueError(f"the block of {named['WARC-Record-ID']} is shorter than its header states")
    payload = block.partition(b"\r\n\r\n")[2]
    urn = lambda key: named[key].removeprefix("<urn:page:").removesuffix(">") or None if key in named else None
    revisit = named["WARC-Type"] == "revisit"
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of {named['WARC-Record-ID']} does not have the digest that its header states")
    return {
        "page_id": urn("WARC-Record-ID"),
        "url": named.get("WARC-Target-URI"),
        "record_type": named["WARC-Type"],
        "refers_to": urn("WARC-Refers-To"),
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


RECORD_SCHEMA = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload binary"


def read(spark: SparkSession, path: str, range_bytes: int = 16 << 20) -> DataFrame:
    """Records of all archives under `path`: page_id, url, record_type, refers_to, payload_digest, payload (null for revisits)."""
    ready(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.select("path", starts.alias("start"), "length")
    tasks = min(max(1, ranges.count()), MOST_TASKS)  # a stated number: a few bytes a range would be merged into one task
    ranges = ranges.repartition(tasks, "path", "start")

    def records(batches):
        types = pa.schema([(n, pa.binary() if n == "payload" else pa.string()) for n in RECORD_SCHEMA.replace(" string", "").replace(" binary", "").split(", ")])
        for batch in batches:
            for row in batch.to_pylist():
                source, out, size = Ranged(row["path"]), [], 0
                for content in scan(source, row["start"], min(row["start"] + range_bytes, row["length"])):
                    out.append(parse(content))
                    size += len(content)
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(out, types)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, types)

    return ranges.mapInArrow(records, RECORD_SCHEMA)


def op4_round_trip(pages: DataFrame) -> DataFrame:
    """Writes `pages` as archives, reads them back and resolves each revisit's length through its response."""
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    found = read(spark, path)
    kept = cut(
        found.select(
            F.col("page_id").cast(pages.schema["page_id"].dataType),
            F.length("payload").cast("long").alias("own_bytes"),
            "payload_digest",
            "record_type",
            F.col("refers_to").cast(pages.schema["page_id"].dataType),
        )
    )
    drop_folder(spark, path)
    responses = kept.where("record_type = 'response'")
    originals = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("own_bytes").alias("full_bytes"))
    resolved = kept.where("record_type = 'revisit'").join(originals, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        responses.withColumnRenamed("own_bytes", "payload_bytes").select(columns)
        .unionByName(resolved.withColumnRenamed("full_bytes", "payload_bytes").select(columns))
    )
