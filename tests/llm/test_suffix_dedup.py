import hashlib
import random
from collections import Counter

import pytest
from corpus import prose

from motionloom.llm import suffix_dedup


def brute(texts, length):
    """(bytes, removed, spans, kept) per text, from all windows of all texts."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    found = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        found.append((len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return found


def texts():
    rng = random.Random(11)
    shared = [prose(100 + n, 40) for n in range(3)]
    found = [prose(n, 60) for n in range(8)]
    found += [prose(20 + n, rng.randrange(5, 40)) + shared[n % 3][n : 180 + n] + prose(40 + n, rng.randrange(3, 30)) for n in range(9)]
    found += [None, "", "short", "a" * 700, "ab" * 300, "ab" * 300, shared[0] + shared[0], "中文 ü" * 90, "中文 ü" * 90 + "x"]
    found += [found[0], found[9][:150] + found[9][151:]]
    return found


@pytest.mark.parametrize("length", [40, 100, 400])
@pytest.mark.parametrize("most_runs", [256, 1])
def test_agrees_with_brute_force(spark, monkeypatch, length, most_runs):
    """most_runs 1: every anchor with different runs takes the way of very frequent ones."""
    monkeypatch.setattr(suffix_dedup, "MOST_RUNS", most_runs)
    rows = list(enumerate(texts()))
    got = {r.kid: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()}
    assert got == dict(enumerate(brute([t for _, t in rows], length)))


def test_whole_table_agrees_with_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for r, (n, gone, spans, kept) in zip(rows, brute([r.text for r in rows], 400), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op5_removed(docs).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_stage_leaves_valid_text(spark):
    same = "中" * 200
    rows = [(1, "a" + same, "k", 201), (2, "bc" + same + "üend", "k", 206), (3, None, "k", 0)]
    out = {r.doc_id: r for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")).collect()}
    assert out[1].text == "a" and out[2].text == "bcüend" and out[3].text == ""
    assert out[2].n_chars == 6 and out[2].source == "k"


def test_all_bounds_crossed_change_nothing(spark, monkeypatch):
    """Texts longer than a piece, anchors beyond the broadcast, every kind hot or none, batches of a few runs."""
    rows = list(enumerate(texts()))
    want = dict(enumerate(brute([t for _, t in rows], 60)))
    for bounds in ({"PIECE": 128, "BROADCAST_ANCHORS": 0}, {"HOT_ROWS": 1, "BATCH_RUNS": 2}):
        for name, value in bounds.items():
            monkeypatch.setattr(suffix_dedup, name, value)
        found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=60).collect()
        assert {r.kid: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found} == want
