import zlib
from collections import defaultdict

import numpy as np
import pytest
from corpus import odd_rows, prose

from motionloom.llm import packing


def encode(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    return [[*plain.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def check(rows, packed):
    whole = defaultdict(list)
    for (i, _), ids in zip(rows, encode([t for _, t in rows]), strict=True):
        whole[i].append(ids)
    want, got = defaultdict(int), defaultdict(int)
    for i, texts in whole.items():
        for ids in texts:
            for n, at in enumerate(range(0, len(ids), 2048)):
                part = ids[at : at + 2048]
                want[i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    for r in packed:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert got == want
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    tokens = sum(r.length for r in packed)
    assert len(sequences) <= 1.02 * (tokens / 2048) + 2


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(90, "Don't <|endoftext|> İI ΣΣ x́ é 3.14 a--b"), (91, prose(5, 9000))]
    check(rows, packing.op7_pack(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(rows, packing.op7_pack(docs).collect())


@pytest.mark.parametrize("order", ["falling", "random"])
def test_each_piece_goes_where_the_squares_become_smallest(order):
    lengths = np.random.default_rng(2).integers(1, 101, 400)
    lengths = np.sort(lengths)[::-1] if order == "falling" else lengths
    bins, offsets = packing.sum_of_squares(lengths, 100)
    gaps = []
    for b, o, s in zip(bins, offsets, lengths, strict=True):
        squares = lambda g: sum(n * n for n in np.bincount([x for x in g if 0 < x < 100] or [0], minlength=101)[1:])
        fitting = {g for g in gaps if g >= s}
        if fitting:
            costs = {}
            for g in fitting:
                left = gaps.copy()
                left[left.index(g)] -= s
                costs[g] = squares(left)
            assert costs[100 - o] == min(costs.values())
        else:
            gaps.append(100)
        assert gaps[b] == 100 - o
        gaps[b] -= s


def test_sequences_hold_the_tokens_in_place(spark):
    docs = spark.createDataFrame([(n, prose(n, 50 + n)) for n in range(60)], "doc_id long, text string")
    pieces = packing.pieces(docs)
    packed = packing.pack(pieces.checkpoint())
    ids = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert ids[r.sequence_id][r.offset : r.offset + r.length].tobytes() == bytes(r.ids)
