"""Nearest labelled examples: exact neighbours against all cosines, whole results recomputed, held-out accuracy."""

import math
from zlib import crc32

import numpy as np
import pytest

from motionloom.llm import toxicity

SF = "/root/testdata/sf0.01"


def fold(doc_id):
    return crc32(str(doc_id).encode()) % 3


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    outside = [r.doc_id for r in docs.select("doc_id").collect() if fold(r.doc_id) != 1]
    kept = docs.join(spark.createDataFrame([(i,) for i in outside], "doc_id long"), "doc_id", "left_semi")
    return docs, labels, toxicity.fit(kept, labels)


def cosines(index, counts):
    """All cosines over 0, by plain dictionaries; nearest first, ties by example."""
    n = len(index.rows)
    df = {t: sum(t in row for row in index.rows) for t in counts}

    def unit(row):
        w = {t: (1 + math.log(c)) * (math.log((n + 1) / (sum(t in r for r in index.rows) + 1)) + 1) for t, c in row.items()}
        size = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / size for t, v in w.items()}

    assert all(df.values()) or not counts
    mine = unit(counts)
    found = [(sum(v * other.get(t, 0.0) for t, v in mine.items()), i) for i, other in enumerate(map(unit, index.rows)) if other]
    return sorted([(-c, i) for c, i in found if c > 0])


def test_neighbours_are_the_nearest_of_all_examples():
    rng = np.random.default_rng(5)
    rows = [{int(t): int(rng.integers(1, 5)) for t in rng.choice(30, rng.integers(0, 6), replace=False)} for _ in range(150)] + [{3: 1}] * 9
    labels = rng.integers(0, 2, len(rows))
    index = toxicity.Index({str(n): n for n in range(30)}, rows, labels, list(range(len(rows))), 0.2, block=8)
    for row in rows[:60] + [{}, {1: 9}, {3: 1}, {2: 1, 29: 3}]:
        want = cosines(index, row)[:16]
        got = index.nearest(*index.vector(row))
        assert [c for c, _ in got] == pytest.approx([-c for c, _ in want]) and len(got) == len(want)
        near = {round(-c, 9) for c, _ in want}
        last = min((-c for c, _ in want), default=0)
        assert [i for c, i in got if c > last + 1e-9] == pytest.approx([i for c, i in want if -c > last + 1e-9]) or len(near) < len(want)
        assert not row or index.nearest(*index.vector(row), k=len(rows))[-1][0] == pytest.approx(-cosines(index, row)[-1][0])


def test_whole_result_follows_from_the_index(fitted):
    docs, labels, index = fitted
    known = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    content = {}
    for i, t in texts.items():
        if fold(i) != 1 and known.get(i) is not None:
            content.setdefault(t or "", []).append((known[i], i))
    assert sorted(index.doc_ids) == sorted(min(i for _, i in v) for v in content.values())  # fewer than the bound: all of them
    assert index.share == pytest.approx(np.mean([np.mean([y for y, _ in v]) >= 0.5 for v in content.values()]))
    reader = toxicity.Reader(index.terms)
    rows = toxicity.op12_scores(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    units = [dict(zip(*map(np.ndarray.tolist, index.vector(row)), strict=True)) for row in index.rows]
    for r in rows[::7]:
        mine = dict(zip(*map(np.ndarray.tolist, index.vector(reader.counts(texts[r.doc_id] or ""))), strict=True))
        near = sorted((-sum(v * u.get(t, 0.0) for t, v in mine.items()), i) for i, u in enumerate(units))
        near = [(-c, i) for c, i in near if c < 0][: toxicity.NEIGHBOURS]
        total = toxicity.PRIOR + sum(index.rates[index.labels[i]] / (1.1 - min(c, 1.0)) for c, i in near)
        toxic = toxicity.PRIOR * index.share + sum(index.rates[1] / (1.1 - min(c, 1.0)) for c, i in near if index.labels[i])
        assert r.held_out == (fold(r.doc_id) == 1) and r.predicted == int(r.score >= 0.7)
        assert r.score == pytest.approx(float(np.interp(toxic / total, index.votes, index.levels)), abs=1e-6)


def test_held_out_rows(fitted):
    docs, labels, _ = fitted
    known = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(known[r.doc_id], r.score, r.predicted) for r in toxicity.op12_scores(docs, labels).collect() if r.held_out and known.get(r.doc_id) is not None]
    assert np.mean([y == p for y, _, p in held]) > 0.94  # some 40 toxic examples teach here
    assert np.mean([p for y, _, p in held if y]) > 0.7 and np.mean([p for y, _, p in held if not y]) < 0.02
    assert abs(np.mean([s for _, s, _ in held]) - np.mean([y for y, _, _ in held])) < 0.05


def test_bound_on_examples_and_copies(spark):
    """Copies are one example, of any number; a bound below the number of texts is kept for each label."""
    rows = [(n, "vile text") for n in range(300)] + [(1000 + n, f"word{'abcdefghij'[n % 10]} plain{n}") for n in range(60)] + [(2000 + n, f"vile thing{'abcdefghij'[n % 10]}") for n in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("vile" in t)) for i, t in rows] + [(0, None), (5, 7)], "doc_id long, toxic int")
    chosen, counts = toxicity.examples(docs, labels, most=20)
    got = chosen.collect()
    assert counts == {0: 60, 1: 11} and sum(r.label == 0 for r in got) == 20 and sum(r.label == 1 for r in got) == 11
    assert [r.doc_id for r in got if r.text == "vile text"] == [0]


def test_words_have_the_terms_that_are_kept():
    words = ["aber", "abe", "ab", "a", "überaus", "überau", "aberglaube", "zzz", "ber", "laus"]
    terms = {t: n for n, t in enumerate(t for w in words[::2] for t in toxicity.word_terms(w.encode()))}
    terms = {t: n for n, t in enumerate(sorted(terms)) if n % 3 or t == "=a"}
    reader = toxicity.Reader(terms)
    for w in words:
        assert sorted(reader.counts(w)) == sorted(terms[t] for t in set(toxicity.word_terms(w.encode())) if t in terms)


def test_no_labels_and_one_label(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    for rows in ([], [(1, 0), (2, 0)]):
        out = toxicity.op12_scores(docs, spark.createDataFrame(rows, "doc_id long, toxic int")).collect()
        assert len(out) == 3 and all(r.score == 0 and r.predicted == 0 and r.neighbours == [] for r in out)


def test_long_texts_and_other_scripts(spark):
    docs = spark.createDataFrame([(1, "scum " * 300000), (2, "中文" * 100000), (3, "É" * 50)], "doc_id long, text string")
    assert toxicity.word_terms("é".encode() * 4) == ["=éééé", "^ééé", "$ééé"]
    assert len(toxicity.op12_scores(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")).collect()) == 3
