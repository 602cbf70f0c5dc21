"""The trained operators: held-out accuracy, exact base scores, probabilities that sum to one."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from corpus import prose

from motionloom.llm import langid, lm_score, quality

SF = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return crc32(str(doc_id).encode()) % n


def test_quality_is_right_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.op1_scores(docs, labels).collect()
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(known[r.doc_id], r.score) for r in rows if r.held_out and known.get(r.doc_id) is not None]
    good, bad = [s for y, s in held if y == 1], [s for y, s in held if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    accuracy = np.mean([(s >= 0.3) == (y == 1) for y, s in held])
    assert auc > 0.85 and accuracy > 0.8


def test_quality_scores_are_mahalanobis_differences():
    rng = np.random.default_rng(1)
    rows = {k: rng.normal(k, 1 + k, (300, 3)) for k in (0, 1)}
    model = quality.Discriminant({k: (300, r.sum(axis=0), r.T @ r) for k, r in rows.items()}, 0.0, 1e-9)
    x = rng.normal(0.5, 1, (5, 3))

    def log_density(k):
        mean, cov = rows[k].mean(axis=0), np.cov(rows[k].T, bias=True)
        return -0.5 * np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean) - 0.5 * np.log(np.linalg.det(cov))

    assert model.score(x) == pytest.approx(1 / (1 + np.exp(log_density(0) - log_density(1))), rel=1e-4)
    assert quality.Discriminant({}).score(x).tolist() == [0.5] * 5


def test_language_is_right_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id: (r.lang, r.text) for r in docs.select("doc_id", "lang", "text").collect()}
    rows = langid.op10_languages(docs).collect()
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [(known[r.doc_id][0], r.lang_pred) for r in rows if r.held_out and known[r.doc_id][0] and any(c.isalpha() for c in known[r.doc_id][1] or "")]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in known[r.doc_id][1] or "")) for r in rows)


def test_switched_texts_are_tagged_word_by_word():
    de = ["der hund läuft schnell und die katze schläft nicht weil das haus groß ist"] * 6
    en = ["the dog runs quickly and the cat does not sleep because this house is big"] * 6
    field = langid.train([("de", t) for t in de] + [("en", t) for t in en], ["de", "en"])
    got = langid.Tagger(field).words("der hund schläft nicht the cat does not sleep")
    assert [x for _, x in got] == ["de"] * 4 + ["en"] * 5


def test_every_run_of_letters_is_scored_whole():
    de = ["der hund läuft schnell und die katze schläft nicht weil das haus groß ist"] * 6
    en = ["the dog runs quickly and the cat does not sleep because this house is big"] * 6
    zh = ["".join(chr(0x4E00 + (7 * n + m) % 300) for n in range(90)) for m in range(6)]
    pairs = [(k, t) for k, ts in (("de", de), ("en", en), ("zh", zh)) for t in ts]
    tagger = langid.Tagger(langid.train(pairs, ["de", "en", "zh"]))
    blanks = "der hund schläft nicht the cat does not sleep"
    joined = blanks.replace(" ", "_", 3).replace(" ", "/")
    assert tagger.words(joined) == tagger.words(blanks)  # no run of a token is left out
    plain, other = tagger.shares([blanks, joined])
    assert plain == pytest.approx(other, rel=1e-5)
    long = "".join(zh) * 10
    assert "".join(langid.runs(long)) == long and max(len(x.encode()) for x in langid.runs(long)) <= langid.PIECE
    words = tagger.words(long[:30] + "".join(en[0].split()) * 5 + long)  # one run: what stands behind its start counts
    assert len(words) > 200 and sum(x == "zh" for _, x in words) > 200
    assert langid.runs("x" * 65 + "1ab") == ["x" * 64, "x", "ab"]
    assert langid.runs("½ ² ① 12 _ Ⅷ") == [] and langid.runs("a½b x² 中一") == ["a", "b", "x", "中一"]
    assert langid.Tagger(langid.train(pairs, ["de", "en", "zh"])).shares(["½ ² ①", "12"]) == [None, None]


def test_small_caches_change_nothing(monkeypatch):
    pairs = [("de", prose(1, 300)), ("en", "the dog runs and the cat sleeps in this house " * 9)]
    field = langid.train(pairs, ["de", "en"])
    texts = [prose(n, 40 + n) for n in range(30)]
    whole = langid.Tagger(field).shares(texts)
    monkeypatch.setattr(langid, "CACHED_WORDS", 20)
    small = langid.Tagger(field)
    for n in range(0, 30, 3):
        assert all(a == pytest.approx(b, rel=1e-5) for a, b in zip(small.shares(texts[n : n + 3]), whole[n : n + 3], strict=True))


def test_marginals_agree_with_all_paths():
    from itertools import product

    rng = np.random.default_rng(4)
    field = langid.Field(["a", "b", "c"], {})
    field.move, field.start = rng.normal(size=(3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32)
    weights = rng.normal(size=(4, 1, 3)).astype(np.float32)
    total, want = 0.0, np.zeros((4, 3))
    for path in product(range(3), repeat=4):
        p = math.exp(field.start[path[0]] + sum(weights[t, 0, k] for t, k in enumerate(path)) + sum(field.move[i, j] for i, j in zip(path, path[1:], strict=False)))
        total += p
        for t, k in enumerate(path):
            want[t, k] += p
    assert field.marginals(weights, np.ones(4, int))[:, 0] == pytest.approx(want / total, rel=1e-4)


def test_chains_of_other_lengths_beside_it_change_no_text():
    pairs = [("de", "der hund läuft und die katze schläft im haus"), ("en", "the dog runs and the cat sleeps in this house")]
    field = langid.train(pairs * 5, ["de", "en"])
    texts = ["the dog", "der hund und die katze " * 40, "the cat sleeps in this house " * 200, None, "haus"]
    together = langid.Tagger(field).shares(texts)
    for text, shares in zip(texts, together, strict=True):
        (alone,) = langid.Tagger(field).shares([text])
        assert (alone is None) == (shares is None) == (text is None)
        if text:
            assert np.isfinite(shares).all() and shares == pytest.approx(alone, rel=1e-5) and shares.sum() == pytest.approx(1, abs=1e-4)


def test_base_scores_and_counts_are_exact(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(lm_score, "HEAD", 6000)  # so that words beyond the head occur
    monkeypatch.setattr(lm_score, "BANDS", (5000, 6000))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: lm_score.tokens(r.text or "") for r in docs.select("doc_id", "text").collect()}
    counts = Counter(t for i, ts in texts.items() if fold(i, 10) for t in [*ts, b"\n"])
    n, v = sum(counts.values()), len(counts)
    assert v > 6000
    rows = lm_score.op9_scores(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ts = [*texts[r.doc_id], b"\n"]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (fold(r.doc_id, 10) == 0, len(ts), n)
        assert r.n_known == sum(counts[t] > 0 for t in ts)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), rel=1e-9)
        assert r.score < 0


def test_recurrent_model_beats_the_base_on_held_out_rows(spark):
    rows = [r for r in lm_score.op9_scores(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_outputs_are_a_distribution_and_state_is_carried():
    model = lm_score.Gru()
    states = np.random.default_rng(1).normal(size=(2, lm_score.HIDDEN)).astype(np.float32)
    for s in states:
        every = model.output(np.repeat(s[None], lm_score.SYMBOLS, axis=0), np.arange(lm_score.SYMBOLS))
        assert np.exp(every.astype(float)).sum() == pytest.approx(1, abs=1e-3)
    text = np.array([*np.random.default_rng(2).integers(1, 500, 3 * lm_score.WINDOW + 5), 0])
    both = model.scores([text, text[-20:]])
    state, want = np.zeros((1, lm_score.HIDDEN), np.float32), 0.0
    for before, symbol in zip([0, *text[:-1]], text, strict=True):
        entered = model.w["embed"][[before]] @ model.w["enter"] + model.w["enter_bias"]
        state = model.step(entered, state, model.w["gates"], model.w["candidate"])[0]
        want += float(model.output(state, np.array([symbol]))[0])
    assert both[0] == pytest.approx(want, rel=1e-4)


def test_learning_follows_the_gradient(monkeypatch):
    monkeypatch.setattr(lm_score, "STREAMS", 4)
    rng = np.random.default_rng(0)
    stream = np.tile(rng.integers(0, 30, 40), 200)
    model = lm_score.Gru(64)
    before = model.scores([stream[:200]])[0]
    model.learn(stream)
    assert model.scores([stream[:200]])[0] > before + 50


def test_every_training_document_reaches_the_model(spark):
    assert lm_score.ROUNDS == lm_score.SHARE  # the shares of the rounds are all there are
    rows = spark.createDataFrame([(n, f"word{n} stays here") for n in range(60)], "doc_id long, text string").repartition(3)
    words = lm_score.vocabulary(lm_score.token_counts(rows))
    before, after = lm_score.Gru(len(words.words)).w, lm_score.train(lm_score.coded(rows, words), len(words.words)).w
    at = {w: n for n, w in enumerate(words.words)}
    moved = [not np.array_equal(before["embed"][at[f"word{n}"]], after["embed"][at[f"word{n}"]]) for n in range(60)]
    assert all(moved)  # as an input, each word is in one document alone


def test_few_tokens_and_remainders_teach():
    for n in (1, 7, lm_score.STREAMS + 1, 5 * lm_score.STREAMS * lm_score.WINDOW + 3):
        one, other = lm_score.Gru(64), lm_score.Gru(64)
        assert one.learn(np.array([5] * (n - 1) + [9])) == other.learn(np.array([5] * n)) == n
        assert not np.array_equal(one.flat(), other.flat())  # the last token counts


def test_prose_helper_is_stable():
    assert prose(1, 5) == prose(1, 5)


def test_a_language_whose_first_text_is_over_the_bound_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "FIT_BYTES", 2000)
    es, en = "el perro corre por la calle y la gata duerme en la casa ", "the dog runs along the street while the cat sleeps in a house "
    rows = [(n, en * 3, "en") for n in range(10)] + [(100, es * 200, "es"), (101, es * 300, "es")]
    field = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(field.languages) == ["en", "es"]


ODD_WORDS = ["", None, "  a  b ", "A\tB\nC\x0bD\x0cE\rF\x1cG\x1d \x85 \xa0 É ÄÖ Ünï　x y", "\n\n", " ", "x\x00y Z", "İI K"]


@pytest.mark.parametrize("skipped", [0, 3])
def test_words_of_a_column_are_those_of_its_texts(skipped):
    words, sizes = lm_score.words_of(pa.array(ODD_WORDS, pa.string()).slice(skipped))
    told = [lm_score.tokens(t or "") for t in ODD_WORDS[skipped:]]
    assert [w.encode() for w in words.to_pylist()] == [w for t in told for w in t] and sizes.tolist() == [len(t) for t in told]


def test_lanes_and_cached_rows_change_no_score(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [np.append(rng.integers(1, lm_score.SYMBOLS, n), 0) for n in (0, 1, 31, 32, 33, 64, 200, 5, 5)]
    model = lm_score.Gru()
    alone = [model.scores([t])[0] for t in texts]
    for name, value in (("LANES", 2), ("CACHED_ROWS", 7), ("ROWS", 40)):
        monkeypatch.setattr(lm_score, name, value)
        assert model.scores(texts) == pytest.approx(alone, rel=1e-5)
    assert model.scores([]).tolist() == []


def test_gradients_agree_with_differences():
    """Of the outputs: each kind of weight, and a state."""
    rng = np.random.default_rng(6)
    states = np.tanh(rng.normal(size=(50, lm_score.HIDDEN))).astype(np.float32)
    targets = rng.choice([0, 3, 70, lm_score.OWN - 1, lm_score.OWN, lm_score.SYMBOLS - 1], 50)
    model = lm_score.Gru()
    found, back, grads = model.output(states, targets, learn=True)
    assert found == pytest.approx(model.output(states, targets), rel=1e-6)
    loss = lambda: -model.output(states, targets).astype(float).sum()
    for name, at in (("classes", (2, 1)), ("class_bias", (0, 0)), ("words", (70, 4)), ("word_bias", (3, 0))):
        kept = model.w[name][at]
        model.w[name][at] = kept + 1e-2
        high = loss()
        model.w[name][at] = kept - 1e-2
        assert grads[name][at] == pytest.approx((high - loss()) / 2e-2, rel=2e-2, abs=2e-3)
        model.w[name][at] = kept
    moved = np.zeros_like(states)
    moved[7, 3] = 1e-2
    high, low = (-model.output(states + m, targets).astype(float).sum() for m in (moved, -moved))
    assert back[7, 3] == pytest.approx((high - low) / 2e-2, rel=2e-2, abs=2e-3)


def test_words_are_counted_and_coded_alike_in_small_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(n, f"one two{n % 3} {'long' * n} A a\n") for n in range(12)] + [(99, None)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(lm_score, "HEAD", 3)  # so that words beyond the head occur

    def found():
        counts = lm_score.token_counts(rows)
        told = lm_score.coded(rows, lm_score.vocabulary(counts)).collect()
        return sorted(counts.collect()), [(r.doc_id, r.n_tokens, r.n_known, r.base, r.band, bytes(r.symbols), sorted(r.rare)) for r in told]

    whole = found()
    for name in ("COUNT_BYTES", "LOOK_UP_BYTES"):
        monkeypatch.setattr(lm_score, name, 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert found() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
