"""Language of each word and text, from a linear-chain conditional random field.

Method: a chain over all runs of letters of a text, in training and in scoring alike; runs of over
`PIECE` bytes, as in scripts without blanks, are cut into consecutive pieces. The weights of a word (a
run or piece) come from hashed features: prefixes and suffixes, character n-grams and lexicon entries; transitions between the languages of
neighbouring words are learned with them. Forward-backward gives every word's marginal, also in texts
that switch language; a text's language is the one with the largest mean marginal, and that mean is
its score.

Learning: about `docs_per_language` labelled documents of each language (whole texts, drawn by a hash
of the id, together no more than `FIT_BYTES` a language, of the `LANGUAGES` most frequent label values:
documented bounds on what the classifier is fitted on) train the field by full-batch Adam. Their words are cut into spans, and spans of different languages follow one another in the
training chains, so that transitions see switches. The lexicon holds words typical of one language
in that sample. The fitted weights have a fixed size; every text is scored, whole, where it lies.

Edge cases: a null text and one without any letter are `und` with score 0; so is all if nothing can be
learned. Repeated rows are scored alike; a null id is a text like any other; labels that are null
teach nothing; an empty table gives an empty result. Ties go to the first language in order. Numbers
and signs (½, ², 一 is a letter) are no letters. A very long text is one chain, scored whole. Extra
columns are ignored by `predict` and kept by `accepted`, whatever their names.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import fold, ready, release

UNKNOWN = "und"
SLOT_BITS = 15
SLOTS = 1 << SLOT_BITS
CHAIN = 64
LETTERS = re.compile(r"[^\W\d_]+")
PIECE = 64
#: Words a worker keeps with their weights; when it is full, only those of the texts at hand stay.
CACHED_WORDS = 150_000
#: Characters of texts that a task splits into words at a time, unless one text has more.
PART_CHARS = 1 << 20
LANGUAGES, FIT_BYTES = 256, 4 << 20


@cache
def numbers() -> frozenset[str]:
    """Word characters that count and are neither letters nor digits: ½ ² ① Ⅷ."""
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha())


def runs(text: str) -> list[str]:
    """All lower-case runs of letters of a text in order, long ones in pieces of up to PIECE bytes."""
    text = text.lower()
    if not text.isascii() and not numbers().isdisjoint(text):
        text = text.translate(dict.fromkeys(map(ord, numbers().intersection(text)), " "))
    found = LETTERS.findall(text)
    if all(len(run) <= PIECE // 4 for run in found):
        return found
    return [piece for run in found for piece in ([run] if len(run) <= PIECE // 4 else pieces(run))]


def pieces(run: str) -> list[str]:
    raw, found, at = run.encode(), [], 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and raw[end] & 0xC0 == 0x80:  # inside a code point
            end -= 1
        found.append(raw[at:end].decode())
        at = end
    return found


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the features of lower-case words, word after word, and how many each word has: affixes, n-grams of the word
    with its edges, and its lexicon entry with its language. All words are worked on at once."""
    raws = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    letters = np.frombuffer(b"".join([b"^%b$" % raw for raw in raws]) + bytes(3), np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    which, slots = [], []

    def add(kind: int, words_: np.ndarray, values: np.ndarray) -> None:
        mixed = (values * np.uint64(8) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        which.append(words_)
        slots.append((mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64))

    def run(at: np.ndarray, k: int) -> np.ndarray:
        """The k letters from each place on as one number, which tells runs of other lengths apart."""
        value = np.full(len(at), k, np.uint64)
        for i in range(k):
            value = value << np.uint64(8) | letters[at + i]
        return value

    for k in range(1, 5):
        long = np.flatnonzero(sizes >= k)
        if k <= 3:
            add(1, long, run(starts[long] + 1, k))
        add(2, long, run(starts[long] + 1 + sizes[long] - k, k))
    owner = np.repeat(np.arange(len(raws)), sizes + 2)
    inside = np.arange(len(owner)) - starts[owner]
    for k, kind in ((2, 3), (3, 4)):
        at = np.flatnonzero(inside <= sizes[owner] + 2 - k)
        add(kind, owner[at], run(at, k))
    known = np.array([n for n, w in enumerate(words) if w in lexicon], np.int64)
    add(5, known, np.array([lexicon[words[n]] for n in known], np.uint64))
    add(6, known, np.array([crc32(raws[n]) for n in known], np.uint64))
    all_words = np.concatenate(which)
    order = np.argsort(all_words, kind="stable")
    return np.concatenate(slots)[order], np.bincount(all_words, minlength=len(raws))


class Field:
    """Weights of a fitted field: emissions (SLOTS x K), transitions (K x K), start (K)."""

    def __init__(self, languages: list[str], lexicon: dict[str, int]):
        self.languages, self.lexicon = languages, lexicon
        k = len(languages)
        self.emit = np.zeros((SLOTS, k), np.float32)
        self.move = np.zeros((k, k), np.float32)
        self.start = np.zeros(k, np.float32)

    def slots(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return features(words, self.lexicon)

    def emissions(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Mean of the weights of each word's features, times their number's root."""
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        return np.add.reduceat(self.emit[flat], starts, axis=0) / np.sqrt(counts)[:, None].astype(np.float32)

    def marginals(self, weights: np.ndarray, active: np.ndarray, pairs: bool = False):
        """Marginals (T, B, K) of chains whose emissions are (T, B, K); chain b has weights in the first rows: active[t]
        chains, the longest first, are that long. With pairs, also the expected transitions."""
        move, k = np.exp(self.move - self.move.max()), weights.shape[2]
        local = np.exp(weights - weights.max(axis=2, keepdims=True))
        ahead = np.zeros_like(local)  # also beyond a chain's end
        ahead[0] = np.exp(self.start - self.start.max()) * local[0]
        ahead[0] /= ahead[0].sum(axis=1, keepdims=True)
        steps = len(local)
        for t in range(1, steps):
            n = active[t]
            now = (ahead[t - 1, :n] @ move) * local[t, :n]
            ahead[t, :n] = now / now.sum(axis=1, keepdims=True)
        behind = np.ones_like(local)
        expected = np.zeros((k, k))
        for t in range(steps - 2, -1, -1):
            n = active[t + 1]
            later = local[t + 1, :n] * behind[t + 1, :n]
            back = later @ move.T
            scale = back.sum(axis=1, keepdims=True)
            behind[t, :n] = back / scale
            if pairs:
                norm = (ahead[t, :n] * back).sum(axis=1, keepdims=True)
                expected += (ahead[t, :n] / norm).T @ later
        both = ahead * behind
        sums = both.sum(axis=2, keepdims=True)
        both /= np.where(sums > 0, sums, 1)
        return (both, expected * move) if pairs else both


def train(samples: list[tuple[str, str]], languages: list[str], rounds: int = 30, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Fits a field to (language, text) pairs."""
    rng = np.random.default_rng(7)
    code = {language: n for n, language in enumerate(languages)}
    vocabulary: dict[str, int] = {}
    spans, counts = [], [Counter() for _ in languages]
    for language, text in samples:
        words = runs(text)
        counts[code[language]].update(set(words))
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        at = 0
        while at < len(ids):
            size = int(rng.integers(6, 48))
            spans.append((code[language], ids[at : at + size]))
            at += size
    docs = Counter(language for language, _ in samples)
    lexicon = {}
    for n, language in enumerate(languages):
        for word, c in counts[n].items():
            others = max((counts[m][word] / max(1, docs[x]) for m, x in enumerate(languages) if m != n), default=0)
            if c >= max(3, 0.03 * docs[language]) and c / docs[language] > 4 * others:
                lexicon[word] = n
    field = Field(languages, lexicon)
    words, labels = [], []
    for s in rng.permutation(len(spans)):
        words += spans[s][1]
        labels += [spans[s][0]] * len(spans[s][1])
    chains = len(words) // CHAIN
    if not chains:  # too little for one chain: repeat it
        words, labels, chains = (words * CHAIN)[:CHAIN], (labels * CHAIN)[:CHAIN], int(bool(words))
    if not chains or len(languages) < 2:
        return field
    w = np.array(words[: chains * CHAIN]).reshape(chains, CHAIN).T
    y = np.array(labels[: chains * CHAIN]).reshape(chains, CHAIN).T
    flat, sizes = field.slots(list(vocabulary))
    k, v, total = len(languages), len(vocabulary), w.size
    owner, root = np.repeat(np.arange(v), sizes), np.sqrt(sizes)
    active = np.full(CHAIN, chains)
    gold_move = np.bincount((y[:-1] * k + y[1:]).ravel(), minlength=k * k).reshape(k, k)
    gold_start = np.bincount(y[0], minlength=k)
    parameters = [field.emit, field.move, field.start]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    per_word = np.bincount(w.ravel(), minlength=v)
    gold = np.bincount(w.ravel() * k + y.ravel(), minlength=v * k).reshape(v, k)
    for step in range(1, rounds + 1):
        emissions = field.emissions(flat, sizes)
        seen, moved = field.marginals(emissions[w], active, pairs=True)
        gap = np.empty((v, k))
        for j in range(k):
            gap[:, j] = (gold[:, j] - np.bincount(w.ravel(), weights=seen[:, :, j].ravel(), minlength=v)) / root
        emit = np.column_stack([np.bincount(flat, weights=gap[owner, j], minlength=SLOTS) for j in range(k)])
        gradients = [emit, gold_move - moved, gold_start - seen[0].sum(axis=0)]
        for p, g, m, s in zip(parameters, gradients, first, second, strict=True):
            g = g / total - decay * p / 100
            m += 0.1 * (g - m)
            s += 0.02 * (g * g - s)
            p += (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-10)).astype(np.float32)
    assert per_word.sum() == total
    return field


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 250) -> Field:
    """Fits on about `docs_per_language` of the given documents of each language, drawn by a hash of id and text."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    rate = F.broadcast(most.select("lang", (F.lit(float(docs_per_language)) / F.col("n")).alias("rate")))  # a row a language
    draw = F.xxhash64("doc_id", F.length("text"))
    drawn = rows.join(rate, "lang").where(F.pmod(draw, F.lit(1 << 20)) / (1 << 20) < F.col("rate"))
    so_far = F.sum(F.length(F.col("text").cast("binary"))).over(Window.partitionBy("lang").orderBy(draw, "text").rowsBetween(Window.unboundedPreceding, 0))
    before = so_far - F.length(F.col("text").cast("binary"))  # the text that passes the bound is the last one, and is cut to it
    sample = drawn.withColumn("before", before).where(F.col("before") < FIT_BYTES).select("lang", F.substr("text", F.lit(1), F.lit(FIT_BYTES) - F.col("before")).alias("text")).collect()
    pairs = sorted((r["lang"], r["text"]) for r in sample)
    return train(pairs, sorted({p[0] for p in pairs}))


class Tagger:
    """Scores texts by a field; keeps the emissions of words it has met."""

    def __init__(self, field: Field):
        self.field = field
        self._empty()

    def _empty(self, but: list[str] = ()) -> None:
        rows = self.table[[self.known[w] for w in but]] if but else None
        self.known: dict[str, int] = dict(zip(but, range(len(but)), strict=True))
        self.table = np.zeros((max(1 << 14, len(but)), len(self.field.languages)), np.float32)
        self.used = len(but)
        if but:
            self.table[: len(but)] = rows

    def _learn(self, words: set[str]) -> None:
        """Makes all of `words` known."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS:
            self._empty([w for w in words if w in self.known])
        if not new:
            return
        rows = self.field.emissions(*self.field.slots(new))
        if self.used + len(new) > len(self.table):
            more = np.zeros((max(len(self.table), len(new)), self.table.shape[1]), np.float32)
            self.table = np.concatenate((self.table, more))
        self.table[self.used : self.used + len(new)] = rows
        self.known.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def shares(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Mean marginal of each language per text; None if no word has a letter."""
        split = [runs(t or "") for t in texts]
        self._learn(set().union(*split))
        found: list[np.ndarray | None] = [None] * len(texts)
        ids = [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in split]
        order = sorted((n for n in range(len(texts)) if len(ids[n])), key=lambda n: -len(ids[n]))
        at = 0
        while at < len(order):
            longest = len(ids[order[at]])
            part = order[at : at + max(1, (1 << 17) // longest)]
            lengths = np.array([len(ids[n]) for n in part])
            chain = np.zeros((longest, len(part)), np.int64)
            for b, n in enumerate(part):
                chain[: lengths[b], b] = ids[n]
            active = (lengths[None, :] > np.arange(longest)[:, None]).sum(axis=1)
            seen = self.field.marginals(self.table[chain], active)
            seen *= (lengths[None, :] > np.arange(longest)[:, None])[:, :, None]
            for b, n in enumerate(part):
                found[n] = seen[:, b].sum(axis=0, dtype=np.float64) / lengths[b]
            at += len(part)
        return found

    def words(self, text: str) -> list[tuple[str, str]]:
        """(word, language) of each run of letters: the tagging of one text."""
        tokens = runs(text)
        if not tokens:
            return []
        self._learn(set(tokens))
        rows = self.table[[self.known[t] for t in tokens]][:, None, :]
        best = self.field.marginals(rows, np.ones(len(tokens), int)).argmax(axis=2)[:, 0]
        return [(t, self.field.languages[b]) for t, b in zip(tokens, best, strict=True)]


def parts(column: pa.Array) -> Iterator[list[str | None]]:
    """Texts of a column, few at a time."""
    held, size = [], 0
    for value in column:
        held.append(value.as_py())
        size += len(held[-1] or "")
        if size > PART_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def predict(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, outputs: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """doc_id, lang_pred, score of every row; `keep` names columns to carry along instead of doc_id alone, `outputs` the
    two new columns."""
    ready(docs.sparkSession)
    keep = keep or [id_col]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema += f", `{outputs[0]}` string, `{outputs[1]}` double"
    inside = [F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)]  # any name may be a column's
    names = [*keep, *outputs]

    def each(batches):
        tagger = Tagger(field)
        for batch in batches:
            shares = [s for texts in parts(batch.column(len(keep))) for s in (tagger.shares(texts) if field.languages else [None] * len(texts))]
            langs = [UNKNOWN if s is None else field.languages[int(s.argmax())] for s in shares]
            scores = [0.0 if s is None else min(1.0, float(s.max())) for s in shares]
            arrays = [*(batch.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names)
        tagger = None
        release()

    return docs.select(*inside, F.col(text_col).alias("text")).mapInArrow(each, schema)


def accepted(docs: DataFrame, field: Field, least_share: float = 0.4) -> DataFrame:
    """The rows of docs, with their columns, whose text has a language: not `und`, and a mean marginal of at least
    `least_share`. Without any learned language, those whose text has a letter."""
    if not field.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    inside = [f"c{n}" for n in range(len(docs.columns))]  # names that no output has
    text = inside[docs.columns.index("text")]
    marked = predict(docs.toDF(*inside), field, text_col=text, keep=inside)
    return marked.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_share)).select(*inside).toDF(*docs.columns)


def op10_languages(docs: DataFrame) -> DataFrame:
    held_out = fold(F.col("doc_id"), 4) == 2
    field = fit(docs.where(~held_out))
    return predict(docs, field).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
