"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Method: examples are documents with a label. Terms are words and their beginnings and ends (3 to 6 characters), those
kept whose presence and the label depend on each other most (chi-squared over the examples), stop words left out. A document's vector has
(1 + ln tf) * idf in each kept term, at unit length. The examples' postings lie in blocks of `BLOCK` examples with like
terms; each block knows every term's largest weight. A search bounds all blocks at once, takes them by falling bound and
stops where the bound of the next is under the k-th best cosine so far: the k nearest are exact. Neighbours vote with
weights that fall with their distance, each class at its share among labelled documents; votes become scores by the
shares of toxic examples at like votes when each example is scored by the others (leave one out). The neighbours are the
evidence of a score.

On Spark: the sample of examples is bounded (`EXAMPLES` of each label, by the hash of the text, equal texts once), so
the index is as well: at most 2 * EXAMPLES rows of at most `TERMS` terms; it goes to tasks by broadcast. Terms of
examples are counted and ranked by Spark; whole texts are scored where they lie, without any shuffle.

Edge cases: a null or empty text, and one without kept terms, has no neighbour and gets the score of examples without
any; a label other than 0 and 1 is none; several labels of a document count by their mean (toxic from one half on), as
do labels of equal texts; without labels all scores are 0, without toxic examples as well. Ties in cosine go to the
example that comes first (smaller hash of its text). Repeated rows get equal scores; a null id is kept, in the fold of
the empty text. Very long texts are read whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, fold, ready, release, texts_of
from .divergence import TERM_BYTES

EXAMPLES = 4096
TERMS = 4096
LEAST_DOCS = 4
LEAST_CHI = 25.0
#: Terms of more than this share of the examples are stop words.
MOST_SHARE = 0.25
BLOCK = 64
FIRST_BLOCKS = 4
NEIGHBOURS = 16
#: Length of beginnings and ends of words that are terms.
SHORTEST, LONGEST = 3, 6
#: Added to a distance before it divides, and the weight of the prior beside the votes.
SOFT = 0.1
PRIOR = 0.5
#: Words a worker keeps with their terms.
CACHED_WORDS = 500_000
CACHED_ANSWERS = 20_000


def word_terms(word: bytes) -> list[str]:
    """The word, its beginnings and its ends."""
    text = word.decode("utf-8", "ignore")
    sizes = range(SHORTEST, min(LONGEST, len(text) - 1) + 1)
    return [f"={text}", *[f"^{text[:n]}" for n in sizes], *[f"${text[-n:]}" for n in sizes]]


def words_of(text: str) -> Counter:
    return Counter(text.encode().translate(TERM_BYTES).split())


class Reader:
    """Counts of kept terms in a text; words are looked up once and kept."""

    def __init__(self, terms: dict[str, int]):
        self.terms, self.known = terms, {}
        # what a word must begin or end with to have a kept term
        self.heads = {t[1 : 1 + SHORTEST] for t in terms if t[0] in "=^"}
        self.tails = {t[-SHORTEST:] for t in terms if t[0] == "$"}

    def counts(self, text: str) -> dict[int, int]:
        known, found = self.known, {}
        for word, n in words_of(text).items():
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self._ids(word)
            for i in ids:
                found[i] = found.get(i, 0) + n
        if len(known) > CACHED_WORDS:
            self.known = {}
        return found

    def _ids(self, word: bytes) -> tuple[int, ...]:
        text = word.decode("utf-8", "ignore")
        if text[:SHORTEST] not in self.heads and text[-SHORTEST:] not in self.tails:
            return ()
        return tuple([i for t in word_terms(word) if (i := self.terms.get(t)) is not None])


@dataclass
class Index:
    """Examples as unit vectors in blocks. rows: of each example, counts by term; labels 0 or 1; share: of label 1 among labelled documents."""

    terms: dict[str, int]
    rows: list[dict[int, int]]
    labels: np.ndarray
    doc_ids: list
    share: float
    block: int = BLOCK
    idf: np.ndarray = field(init=False)

    def __post_init__(self):
        df = np.zeros(len(self.terms))
        for row in self.rows:
            df[list(row)] += 1
        self.idf = np.log((len(self.rows) + 1) / (df + 1)) + 1
        vectors = [self.vector(row) for row in self.rows]
        # like examples into one block: by their heaviest term, then by the next
        heaviest = [tuple(ids[np.lexsort((ids, -w))[:3]].tolist()) for ids, w in vectors]
        self.order = np.array(sorted((i for i in range(len(vectors)) if len(vectors[i][0])), key=lambda i: (heaviest[i], i)), np.int64)
        blocks = -(-len(self.order) // self.block)
        self.bounds = np.zeros((len(self.terms), blocks))
        ids = np.concatenate([vectors[i][0] for i in self.order]) if blocks else np.empty(0, np.int64)
        weights = np.concatenate([vectors[i][1] for i in self.order]) if blocks else np.empty(0)
        example = np.repeat(np.arange(len(self.order)), [len(vectors[i][0]) for i in self.order])
        by = np.lexsort((example, ids, example // self.block))
        self.posted, self.weights = (example % self.block)[by], weights[by]
        keys = (example // self.block * max(len(self.terms), 1) + ids)[by]
        self.starts = np.searchsorted(keys, np.arange(blocks * max(len(self.terms), 1) + 1))
        np.maximum.at(self.bounds, (ids, example // self.block), weights)
        ones = self.labels.sum()
        rates = np.array([(1 - self.share) / max(len(self.labels) - ones, 1), self.share / max(ones, 1)]) * len(self.labels)
        self.rates = rates  # what an example of each label stands for
        self.votes, self.levels = np.array([0.0]), np.array([self.share])
        if 0 < ones < len(self.labels):
            self._calibrate(vectors)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(sorted(counts), np.int64)
        weights = (1 + np.log(np.array([counts[i] for i in ids.tolist()], float))) * self.idf[ids]
        return ids, weights / (math.sqrt(float(weights @ weights)) or 1.0)

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """The k largest cosines over 0 and their examples; `without` is left out."""
        if not len(ids) or not len(self.order):
            return []
        bound = weights @ self.bounds[ids]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best: list[tuple[float, int]] = []
        for at in (slice(0, FIRST_BLOCKS), slice(FIRST_BLOCKS, None)):  # the first blocks set the mark for the rest
            blocks = order[at]
            floor = -best[-1][0] if len(best) == k else 0.0
            blocks = np.sort(blocks[bound[blocks] * (1 + 1e-9) >= floor])
            if not len(blocks):
                break
            cosine = self._cosines(blocks, ids, weights)
            met = np.flatnonzero((cosine >= floor) & (cosine > 0))
            if len(met) > 4 * k:  # only what can be among the k + 1 largest
                met = met[cosine[met] >= np.partition(cosine[met], -k - 1)[-k - 1]]
            found = self.order[blocks[met // self.block] * self.block + met % self.block]
            pairs = zip((-cosine[met]).tolist(), found.tolist(), strict=True)
            best = sorted([*best, *[m for m in pairs if m[1] != without]])[:k]
        return [(-c, i) for c, i in best]

    def _cosines(self, blocks: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Cosines of all examples of these blocks, block by block, from the postings of the terms `ids` in them."""
        keys = (blocks[:, None] * len(self.terms) + ids).ravel()
        lo, sizes = self.starts[keys], self.starts[keys + 1] - self.starts[keys]
        ends = np.cumsum(sizes)
        which = np.arange(ends[-1]) + np.repeat(lo - ends + sizes, sizes)
        row = np.repeat(np.repeat(np.arange(len(blocks)) * self.block, len(ids)), sizes) + self.posted[which]
        return np.bincount(row, self.weights[which] * np.repeat(np.tile(weights, len(blocks)), sizes), minlength=len(blocks) * self.block)

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic votes, between which and the prior the weight of the neighbours decides."""
        total, toxic = PRIOR, PRIOR * self.share
        for cosine, i in near:
            weight = self.rates[self.labels[i]] / (SOFT + 1 - min(cosine, 1.0))
            total += weight
            toxic += weight * self.labels[i]
        return toxic / total

    def _calibrate(self, vectors: list) -> None:
        """Rising shares of toxic examples over the votes that the other examples give them (pooled adjacent violators)."""
        votes = np.array([self.vote(self.nearest(*v, without=i)) for i, v in enumerate(vectors)])
        pools: list[list[float]] = []  # weight, toxic weight, vote * weight
        for i in np.argsort(votes, kind="stable").tolist():
            w = float(self.rates[self.labels[i]])
            pools.append([w, w * float(self.labels[i]), w * float(votes[i])])
            while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
        self.votes = np.array([p[2] / p[0] for p in pools])
        self.levels = np.array([(p[1] + self.share) / (p[0] + 1) for p in pools])

    def score(self, near: list[tuple[float, int]]) -> float:
        return float(np.interp(self.vote(near), self.votes, self.levels))


def examples(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = EXAMPLES) -> tuple[DataFrame, dict[int, int]]:
    """content, label, doc_id, text of at most `most` documents of each label, and how many different texts each label has."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.avg(label_col).alias("_label"))
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select("doc_id", F.xxhash64(text, F.length(text)).alias("content"))
    of_text = hashed.join(known, hashed["doc_id"] == known["_id"]).groupBy("content").agg(F.avg("_label").alias("label"), F.min("doc_id").alias("doc_id"))
    of_text = cut(of_text.select("content", (F.col("label") >= 0.5).cast("int").alias("label"), "doc_id"))
    counts = {r["label"]: r["n"] for r in of_text.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [of_text.where(F.col("label") == k).orderBy(F.xxhash64("content"), "content").limit(most) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).withColumnRenamed("doc_id", "_id").withColumnRenamed("content", "_content")
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text, F.length(text)).alias("content"))
    met = texts.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("content") == F.col("_content")))  # 2 * most rows
    return cut(met.groupBy("content", "label", "doc_id").agg(F.min("text").alias("text"))), counts


def select_terms(chosen: DataFrame, most: int = TERMS) -> list[str]:
    """The terms of most examples' labels: largest chi-squared between presence and label."""

    def count(batches):
        held = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                held[label].update({t for w in words_of(text) for t in word_terms(w)})
            if len(held[0]) + len(held[1]) > 2_000_000:
                yield from told(held)
                held = (Counter(), Counter())
        yield from told(held)
        held = None
        release()

    def told(held):
        for label in (0, 1):
            terms, n = list(held[label]), list(held[label].values())
            for at in range(0, len(terms), 1 << 16):
                part = [pa.array(terms[at : at + (1 << 16)], pa.string()), pa.array(n[at : at + (1 << 16)], pa.int64())]
                zero = pa.array(np.zeros(len(part[0]), np.int64))
                yield pa.RecordBatch.from_arrays([part[0], *((zero, part[1]) if label else (part[1], zero))], ["term", "clean", "toxic"])

    size = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = float(size.get(0, 0)), float(size.get(1, 0))
    met = chosen.repartition(16, "content").select("label", "text").mapInArrow(count, "term string, clean long, toxic long")
    summed = met.groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")).where((F.col("a") + F.col("b")).between(LEAST_DOCS, MOST_SHARE * (n0 + n1)))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi = F.try_divide((n0 + n1) * F.pow(b * (n0 - a) - a * (n1 - b), 2), (a + b) * (n0 + n1 - a - b) * n0 * n1)
    best = summed.select("term", chi.alias("chi")).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "term").limit(most)
    return [r["term"] for r in best.collect()]  # at most `most` of them


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = EXAMPLES, most_terms: int = TERMS) -> Index:
    """The index of labelled examples among docs (doc_id, text)."""
    ready(docs.sparkSession)
    chosen, counts = examples(docs, labels, label_col, most)
    terms = {t: n for n, t in enumerate(select_terms(chosen, most_terms))}

    def read(batches):
        reader = Reader(terms)
        for batch in batches:
            rows = [reader.counts(t) for t in texts_of(batch.column(3))]
            arrays = [pa.array([[*r] for r in rows], pa.list_(pa.int32())), pa.array([[*r.values()] for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], ["content", "label", "doc_id", "ids", "n"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    read_ = chosen.select("content", "label", "doc_id", "text").mapInArrow(read, f"content long, label int, doc_id {kind}, ids array<int>, n array<long>")
    rows = sorted(read_.collect(), key=lambda r: r["content"])  # at most 2 * most rows of numbers of kept terms
    total = sum(counts.values())
    return Index(
        terms, [dict(zip(r["ids"], r["n"], strict=True)) for r in rows], np.array([r["label"] for r in rows], np.int64),
        [r["doc_id"] for r in rows], counts.get(1, 0) / total if total else 0.0,
    )


def scores(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, evidence (the neighbours, nearest first: doc_id, cosine, label) for every row of docs."""
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(index)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def each(batches):
        index = shared.value
        reader, known = Reader(index.terms), {}
        for batch in batches:
            scores_, near_ = [], []
            for text in texts_of(batch.column(1)):
                found = reader.counts(text)
                key = tuple(sorted(found.items()))
                if key not in known:  # texts with equal counts of kept terms have equal answers
                    near = index.nearest(*index.vector(found)) if found else []
                    if len(known) >= CACHED_ANSWERS:
                        known.clear()
                    known[key] = index.score(near), [{"doc_id": index.doc_ids[i], "cosine": c, "label": int(index.labels[i])} for c, i in near]
                scores_.append(known[key][0])
                near_.append(known[key][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores_, pa.float64()), pa.array(near_, evidence)], ["doc_id", "score", "evidence"])
        reader = known = None
        release()

    schema = f"doc_id {kind}, score double, evidence array<struct<doc_id: long, cosine: double, label: int>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)


def op12_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    index = fit(docs.where(fold(F.col("doc_id"), 3) != 1), labels)
    return scores(docs, index).select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
        F.col("evidence.doc_id").alias("neighbours"),
    )
