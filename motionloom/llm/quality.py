"""Quality scores from a regularised quadratic discriminant over document statistics.

Method: each class (label 0 and 1) is a Gaussian over transformed statistics of the text; its
covariance is shrunk towards the pooled covariance and towards a scaled identity. A score is the
logistic of half the difference of squared Mahalanobis distances, plus log-determinants and log
priors. Class moments are sums that Spark aggregates over all labelled rows outside the held-out
fold; only these sums reach the driver. The inverse Cholesky factor of each class is computed once
and sent with the scoring tasks.

Edge cases: a null or empty text has the statistics of an empty one and is scored; rows without a
label, with a null label or with another label than 0 and 1 teach nothing; repeated rows are scored
alike; with no labelled rows of one class all scores are the share of label 1 (0.5 without labels); a
null doc_id is not matched with a label; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, fold, ready, texts_of

STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper_share", "digit_share", "space_share", "mark_share", "odd_share",
    "bang_share", "distinct_share", "top_share", "line_words", "repeated_lines", "sentence_words", "long_share",
)
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_MARKS, _ODD = list(b".,;:'\"()-?"), list(b"#$%&*+<=>@[\\]^_`{|}~/")


def statistics(text: str) -> list[float]:
    """Transformed statistics of one whole text, in the order of STATISTICS."""
    raw = text.encode()
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    words = raw.split()
    seen = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    w, size = max(1, len(words)), max(1, n)
    upper, lower = int(counts[_UPPER].sum()), int(counts[_LOWER].sum())
    log_share = lambda part, whole: float(np.log(part / whole + 0.003))  # noqa: E731  alike for clean texts of any length
    return [
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        float(np.log1p(sum(map(len, words)) / w)),
        log_share(upper, max(1, upper + lower)),
        log_share(int(counts[_DIGIT].sum()), size),
        log_share(int(counts[[9, 10, 13, 32]].sum()), size),
        log_share(int(counts[_MARKS].sum()), size),
        log_share(int(counts[_ODD].sum()), size),
        log_share(int(counts[33]), size),
        float(np.log(max(1, len(seen)) / w) + 0.15 * np.log(w)),  # the share of distinct words falls as texts grow
        log_share(max(seen.values(), default=1) - 1, w),
        float(np.log1p(w / max(1, len(lines)))),
        log_share(len(lines) - len(set(lines)), max(1, len(lines))),
        float(np.log1p(w / (1 + int(counts[46]) + int(counts[63])))),
        log_share(sum(1 for x in seen if len(x) > 14), max(1, len(seen))),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one double per name of STATISTICS."""
    ready(docs.sparkSession)

    def each(batches):
        for batch in batches:
            rows = np.array([statistics(t) for t in texts_of(batch.column(1))]).reshape(-1, len(STATISTICS))
            columns = [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *STATISTICS])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{name} double" for name in STATISTICS)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)


class Discriminant:
    """Two Gaussians from class moments. moments: label -> (rows, sums, sums of products)."""

    def __init__(self, moments: dict, to_pooled: float = 0.3, to_identity: float = 0.005):
        self.prior = {k: m[0] for k, m in moments.items()}
        total = sum(self.prior.values())
        self.share = self.prior.get(1, 0) / total if total else 0.5
        self.classes = {}
        if min(self.prior.get(0, 0), self.prior.get(1, 0)) < 2:
            return
        means = {k: s / n for k, (n, s, _) in moments.items()}
        scatter = {k: p / n - np.outer(s / n, s / n) for k, (n, s, p) in moments.items()}
        pooled = sum(scatter[k] * self.prior[k] for k in scatter) / total
        for k in (0, 1):
            cov = (1 - to_pooled) * scatter[k] + to_pooled * pooled
            cov = (1 - to_identity) * cov + to_identity * max(np.trace(cov) / len(cov), 1e-9) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            level = np.log(self.prior[k] / total) - np.log(np.diag(factor)).sum()
            self.classes[k] = (means[k], np.linalg.inv(factor), level)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(rows), self.share)
        density = {
            k: level - 0.5 * (((rows - mean) @ inverse.T) ** 2).sum(axis=1)
            for k, (mean, inverse, level) in self.classes.items()
        }
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Discriminant:
    """stats: doc_id and STATISTICS of the rows to learn from; labels: doc_id and a label of 0 or 1."""
    known = labels.where(F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).cast("int").alias("_label"))
    pairs = [(i, j) for i in range(len(STATISTICS)) for j in range(i + 1)]
    sums = [F.sum(name) for name in STATISTICS]
    products = [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])) for i, j in pairs]
    joined = stats.join(known, "doc_id").groupBy("_label")
    moments = {}
    for row in joined.agg(F.count("*"), *sums, *products).collect():
        label, n, *values = row
        matrix = np.zeros((len(STATISTICS),) * 2)
        for (i, j), v in zip(pairs, values[len(STATISTICS) :], strict=True):
            matrix[i, j] = matrix[j, i] = v
        moments[label] = (n, np.array(values[: len(STATISTICS)]), matrix)
    return Discriminant(moments)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score for rows that have STATISTICS."""

    def each(batches):
        for batch in batches:
            rows = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in STATISTICS])
            scores = pa.array(model.score(rows.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", *STATISTICS).mapInArrow(each, f"doc_id {kind}, score double")


def op1_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = cut(with_statistics(docs))
    model = fit(stats.where(fold(F.col("doc_id"), 5) != 0), labels)
    return score(stats, model).select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )
