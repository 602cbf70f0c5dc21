"""Every operator: odd rows, empty tables and columns with clashing names."""

import pytest
from corpus import CLASHING, bag, empty_docs, odd_docs, odd_rows, with_clashes
from pyspark.sql import functions as F

from motionloom.llm import decontaminate, divergence, langid, licenses, lm_score, order_minhash, packing, quality, simhash, suffix_dedup, token_align, toxicity, warc

ITEMS = [("i1", "one"), ("i2", None), ("i3", ""), (None, "zz yy"), ("i1", "one")]


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id string, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, None), (7, None, 0), (8, 0, 1), (None, 1, 1), (11, 1, 0), (12, 0, 0)], "doc_id long, quality int, toxic int")


def pages(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x.y/").alias("url"), F.col("text").alias("html"), *[c for c in docs.columns if c not in ("doc_id", "text", "url")])


OPERATORS = {
    "quality": lambda d: quality.op1_scores(d, labels(d.sparkSession)),
    "simhash": simhash.op2_groups,
    "order_minhash": order_minhash.op3_fingerprints,
    "warc": lambda d: warc.op4_round_trip(pages(d)),
    "suffix_dedup": suffix_dedup.op5_removed,
    "decontaminate": lambda d: decontaminate.op6_hits(d, items(d.sparkSession)),
    "packing": packing.op7_pack,
    "licenses": licenses.op8_labels,
    "lm_score": lm_score.op9_scores,
    "langid": langid.op10_languages,
    "token_align": token_align.op13_alignments,
    "toxicity": lambda d: toxicity.op12_scores(d, labels(d.sparkSession)),
}
STAGES = {
    "language": lambda d: langid.accepted(d, langid.fit(d)),
    "near_duplicates": simhash.representatives,
    "repeats": suffix_dedup.without_repeats,
    "benchmark": lambda d: decontaminate.clean(d, items(d.sparkSession)),
}
#: These number sequences by partition or round floating sums by order; the other columns must agree.
LOOSE = {"quality": ["doc_id", "held_out", "predicted"], "packing": ["doc_id", "piece", "start", "length", "ids_crc32"], "lm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_clashing_columns(spark, name):
    docs = odd_docs(spark)
    plain = OPERATORS[name](docs)
    columns = LOOSE.get(name, plain.columns)
    got = bag(plain, columns)
    ids = [r[0] for r in (OPERATORS[name](docs).select(plain.columns[0]).collect())]
    want = [r[0] for r in odd_rows()]
    key = lambda i: (i is None, i or 0)
    if name == "packing":
        assert set(ids) == set(want)
    else:
        assert sorted(ids, key=key) == sorted(want, key=key)  # one row per row, repeated ones too
    assert bag(OPERATORS[name](with_clashes(docs)), columns) == got


def test_audit_of_odd_rows_and_clashing_columns(spark):
    docs = odd_docs(spark).withColumn("source", F.concat(F.lit("s"), F.col("n_chars") % 3))
    plain = divergence.op11_audit(docs)
    assert plain.count() > 0 and bag(divergence.op11_audit(with_clashes(docs)), plain.columns) == bag(plain)
    assert divergence.op11_audit(with_clashes(empty_docs(spark))).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](empty_docs(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stage_keeps_columns_and_stands_odd_rows(spark, name):
    docs = with_clashes(odd_docs(spark))
    out = STAGES[name](docs)
    assert out.columns == docs.columns and out.count() > 0
    clashing = [c for c in CLASHING if c in docs.columns and c not in odd_docs(spark).columns]
    assert out.where(" or ".join(f"`{c}` <> 'clash'" for c in clashing)).count() == 0
    empty = with_clashes(empty_docs(spark))
    assert STAGES[name](empty).columns == empty.columns and STAGES[name](empty).count() == 0
