"""The pipeline stage by stage: decisions take effect, and the last rows are the packing of what is left."""

import corpus_pipeline
import pytest
from corpus import empty_docs, odd_docs

from motionloom.llm import decontaminate, simhash, suffix_dedup


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"file://{folder}/{n}")
        out = spark.read.parquet(f"file://{folder}/{n}")
        found.append((name, docs, out))
        docs = out
    return found


def test_stages_keep_the_columns(steps):
    for name, before, after in steps[:-1]:
        assert after.columns == before.columns, name
        assert 0 < after.count() <= before.count(), name


def test_language_keeps_known_languages(steps):
    _, before, after = steps[0]
    assert after.where("text is null").count() == 0
    assert after.count() > 0.9 * before.where(r"text rlike '\\p{L}'").count()


def test_one_of_each_near_duplicate_group_stays(steps):
    _, before, after = steps[1]
    want = sorted({r.component_id for r in simhash.op2_groups(before).collect()})
    assert sorted(r.doc_id for r in after.collect()) == want
    assert simhash.op2_groups(after).where("doc_id <> component_id").count() == 0


def test_repeats_go(steps):
    _, before, after = steps[2]
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.op5_removed(before).collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        kept = len(texts[r.doc_id].encode()) - removed[r.doc_id]
        assert len(r.text.encode()) == kept if not removed[r.doc_id] else kept - 12 <= len(r.text.encode()) <= kept
        assert r.n_chars == len(r.text) if removed[r.doc_id] else True


def test_contaminated_documents_go(spark, sf_dir, steps):
    _, before, after = steps[3]
    bad = {r.doc_id for r in decontaminate.op6_hits(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad


def test_packing_holds_all_that_is_left(steps):
    _, before, after = steps[4]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_run_gives_the_same_rows(spark, sf_dir, steps):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    key = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(steps[4][2])


@pytest.mark.parametrize("make", [empty_docs, odd_docs])
def test_run_stands_odd_and_no_rows(spark, tmp_path, make):
    docs = make(spark)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([("i1", "one"), ("i2", None)], "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert (packed.count() > 0) == (docs.count() > 0)
