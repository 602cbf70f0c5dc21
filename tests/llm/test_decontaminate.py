import hashlib
import re

import duckdb
from corpus import odd_rows, prose

from motionloom.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    found = []
    for doc_id, text in docs:
        w, hit, met = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(13, len(v))
            wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1) if v else ():
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    met.add(str(item_id))
        joined = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        found.append((str(doc_id), len(w), len(hit), len(met), joined, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(found)


def check(spark, docs, items):
    df = decontaminate.op6_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()) == brute(docs, items)


def test_planted_passages(spark, monkeypatch):
    a, b, c = prose(1, 40), prose(2, 13), "Tiny ITEM"
    docs = [
        (1, prose(9, 50) + " " + a + " " + prose(10, 50)), (2, " ".join(a.split()[5:18])), (3, " ".join(a.split()[5:17])), (4, b.upper()),
        (5, prose(11, 400) + " tiny, item"), (6, prose(12, 30)), (7, "tiny item tiny item"), (8, a + "\n" + a),
    ]
    docs += [(r[0], r[1]) for r in odd_rows()]
    items = [("a", a), ("b", b), ("b2", b), ("c", c), ("n", None), ("e", ""), ("one", "one"), ("w", "x y " * 20)]
    check(spark, docs, items)
    monkeypatch.setattr(decontaminate, "BROADCAST_TOKENS", 0)  # the way for large benchmarks
    check(spark, docs, items)


def test_query_agrees_with_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    want = sorted(con.execute(decontaminate.OP6_SQL).fetchall())
    df = decontaminate.op6_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert sorted(map(tuple, df.collect())) == want and any(row[-1] for row in want)


def test_stage_keeps_clean_documents_only(spark):
    item = prose(1, 30)
    docs = spark.createDataFrame([(1, item), (2, prose(2, 700) + " " + " ".join(item.split()[:13])), (3, None), (4, prose(3, 40))], "doc_id long, text string")
    kept = decontaminate.clean(docs, spark.createDataFrame([("i", item)], "item_id string, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
