"""The source audit against SQL over the whole table and a plain reading over odd rows, with every bound forced."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from corpus import odd_rows, prose

from motionloom.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """rows: text, lang, source."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang or ""].add(source or "")
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + 1000000000 * (of[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, n + 1) for n, (v, _, o) in enumerate(sorted(pairs))]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, n + 1) for n, (v, _, t) in enumerate(sorted(terms)[:200])]
    return sorted(out)


def rows_of_fixture():
    rows = [(prose(n, 5 + n * 7), ("en", "de", None, "fr")[n % 4], f"s{n % 5}") for n in range(40)]
    rows += [(t, lang, s) for _, t, lang, s, _ in odd_rows()]
    rows += [("É é ÉÉ zz zz Zz", "x", "ä"), ("É zz é", "x", "z"), ("É zz é", "x", None), ("", "x", "empty"), (None, "y", "one"), ("rare", "y", "two")]
    return rows + [("\U0001f600a ￿a a\U0001f600 b", "u", s) for s in "abc"] * 2


def check(spark, rows):
    df = divergence.op11_audit(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert sorted(map(tuple, df.collect())) == brute(rows)


def test_odd_rows(spark):
    check(spark, rows_of_fixture())


@pytest.mark.parametrize("name, value", [("HELD_COUNTS", 10), ("CHUNK_ROWS", 7), ("CELLS", 9), ("BROADCAST_BYTES", -1)])
def test_bounds_do_not_change_the_result(spark, monkeypatch, name, value):
    monkeypatch.setattr(divergence, name, value)
    check(spark, rows_of_fixture())


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(spark, [tuple(r) for r in docs.select("text", "lang", "source").collect()])


def test_query_agrees_with_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(divergence.OP11_SQL)
    names = [c[0] for c in want.description]
    df = divergence.op11_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert names == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_shares_are_exact_where_products_leave_64_bits():
    counts = np.array([0, 5, 10**13, 3 * 10**14 - 2], np.int64)
    total = 3 * 10**14
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]
