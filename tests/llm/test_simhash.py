import random

import xxhash
from corpus import odd_rows, prose

from motionloom.llm import simhash
from motionloom.llm.components import components


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    """fingerprint -> representative fingerprint set, by all pairs."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in distinct}


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [brute_fingerprint(t) for _, t in rows]
    groups, first = brute_groups(fps), {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            first[groups[f]] = min(i, first.get(groups[f], i))
    want = sorted((str(i), f"{f:016x}", str(first.get(groups[f]))) for (i, _), f in zip(rows, fps, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.op2_groups(docs).collect())
    assert got == want


def test_odd_rows_agree_with_brute_force(spark):
    check(spark, [(r[0], r[1]) for r in odd_rows()])


def test_whole_table_agrees_with_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_links_are_all_pairs_within_three_bits(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << k for k in rng.sample(range(64), d)) for b in base for d in (0, 1, 2, 3, 4, 5)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = {frozenset((a, b)) for a in values for b in values if a != b and (a ^ b).bit_count() <= 3}
    assert {frozenset(p) for p in got} == want


def test_long_chains_become_one_component(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = [(a, b) for a, b in zip(order, order[1:], strict=False)] + [(1000, 1001), (1001, 1001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[n] for n in order} == {0} and got[1001] == 1000


def test_representatives_are_the_smallest_of_each_group(spark):
    a, b = prose(7, 200), prose(8, 200)
    rows = [(5, a), (3, a), (9, b), (9, b), (4, a.upper()), (None, b)]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, a), (9, b)]
