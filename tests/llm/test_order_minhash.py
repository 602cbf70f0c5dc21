import collections
import functools
import hashlib
import random
import struct

from corpus import odd_rows, prose

from motionloom.llm import order_minhash


def shown(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n long, t string")
    return {r.n: r.fp for r in order_minhash.fingerprint(df, "t", "fp").collect()}


def like(a, b):
    present = [(x, y) for x, y in zip(a, b, strict=True) if x != order_minhash.ABSENT or y != order_minhash.ABSENT]
    return sum(x == y for x, y in present) / len(present) if present else 1.0


def check(docs, rows):
    """Digest columns of rows with distinct ids against brute force."""
    ordered = sorted(rows)
    got = {r.doc_id: r for r in order_minhash.op3_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for n, (i, text) in enumerate(ordered):
        text, after_id, after = text or "", *ordered[(n + 1) % len(ordered)]
        q = len(text) // 4
        edited = text[: len(text) - q] + (after or "")[:q]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        split = lambda s: [s[k : k + 8] for k in range(0, len(s), 8)]
        assert got[i].near_edited == like(split(got[i].fingerprint), split(got[i].edited_fingerprint))
        assert got[i].near_next == like(split(got[i].fingerprint), split(got[after_id].fingerprint))
    return got


def test_edits_and_neighbours(spark):
    rows = list({r[0]: (r[0], r[1]) for r in odd_rows() if r[0] is not None}.values())
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = check(docs, rows)
    by_text = {}
    for i, text in rows:
        assert by_text.setdefault(text or "", got[i].fingerprint) == got[i].fingerprint
    near = sorted(got[i].near_edited for i, t in rows if len(t or "") > 400)
    far = sorted(got[i].near_next for i, t in rows if len(t or "") > 400)
    assert near[len(near) // 2] > 0.3 > far[len(far) // 2]


def test_likeness_falls_with_edits_and_sees_order(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    few, many = words.copy(), words.copy()
    for n in rng.sample(range(2000), 10):
        few[n] = "changed"
    for n in rng.sample(range(2000), 300):
        many[n] = "changed"
    half = words[1000:] + words[:1000]
    pairs = [words[n : n + 4] for n in range(0, 2000, 4)]
    rng.shuffle(pairs)
    shuffled = [w for p in pairs for w in p]
    fps = shown(spark, [" ".join(x) for x in (words, few, many, half, shuffled)])
    same = lambda n: like(fps[0], fps[n])
    assert same(0) == 1 and same(1) > 0.8 and same(1) > same(2)
    assert 0.2 < same(3) < 0.9 and same(4) < 0.5


def test_numbered_occurrences_count(spark):
    base = prose(1, 20)
    fps = shown(spark, [" ".join([base] * 40), " ".join([base] * 41), base * 1, "", None, "ab"])
    assert 0.5 < like(fps[0], fps[1]) < 1.01
    assert fps[3] == [order_minhash.ABSENT] * order_minhash.BINS
    assert like(fps[3], fps[5]) == 0


def test_one_unit_for_every_length_and_script(spark):
    words = prose(7, 400)
    for n in (399, 400, 401, 900):  # near copies of less and more than 400 code points
        fps = shown(spark, [words[:n], words[: n - 2], words[: n // 2] + "x" + words[n // 2 :][: n - n // 2 - 2]])
        assert like(fps[0], fps[1]) > 0.8 and like(fps[0], fps[2]) > 0.7
    rng = random.Random(5)
    for first, span in ((0x4E00, 3000), (0x1F300, 600), (97, 26)):  # no blank in it; one place edited, inserted into, cut
        text = "".join(chr(first + rng.randrange(span)) for _ in range(1500))
        fps = shown(spark, [text, text[:700] + "Q" + text[701:], text[:700] + "QQQ" + text[700:], text[:700] + text[705:]])
        assert min(like(fps[0], fps[n]) for n in (1, 2, 3)) > 0.8


def test_signatures_select_from_all_elements(spark, monkeypatch):
    rng = random.Random(8)
    new = lambda n: "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(n))
    shares = []
    for _ in range(16):  # three quarters of the runs kept, in texts of other lengths
        text = new(1200)
        fps = shown(spark, [text, text[:900], text[:900] + new(300)])
        shares.append((like(fps[0], fps[1]), like(fps[0], fps[2])))
    cut_, changed = (sum(x) / len(x) for x in zip(*shares, strict=True))
    assert abs(cut_ - 0.75**2) < 0.07 and abs(changed - 0.6**2) < 0.07  # pairs of 900 of 1200 and of 1500 elements
    texts = [prose(n, size) for n, size in enumerate((130, 150, 200, 700, 3000))] + ["A" * 3000]
    thinned = shown(spark, texts)
    monkeypatch.setattr(order_minhash, "SORTED", 1 << 20)
    assert shown(spark, texts) == thinned


def test_no_python_in_the_plan(spark, sf_dir):
    plan = order_minhash.op3_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute(text):
    """Signatures of a text, with no thinning: every k-mer numbered, every signature's two smallest elements picked one by one."""
    from xxhash import xxh64_intdigest as xxh

    m = order_minhash
    chained = lambda *longs: functools.reduce(lambda seed, x: xxh(x, seed), longs, 42)  # noqa: E731  Spark's hash of several values
    seen, elements = collections.Counter(), []
    for place in range(max(1, len(text) - m.RUN + 1) if text else 0):
        kmer = xxh(text[place : place + m.RUN].encode("utf-32-be"), 42) & m.HASHES
        seen[kmer] += 1
        again = chained(struct.pack("<q", kmer >> m.PLACE_BITS), struct.pack("<i", seen[kmer])) & m.HASHES
        elements.append(((kmer if seen[kmer] == 1 else again) >> m.PLACE_BITS, place))
    found = []
    for n in range(m.BINS):
        own = sorted((h >> m.BIN_BITS, place) for h, place in elements if h % m.BINS == n)[:2]
        longs = [struct.pack("<q", n << 30 | h) for h, place in sorted(own, key=lambda e: e[1])]
        found.append(f"{chained(*longs):016x}"[-8:] if own else m.ABSENT)
    return found


def test_signatures_against_brute_force(spark, sf_dir):
    texts = ["", "abc", "abcdefgh", "abcdefghi", "a" * 2000, prose(9, 30), prose(10, 400), prose(11, 3000), "中文字符" * 300]
    texts += [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    got = shown(spark, texts)
    assert all(got[n] == brute(t) for n, t in enumerate(texts))


def test_edited_signatures_against_brute_force(spark, sf_dir):
    """Both fingerprints of every document of the table and of odd texts, each from its own whole text."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()][:120]
    rows += [(10**6 + n, t) for n, t in enumerate(["", "abc", "a" * 500, "abcdefghijk", None, "中文字符" * 90, prose(10, 400), "a" * 33])]
    ordered = sorted(rows)
    got = {r.doc_id: r for r in order_minhash.op3_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(n + 1) % len(ordered)][1] or ""
        q = len(text) // 4
        assert got[i].fingerprint == "".join(brute(text))
        assert got[i].edited_fingerprint == "".join(brute(text[: len(text) - q] + after[:q]))
