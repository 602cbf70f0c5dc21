"""Benchmark decontamination: words of documents that lie in occurrences of benchmark windows.

Method: prefix-filtered set join on exact containment. A window is `window_words` consecutive words
of an item (an item of fewer words is one window). Its tokens are its shingles of `shingle_words`
words; tokens are ordered by rarity over all documents. As a window only matches a span that holds
all of its tokens, the necessary prefix is one token, its rarest: only places of that token are
candidates. A candidate fixes where the window would start (positional bound: inside the text) and
end (length bound: the window's words fit before the text ends). Candidates are verified over the
words of a span as long as the window. A window with a token that no document has is dropped at once.

On Spark, with DataFrame functions only: one pass over the texts finds the places of all benchmark
tokens, with their words, against a broadcast table of tokens; counts of that table are the rarity
order. The token table is broadcast only up to `BROADCAST_TOKENS` rows, else it is joined by shuffle.
Whole texts are tokenized once; only places of benchmark tokens, and one row per document, leave
that pass.

Edge cases: a null text has no words; a null or empty item has no window; equal windows of several
items count for each of them; documents with one id and text are one content and get equal rows; two
texts with one id are judged each by itself; a null id is kept; an empty benchmark hits nothing; an
empty table of documents gives an empty result; very long texts are searched whole; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, cut, ready

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS = 13
SHINGLE_WORDS = 5
#: So many distinct benchmark tokens (some 100 bytes each) are broadcast at most.
BROADCAST_TOKENS = 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingles(size: int, all_words: Column, count: Column) -> Column:
    """Hashes of the runs of `size` words by place; none if there are fewer words."""
    hashes = F.transform(
        F.sequence(F.lit(1), F.greatest(count - size + 1, F.lit(1))),
        lambda i: F.xxhash64(*[F.get(all_words, i + (k - 1)) for k in range(size)], F.lit(size)),
    )
    return F.when(count >= size, hashes).otherwise(F.array().cast("array<bigint>"))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window_words: int = WINDOW_WORDS) -> DataFrame:
    """item_id, w: the words of each window of each item, without repeats in an item."""
    worded = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window_words + 1, F.lit(1)))
    each = worded.where(F.size("all") > 0).select("item_id", "all", F.explode(starts).alias("at"))
    return each.select("item_id", F.slice("all", F.col("at"), F.lit(window_words)).alias("w")).distinct()


def places(docs: DataFrame, tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """Where documents have benchmark tokens: doc (a key of id and text), size, token, pos, n_words, around; and one row
    of size 0 per document.

    docs: doc_id, text. tokens: size, token. around: the words from WINDOW_WORDS - 1 before the place to WINDOW_WORDS - 1
    behind it, for verification. Tokens beyond BROADCAST_TOKENS are joined by shuffle, on hashes and places alone; words
    are fetched for the places that match.
    """
    worded = docs.select("doc_id", F.xxhash64("text", F.length("text")).alias("content"), words(F.col("text")).alias("all"))
    worded = worded.withColumn("n_words", F.size("all"))
    own = F.struct(F.lit(0).alias("size"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("token"))

    def at(size: int) -> Column:
        hashes = _shingles(size, F.col("all"), F.col("n_words"))
        return F.transform(hashes, lambda h, i: F.struct(F.lit(size).alias("size"), i.alias("pos"), h.alias("token")))

    every = tokens.select("size", "token").unionByName(tokens.sparkSession.sql("select 0 size, 0L token")).distinct()
    every = cut(every)
    all_places = F.explode(F.concat(F.array(own), *map(at, sizes))).alias("at")
    if every.count() <= BROADCAST_TOKENS:
        flat = worded.select("doc_id", "content", "n_words", "all", all_places).select("doc_id", "content", "n_words", "all", "at.*")
        met = flat.join(F.broadcast(every), ["size", "token"])
    else:
        keys = worded.select("doc_id", "content", all_places).select("doc_id", "content", "at.*").where("size > 0")
        of_doc = keys.join(every, ["size", "token"]).groupBy("doc_id", "content").agg(F.collect_set(F.struct("size", "pos", "token")).alias("met"))
        same = F.col("w.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("w.content") == F.col("o.content"))
        kept = worded.alias("w").join(of_doc.alias("o"), same, "left").select("w.doc_id", "w.content", "w.n_words", "w.all", "o.met")
        met = kept.select("*", F.explode(F.concat(F.array(own), F.coalesce("met", F.array().cast("array<struct<size:int,pos:int,token:bigint>>")))).alias("at"))
        met = met.select("doc_id", "content", "n_words", "all", "at.*")
    start = F.greatest(F.col("pos") - WINDOW_WORDS + 1, F.lit(0))
    around = F.slice("all", start + 1, F.col("pos") - start + WINDOW_WORDS)
    return met.select(
        "doc_id", "content", "n_words", "size", "pos", "token", start.alias("from"),
        F.when(F.col("size") > 0, around).alias("around"),
    )


def occurrences(found: DataFrame, wins: DataFrame) -> DataFrame:
    """doc_id, content, start, length, wid: every place where a window stands whole. found: of `places`; wins: wid, w, tokens."""
    counts = found.where("size > 0").groupBy("token").agg(F.count("*").alias("n"))
    each = wins.select("wid", F.posexplode("tokens").alias("off", "token"))
    ranked = each.join(counts, "token", "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "off")).alias("first")
    )
    rarest = cut(wins.join(ranked.where("first.n > 0"), "wid").select("wid", "w", F.size("w").alias("length"), "first.token", "first.off"))
    rarest = F.broadcast(rarest) if rarest.count() <= BROADCAST_TOKENS else rarest
    start = (F.col("pos") - F.col("off")).alias("start")
    candidates = found.where("size > 0").join(rarest, "token").withColumn("start", start)
    bounded = candidates.where("start >= 0 and start + length <= n_words")
    whole = F.slice("around", F.col("start") - F.col("from") + 1, F.col("length")) == F.col("w")
    return bounded.where(whole).select("doc_id", "content", "start", "length", "wid")


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, content, n_words, n_hit, items (ids as strings, sorted), contaminated, for every row of docs."""
    ready(docs.sparkSession)
    of_items = windows(items, item_id_col, item_text_col)
    keyed = of_items.withColumn("wid", F.xxhash64("w", F.size("w")))
    size = F.least(F.size("w"), F.lit(SHINGLE_WORDS))
    by_size = [F.when(size == s, _shingles(s, F.col("w"), F.size("w"))) for s in range(1, SHINGLE_WORDS + 1)]
    keyed = cut(keyed.select("item_id", "wid", "w", size.alias("size"), F.coalesce(*by_size).alias("tokens")))
    wins = keyed.dropDuplicates(["wid"]).select("wid", "w", "size", "tokens")
    sizes = sorted(r["size"] for r in keyed.select("size").distinct().collect())  # at most SHINGLE_WORDS of them
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = cut(places(docs, wins.select("size", F.explode("tokens").alias("token")), sizes))
    stands = cut(occurrences(found, wins.drop("size")))
    key = ["doc_id", "content"]
    inside = stands.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at"))
    n_hit = inside.distinct().groupBy(key).agg(F.count("*").alias("n_hit"))
    met = stands.select(*key, "wid").distinct().join(keyed.select("wid", "item_id"), "wid")
    of_doc = met.groupBy(key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hit = n_hit.alias("h").join(
        of_doc.alias("i"), F.col("h.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("h.content") == F.col("i.content"))
    ).select("h.doc_id", "h.content", "n_hit", "items")
    rows = found.where("size = 0").select(*key, F.col("n_words").cast("long").alias("n_words")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.content") == F.col("x.content"))
    told = rows.join(hit.alias("x"), same, "left").select(
        "d.doc_id", "d.content", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return told.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and more) that are not contaminated."""
    bad = cut(hits(docs, items).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("content").alias("_bad")).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_TOKENS else bad
    content = F.xxhash64("text", F.length("text"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (content == bad["_bad"]), "left_anti")


def op6_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    return hits(docs, items).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS win, least(13, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
occ AS (
  SELECT doc_id, i, p.n, win.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM pos) p JOIN win ON win.win = p.s AND win.n = p.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY 1),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
