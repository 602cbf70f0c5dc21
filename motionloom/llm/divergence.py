"""Source divergence audit: how far the words of each source lie from those of the other sources of its language.

Method: integer dictionaries. The kept terms of a language stand in sorted arrays; a term's id is its place there, found
by searchsorted, so that ids keep the UTF-8 order and ties fall to the smaller id. Counts of a group are a bincount over
ids: a dense vector over a chunk of the dictionary. All shares and divergences are exact integers.

On Spark: tasks count terms per (lang, source) before anything is shuffled, so a frequent word or a large source is a
few rows a task. Rows of a term meet in one partition in order of (lang, term), and are encoded as a stream: whenever
`CHUNK_ROWS` rows of whole terms are there, they become one chunk with its own sorted array, whatever the size of the
partition. Sizes and sums of groups (a row per group) follow from the chunks; they are broadcast up to
`BROADCAST_BYTES`, beyond that they are dealt to salted keys. Chunks then give partial sums per pair of sources and their
own best terms, `CELLS` cells of the dense vectors at a time.

Edge cases: null text, lang and source are ''; a group without terms takes part with counts of zero; a language without
kept terms has pairs of value 0 and no terms; a language with one source has no pairs. Repeated rows are documents of
their own. A very long text, and one very long term, are counted whole. An empty table gives an empty result. Columns
other than text, lang and source are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, ready, release, texts_of

#: As bytes.translate table: A-Z lower-cased; what cannot be part of a term of [^\x00-\x40\x5B-\x60\x7B-\x7F]+ becomes a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
LEAST_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Counts a task holds before it hands them on, rows of a chunk, cells of dense vectors at a time.
HELD_COUNTS = 500_000
CHUNK_ROWS = 1 << 18
CELLS = 1 << 21
#: Groups (source names and sums) are broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20
SALTS = 64


def _batches(names: list[str], kinds: list[pa.DataType], columns: list[list], rows: int = 1 << 16):
    for at in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + rows], k) for c, k in zip(columns, kinds, strict=True)], names)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents): rows of one term and group are to be summed up."""
    ready(docs.sparkSession)

    def handed(held):
        columns = [[], [], [], [], []]
        for (lang, source), (n, docs_) in held.items():
            for column, values in zip(columns, ([lang] * len(n), [source] * len(n), list(n), list(n.values()), [docs_[t] for t in n]), strict=True):
                column += values
        names, kinds = ["lang", "source", "term", "n", "docs"], [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        for batch in _batches(names, kinds, columns):
            yield batch.set_column(2, "term", batch.column(2).cast(pa.string()))

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(texts_of(batch.column(0)), texts_of(batch.column(1)), texts_of(batch.column(2)), strict=True):
                terms = text.encode().translate(TERM_BYTES).split()
                n, docs_ = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(terms)
                docs_.update(set(terms))
                size += len(n) - before
                if size > HELD_COUNTS:
                    yield from handed(held)
                    held, size = {}, 0
        yield from handed(held)
        held = None
        release()

    named = docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    return named.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def chunks(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, chunk, terms (kept ones, sorted), sources (sorted), sums (of each source), at (source * terms + term), n: the
    counts of each chunk of a language's dictionary; counts that are not named are zero."""
    met = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    schema = "lang string, chunk long, terms array<string>, sources array<string>, sums array<long>, at array<long>, n array<long>"
    kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def starts(rows: pa.Table) -> np.ndarray:
        """Where a new (lang, term) begins."""
        new = np.ones(rows.num_rows, bool)
        for name in ("lang", "term"):
            column = rows[name].combine_chunks()
            changed = np.array(pc.not_equal(column[1:], column[:-1]), dtype=bool)
            new[1:] = changed if name == "lang" else new[1:] | changed
        return np.flatnonzero(new)

    def encoded(rows: pa.Table, first: np.ndarray):
        """The chunks, one for each language, of whole terms that begin at `first`."""
        kept = np.add.reduceat(rows["docs"].to_numpy(), first) >= least_docs
        ends = np.append(first, rows.num_rows)
        inside = np.repeat(kept, np.diff(ends))
        kept_first = first[kept]
        langs, terms = rows["lang"].take(kept_first).to_pylist(), rows["term"].take(kept_first)
        edges = [0, *[i for i in range(1, len(langs)) if langs[i] != langs[i - 1]], len(langs)] if langs else [0]
        at = np.flatnonzero(inside)
        ids = np.searchsorted(kept_first, at, side="right") - 1  # of terms, in UTF-8 order
        n, names = rows["n"].to_numpy()[at], rows["source"].take(at).combine_chunks().dictionary_encode()
        known = names.dictionary.to_pylist()
        order = np.array(sorted(range(len(known)), key=lambda i: known[i].encode()), np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sources, group = [known[i] for i in order], rank[names.indices.to_numpy()]
        for lo, hi in zip(edges, edges[1:], strict=False):
            a, b = np.searchsorted(ids, [lo, hi])
            dense = np.bincount(group[a:b], minlength=len(sources)).astype(bool)
            own = np.flatnonzero(dense)
            place = np.searchsorted(own, group[a:b])
            sums = np.zeros(len(own), np.int64)
            np.add.at(sums, place, n[a:b])
            yield langs[lo], terms[lo:hi].to_pylist(), [sources[i] for i in own], sums.tolist(), (place * (hi - lo) + ids[a:b] - lo).tolist(), n[a:b].tolist()

    def encode(batches):
        held, size, made = [], 0, TaskContext.get().partitionId() << 32
        done = False
        batches = iter(batches)
        while not done:
            batch = next(batches, None)
            done = batch is None
            if not done:
                held.append(batch)
                size += batch.num_rows
            if not size or not done and size < CHUNK_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            first = starts(rows)
            end = rows.num_rows if done else int(first[-1])  # the last term may go on
            if not done and end == 0:
                continue
            for chunk in encoded(rows.slice(0, end), first if done else first[:-1]):
                values = (chunk[0], made, *chunk[1:])
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["lang", "chunk", "terms", "sources", "sums", "at", "n"])
                made += 1
            held, size = rows.slice(end).to_batches(), rows.num_rows - end
        release()

    return met.sortWithinPartitions("lang", "term").select("lang", "term", "source", "n", "docs").mapInArrow(encode, schema)


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total) in 64 bits, by long division where the product would not fit. count < total < 9 * 10^15."""
    above = counts + 1
    if counts.size == 0 or int(above.max()) < (1 << 63) // SCALE:
        return 1 + SCALE * above // total
    quotient, rest = above // total, above % total
    for _ in range(3):
        quotient, rest = quotient * 1000 + rest * 1000 // total, rest * 1000 % total
    return 1 + quotient


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _groups(docs: DataFrame, encoded: DataFrame) -> DataFrame:
    """lang, vocabulary, sources (sorted), sums: one row a language, with all of its groups."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    met = docs.select(text("lang"), text("source")).distinct()
    of_chunk = encoded.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("g"))
    sums = of_chunk.groupBy("lang", F.col("g.sources").alias("source")).agg(F.sum("g.sums").alias("n"))
    sizes = encoded.groupBy("lang").agg(F.sum(F.size("terms")).alias("vocabulary"))
    each = met.join(sums, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("g"))
    listed = each.groupBy("lang").agg(F.array_sort(F.collect_list("g")).alias("g"))
    whole = listed.join(sizes, "lang", "left")
    return whole.select("lang", F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"), F.col("g.source").alias("all_sources"), F.col("g.n").alias("all_sums"))


def _with_groups(encoded: DataFrame, groups: DataFrame) -> DataFrame:
    """Chunks with the row of their language. groups: checkpointed."""
    size = F.expr("aggregate(all_sources, 0L, (s, x) -> s + length(x) * 4 + 40)")
    total = groups.agg(F.sum(size)).first()[0] or 0
    if total <= BROADCAST_BYTES:
        return encoded.join(F.broadcast(groups), "lang")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return encoded.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")


def _parts(joined: DataFrame, top: int) -> DataFrame:
    """lang, source, part, item, value of each chunk: sums of pairs, and each group's best terms."""
    names, kinds = ["lang", "source", "part", "item", "value"], [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def told(batches):
        for batch in batches:
            for row in batch.to_pylist():
                terms, sources = row["terms"], row["all_sources"]
                totals = np.array(row["all_sums"], np.int64) + row["vocabulary"]
                place = np.searchsorted(np.array(sources, object), np.array(row["sources"], object))  # names of the chunk among all
                at, n = np.array(row["at"], np.int64), np.array(row["n"], np.int64)
                group, ids = place[at // len(terms)], at % len(terms)
                order = np.argsort(ids, kind="stable")
                group, ids, n = group[order], ids[order], n[order]
                pairs = np.zeros((len(sources), len(sources)), np.int64)
                columns = [[], [], [], [], []]
                width = max(1, CELLS // len(sources))
                for lo in range(0, len(terms), width):
                    a, b = np.searchsorted(ids, [lo, lo + width])
                    wide = min(width, len(terms) - lo)
                    dense = np.zeros((len(sources), wide), np.int64)
                    dense[group[a:b], ids[a:b] - lo] = n[a:b]
                    p = shares(dense, totals[:, None])
                    q = shares(dense.sum(axis=0), int(sum(row["all_sums"])) + row["vocabulary"])
                    for g, source in enumerate(sources):
                        pairs[g] += divergence(p[g], p).sum(axis=1)
                        above = np.flatnonzero((dense[g] > 0) & (p[g] > q))
                        value = divergence(p[g][above], q[above])
                        best = np.lexsort((above, -value))[:top]
                        for column, values in zip(columns, ([row["lang"]] * len(best), [source] * len(best), ["term"] * len(best), [terms[lo + k] for k in above[best].tolist()], value[best].tolist()), strict=True):
                            column += values
                yield from _batches(names, kinds, columns)
                for g, source in enumerate(sources):
                    others = [k for k in range(len(sources)) if k != g]
                    m = len(others)
                    yield from _batches(names, kinds, [[row["lang"]] * m, [source] * m, ["pair"] * m, [sources[k] for k in others], pairs[g][others].tolist()])

    return joined.mapInArrow(told, "lang string, source string, part string, item string, value long")


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank. docs: text, lang, source."""
    encoded = cut(chunks(term_counts(docs), least_docs))
    groups = cut(_groups(docs, encoded))
    told = cut(_parts(_with_groups(encoded, groups), top))
    one = groups.select("lang", "all_sources", F.explode("all_sources").alias("source"))
    none = one.select("lang", "source", F.explode("all_sources").alias("item"), F.lit(0).cast("long").alias("value")).where("source <> item")
    pairs = told.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(none)
    summed = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = told.where("part = 'term'").select("lang", "source", "item", "value")
    named = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(_ranked(summed), "pair").unionByName(named(_ranked(terms).where(F.col("rank") <= top), "term"))


def op11_audit(docs: DataFrame) -> DataFrame:
    return audit(docs)


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
tok AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM tok) GROUP BY lang, term HAVING count(*) >= 3),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
voc AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN cnt USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (g.total + v.v)::HUGEINT AS p
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN voc v ON v.lang = g.lang LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
  SELECT lang, term, 1 + (1000000000 * (n + 1)::HUGEINT) // (total + v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM cnt GROUP BY lang, term) JOIN voc USING (lang) JOIN (SELECT lang, sum(n) AS total FROM cnt GROUP BY lang) USING (lang)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""
