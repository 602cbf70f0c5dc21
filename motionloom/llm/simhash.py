"""SimHash fingerprints and near-duplicate groups.

Method: multi-index hashing. A 64-bit fingerprint is cut into `segments` parts; fingerprints that
differ in at most `distance` bits differ in at most distance // segments bits of some part. Every
distinct fingerprint enters one index table per part, and looks up the small Hamming ball around its
own part; the pairs so met are verified over all 64 bits. Verified links are closed into groups by
`components`.

Copies share a fingerprint and are collapsed before any join, so a group of copies of any size is
one entry. With two parts of 32 bits an entry meets few others by chance even among 10^10
fingerprints (the table of a part has 2^32 slots). Links are between distinct fingerprints only; none
is capped or dropped.

Edge cases: a null or empty text, and one without words, has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle of all; repeated rows stay separate rows of one
group; a null doc_id is never the smallest id unless a group has no other (then component_id is
null); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ASCII_LOWER, cut, ready, texts_of
from .components import components

SEED = 42


def simhash(text: str, shingle_words: int = 3, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if over half of the shingles' XXH64 have it."""
    from xxhash import xxh64_digest

    words = text.encode().translate(ASCII_LOWER).split()  # bytes.split: exactly \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return int.from_bytes(xxh64_digest(joined, seed), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -shingle_words])).tolist()
    stops = (ends[shingle_words - 1 :] - 1).tolist()
    digests = b"".join([xxh64_digest(joined[s:e], seed) for s, e in zip(starts, stops, strict=True)])
    set_bits = np.zeros(64, np.int64)
    octets = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    for at in range(0, len(octets), 1 << 16):
        set_bits += np.unpackbits(octets[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * set_bits > len(octets)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint's bits as a signed long."""
    ready(docs.sparkSession)

    def each(batches):
        for batch in batches:
            bits = [simhash(t, shingle_words) for t in texts_of(batch.column(1))]
            fps = pa.array(np.array(bits, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)


def links(fps: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """Pairs a, b of distinct fingerprints (column fp) that differ in at most `distance` bits.

    A pair whose parts differ in one bit is met once, by the entry that has the bit unset; so the ball
    holds the part itself and the parts with one more bit set.
    """
    if distance // segments > 1:
        raise ValueError("balls of a radius over 1 are not enumerated; use more segments")
    width = 64 // segments
    mask = (1 << width) - 1
    part = lambda n: F.shiftrightunsigned("fp", n * width).bitwiseAND(F.lit(mask))
    index = fps.select("fp", F.posexplode(F.array(*[part(n) for n in range(segments)])).alias("part", "value"))
    unset = F.filter(
        F.array(*[F.lit(1 << i).cast("long") for i in range(width)]),
        lambda bit: F.col("value").bitwiseAND(bit) == 0,
    )
    ball = F.array(F.col("value"))
    if distance >= segments:
        ball = F.concat(ball, F.transform(unset, lambda bit: F.col("value").bitwiseOR(bit)))
    probes = index.select(F.col("fp").alias("a"), "part", F.col("value").alias("own"), F.explode(ball).alias("value"))
    met = probes.join(index.withColumnRenamed("fp", "b"), ["part", "value"])
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return met.where(near & ((F.col("own") != F.col("value")) | (F.col("a") < F.col("b")))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )


def _named(marked: DataFrame, distance: int) -> DataFrame:
    """fp, component (the smallest fingerprint of the group), of every distinct fp of `marked`."""
    distinct = cut(marked.select("fp").distinct())
    joined = components(links(distinct, distance)).withColumnRenamed("node", "fp")
    return distinct.join(joined, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the group) for every row of docs."""
    marked = cut(fingerprints(docs, id_col, text_col, shingle_words))
    rooted = cut(_named(marked, distance))
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(rooted, "fp")
    smallest = first.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = cut(rooted.join(smallest, "component").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle_words: int = 3, distance: int = 3) -> DataFrame:
    """One row of docs (doc_id, text and more) for each group: of the smallest doc_id, and of its texts the one with the
    smallest hash. Only ids and hashes are compared; texts move once, to meet the keys that stay."""
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_kid"), F.xxhash64(text, F.length(text)).alias("_content"))
    marked = cut(fingerprints(docs.select(key.alias("key"), "text"), "key", "text", shingle_words).withColumnRenamed("doc_id", "key"))
    rooted = cut(_named(marked, distance))
    first = marked.groupBy("fp").agg(F.min("key").alias("key")).join(rooted, "fp")
    stay = cut(first.groupBy("component").agg(F.min("key").alias("key")).select("key.*"))
    columns = [f"c{n}" for n in range(len(docs.columns))]  # any name may be a column's
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, columns, strict=True)], key["_kid"].alias("_kid"), key["_content"].alias("_content"))
    kept = named.join(stay, ["_kid", "_content"])
    if not marked.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["_kid", "_content"])
    return kept.select(*columns).toDF(*docs.columns)


def op2_groups(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
