"""Removal of long repeated byte strings, by column-wise construction over collections of suffixes.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in this document
or another.

Method: column-wise multi-document construction. All texts of a collection are extended to the left by
one symbol a round: the order of their suffixes is updated by a stable sort on the new symbols (the
column of the collection's Burrows-Wheeler transform), and the common prefixes of neighbours by range
minima over the ones before. Symbols are read, and order and prefixes written, one column after the
other in sequential files. A suffix with a neighbour of common prefix `length` or more starts a
repeat.

Over whole documents that takes as many rounds as the longest has bytes, in one task. So the
collections are made small and aligned, without loss. In each window of `length` bytes the smallest
hash of a `GRAM`-byte gram is its anchor (of equals, the first); equal windows have equal anchors at
equal places. Windows with one anchor are neighbours and form a run of less than 2 * `length` bytes.
A collection is all different runs with one anchor gram, aligned on it: suffixes that start in one
column are all that can be equal, and 2 * length - GRAM rounds suffice for any number of runs.

On Spark: runs are hashed where the texts lie. Copies of a run are counted and collapsed; a run that
occurs twice is a repeat as a whole (its marks come back by a join, from a broadcast table for the
few kinds that stand for many rows). Only runs whose anchor also has a different run, one of each
kind, are cut out of the texts and brought together by anchor. An anchor with over `MOST_RUNS`
different runs is not brought into one task: its windows are compared as hashed intervals of shrinking
width (`_split_hot`), which counts and never gathers. Both ways give the same result.

Edge cases: a null text is empty; texts under `length` bytes have no repeats; rows with one id and
text are places like any other, so both lose what they share; two texts with one id are told apart by
content; a null id is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from tempfile import TemporaryFile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, ready

LENGTH = 400
GRAM = 32
MOST_RUNS = 256
#: Windows of a text that are hashed at a time.
PIECE = 1 << 22
#: Anchors' hashes (8 bytes each) that are broadcast at most; more are joined by shuffle.
BROADCAST_ANCHORS = 500_000
#: Runs that one task orders at a time; a task holds some of their columns in memory, the rest in files.
BATCH_RUNS = 8192
#: Kinds of run that stand for over HOT_ROWS rows and over a HOT_KINDS-th of all are hot: HOT_KINDS kinds at most.
HOT_ROWS, HOT_KINDS = 1000, 100_000
NO_ID = -(1 << 63)
KEY = ["kid", "content"]


def gram_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of all grams of GRAM bytes."""
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    m = len(raw) - GRAM + 1
    h = words[:m] * np.uint64(0x9E3779B97F4A7C15)
    for at in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += words[at : at + m]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def runs(raw: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(first window, last window, anchor place, anchor hash): maximal runs of windows with one anchor."""
    for start in range(0, len(raw) - length + 1, PIECE):
        part = raw[start : start + PIECE + length - 1]
        h = gram_hashes(part)
        w = length - GRAM + 1
        key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        blocks = -(-len(key) // w)
        padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(key)] = key
        grid = padded.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(part) - length + 1
        chosen = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & np.uint64(0xFFFFFF)
        edges = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
        first = np.concatenate(([0], edges))
        last = np.concatenate((edges - 1, [count - 1]))
        place = chosen[first].astype(np.int64)
        for a, b, p, x in zip(first.tolist(), last.tolist(), place.tolist(), h[place].view(np.int64).tolist(), strict=True):
            yield start + a, start + b, start + p, x


def _rows_columns(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    kid = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return [kid.alias("kid"), F.xxhash64(text, F.length(text)).alias("content"), text.cast("binary").alias("raw")]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*_rows_columns(id_col, text_col))


RUN_SCHEMA = "kid long, content long, a int, b int, lo int, h long, k1 long, k2 long"


def all_runs(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every run of every text: windows a to b, the first window's place from the anchor (lo, at most 0), the anchor's
    hash h, and a 128-bit hash (k1, k2) of the run's bytes and lo."""
    from xxhash import xxh3_128_digest

    names = ["kid", "content", "a", "b", "lo", "h", "k1", "k2"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def each(batches):
        for batch in batches:
            found: list[list] = [[] for _ in range(6)]
            digests = []
            for kid, content, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(raw) < length:
                    continue
                for a, b, p, h in runs(raw, length):
                    for column, value in zip(found, (kid, content, a, b, a - p, h), strict=True):
                        column.append(value)
                    digests.append(xxh3_128_digest(raw[a : b + length], p - a))
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            arrays = [*found, np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, types, strict=True)], names)

    return rows.mapInArrow(each, RUN_SCHEMA)


class Columns:
    """A sequential file of columns: written one after the other, then read in that order.

    A nameless file of the task that writes it, as a spill is: it goes with the task, and nothing else reads it."""

    def __init__(self, dtype, size: int):
        self.file, self.dtype, self.size = TemporaryFile(), np.dtype(dtype), size

    def write(self, column: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(column, self.dtype).tobytes())

    def __iter__(self) -> Iterator[np.ndarray]:
        self.file.seek(0)
        while block := self.file.read(self.size * self.dtype.itemsize):
            yield np.frombuffer(block, self.dtype)
        self.file.close()


def column_repeats(group: np.ndarray, lo: np.ndarray, texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(run, window) of every window of `length` bytes that another run of its group has at the same place.

    group: ascending numbers; lo: place of a run's first byte, from -(length - GRAM) to 0. A window's number is its place
    less the smallest lo.
    """
    m, wide = len(texts), 2 * length - GRAM
    low = -(length - GRAM)
    symbols = Columns(np.int16, m)
    grid = np.zeros((m, wide), np.int16)  # 0: no symbol here
    for i, text in enumerate(texts):
        at = int(lo[i]) - low
        grid[i, at : at + len(text)] = np.frombuffer(text, np.uint8)
        grid[i, at : at + len(text)] += 1
    for j in range(wide - 1, -1, -1):
        symbols.write(grid[:, j])
    del grid
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    of_group = group.astype(np.int64) * 257
    marks = Columns(np.int32, m)
    for symbol in symbols:
        transform = symbol[order]  # the transform's column for the suffixes sorted so far
        key = of_group[order] + transform
        moved = np.argsort(key, kind="stable")
        least = np.minimum.reduceat(common, moved + 1)[:-1]
        key, order = key[moved], order[moved]
        equal = (key[1:] == key[:-1]) & (transform[moved][1:] > 0)
        common = np.zeros(m + 1, np.int32)
        common[1:m] = np.where(equal, least + 1, 0)
        best = np.empty(m, np.int32)
        best[order] = np.maximum(common[:m], common[1:])
        marks.write(best)
    found_run, found_window = [], []
    for j, best in zip(range(wide - 1, -1, -1), marks, strict=True):
        hit = np.flatnonzero(best >= length)
        found_run.append(hit)
        found_window.append(np.full(len(hit), j))
    return np.concatenate(found_run), np.concatenate(found_window)


def _cut_out(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted runs. wanted: KEY, runs (array of a, b, lo, h, n, d)."""
    schema = "kid long, content long, a int, lo int, h long, n long, d long, s binary"

    def each(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for r in row["runs"]:
                    s = row["raw"][r["a"] : r["b"] + length]
                    out.append({"kid": row["kid"], "content": row["content"], "a": r["a"], "lo": r["lo"], "h": r["h"], "n": r["n"], "d": r["d"], "s": s})
            types = pa.schema([("kid", pa.int64()), ("content", pa.int64()), ("a", pa.int32()), ("lo", pa.int32()), ("h", pa.int64()), ("n", pa.int64()), ("d", pa.int64()), ("s", pa.binary())])
            yield pa.RecordBatch.from_pylist(out, types)

    return rows.join(wanted, KEY).mapInArrow(each, schema)


SPAN_SCHEMA = "kid long, content long, a int, b int"


def _by_columns(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of runs that share an anchor with few other runs. One row per maximal span of windows a to b."""
    types = pa.schema([("kid", pa.int64()), ("content", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        h = np.array([r[4] for r in rows])
        group = np.concatenate(([0], np.cumsum(h[1:] != h[:-1])))
        lo = np.array([r[3] for r in rows])
        run, window = column_repeats(group, lo, [r[6] for r in rows], length)
        single = np.array([r[5] == 1 for r in rows])[run]  # others are repeats as a whole already
        run, window = run[single], window[single]
        by = np.lexsort((window, run))
        run, window = run[by], window[by]
        starts = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (window[1:] != window[:-1] + 1)))) if len(run) else np.zeros(0, int)
        stops = np.concatenate((starts[1:], [len(run)])) - 1 if len(run) else starts
        out = []
        for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
            kid, content, a, first, *_ = rows[run[s]]
            base = a - (first + length - GRAM)
            out.append({"kid": kid, "content": content, "a": base + int(window[s]), "b": base + int(window[e])})
        return pa.RecordBatch.from_pylist(out, types)

    def each(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(held) > BATCH_RUNS and held[0][4] != held[-1][4]:
                end = len(held) - 1
                while held[end - 1][4] == held[-1][4]:
                    end -= 1
                yield spans(held[:end])
                held = held[end:]
        if held:
            yield spans(held)

    sorted_ = contexts.select("kid", "content", "a", "lo", "h", "n", "s").repartition("h").sortWithinPartitions("h")
    return sorted_.mapInArrow(each, SPAN_SCHEMA)


def _split_hot(contexts: DataFrame, length: int) -> DataFrame:
    """As _by_columns, for anchors with any number of runs, by counting hashes of intervals of windows.

    Windows u to v of a run all hold its bytes v to u + length: if no other run has these, none of the windows is a
    repeat. If another run has all bytes from u to v + length, all are. Else the interval is split; at width 1 both agree.
    """
    cells, spans, width = contexts.withColumn("hi", F.col("lo") + F.length("s") - length), None, 64
    columns = ["kid", "content", "a", "lo", "hi", "h", "n", "s"]

    def split(cells: DataFrame, first: str, last: str, width: int) -> DataFrame:
        starts = F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))
        return cells.select(*columns, F.explode(starts).alias("q")).select(*columns, (F.col("q") * width).cast("int").alias("u"))

    cells = split(cells, "lo", "hi", width)

    def part(start: Column, size: Column) -> Column:
        return F.md5(F.substring(F.col("s"), start - F.col("lo") + 1, size))

    while True:
        v = F.col("u") + (width - 1)
        clipped = {"cu": F.greatest("u", "lo"), "cv": F.least(v, F.col("hi"))}
        cells = cells.withColumns(clipped).withColumns(
            {"core": part(v, F.lit(length - width + 1)), "hull": part(F.col("cu"), F.col("cv") - F.col("cu") + length)}
        )
        cells = cut(cells)
        core, hull = ["h", "u", "core"], ["h", "u", "cu", "cv", "hull"]
        one = F.struct("kid", "content", "a")
        count = lambda by: cut(cells.groupBy(by).agg(F.count("*").alias("c"), F.min(one).alias("one")).where("c > 1").drop("c"))
        copies = count(hull)
        whole = cells.join(copies, hull, "left_semi").where("n = 1")
        found = cut(whole.select("kid", "content", *[(F.col(c) - F.col("lo") + F.col("a")).cast("int").alias(x) for c, x in (("cu", "a"), ("cv", "b"))]))
        spans = found if spans is None else spans.unionByName(found)
        if width == 1:
            return spans
        # of equal intervals one goes on, for runs that overlap it otherwise
        left = cells.join(count(core).drop("one"), core, "left_semi").join(copies, hull, "left")
        left = left.where((F.col("one").isNull()) | (F.col("one") == one)).withColumn("n", F.expr("if(one is null, n, 2L)"))
        width //= 4
        cells = split(left, "cu", "cv", width)


def repeated_windows(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """KEY, a, b: spans of windows (window a to window b) whose `length` bytes also start elsewhere; spans may touch."""
    found = cut(all_runs(rows, length))
    anchors = cut(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    shared = F.broadcast(anchors) if anchors.count() <= BROADCAST_ANCHORS else anchors
    found = cut(found.join(shared, "h", "left_semi"))
    kinds = cut(
        found.groupBy("h", "k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "a", "b", "lo")).alias("one"))
    )
    kind = ["h", "k1", "k2"]
    repeated = cut(kinds.where("n > 1").select(*kind, "n"))
    many = HOT_ROWS + (repeated.agg(F.sum("n")).first()[0] or 0) // HOT_KINDS
    hot = F.broadcast(repeated.where(F.col("n") > many).drop("n"))  # HOT_KINDS rows at most, whatever the input
    rest = found.join(hot, kind, "left_anti").join(repeated.where(F.col("n") <= many).drop("n"), kind, "left_semi")
    copied = found.join(hot, kind, "left_semi").unionByName(rest).select(*KEY, "a", "b")
    of_anchor = kinds.groupBy("h").agg(F.count("*").alias("d"), F.count_if(F.col("n") == 1).alias("open")).where("d > 1 and open > 0")
    mixed = kinds.join(cut(of_anchor.select("h", "d")), "h").select("one.*", "h", "n", "d")
    wanted = mixed.groupBy(*KEY).agg(F.collect_list(F.struct("a", "b", "lo", "h", "n", "d")).alias("runs"))
    contexts = cut(_cut_out(rows, wanted, length))
    spans = copied.unionByName(_by_columns(contexts.where(F.col("d") <= MOST_RUNS), length))
    wide = contexts.where(F.col("d") > MOST_RUNS)
    return spans if wide.isEmpty() else spans.unionByName(_split_hot(wide, length))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: tuple[str, ...] = ()
) -> DataFrame:
    """kid, content, kept (binary), n_bytes, n_removed, n_spans, for every row, and the columns of docs that `keep` names."""
    ready(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    carried = docs.select(*_rows_columns(id_col, text_col), *[F.col(f"`{c}`").alias(f"_{n}") for n, c in enumerate(keep)])
    of_doc = repeated_windows(rows, length).groupBy(*KEY).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    held = [f"_{n}" for n in range(len(keep))]
    schema = "kid long, content long, kept binary, n_bytes long, n_removed long, n_spans long"
    schema += "".join(f", {h} {docs.schema[c].dataType.simpleString()}" for h, c in zip(held, keep, strict=True))
    names = ["kid", "content", "kept", "n_bytes", "n_removed", "n_spans", *held]

    def each(batches):
        for batch in batches:
            kept, sizes, removed, counts = [], [], [], []
            for raw, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                sizes.append(len(raw))
                if not spans:
                    kept.append(raw), removed.append(0), counts.append(0)
                    continue
                depth = np.zeros(len(raw) + 1, np.int32)
                np.add.at(depth, [s["a"] for s in spans], 1)
                np.add.at(depth, [s["b"] + length for s in spans], -1)
                gone = np.cumsum(depth[:-1]) > 0
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                removed.append(int(gone.sum()))
                counts.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, counts)]
            arrays = [batch.column(0), batch.column(1), pa.array(kept, pa.binary()), *numbers, *batch.columns[4:]]
            yield pa.RecordBatch.from_arrays(arrays, names)

    told = carried.join(of_doc, KEY, "left").select(*KEY, "raw", "spans", *held).mapInArrow(each, schema)
    clash = {"kid", "content", "kept", "n_bytes", "n_removed", "n_spans"}.intersection(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} cannot be kept under their own names")
    return told.withColumnsRenamed(dict(zip(held, keep, strict=True)))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text, n_chars and more) with repeats taken out of the texts; a character that loses some of its bytes
    goes whole. A null text becomes empty; no row goes."""
    renamed = {c: f"_c{n}" for n, c in enumerate(docs.columns)}
    kept = remove_repeats(docs.toDF(*renamed.values()), renamed["doc_id"], renamed["text"], length, tuple(renamed.values()))
    text = F.when(F.col("n_removed") == 0, F.coalesce(renamed["text"], F.lit(""))).otherwise(
        F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\uFFFD", "")
    )
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return kept.select(*[new.get(c, F.col(renamed[c])).alias(c) for c in docs.columns])


def op5_removed(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select(
        F.nullif("kid", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
