"""Keys one after the other in sorted partitions: steps over many short keys as well as over long ones.

A group of pandas costs some milliseconds whatever it holds. Here a partition is sorted by key and order, a flag marks where
a key begins, and Python goes through its Arrow batches; the keys of a batch share what a batch costs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST = "_first"


def sorted_keys(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows of a key of `by` together and in order (nulls last), with a flag on the first of each."""
    inside = Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn(FIRST, F.row_number().over(inside) == 1)


def numbers(batch: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    """A column as doubles; null: not a number."""
    return np.asarray(batch.column(column).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(column).to_numpy(), float)


def begins(batch: pa.RecordBatch) -> np.ndarray:
    return np.flatnonzero(batch.column(FIRST).to_numpy(zero_copy_only=False))


def whole_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole keys, and where each key begins and ends in its table. Only a key that goes over the end of a batch waits."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        at = np.flatnonzero(table.column(FIRST).to_numpy()).tolist()
        return table, list(zip(at, [*at[1:], len(table)], strict=True))

    for batch in batches:
        at = begins(batch)
        if not len(at):
            held.append(batch)
            continue
        last = int(at[-1])
        done, held = [*held, batch.slice(0, last)], [batch.slice(last)]
        if sum(map(len, done)):
            yield joined(done)
    if sum(map(len, held)):
        yield joined(held)
