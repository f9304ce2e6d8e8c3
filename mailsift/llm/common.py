"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.session import bound_batches, ship_package  # noqa: F401

#: A word: a maximal run of characters other than these six (space, tab to carriage return).
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def map_stream(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_batches(
    df: DataFrame,
    setup: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Apply a function to each Arrow batch; ``setup`` runs once per task and makes the function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return map_stream(df, run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


class BoundedCache(dict):
    """A dictionary that computes a missing value and is emptied when it holds ``limit`` keys."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class TwoGenerations(dict):
    """A bounded dictionary: full, it becomes the old generation, from which used keys come back."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def missing(self, wanted: set) -> set:
        """The keys that neither generation has; all others are then in the young one."""
        need = wanted - self.keys()
        if len(self) + len(need) > self.limit:
            self.old = dict(self)
            self.clear()
            need = wanted
        again = need & self.old.keys()
        self.update((k, self.old[k]) for k in again)
        return need - again


_INDEX_BITS = 33  # monotonically_increasing_id: task number above, row number of the task below


def place_in_order(df: DataFrame, order: list[Column], path: str) -> DataFrame:
    """``df`` sorted over all tasks and stored at ``path``, with ``part`` and ``idx``.

    Parts are ordered ranges and ``idx`` counts the rows of a part from 0, so the place of a row is
    the size of all parts before its own plus ``idx``. Rows that are equal in ``order`` are told
    apart by their place in the input, so many copies of a row do not make one large part.
    """
    by = [*order, F.col("_row")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        df.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .drop("_row")
        .withColumn("_at", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    stored = df.sparkSession.read.parquet(path)
    return stored.withColumns(
        {
            "part": F.shiftright("_at", _INDEX_BITS),
            "idx": F.col("_at").bitwiseAND((1 << _INDEX_BITS) - 1),
        }
    ).drop("_at")
