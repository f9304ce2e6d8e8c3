"""Row identity for tables without an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.session import shared_path

DIGEST, PLACE = "_digest", "_place"
_PART_BITS = 33  # of monotonically_increasing_id: task number above, row number below


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 over the fields of a row that are not null, by name.

    Name and value each go in with their length before them, so fields never run together, and an
    empty text differs from an absent one. Columns count in the order of their names; a column that
    is null in a row has no part in it, so a table that gains a column keeps its digests.
    """

    def sized(text: Column) -> Column:
        return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)

    def field(name: str) -> Column:
        value = F.col(f"`{name}`")
        nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
        text = F.to_json(F.struct(value), {"ignoreNullFields": "false"}) if nested else value.cast("string")
        return F.when(value.isNotNull(), F.concat(sized(F.lit(name)), sized(text))).otherwise(F.lit(""))

    return F.sha2(F.concat(F.lit(""), *[field(c) for c in sorted(columns)]), 256)


def number_copies(placed: DataFrame) -> DataFrame:
    """``_place, _number`` of every row whose digest occurs more than once: 1, 2, 3... by place.

    ``placed`` holds ``_digest, _place`` only. Places are counted within each task's rows first and
    the counts are added up over the tasks before, so a digest that fills the table is numbered in
    as many tasks as its rows came from.
    """
    part = F.shiftright(PLACE, _PART_BITS)
    counts = placed.groupBy(DIGEST, part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(DIGEST).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        DIGEST, "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.sum("_n").over(Window.partitionBy(DIGEST)).alias("_copies"),
    ).where("_copies > 1")
    inside = Window.partitionBy(DIGEST, "_part").orderBy(PLACE)
    return (
        placed.withColumn("_part", part)
        .join(bases, [DIGEST, "_part"])
        .select(DIGEST, PLACE, (F.col("_base") + F.row_number().over(inside)).alias("_number"))
    )


def placed_rows(df: DataFrame, columns: list[str], path: str) -> DataFrame:
    """``df`` with ``_digest`` and ``_place``, stored at ``path`` so that both stay as they are."""
    df.withColumns({DIGEST: row_digest(df, columns), PLACE: F.monotonically_increasing_id()}).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def identified(placed: DataFrame, id_col: str, taken: DataFrame | None = None) -> DataFrame:
    """``placed`` (see :func:`placed_rows`) with ``id_col`` and ``_digest, _number``.

    ``taken`` (``_digest, _taken``) says how many numbers of a digest are used already. Only
    digests and places are shuffled; the rows meet the few numbers that are not 1, which Spark
    broadcasts or, beyond its size limit, joins by place.
    """
    narrow = placed.select(DIGEST, PLACE)
    numbers = number_copies(narrow)
    if taken is not None:
        known = narrow.join(taken, DIGEST)
        numbers = (
            known.join(numbers.select(PLACE, "_number"), PLACE, "left")
            .select(PLACE, (F.coalesce("_number", F.lit(1)) + F.col("_taken")).alias("_number"))
            .unionByName(numbers.join(taken, DIGEST, "left_anti").select(PLACE, "_number"))
        )
    path = shared_path(placed.sparkSession, "copies")
    numbers.select(PLACE, "_number").where("_number > 1").write.parquet(path)
    numbers = placed.sparkSession.read.parquet(path)
    number = F.coalesce("_number", F.lit(1).cast("bigint"))
    return (
        placed.join(numbers, PLACE, "left")
        .withColumn("_number", number)
        .withColumn(id_col, F.concat_ws("-", DIGEST, F.col("_number").cast("string")))
        .drop(PLACE)
    )


def with_email_id(df: DataFrame, id_col: str = "email_id") -> DataFrame:
    """Add ``id_col``: SHA-256 of the row (:func:`row_digest`), a dash and its occurrence from 1.

    The id is never null, unique, and the same for any partitioning or file order; equal rows are
    interchangeable, and every row keeps its own fields. The rows are stored once in the shared
    folder and read from there. A column ``id_col`` that is already there is replaced.
    """
    columns = [c for c in df.columns if c != id_col]
    placed = placed_rows(df.select(*[F.col(f"`{c}`") for c in columns]), columns, shared_path(df.sparkSession, "rows"))
    return identified(placed, id_col).select(id_col, *[F.col(f"`{c}`") for c in columns])
