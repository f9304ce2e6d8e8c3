"""Mixing of sources to target weights by a low-discrepancy schedule of slots.

Sources in order of code points, null last, weigh ``WEIGHTS`` in turn and share all words. A target stops
at ``MAX_EPOCHS`` times its source's words; the excess is shared again by weight (:func:`targets`).

*Schedule.* Slot i stands at the fractional part of i times the golden ratio, as a 64-bit fraction.
Mapped through the sources' cumulative targets, any run of slots holds each source nearly in
proportion. A slot's rank in its source is counted in chunks of slots: counts per chunk and source
are added up over the chunks before, and ranks within a chunk follow from a stable sort.

*Blocks.* Each source is shuffled by a seeded hash of ids and texts and read as one cyclic stream of words,
cut into blocks of equal length (the target's words over the source's slots, rounded up; the last
may be shorter). Slot rank r takes block r, a join on (source, r) in which every key is one slot,
so a large source is spread like any other. The words taken of a source are its target, floored.
Positions in a stream are added up in two steps, by hash bucket and within a bucket, so no task holds a
source.

Sizes: there is a slot for every ``BLOCK`` words, but at least ``SLOTS`` of them (at most one per
word). A source with a share below that of one or two slots may get none. The number of sources
is checked against ``MAX_SOURCES``, which bounds the table of targets on the driver and in tasks.

Defined results: a null text and one without words has size 0 and nothing is taken of it. Rows with
equal ids are rows of their own; a null id sorts first among equal hashes. An empty table has no rows. The
result is the same in every run and for any partitioning. Other columns, also those named like
results, are neither read nor returned.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailsift.llm.common import SPACE, map_stream
from mailsift.session import shared_path

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK = 2_048  # words of a slot, about
SLOTS = 65_536
CHUNK_BITS = 14  # slots ranked together
BUCKET_ROWS = 1_024  # rows of a source in one hash bucket, about
MAX_SOURCES = 100_000
SEED = 7
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # the golden ratio's fraction times 2 ** 64


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> list[float]:
    """Words to take of each source: shares by weight, none above ``most`` times its size."""
    own = [weights[i % len(weights)] for i in range(len(sizes))]
    left, weight = sum(sizes), sum(own)
    out = [0.0] * len(sizes)
    # The source that reaches its limit first has the least limit per weight.
    order = sorted(range(len(sizes)), key=lambda i: (Fraction(most * sizes[i], own[i]), i))
    for at, i in enumerate(order):
        if most * sizes[i] * weight > own[i] * left:
            for j in order[at:]:
                out[j] = own[j] * left / weight
            break
        out[i] = float(most * sizes[i])
        left, weight = left - most * sizes[i], weight - own[i]
    return out


def n_slots(words: int, block: int = BLOCK, least: int = SLOTS) -> int:
    return max(-(-words // block), min(words, least))


def schedule(spark: SparkSession, wanted: list[float], slots: int, path: str) -> DataFrame:
    """``slot, number, rank``: the source of each slot and its rank among that source's slots."""
    total = sum(map(Fraction, wanted)) or Fraction(1)
    bounds, sum_so_far = [], Fraction(0)
    for w in wanted:
        sum_so_far += Fraction(w)
        bounds.append(min((1 << 64) - 1, int(sum_so_far / total * (1 << 64))))
    cumulative = spark.sparkContext.broadcast(np.array(bounds, dtype=np.uint64))
    size = 1 << CHUNK_BITS

    def sources_of(chunk: int) -> tuple[np.ndarray, np.ndarray]:
        slot = np.arange(chunk << CHUNK_BITS, min((chunk << CHUNK_BITS) + size, slots), dtype=np.uint64)
        at = np.searchsorted(cumulative.value, slot * _GOLDEN, side="right")
        return slot, np.minimum(at, len(cumulative.value) - 1)

    def count(batches):
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                number, n = np.unique(sources_of(chunk)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), chunk)), pa.array(number), pa.array(n)], ["chunk", "number", "n"]
                )

    def rank(batches):
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                slot, number = sources_of(chunk)
                order = np.argsort(number, kind="stable")
                found, first, n = np.unique(number[order], return_index=True, return_counts=True)
                place = np.empty(len(slot), dtype=np.int64)
                place[order] = np.arange(len(slot)) - np.repeat(first, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(slot), chunk)), pa.array(slot.astype(np.int64)), pa.array(number),
                        pa.array(place),
                    ],
                    ["chunk", "slot", "number", "place"],
                )

    chunks = spark.range(-(-slots // size))
    before = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    map_stream(chunks, count, "chunk bigint, number bigint, n bigint").withColumn(
        "before", F.coalesce(F.sum("n").over(before), F.lit(0))
    ).write.parquet(path)
    counts = spark.read.parquet(path)
    places = map_stream(chunks, rank, "chunk bigint, slot bigint, number bigint, place bigint")
    return places.join(counts, ["chunk", "number"]).select("slot", "number", (F.col("before") + F.col("place")).alias("rank"))


def shuffled(sized: DataFrame, rows: int) -> DataFrame:
    """``sized`` (``number, id, size, hash``) with ``start``, the place of a row in its source's stream."""
    bits = max(1, (-(-rows // BUCKET_ROWS) - 1).bit_length())
    bucket = F.conv(F.substring("hash", 1, 12), 16, 10).cast("bigint")
    own = sized.withColumn("bucket", F.shiftright(bucket, 48 - min(bits, 48)))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("number", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select("number", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = (
        Window.partitionBy("number", "bucket")
        .orderBy("hash", "id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = own.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(sums, ["number", "bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("bucket", "base")


class Mix:
    """The sized documents, the targets of their sources, and the mix."""

    def __init__(
        self, df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        seed: int = SEED, block: int = BLOCK, least_slots: int = SLOTS,
    ):
        spark = df.sparkSession
        path = shared_path(spark, "mixing")
        id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
        words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(f"[^{SPACE}]+")), F.lit(0))
        sized = df.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.cast("bigint").alias("size"),
            F.sha2(F.concat(F.lit(f"{seed}:"), id_text, F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))), 256).alias("hash"),
        )
        sized.write.parquet(f"{path}/sized")
        sized = spark.read.schema(sized.schema).parquet(f"{path}/sized")
        found = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        found = found.orderBy(F.asc_nulls_last("source")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        wanted = targets([r.words for r in found])
        slots = n_slots(sum(r.words for r in found), block, least_slots)
        schedule(spark, wanted, slots, f"{path}/chunks").write.parquet(f"{path}/schedule")
        self.schedule = spark.read.parquet(f"{path}/schedule")
        per_source = {r.number: r.n for r in self.schedule.groupBy("number").agg(F.count("*").alias("n")).collect()}
        table = [
            (i, r.source, r.words, t, int(t) if i in per_source else 0, max(1, -(-int(t) // per_source.get(i, 1))))
            for i, (r, t) in enumerate(zip(found, wanted))
        ]
        self.sources = spark.createDataFrame(
            table, "number bigint, source string, source_size bigint, target double, goal bigint, block bigint"
        )
        rows = max((r.rows for r in found), default=0)
        numbered = sized.join(F.broadcast(self.sources), sized["source"].eqNullSafe(self.sources["source"])).select(
            "number", "id", "size", "hash", "source_size", "target", "goal", "block"
        )
        shuffled(numbered, rows).write.parquet(f"{path}/placed")
        self.placed = spark.read.parquet(f"{path}/placed")

    def pieces(self) -> DataFrame:
        """``number, start, rank, epoch, from_word, to_word``: the parts of documents in each block of a stream.

        ``epoch`` counts the readings of a source from 0; words are counted in the document. Every
        row with words and a goal has a piece, all of it in blocks that the goal covers.
        """
        epochs = self.placed.where("size > 0 and start < goal").withColumn(
            "epoch", F.explode(F.sequence(F.lit(0), ((F.col("goal") - 1 - F.col("start")) / F.col("source_size")).cast("int")))
        )
        first = F.col("start") + F.col("epoch") * F.col("source_size")
        end = F.least(first + F.col("size"), "goal")
        parts = epochs.withColumns({"first": first, "end": end}).withColumn(
            "rank", F.explode(F.sequence(F.expr("first div block"), F.expr("(end - 1) div block")))
        )
        begin = F.greatest("first", F.col("rank") * F.col("block"))
        stop = F.least("end", (F.col("rank") + 1) * F.col("block"))
        return parts.select(
            "number", "id", "start", "rank", "epoch", (begin - F.col("first")).alias("from_word"),
            (stop - F.col("first")).alias("to_word"),
        )

    def mixed(self) -> DataFrame:
        """``slot, number, id, start, from_word, to_word``: the mix; slots in order are its order."""
        return self.schedule.join(self.pieces(), ["number", "rank"]).drop("rank")


def mix_sources(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``id_col, size, source_size, target, taken``, one row per row of ``df``."""
    mix = Mix(df, id_col, source_col, text_col)
    taken = mix.mixed().groupBy("number", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    # A row with words is alone at its start; rows without any may stand at the same one.
    with_words = mix.placed.where("size > 0").join(taken, ["number", "start"], "left")
    none = mix.placed.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
    out = ["id", "size", "source_size", "target", "taken"]
    rows = with_words.select(out).unionAll(none.select(out))
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )
