"""Monitoring counts over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SKETCH_K = 800  # size of a sketch
RANK_ERROR = 0.0035  # of a sketch of this size


def monitor(
    df: DataFrame,
    ts: str = "scored_at",
    failed: Column | None = None,
    value: str = "process_time_ms",
    width: str = "1 hour",
    watermark: str | None = "10 minutes",
    percentiles: tuple[float, ...] = (),
) -> DataFrame:
    """Records, share of failures and mean duration per tumbling window.

    ``percentiles`` adds a column ``p50, p95, ...`` each: a value whose rank is off by
    ``RANK_ERROR`` of the window's records at most (in 99 of 100 windows), from a KLL sketch. The sketch is
    what a window keeps as state, of bounded size whatever number of records it has.

    Batch or streaming. On a stream the watermark bounds the state: windows are closed once no
    record for them is expected any more. A time without zone is taken as it stands in batch and
    made a timestamp on a stream, which is what watermarks need.
    """
    failed = (F.col("status") != "OK") if failed is None else failed
    if df.isStreaming:
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
        if watermark:
            df = df.withWatermark(ts, watermark)
    return (
        df.groupBy(F.window(ts, width).alias("w"))
        .agg(
            F.count("*").alias("n_rows"),
            F.avg(F.when(failed, 1.0).otherwise(0.0)).alias("error_share"),
            F.avg(value).alias("mean_value"),
            F.expr(f"kll_sketch_agg_double(cast(`{value}` as double), {SKETCH_K})").alias("sketch"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "n_rows",
            "error_share",
            "mean_value",
            *[F.expr(f"kll_sketch_get_quantile_double(sketch, {p}D)").alias(f"p{p * 100:g}") for p in percentiles],
        )
    )
