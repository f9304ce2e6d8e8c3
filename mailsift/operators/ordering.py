"""Exact ranks, running sums and order statistics without a single-task sort.

A plain ``row_number() over (order by ...)`` puts every row in one task, and a window partitioned
by a class label puts a third or more of all rows in one task. The operators here give the same
exact results from *ordered buckets*: a bucket is a function of the ordering value that never
decreases, so the rank of a row is its rank inside its bucket plus the sizes of the buckets before
it. Bucket sizes are a map-side combined count; only the rows inside one bucket are sorted
together.

Two kinds of bucket are used: a prefix of an MD5 hash (uniform by construction) and ranges bounded
by approximate percentiles of the *distinct* values (balanced even where one value holds a third
of all rows). The bounds steer only how the work is divided; results are exact for any bounds.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mailsift.session import materialize, stored

HASH_BUCKET_DIGITS = 4
RANGE_BUCKETS = 256


def shuffle_key(id_col: str, seed: int) -> Column:
    """Seeded pseudo-random ordering key: MD5 of ``seed:id``; the id must be unique.

    A null id is an error at run time: rows without one cannot be told apart.
    """
    present = F.coalesce(F.col(id_col).cast("string"), F.raise_error(F.lit(f"null {id_col}")))
    return F.md5(F.concat(F.lit(f"{seed}:"), present))


def hash_bucket(key: str, digits: int = HASH_BUCKET_DIGITS) -> Column:
    """Ordered bucket of an MD5 key: its first hexadecimal digits, 16 ** digits buckets."""
    return F.substring(key, 1, digits)


def with_range_bucket(
    df: DataFrame, value: str, bucket: str = "_bucket", n_buckets: int | None = None
) -> DataFrame:
    """Add an ordered bucket number for a number or text, balanced over the rows of ``df``.

    Bounds come from one approximate-percentile aggregate, those of texts from the ranges that Spark
    deals the values out by (at most ``n_buckets`` values reach the driver). Rows with a null value
    get a null bucket.
    """
    if n_buckets is None:
        # Follows the shuffle partitions, so that ranges do not grow with the table.
        n_buckets = max(RANGE_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if isinstance(df.schema[value].dataType, StringType):
        dealt = df.select(value).where(F.col(value).isNotNull()).repartitionByRange(n_buckets, value)
        least = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(value).alias("least"))
        firsts = F.array(*[F.lit(r.least) for r in least.orderBy("least").collect()]).cast("array<string>")
        number = F.size(F.filter(firsts, lambda b: b <= F.col(value))).cast("double")
        return df.withColumn(bucket, F.when(F.col(value).isNotNull(), number))
    shares = [i / n_buckets for i in range(1, n_buckets)]
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), shares, 10_000)).first()[0]
    bounds = sorted({b for b in (found or []) if isfinite(b)})
    splits = [float("-inf"), *bounds, float("inf")]
    if len(splits) < 3:
        return df.withColumn(bucket, F.lit(0.0))
    numbered = Bucketizer(
        splits=splits, inputCol="_numeric", outputCol=bucket, handleInvalid="keep"
    ).transform(df.withColumn("_numeric", F.col(value).cast("double")))
    return numbered.drop("_numeric")


def _match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join on ``keys`` in which null keys match each other."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition).drop(*[f"_r_{k}" for k in keys])


def running_sums(
    df: DataFrame, group: list[str], bucket: str, order: list[Column], values: list[str]
) -> DataFrame:
    """Add ``cum_<value>``: the inclusive running sum of each value within its group.

    ``bucket`` must never decrease along ``order``. One shuffle, by (group, bucket): there is one
    offset per group and bucket, and they are joined without a shuffle while they are few.
    """
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        df.groupBy(*group, bucket)
        .agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
        .select(
            *group,
            bucket,
            *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
        )
    )
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    joined = _match(df, stored(offsets), [*group, bucket])
    return joined.withColumns(
        {f"cum_{v}": F.sum(v).over(inside) + F.col(f"_o_{v}") for v in values}
    ).drop(*[f"_o_{v}" for v in values])


def global_rank(
    df: DataFrame,
    id_col: str,
    seed: int | None,
    rank: str = "rank",
    digits: int = HASH_BUCKET_DIGITS,
) -> DataFrame:
    """Add the exact 1-based rank over the whole table.

    With a seed the order is the seeded shuffle, without one it is the order of the unique id, a
    number or a text.
    """
    if seed is None:
        keyed = with_range_bucket(df, id_col)
        order = [F.col(id_col)]
    else:
        keyed = df.withColumn("_key", shuffle_key(id_col, seed)).withColumn(
            "_bucket", hash_bucket("_key", digits)
        )
        order = [F.col("_key"), F.col(id_col)]
    # At most 16 ** digits (or RANGE_BUCKETS) rows: one per bucket, whatever the table holds.
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return (
        _match(keyed, F.broadcast(offsets), ["_bucket"])
        .withColumn(rank, F.row_number().over(inside) + F.col("_offset"))
        .drop("_bucket", "_offset", "_key")
    )


def values_at_ranks(
    rows: DataFrame,
    group: list[str],
    bucket: str,
    value: str,
    weight: str,
    ranks: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """The value found at given 1-based ranks of each group: columns ``group, name, value``.

    ``rows`` holds ``weight`` copies of each value; ``ranks`` maps a name to a function of the
    group size. A rank of zero gives no row. Only the rows of the buckets in which a rank falls are
    sorted.
    """
    along = Window.partitionBy(*group).orderBy(bucket)
    whole = Window.partitionBy(*group)
    totals = rows.groupBy(*group, bucket).agg(F.sum(weight).alias("_total"))
    wanted = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("bigint").alias("rank"))
                for name, rank in ranks.items()
            ]
        )
    )
    targets = (
        totals.withColumn("_upto", F.sum("_total").over(along))
        .withColumn("_n", F.sum("_total").over(whole))
        .withColumn("_want", wanted)
        .where(
            (F.col("_want.rank") > F.col("_upto") - F.col("_total"))
            & (F.col("_want.rank") <= F.col("_upto"))
        )
        .select(
            *group,
            bucket,
            F.col("_want.name").alias("name"),
            (F.col("_want.rank") - F.col("_upto") + F.col("_total")).alias("_rank"),
        )
    )
    inside = Window.partitionBy(*group, bucket, "name").orderBy(value)
    return (
        _match(rows, stored(targets), [*group, bucket])
        .withColumn("_cum", F.sum(weight).over(inside))
        .where(
            (F.col("_rank") <= F.col("_cum")) & (F.col("_rank") > F.col("_cum") - F.col(weight))
        )
        .select(*group, "name", value)
    )


def value_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Copies of each non-null value per group, stored once: ``group, value, copies``.

    Equal values are added up on the map side, so a hot value is one row from here on.
    """
    found = df.where(F.col(value).isNotNull()).groupBy(*group, value)
    return materialize(found.agg(F.count("*").alias("copies")))


def exact_percentiles(
    counts: DataFrame, group: list[str], value: str, shares: dict[str, float]
) -> DataFrame:
    """Exact percentiles with linear interpolation from ``value_counts``.

    One row per group, one column per share.
    """
    rows = with_range_bucket(counts, value)

    def position(n: Column, share: float) -> Column:
        return (n - 1).cast("double") * F.lit(share)

    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, share in shares.items():
        ranks[f"{name}:lo"] = lambda n, s=share: F.floor(position(n, s)) + 1
        ranks[f"{name}:hi"] = lambda n, s=share: F.ceil(position(n, s)) + 1
    found = values_at_ranks(rows, group, "_bucket", value, "copies", ranks)
    wide = found.groupBy(*group).agg(
        *[F.max(F.when(F.col("name") == n, F.col(value))).alias(f"_{n}") for n in ranks]
    )
    sizes = counts.groupBy(*group).agg(F.sum("copies").alias("_n"))
    joined = _match(wide, sizes, group)
    out = []
    for name, share in shares.items():
        lo, hi = F.col(f"`_{name}:lo`"), F.col(f"`_{name}:hi`")
        at = position(F.col("_n"), share)
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return joined.select(*group, *out)
