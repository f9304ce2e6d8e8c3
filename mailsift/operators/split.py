"""Stratified split, seeded shuffle, batching and batch flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.operators.ordering import (
    _match,
    global_rank,
    hash_bucket,
    shuffle_key,
    values_at_ranks,
)
from mailsift.session import materialize, stored


def split_shares(train: float, val: float, test: float) -> tuple[float, float]:
    """Share of train in the whole and of validation in the rest, sizes scaled to sum to one."""
    total = train + val + test
    if min(train, val, test) < 0 or total <= 0:
        raise ValueError("split sizes must be non-negative and not all zero")
    train, val, test = train / total, val / total, test / total
    return train, (val / (val + test) if val + test > 0 else 0.0)


def stratified_split(
    df: DataFrame,
    train: float = 0.7,
    val: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
    label: str = "label",
    id_col: str = "email_id",
) -> DataFrame:
    """Add ``split``: exact, seeded, disjoint and complete within each class.

    Rows of a class are ordered by ``md5(seed:id)``; the first ``floor(n * train)`` are train,
    the next ``floor(rest * val / (val + test))`` are validation, the rest are test.

    The two cut-off keys of each class are found first, from the id and label columns only. The
    table itself is then labelled by comparing its own key with the cut-offs: a map-side step, so
    the mail texts are never shuffled.
    """
    keys = df.select(label, shuffle_key(id_col, seed).alias("_key")).withColumn("_weight", F.lit(1))
    keyed = df.withColumn("_key", shuffle_key(id_col, seed)).withColumn("_class", F.col(label))
    return _cut(keyed, keys, label, split_shares(train, val, test)).drop("_key", "_class")


def _cut(keyed: DataFrame, keys: DataFrame, label: str, shares: tuple[float, float]) -> DataFrame:
    """``keyed`` (with ``_key, _class``) with ``split``; the two cut-off keys of each class are found
    from ``keys`` (class ``label``, ``_key``, and ``_weight`` rows that the key stands for)."""
    train_share, val_share = shares

    def train_rank(n):
        return F.floor(n.cast("double") * F.lit(train_share))

    def val_rank(n):
        rest = (n - train_rank(n)).cast("double")
        return train_rank(n) + F.floor(rest * F.lit(val_share))

    ranked = values_at_ranks(
        keys.withColumn("_bucket", hash_bucket("_key")), [label], "_bucket", "_key", "_weight",
        {"train": train_rank, "val": val_rank},
    )
    cuts = ranked.groupBy(F.col(label).alias("_of")).agg(
        F.max(F.when(F.col("name") == "train", F.col("_key"))).alias("_train_cut"),
        F.max(F.when(F.col("name") == "val", F.col("_key"))).alias("_val_cut"),
    )
    # A class too small for any cut has no row above; the left side keeps it as test.
    joined = keyed.join(stored(cuts), F.col("_class").eqNullSafe(F.col("_of")), "left")
    split = (
        F.when(F.col("_key") <= F.col("_train_cut"), "train")
        .when(F.col("_key") <= F.col("_val_cut"), "val")
        .otherwise("test")
    )
    return joined.withColumn("split", split).drop("_of", "_train_cut", "_val_cut")


def text_digest(text: str) -> Column:
    """SHA-256 of a text; a null text has a digest of its own."""
    return F.coalesce(F.sha2(F.col(text), 256), F.lit("null"))


def grouped_split(
    df: DataFrame,
    train: float = 0.7,
    val: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
    label: str = "label",
    text: str = "email_text",
) -> DataFrame:
    """Add ``split`` so that equal texts are never in two splits; no id is needed.

    Equal texts are one group with the class that most of its rows have (ties: the smaller
    label; null counts last). Within a class the groups are ordered by ``md5(seed:digest)``, and a group is
    in the split in which its first row falls, as :func:`stratified_split` would cut the rows: so a split
    has at least its share of the class, and at most the rest of one group more.

    Digests are what is shuffled, one row per text and task. The texts are labelled where they are read,
    by comparing their own key with the cut-off keys; only the groups with more than one label are
    joined to them, which Spark does without a shuffle while they are few.
    """
    digest = text_digest(text)
    counts = df.groupBy(digest.alias("_digest"), F.col(label).alias("_own")).agg(F.count("*").alias("_n"))
    most = F.max_by("_own", F.struct("_n", F.col("_own").isNotNull(), -F.col("_own"))).alias("_class")
    groups = counts.groupBy("_digest").agg(
        most, F.sum("_n").alias("_weight"), (F.count("*") > 1).alias("_mixed")
    )
    groups = materialize(groups)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_digest")))
    keys = groups.select(F.col("_class").alias(label), key.alias("_key"), "_weight")
    mixed = groups.where("_mixed").select("_digest", F.col("_class").alias("_most"), F.lit(True).alias("_found"))
    keyed = (
        df.withColumn("_digest", digest)
        .join(mixed, "_digest", "left")
        .withColumn("_class", F.when(F.col("_found"), F.col("_most")).otherwise(F.col(label)))
        .withColumn("_key", key)
    )
    found = _cut(keyed, keys, label, split_shares(train, val, test))
    return found.select(*df.columns, "split")


def split_leakage(df: DataFrame, text: str = "email_text") -> DataFrame:
    """One row: ``n_texts`` different texts, ``n_leaked`` of them in more than one split, ``n_rows`` these have."""
    texts = df.groupBy(text_digest(text).alias("_digest")).agg(
        F.count("*").alias("_n"), (F.min("split") != F.max("split")).alias("_leaked")
    )
    return texts.agg(
        F.count("*").alias("n_texts"),
        F.count_if(F.col("_leaked")).alias("n_leaked"),
        F.coalesce(F.sum(F.when(F.col("_leaked"), F.col("_n"))), F.lit(0)).alias("n_rows"),
    )


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows per split."""
    return df.groupBy("split").agg(F.count("*").alias("n_rows"))


def shuffled(df: DataFrame, seed: int = 42, id_col: str = "email_id") -> DataFrame:
    """All rows in seeded random order: a range-partitioned sort by ``md5(seed:id)``."""
    return (
        df.withColumn("_key", shuffle_key(id_col, seed)).orderBy("_key", id_col).drop("_key")
    )


def batch_rows(
    df: DataFrame,
    size: int = C.BATCH_SIZE,
    seed: int | None = 42,
    id_col: str = "email_id",
) -> DataFrame:
    """Add ``batch_id`` and ``batch_pos``: consecutive groups of ``size``, the last may be short.

    With a seed the rows are taken in shuffled order, with ``seed=None`` in order of the id.
    """
    ranked = global_rank(df, id_col, seed, rank="_rank")
    return ranked.withColumns(
        {
            "batch_id": F.expr(f"(_rank - 1) div {int(size)}"),
            "batch_pos": F.expr(f"(_rank - 1) % {int(size)}"),
        }
    ).drop("_rank")


def flatten_batches(df: DataFrame, emails: str = "emails") -> DataFrame:
    """One row per mail of a batch request: the other columns, ``pos`` and ``email_text``."""
    keep = [c for c in df.columns if c != emails]
    return df.select(*keep, F.posexplode(emails).alias("pos", "email_text"))
