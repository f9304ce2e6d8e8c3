"""Quality: required columns, validity, blank and batch guards, profile of a labelled table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.functions.text import is_blank, token_count


def missing_columns(df: DataFrame, required: list[str] | None = None) -> list[str]:
    """All required columns that the table lacks, in required order."""
    return [c for c in required or C.REQUIRED_COLUMNS if c not in df.columns]


def require_columns(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """The table itself, or an error that names every missing column."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return df


def column_check(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """One row per required column: ``column_name, present``."""
    wanted = required or C.REQUIRED_COLUMNS
    rows = [(c, c in df.columns) for c in wanted]
    return df.sparkSession.createDataFrame(rows, "column_name string, present boolean")


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class, nulls dropped, most frequent first."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label)
    return counts.agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), label)


def language_counts(df: DataFrame, language: str = "language") -> DataFrame:
    """Rows per language, nulls dropped, most frequent first."""
    return class_counts(df, language)


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row with the number of nulls of each required column."""
    return df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns or C.REQUIRED_COLUMNS]
    )


def text_length_stats(df: DataFrame, text: str = "email_text", mode: str = "compat") -> DataFrame:
    """Mean, longest and shortest text in code points.

    ``compat`` counts a null text as the three characters of ``nan``; ``strict`` skips nulls.
    """
    if mode not in ("compat", "strict"):
        raise ValueError(f"unknown mode: {mode}")
    value = F.coalesce(F.col(text), F.lit("nan")) if mode == "compat" else F.col(text)
    return df.select(F.length(value).alias("_len")).agg(
        F.avg("_len").alias("text_len_mean"),
        F.max("_len").alias("text_len_max"),
        F.min("_len").alias("text_len_min"),
    )


def validity(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: ``n_rows, all_labels_valid, is_valid``.

    Valid means that every label is 0 or 1 (a null is not) and that there are more than ten rows.
    """
    good = F.coalesce(F.col(label).isin(C.VALID_LABELS), F.lit(False))
    return (
        df.agg(F.count("*").alias("n_rows"), F.bool_and(good).alias("_all"))
        .select(
            "n_rows",
            F.coalesce("_all", F.lit(True)).alias("all_labels_valid"),
        )
        .withColumn(
            "is_valid", F.col("all_labels_valid") & (F.col("n_rows") > C.MIN_ROWS_EXCLUSIVE)
        )
    )


def validation_report(df: DataFrame) -> DataFrame:
    """The whole report as ``section, key, value`` (text values).

    One scan: the table is reduced to one row per (label, language) with a map-side combined
    aggregate, and every section is read off that small table.
    """
    spark = df.sparkSession
    missing = missing_columns(df)
    if missing:
        rows = [("error", "", f"the table has no column {missing[0]}")]
        return spark.createDataFrame(rows, "section string, key string, value string")
    length = F.length(F.coalesce("email_text", F.lit("nan")))
    bad_label = ~F.coalesce(F.col("label").isin(C.VALID_LABELS), F.lit(False))
    cells = df.groupBy("label", "language").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("email_text").isNull()).alias("no_text"),
        F.count_if(F.col("language").isNull()).alias("no_language"),
        F.count_if(F.col("label").isNull()).alias("no_label"),
        F.count_if(bad_label).alias("bad_labels"),
        F.sum(length).alias("len_sum"),
        F.max(length).alias("len_max"),
        F.min(length).alias("len_min"),
    )
    # A row of zeros, so that an empty table still has totals.
    counted = ["n", "no_text", "no_language", "no_label", "bad_labels"]
    zero = spark.range(1).select(*[F.lit(0).cast("bigint").alias(c) for c in counted])
    cells = cells.unionByName(zero, allowMissingColumns=True)
    totals = cells.groupingSets(
        [[F.col("label")], [F.col("language")], []], F.col("label"), F.col("language")
    ).agg(
        F.grouping("label").alias("over_labels"),
        F.grouping("language").alias("over_languages"),
        *[F.sum(c).alias(c) for c in counted],
        (F.sum("len_sum") / F.sum("n")).alias("len_mean"),
        F.max("len_max").alias("len_max"),
        F.min("len_min").alias("len_min"),
    )

    def entry(section: str, key, value):
        return F.struct(
            F.lit(section).alias("section"),
            (F.lit(key) if isinstance(key, str) else key.cast("string")).alias("key"),
            value.cast("string").alias("value"),
        )

    valid = (F.col("bad_labels") == 0) & (F.col("n") > C.MIN_ROWS_EXCLUSIVE)
    whole = F.array(
        entry("missing_values", "email_text", F.col("no_text")),
        entry("missing_values", "language", F.col("no_language")),
        entry("missing_values", "label", F.col("no_label")),
        entry("text_len", "mean", F.col("len_mean")),
        entry("text_len", "max", F.col("len_max")),
        entry("text_len", "min", F.col("len_min")),
        entry("rows", "total", F.col("n")),
        entry("valid", "", valid),
        entry("error", "", F.when(~valid, F.lit(C.UNFIT_TABLE))),
    )
    entries = (
        F.when((F.col("over_labels") == 1) & (F.col("over_languages") == 1), whole)
        .when(
            F.col("over_languages") == 1,
            F.array(entry("class_counts", F.col("label"), F.col("n"))),
        )
        .otherwise(F.array(entry("language_counts", F.col("language"), F.col("n"))))
    )
    return totals.select(F.inline(entries)).where(
        F.col("key").isNotNull() & F.col("value").isNotNull()
    )


def validate_emails(df: DataFrame) -> tuple[bool, DataFrame]:
    """Whether the table is fit for training, and its report."""
    report = validation_report(df)
    if missing_columns(df):
        return False, report
    return bool(validity(df).first()["is_valid"]), report


def reject_blank(df: DataFrame, text: str = "email_text") -> tuple[DataFrame, DataFrame]:
    """Rows that can be scored, and a quarantine of ``email_id, reason``."""
    blank = is_blank(F.col(text))
    quarantine = df.where(blank).select("email_id", F.lit("EMPTY_TEXT").alias("reason"))
    return df.where(~blank), quarantine


def batch_reason(df: DataFrame, emails: str = "emails") -> DataFrame:
    """Add ``reason`` to batch requests: null when accepted."""
    size = F.coalesce(F.size(emails), F.lit(0))
    return df.withColumn(
        "reason",
        F.when(size <= 0, "EMPTY_BATCH").when(size > C.MAX_BATCH_EMAILS, "BATCH_TOO_LARGE"),
    )


def guard_batches(df: DataFrame, emails: str = "emails") -> tuple[DataFrame, DataFrame]:
    """Batch requests of 1 to 100 mails, and the rejected ones with a reason."""
    checked = batch_reason(df, emails)
    accepted = checked.where(F.col("reason").isNull()).drop("reason")
    return accepted, checked.where(F.col("reason").isNotNull()).drop(emails)


def class_slices(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: number of phishing and of legitimate mails."""
    return df.agg(
        F.count_if(F.col(label) == 1).alias("n_phishing"),
        F.count_if(F.col(label) == 0).alias("n_legitimate"),
    )


def token_length_histogram(
    df: DataFrame,
    text: str = "email_text",
    language: str = "language",
    width: int = 32,
    max_len: int = C.MAX_SEQ_LEN,
) -> DataFrame:
    """Mails per language and token-count bin, and how many of them exceed ``max_len``."""
    n = F.col("_tokens")
    return (
        df.select(language, token_count(F.col(text)).alias("_tokens"))
        .groupBy(language, F.expr(f"cast(_tokens div {int(width)} as bigint)").alias("bin"))
        .agg(F.count("*").alias("n_rows"), F.count_if(n > max_len).alias("n_truncated"))
    )


def token_length_summary(
    df: DataFrame,
    text: str = "email_text",
    language: str = "language",
    max_len: int = C.MAX_SEQ_LEN,
) -> DataFrame:
    """Per language: mail count, median and 95th percentile of tokens, share truncated.

    Token counts are integers with few distinct values, so they are counted first and the exact
    percentile is taken from those weighted counts.
    """
    counts = (
        df.select(language, token_count(F.col(text)).alias("_tokens"))
        .groupBy(language, "_tokens")
        .agg(F.count("*").alias("_n"))
    )
    points = counts.groupBy(language).agg(
        F.sum("_n").alias("n_rows"),
        F.expr("percentile(_tokens, 0.5, _n)").alias("tokens_p50"),
        F.expr("percentile(_tokens, 0.95, _n)").alias("tokens_p95"),
        F.coalesce(F.sum(F.when(F.col("_tokens") > max_len, F.col("_n"))), F.lit(0)).alias("_cut"),
    )
    return points.withColumn("share_truncated", F.col("_cut") / F.col("n_rows")).drop("_cut")


