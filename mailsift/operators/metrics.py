"""Evaluation: class metrics, log loss, confusion, ROC, class weights, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.operators.ordering import (
    _match,
    exact_percentiles,
    running_sums,
    value_counts,
    with_range_bucket,
)
from mailsift.session import materialize, stored


def _ratio(part: Column, whole: Column) -> Column:
    """Part of a whole as a double, and 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion_counts(
    df: DataFrame, by: list[str], label: str = "label", score: str = "raw_score"
) -> DataFrame:
    """True and false positives and negatives; predicted positive means a score above 0.5.

    Labelled rows without a score are neither; ``n_unscored`` counts them.
    """
    positive = F.col(score) > C.DECISION_THRESHOLD
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(*by)
        .agg(
            F.count_if(positive & (F.col(label) == 1)).alias("tp"),
            F.count_if(positive & (F.col(label) != 1)).alias("fp"),
            F.count_if(~positive & (F.col(label) == 1)).alias("fn"),
            F.count_if(~positive & (F.col(label) != 1)).alias("tn"),
            F.count_if(F.col(score).isNull()).alias("n_unscored"),
        )
    )


def _rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("n_rows", tp + fp + fn + tn)
        .withColumns(
            {
                "accuracy": _ratio(tp + tn, F.col("n_rows")),
                "precision": _ratio(tp, tp + fp),
                "recall": _ratio(tp, tp + fn),
            }
        )
        .withColumn(
            "f1",
            _ratio(
                2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
        )
        .drop("tp", "fp", "fn", "tn")
    )


def class_metrics(df: DataFrame, label: str = "label", score: str = "raw_score") -> DataFrame:
    """One row: ``n_rows, n_unscored, accuracy, precision, recall, f1``; a ratio of 0/0 is 0.

    ``n_rows`` are the labelled rows with a score, which the ratios are of.
    """
    return _rates(confusion_counts(df, [], label, score))


def metrics_by_language(
    df: DataFrame, language: str = "language", label: str = "label", score: str = "raw_score"
) -> DataFrame:
    """The metrics of each language and of the whole (``scope`` = language or overall).

    The rollup runs over the per-language counts, not over the mails.
    """
    counts = confusion_counts(df, [language], label, score)
    rolled = counts.rollup(language).agg(
        F.grouping(language).alias("_whole"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "n_unscored")],
    )
    scope = F.when(F.col("_whole") == 1, "overall").otherwise("language")
    return _rates(rolled.withColumn("scope", scope).drop("_whole"))


def row_loss(label: Column, score: Column) -> Column:
    """Binary cross-entropy of one row, the probability clipped away from 0 and 1."""
    p = F.greatest(F.least(score, F.lit(1 - C.LOG_LOSS_EPSILON)), F.lit(C.LOG_LOSS_EPSILON))
    return F.when(label == 1, -F.log(p)).otherwise(-F.log(F.lit(1.0) - p))


def log_loss(df: DataFrame, label: str = "label", score: str = "raw_score") -> DataFrame:
    """Mean binary cross-entropy with probabilities clipped away from 0 and 1.

    Labelled rows without a score have no loss; ``n_unscored`` counts them.
    """
    loss = row_loss(F.col(label), F.col(score))
    scored = F.when(F.col(score).isNotNull(), loss)
    return df.where(F.col(label).isNotNull()).agg(
        F.avg(scored).alias("log_loss"), F.count_if(F.col(score).isNull()).alias("n_unscored")
    )


def roc_by_language(
    df: DataFrame,
    language: str = "language",
    label: str = "label",
    score: str = "raw_score",
) -> DataFrame:
    """True and false positive rate at every distinct score of every language.

    Mails without a label or without a score have no part in it.
    Mails are first added up per (language, score); that table is stored once, and the running
    sums over it are taken in score ranges, so a language that holds most of the mails is still
    spread over many tasks.
    """
    hit = F.col(label) == 1
    steps = materialize(
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(language, F.col(score).alias("score"))
        .agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    )
    totals = steps.groupBy(language).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    ranged = with_range_bucket(steps.withColumn("_down", -F.col("score")), "_down")
    summed = running_sums(ranged, [language], "_bucket", [F.col("_down")], ["pos", "neg"])
    return _match(summed, stored(totals), [language]).select(
        language,
        "score",
        _ratio(F.col("cum_pos"), F.col("n_pos")).alias("tpr"),
        _ratio(F.col("cum_neg"), F.col("n_neg")).alias("fpr"),
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights ``n / (k * n_class)`` over the classes present: ``label, n_class, weight``."""
    counts = (
        df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n_class"))
    )
    everything = Window.partitionBy(F.lit(0))  # one row per class
    return counts.select(
        label,
        "n_class",
        (
            F.sum("n_class").over(everything).cast("double")
            / (F.count("*").over(everything) * F.col("n_class")).cast("double")
        ).alias("weight"),
    )


def latency_summary(df: DataFrame, by: list[str], value: str = "process_time_ms") -> DataFrame:
    """Count, mean, exact 95th and 99th percentile of a duration per group."""
    counts = value_counts(df, by, value)
    n = F.sum("copies")
    means = counts.groupBy(*by).agg(
        n.alias("n_rows"), (F.sum(F.col(value) * F.col("copies")) / n).alias("mean")
    )
    points = exact_percentiles(counts, by, value, {"p95": 0.95, "p99": 0.99})
    return _match(means, points, by)
