"""Decisions: label, confidence, verdict, recommendation, display forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift import constants as C

PHISHING = "PHISHING"
LEGITIMATE = "LEGITIMATE"


def classify(score: Column, threshold: float | Column = C.DECISION_THRESHOLD) -> Column:
    """``PHISHING`` when the score is strictly above the threshold."""
    return F.when(score > threshold, PHISHING).otherwise(LEGITIMATE)


def confidence(score: Column, label: Column) -> Column:
    """The score for a phishing label, its complement otherwise."""
    return F.when(label == PHISHING, score).otherwise(1.0 - score)


def confidence_at(score: Column, threshold: float | Column) -> Column:
    """The score when strictly above the threshold, its complement otherwise."""
    return F.when(score > threshold, score).otherwise(1.0 - score)


def with_decision(
    df: DataFrame,
    score: str = "raw_score",
    threshold: float = C.DECISION_THRESHOLD,
    mode: str = "compat",
) -> DataFrame:
    """Add ``label, confidence, threshold, is_phishing``.

    ``compat``: the threshold moves only ``confidence``; the label is always cut at 0.5.
    ``strict``: the threshold moves the label as well.
    """
    if mode not in ("compat", "strict"):
        raise ValueError(f"unknown mode: {mode}")
    cut = C.DECISION_THRESHOLD if mode == "compat" else threshold
    return df.withColumns(
        {
            "label": classify(F.col(score), cut),
            "confidence": confidence_at(F.col(score), threshold),
            "threshold": F.lit(float(threshold)),
        }
    ).withColumn("is_phishing", F.col("label") == PHISHING)


def is_risky(label: Column, heuristic: Column) -> Column:
    """Final verdict: a phishing label or a heuristic score strictly above 0.4.

    A missing prediction counts as legitimate.
    """
    return (F.coalesce(label, F.lit(LEGITIMATE)) == PHISHING) | (
        heuristic > C.RISK_THRESHOLD
    )


def recommendation(risky: Column) -> Column:
    """Headline shown with the verdict."""
    return F.when(risky, C.RISKY_HEADLINE).otherwise(C.SAFE_HEADLINE)


def next_steps(risky: Column) -> Column:
    """Advice shown under the headline."""
    return F.when(risky, C.RISKY_STEPS).otherwise(C.SAFE_STEPS)


def clamp(score: Column) -> Column:
    """Score limited to [0, 1]; a missing score stays missing."""
    return F.when(score.isNotNull(), F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)))


def _rounded(value: Column, digits: int) -> Column:
    """The double's exact binary value rounded to ``digits`` decimals, ties to even, as a whole number.

    The product with the power of ten is a double and its exact error: the value is cut in two
    halves of 26 bits whose products are exact, and the error decides where the double is a tie.
    """
    scale = F.lit(float(10**digits))
    wide = value * F.lit(134217729.0)  # 2 ** 27 + 1
    high = wide - (wide - value)
    product = value * scale
    error = (high * scale - product) + (value - high) * scale
    whole = F.floor(product)
    over = product - whole.cast("double") - F.lit(0.5)
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    return whole + F.when(up, 1).otherwise(0)


def _fixed(value: Column, digits: int) -> Column:
    number = _rounded(F.abs(value), digits)
    sign = F.when((value < 0) & (number > 0), "-").otherwise("")
    power = 10**digits
    after = F.lpad((number % power).cast("string"), digits, "0")
    return F.concat(sign, F.floor(number / F.lit(power)).cast("string"), F.lit("."), after)


def display_score(score: Column, digits: int = 3) -> Column:
    """Score as text with a fixed number of decimals; for display only.

    Rounds the binary value of the double, ties to even; a null score gives null.
    """
    return _fixed(score, digits)


def display_percent(score: Column) -> Column:
    """Score as a percentage with one decimal, rounded in the same way; for display only."""
    return F.concat(_fixed(score * 100.0, 1), F.lit("%"))
