"""Scoring: model scores with decisions, verdicts, and the batch scoring job.

Scoring is a narrow plan: no shuffle, one pass over the texts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.functions import terms
from mailsift.functions.decide import is_risky, next_steps, recommendation, with_decision
from mailsift.functions.signals import signal_counts, social_signals
from mailsift.functions.text import is_blank
from mailsift.operators.quality import guard_batches
from mailsift.operators.split import flatten_batches
from mailsift.plans.training import SIGNALS, counted, weights_of
from mailsift.sources import files
from mailsift.sources.reports import audit_rows, write_audit

OK, BLANK = "OK", "EMPTY_TEXT"

Scorer = PipelineModel | Callable[[DataFrame], DataFrame]


def linear_score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``raw_score``, the probability of class 1, as a plain column expression.

    The weights of all terms are added up without building vectors: the same number that the fitted
    pipeline gives.
    """
    margin = terms.margin("email_text", SIGNALS, weights_of(model), model.stages[-1].intercept)
    return counted(df).withColumn("raw_score", 1.0 / (1.0 + F.exp(-margin))).drop(*SIGNALS)


def score(
    df: DataFrame,
    scorer: Scorer,
    threshold: float = C.DECISION_THRESHOLD,
    mode: str = "compat",
) -> DataFrame:
    """Add ``raw_score, label, confidence, threshold, is_phishing``.

    A true label already in the table is kept as ``true_label``. ``scorer`` is a fitted pipeline,
    or any function that adds ``raw_score`` to a DataFrame.
    """
    if "label" in df.columns:
        df = df.withColumnRenamed("label", "true_label")
    scored = linear_score(df, scorer) if isinstance(scorer, PipelineModel) else scorer(df)
    return with_decision(scored, "raw_score", threshold, mode)


def verdicts(scored: DataFrame) -> DataFrame:
    """Add the signal record, ``is_risky`` and the recommendation texts to scored mails.

    Works without a model too: with no ``label`` column every mail counts as legitimate until its
    signals say otherwise.
    """
    kinds = dict(scored.dtypes)
    if "label" in kinds and kinds["label"] != "string":
        # Not a predicted label: the true one of the table.
        scored = scored.withColumnRenamed("label", "true_label")
    label = F.col("label") if "label" in scored.columns else F.lit(None).cast("string")
    return (
        social_signals(scored)
        .withColumn("is_risky", is_risky(label, F.col("heuristic_score")))
        .withColumns(
            {
                "recommendation": recommendation(F.col("is_risky")),
                "next_steps": next_steps(F.col("is_risky")),
            }
        )
    )


def score_batches(df: DataFrame, scorer: Scorer) -> tuple[DataFrame, DataFrame]:
    """Score batch requests ``(batch_id, emails)``: results per mail, and rejected batches.

    Results keep ``batch_id`` and ``pos``; sort by them to get the request order.
    """
    accepted, rejected = guard_batches(df)
    return score(flatten_batches(accepted), scorer), rejected


def results(df: DataFrame, scorer: Scorer | None, explain: bool = False) -> DataFrame:
    """One row per mail without its text: ``status, text_len`` and what :func:`score` adds.

    Blank mails stay, with status ``EMPTY_TEXT`` and null in every column made here; all others are
    ``OK``. ``explain`` adds the verdicts; with ``scorer`` None these come from signals alone.
    """
    blank = is_blank(F.col("email_text"))
    marked = df.withColumns(
        {"status": F.when(blank, BLANK).otherwise(OK), "text_len": F.length("email_text")}
    )
    found = marked if scorer is None else score(marked, scorer)
    if explain:
        found = verdicts(found)
    given = {*marked.columns, "true_label"} - ({"label"} if scorer is not None else set())
    made = {c: F.when(F.col("status") == OK, F.col(c)) for c in found.columns if c not in given}
    return found.withColumns(made).drop("email_text")


def store_results(found: DataFrame, out: str, batch_id: int) -> tuple[str, dict[str, int]]:
    """Write a batch of :func:`results` under ``out/results/batch=<id>``, one folder per status.

    One write, counted as it goes; returns the path and the counts. The batch appears under its
    name when it is complete and then takes the place of an earlier one with the same id.
    """
    spark, base = found.sparkSession, out.rstrip("/")
    path, draft = f"{base}/results/batch={batch_id}", f"{base}/drafts/{uuid.uuid4().hex}"
    seen = Observation()
    accepted = F.col("status") == OK
    counted = found.observe(seen, F.count_if(accepted).alias("n_ok"), F.count_if(~accepted).alias("n_refused"))
    counted.write.partitionBy("status").parquet(draft)
    for status in (OK, BLANK):
        files.make_folder(spark, f"{draft}/status={status}")
    files.put_in_place(spark, draft, path)
    return path, seen.get


def read_results(spark: SparkSession, out: str) -> DataFrame:
    """All stored results of a job or stream, with ``batch`` and ``status``."""
    base = f"{out.rstrip('/')}/results"
    return spark.read.option("basePath", base).option("mergeSchema", "true").parquet(f"{base}/batch=*")


def score_and_log(df: DataFrame, scorer: Scorer | None, out: str, batch_id: int, explain: bool = False) -> dict[str, str]:
    """Score one batch, store it and write its audit; the mails are read once.

    The audit is made of the stored rows, which hold no text. Returns the paths of the
    ``predictions``, the ``quarantine`` (refused mails) and the ``audit``.
    """
    started = time.monotonic()
    found = results(df, scorer, explain)
    path, _ = store_results(found, out, batch_id)
    elapsed = (time.monotonic() - started) * 1000
    stored = df.sparkSession.read.schema(found.schema).parquet(path)
    audit = write_audit(audit_rows(stored, batch_id, elapsed), f"{out.rstrip('/')}/audit", batch_id)
    return {"predictions": f"{path}/status={OK}", "quarantine": f"{path}/status={BLANK}", "audit": audit}


def score_job(
    spark: SparkSession, df: DataFrame, scorer: Scorer, out: str, batch_id: int
) -> dict[str, str]:
    """Score a mail table in one pass; results and audit go under ``out``, by batch id.

    A batch run again with the same id replaces its own output and nothing else.
    """
    return score_and_log(df, scorer, out, batch_id)


def top_terms(df: DataFrame, model: PipelineModel, k: int = 5) -> DataFrame:
    """The ``k`` terms that push each mail most towards phishing: tf x weight.

    Columns ``email_id, rank, term, tf, contribution``; equal contributions are ordered by term
    hash. Terms are the runs of 1 to 3 tokens and the signal hits (``<n_urgency>`` and so on), as the
    model counts them. Worked out inside each row from term hashes (sort, run lengths, lookup), so no
    term is shuffled; text is made of the ``k`` best only.
    """
    best = terms.top_terms("email_text", SIGNALS, weights_of(model), k)
    return (
        counted(df.select("email_id", "email_text"))
        .select("email_id", best.alias("best"))
        # Outer: for the inner form Spark infers a filter below, which works the terms out once more.
        .select("email_id", F.posexplode_outer("best").alias("pos", "item"))
        .where("pos is not null")
        .select("email_id", (F.col("pos") + 1).alias("rank"), "item.term", "item.tf", "item.contribution")
    )
