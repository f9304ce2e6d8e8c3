"""Report, history and audit sinks (JSON lines) and the model store."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.operators.quality import validate_emails


def write_report(report: DataFrame, path: str) -> str:
    """Write a small report as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)
    return path


def require_valid(df: DataFrame, path: str | None = None) -> DataFrame:
    """The table itself; its report is written when a path is given, an unfit table is an error."""
    valid, report = validate_emails(df)
    if path:
        write_report(report, path)
    if not valid:
        reason = report.where("section = 'error'").first()["value"]
        raise ValueError(f"the table is not fit for use: {reason}")
    return df


def write_history(history: DataFrame, path: str, model_path: str) -> str:
    """Write the training history with the path of the model it belongs to."""
    tagged = history.withColumn("model_path", F.lit(model_path))
    tagged.coalesce(1).write.mode("overwrite").json(path)
    return path


def save_model(model: PipelineModel, path: str) -> str:
    """Store a fitted pipeline."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """Load a fitted pipeline; a missing model stops the job here, before any scoring."""
    return PipelineModel.load(path)


def audit_rows(scored: DataFrame, batch_id: int, process_time_ms: float) -> DataFrame:
    """One audit record per mail; the time is that of the whole (micro-)batch.

    ``status`` and ``text_len`` are taken from the table where it has them; otherwise the status is
    ``OK`` and the length is that of ``email_text``. Ids keep their type.
    """
    have = scored.columns
    return scored.select(
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        "email_id",
        F.current_timestamp().alias("scored_at"),
        (F.col("text_len") if "text_len" in have else F.length("email_text")).alias("text_len"),
        (F.col("label") if "label" in have else F.lit(None).cast("string")).alias("label"),
        (F.col("raw_score") if "raw_score" in have else F.lit(None).cast("double")).alias(
            "raw_score"
        ),
        (F.col("status") if "status" in have else F.lit("OK")).alias("status"),
        F.lit(round(process_time_ms, 2)).alias("process_time_ms"),
    )


def write_audit(audit: DataFrame, path: str, batch_id: int) -> str:
    """Write one batch of audit records; writing the same batch again replaces it."""
    out = f"{path.rstrip('/')}/batch={batch_id}"
    audit.write.mode("overwrite").json(out)
    return out


def read_audit(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The audit records written under a path; ``id_type`` is that of the scored table's ids.

    A record that does not fit (ids of another type) is an error.
    """
    schema = (
        f"batch_id bigint, email_id {id_type}, scored_at timestamp, text_len int, label string, "
        "raw_score double, status string, process_time_ms double"
    )
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path.rstrip('/')}/batch=*")
