"""Continuous scoring of arriving mails.

The stream is stateless: each mail is scored on its own by the same expressions as in batch, so
there is no watermark and no state store. Progress lives in the checkpoint folder, which must be
shared by the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mailsift.plans.scoring import Scorer, results, score_and_log

EMAIL_SCHEMA = T.StructType(
    [
        T.StructField("email_id", T.LongType()),
        T.StructField("email_text", T.StringType()),
        T.StructField("language", T.StringType()),
    ]
)


def read_email_stream(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType = EMAIL_SCHEMA,
    **options: str,
) -> DataFrame:
    """A stream of the files that arrive in a folder; the schema is always given."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def start_scoring(
    emails: DataFrame,
    out: str,
    checkpoint: str,
    scorer: Scorer | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Append verdicts to a Parquet table; ``available_now`` ends after what is there.

    One row per mail, without its text and in a folder per ``status``: blank mails are in the same
    stream, with status ``EMPTY_TEXT`` and no verdict, so none is lost. Without a scorer verdicts
    come from signals alone.
    """
    writer = (
        results(emails, scorer, explain=True)
        .writeStream.format("parquet")
        .partitionBy("status")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_audit(
    emails: DataFrame,
    out: str,
    checkpoint: str,
    scorer: Scorer,
    available_now: bool = True,
) -> StreamingQuery:
    """Score each micro-batch into ``out/results`` and log it in ``out/audit``, in one pass.

    Both are keyed by the micro-batch id and replaced on a retry, so a batch that is run again
    after a failure leaves no duplicates. ``read_results`` and ``read_audit`` read them.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        score_and_log(batch, scorer, out, batch_id)

    writer = emails.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
