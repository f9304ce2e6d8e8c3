import pytest
from pyspark.sql import functions as F

from mailsift.functions import decide
from mailsift.operators import metrics
from mailsift.operators.identity import with_email_id
from mailsift.operators.ordering import with_range_bucket
from mailsift.operators.split import stratified_split
from mailsift.plans.scoring import verdicts
from mailsift.streaming import score as stream


def test_missing_score_stays_missing(spark):
    df = spark.createDataFrame([(None,), (2.0,)], "s double")
    assert [r.s for r in df.select(decide.clamp(F.col("s")).alias("s")).collect()] == [None, 1.0]
    rows = [(1, 0.9), (1, None), (0, None)]
    loss = metrics.log_loss(spark.createDataFrame(rows, "label int, raw_score double")).first()
    assert loss.log_loss == pytest.approx(0.1053605) and loss.n_unscored == 2


def test_verdicts_on_labelled_table(spark):
    df = spark.createDataFrame([(1, "urgent: verify now", 1)], "email_id long, email_text string, label int")
    row = verdicts(df).first()
    assert row.true_label == 1 and row.is_risky


def test_ids_make_the_split_exact(spark):
    rows = [(f"mail {i % 7}", "en", i % 2) for i in range(60)]
    bare = spark.createDataFrame(rows, "email_text string, language string, label int")
    named = with_email_id(bare)
    again = with_email_id(bare.repartition(7))
    assert sorted(r.email_id for r in named.collect()) == sorted(r.email_id for r in again.collect())
    assert named.select("email_id").distinct().count() == 60
    sizes = {r.split: r["count"] for r in stratified_split(named).groupBy("split").count().collect()}
    assert sizes == {"train": 42, "val": 8, "test": 10}
    with pytest.raises(Exception, match="null email_id"):
        stratified_split(bare.withColumn("email_id", F.lit(None).cast("string"))).collect()


def test_infinite_values_have_a_range(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,), (2.0,), (float("-inf"),)], "v double")
    assert with_range_bucket(df, "v").count() == 4


def test_stream_keeps_what_it_refuses(spark, tmp_path):
    mails = [(1, "act now"), (2, " "), (3, None), (4, "hello")]
    rows = spark.createDataFrame([(*m, "en") for m in mails], stream.EMAIL_SCHEMA)
    rows.write.parquet(str(tmp_path / "in"))
    source = stream.read_email_stream(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream.start_scoring(source, out, str(tmp_path / "state")).awaitTermination()
    found = spark.read.parquet(out)
    assert "email_text" not in found.columns
    assert sorted((r.email_id, r.status, r.text_len, r.is_risky is None) for r in found.collect()) == [
        (1, "OK", 7, False), (2, "EMPTY_TEXT", 1, True), (3, "EMPTY_TEXT", None, True), (4, "OK", 5, False),
    ]
    refused = spark.read.parquet(out).where("status = 'EMPTY_TEXT'")
    assert [r.heuristic_score for r in refused.collect()] == [None, None]


def test_fields_never_run_together_in_a_digest(spark):
    rows = [("x\x1fy", "z"), ("x", "y\x1fz"), ("\x1e", "q"), (None, "q"), ("", "q"), ("1:a", "b"), ("a", "1:b")]
    df = spark.createDataFrame(rows, "a string, b string")
    named = with_email_id(df).collect()
    assert sorted(((r.a, r.b) for r in named), key=str) == sorted(rows, key=str)
    assert len({r.email_id.split("-")[0] for r in named}) == len(rows)
    assert {r.email_id.split("-")[1] for r in named} == {"1"}
    # Neither column order nor a column of nulls changes a digest.
    wider = df.select("b", "a").withColumn("c", F.lit(None).cast("string"))
    assert {r.email_id for r in with_email_id(wider).collect()} == {r.email_id for r in named}
    nested = spark.createDataFrame([(["a, b"],), (["a", "b"],)], "a array<string>")
    assert with_email_id(nested).select("email_id").distinct().count() == 2


def test_a_row_that_fills_the_table_is_numbered_in_many_tasks(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("t"))
    named = with_email_id(df.repartition(8)).collect()
    numbers = sorted(int(r.email_id.split("-")[1]) for r in named if r.t == "same")
    assert numbers == list(range(1, 335)) and len({r.email_id for r in named}) == 1000


def test_unscored_rows_are_counted(spark):
    df = spark.createDataFrame([(1, 0.9, "en"), (0, None, "en"), (0, 0.1, "ru")], "label int, raw_score double, language string")
    row = metrics.class_metrics(df).first()
    assert (row.n_rows, row.n_unscored, row.accuracy) == (2, 1, 1.0)
    by = {(r.scope, r.language): r.n_unscored for r in metrics.metrics_by_language(df).collect()}
    assert by == {("language", "en"): 1, ("language", "ru"): 0, ("overall", None): 1}
    assert metrics.roc_by_language(df).where("score is null").count() == 0
