import math
from collections import Counter

import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from mailsift.functions.signals import signal_counts
from mailsift.operators import corpus, metrics
from mailsift.plans import queries, scoring, training
from mailsift.sources import reports
from mailsift.streaming import monitor as monitoring
from mailsift.streaming import score as stream


@pytest.fixture(scope="module")
def fitted(spark):
    return training.fit(corpus.sample_corpus(spark, 100), reg_params=(0.1, 0.01), vocab_size=2000)


def test_training_learns_the_corpus(fitted):
    chosen = fitted.selection.where("chosen").collect()
    assert len(chosen) == 1
    assert chosen[0].val_loss == min(r.val_loss for r in fitted.selection.collect())
    overall = training.evaluate(fitted).where("scope = 'overall'").first()
    assert overall.accuracy > 0.95
    assert {r.metric for r in fitted.history.collect()} == {"loss", "val_loss", "val_accuracy"}


def test_invalid_table_is_refused(spark):
    with pytest.raises(ValueError, match="too few rows"):
        training.fit(corpus.sample_corpus(spark, 2))


def test_saved_model_gives_the_same_scores(spark, fitted, tmp_path):
    mails = corpus.sample_corpus(spark, 10)
    path = reports.save_model(fitted.best, str(tmp_path / "m"))
    a = scoring.score(mails, fitted.best).select("email_id", "raw_score", "true_label").collect()
    b = scoring.score(mails, reports.load_model(path))
    assert sorted(a) == sorted(b.select("email_id", "raw_score", "true_label").collect())
    with pytest.raises(Exception):
        reports.load_model(str(tmp_path / "none"))


def test_term_index_is_the_feature_index(spark):
    df = spark.createDataFrame([(t,) for t in (0, 1, -5, 2**62, -(2**63))], "t long")
    made = HashingTF(numFeatures=2000, inputCol="k", outputCol="v").transform(
        df.withColumn("k", F.array("t"))
    )
    for row in made.select("v", training.term_index(F.col("t"), 2000).alias("i")).collect():
        assert list(row.v.indices) == [row.i]


def test_score_is_the_pipelines_probability(spark, fitted):
    mails = corpus.sample_corpus(spark, 20)
    mine = {r.email_id: r.raw_score for r in scoring.score(mails, fitted.best).collect()}
    for r in fitted.best.transform(training.featurize(mails)).collect():
        assert mine[r.email_id] == pytest.approx(r.probability[1], abs=1e-12)


def test_idf_goes_into_the_coefficients(spark):
    mails = corpus.sample_corpus(spark, 60)
    fit = training.fit(mails, reg_params=(0.1,), vocab_size=500, max_iter=5, min_docs=3)
    assert len(fit.best.stages) == 3
    mine = {r.email_id: r.raw_score for r in scoring.score(mails, fit.best).collect()}
    for r in fit.best.transform(training.featurize(mails)).collect():
        assert mine[r.email_id] == pytest.approx(r.probability[1], abs=1e-12)
    train = fit.splits.where("split = 'train'")
    n = train.count()
    idf = fit.best.stages[1].idf.toArray()
    counted = {r.term_id: r.n_docs for r in training.document_frequencies(train).collect()}
    for i, weight in enumerate(idf):
        docs = counted.get(i, 0)
        assert weight == pytest.approx(math.log((n + 1) / (docs + 1)) if docs >= 3 else 0.0)
    assert training.evaluate(fit, split="val").where("scope = 'overall'").count() == 1


def test_all_candidates_are_compared_in_one_pass(spark, fitted):
    from mailsift.plans.training import probability, weights_of

    val = fitted.splits.where("split = 'val'")
    best = fitted.best
    scored = val.withColumn("raw_score", probability(weights_of(best), best.stages[-1].intercept, "term_ids"))
    chosen = fitted.selection.where("chosen").first()
    assert metrics.log_loss(scored).first()[0] == pytest.approx(chosen.val_loss)
    assert metrics.class_metrics(scored).first().accuracy == pytest.approx(chosen.val_accuracy)


def test_no_text_of_the_test_was_learned(spark):
    mails = corpus.sample_corpus(spark, 60)
    copies = mails.unionAll(mails.withColumn("email_id", F.col("email_id") + 1000))
    fit = training.fit(copies, reg_params=(0.1,), vocab_size=500, max_iter=2, keep_texts_together=True)
    ids = fit.splits.select("email_id", "split").join(copies.select("email_id", "email_text"), "email_id")
    assert ids.groupBy("email_text").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_terms_are_sparks_hashes(spark, fitted):
    """Terms, indexes and margins of many texts at once equal Spark's own expressions over each text."""
    long = [" ".join("w" * n + str(i % 7) for n in range(1, 90, 1 + i % 3)) for i in range(9)]
    odd = ["", " \n\u3000", "a", "a b", "a b c", "\u0130stanbul \u00df\u2003x\x1cy\x85z", "\U0001f600 act now", "x" * 5000, None]
    df = spark.createDataFrame(list(enumerate(odd + long)), "email_id long, email_text string").coalesce(1)
    plain = training.with_terms(signal_counts(df)).withColumn(
        "keys", F.concat("terms", *[F.array_repeat(training.signal_term(s), F.col(s)) for s in training.SIGNALS])
    )
    ids = F.transform("keys", lambda key: training.term_index(key, 2000))
    score = training.probability(training.weights_of(fitted.best), fitted.best.stages[-1].intercept, "ids")
    expected = plain.withColumn("ids", ids).select("email_id", "keys", score.alias("p"))
    found = scoring.score(training.featurize(df), fitted.best).select("email_id", "term_keys", "raw_score")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_stored_features_are_those_of_the_hashing_stage(spark, fitted):
    """The split table's vectors equal what the model's own first stage makes of the mails."""
    mails = corpus.sample_corpus(spark, 100)
    made = fitted.best.stages[0].transform(training.featurize(mails)).select("email_id", "features")
    expected = {r.email_id: r.features for r in made.collect()}
    found = {r.email_id: r.features for r in fitted.splits.select("email_id", "features").collect()}
    assert found == expected


def test_scoring_evaluates_no_lambda_per_term(spark, fitted):
    """Lambdas over arrays run one element at a time: at 6 GB that took the longest part of the time."""
    mails = corpus.sample_corpus(spark, 2)
    for df in (training.featurize(mails), scoring.score(mails, fitted.best), scoring.top_terms(mails, fitted.best)):
        assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_top_terms_equal_brute_force(spark, fitted):
    texts = ["Verify your your account NOW", "one", "", "a b a b a", "x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "email_id long, email_text string")
    got = scoring.top_terms(df, fitted.best, k=4).collect()
    weights = fitted.best.stages[-1].coefficients.toArray()
    for i, t in enumerate(texts):
        words = t.lower().split()
        tf = Counter(
            " ".join(words[a : a + n]) for n in (1, 2, 3) for a in range(len(words) - n + 1)
        )
        best = []
        hits = signal_counts(df.where(f"email_id = {i}")).first()
        for name in training.SIGNALS:
            if hits[name]:
                h, at = df.select(training.signal_term(name), training.term_index(training.signal_term(name), 2000)).first()
                best.append((-hits[name] * weights[at], h, f"<{name}>", hits[name]))
        for term, count in tf.items():
            one = training.with_terms(spark.createDataFrame([(term,)], "email_text string"))
            h, at = one.select(
                F.element_at("terms", -1), training.term_index(F.element_at("terms", -1), 2000)
            ).first()
            best.append((-count * weights[at], h, term, count))
        best = sorted(best)[:4]
        mine = sorted((r["rank"], r.term, r.tf, r.contribution) for r in got if r.email_id == i)
        assert [(m[1], m[2]) for m in mine] == [(x, n) for _, _, x, n in best]
        assert [m[3] for m in mine] == pytest.approx([-c for c, _, _, _ in best])


def test_history_and_report_sinks(spark, fitted, tmp_path):
    path = reports.write_history(fitted.history, str(tmp_path / "h"), "where/it/is")
    assert spark.read.json(path).where("model_path = 'where/it/is'").count() > 0
    reports.require_valid(corpus.sample_corpus(spark, 10), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).where("section = 'valid'").first().value == "true"


def test_log_loss_and_metrics(spark):
    rows = [(1, 1.0), (0, 0.0), (1, 0.5), (0, 0.9), (None, 0.3)]
    df = spark.createDataFrame(rows, "label int, raw_score double")
    eps = 1e-7
    expected = -(2 * math.log(1 - eps) + math.log(0.5) + math.log(1 - 0.9)) / 4
    assert metrics.log_loss(df).first()[0] == pytest.approx(expected)
    row = metrics.class_metrics(df).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.5, 0.5, 0.5, 0.5)
    empty = metrics.class_metrics(df.where("label = 0 and raw_score = 0")).first()
    assert (empty.accuracy, empty.precision, empty.recall, empty.f1) == (1.0, 0.0, 0.0, 0.0)


def test_batch_requests_keep_order(spark):
    df = spark.createDataFrame(
        [(1, ["urgent verify password", ""]), (2, []), (3, ["x"] * 101)],
        "batch_id long, emails array<string>",
    )
    results, rejected = scoring.score_batches(df, queries.heuristic_scorer)
    rows = results.orderBy("batch_id", "pos").collect()
    assert [(r.batch_id, r.pos, r.label) for r in rows] == [
        (1, 0, "PHISHING"), (1, 1, "LEGITIMATE"),
    ]
    assert rejected.count() == 2


SMOKE = [
    (1, "Urgent: Verify your PayPal account immediately. Click here: bit.ly/verify2024"),
    (2, "Thank you for using our service. Here is your monthly invoice."),
    (3, " \n"),
    (4, "WARNING: Your bank account will be suspended unless you confirm here: bit.ly/confirm"),
]


def test_score_job_can_be_repeated(spark, tmp_path):
    df = spark.createDataFrame(SMOKE, "email_id long, email_text string")
    for _ in range(2):
        scoring.score_job(spark, df, queries.heuristic_scorer, str(tmp_path), batch_id=7)
    audit = reports.read_audit(spark, str(tmp_path / "audit")).collect()
    assert sorted((r.email_id, r.status) for r in audit) == [
        (1, "OK"), (2, "OK"), (3, "EMPTY_TEXT"), (4, "OK"),
    ]
    assert all(r.batch_id == 7 and r.process_time_ms > 0 and r.scored_at for r in audit)
    assert {r.email_id: r.text_len for r in audit} == {i: len(t) for i, t in SMOKE}


def test_score_job_reads_the_mails_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(text):
        seen.add(1)
        return text

    df = spark.createDataFrame(SMOKE, "email_id long, email_text string").coalesce(1)
    df = df.withColumn("email_text", watched.asNondeterministic()("email_text"))
    paths = scoring.score_job(spark, df, queries.heuristic_scorer, str(tmp_path), batch_id=1)
    assert seen.value == len(SMOKE) and set(paths) == {"predictions", "quarantine", "audit"}
    stored = scoring.read_results(spark, str(tmp_path))
    assert "email_text" not in stored.columns and "email_text" not in spark.read.json(paths["audit"]).columns
    assert sorted((r.email_id, r.status, r.batch) for r in stored.collect()) == [
        (1, "OK", 1), (2, "OK", 1), (3, "EMPTY_TEXT", 1), (4, "OK", 1),
    ]
    assert {r.email_id for r in spark.read.parquet(paths["quarantine"]).collect()} == {3}


def test_empty_batches_and_text_ids(spark, tmp_path):
    none = spark.createDataFrame([], "email_id string, email_text string")
    scoring.score_job(spark, none, queries.heuristic_scorer, str(tmp_path), batch_id=1)
    some = spark.createDataFrame([("a-1", "act now"), ("b-1", " ")], "email_id string, email_text string")
    scoring.score_job(spark, some, queries.heuristic_scorer, str(tmp_path), batch_id=2)
    audit = reports.read_audit(spark, f"{tmp_path}/audit", id_type="string")
    assert sorted((r.email_id, r.status) for r in audit.collect()) == [("a-1", "OK"), ("b-1", "EMPTY_TEXT")]
    with pytest.raises(Exception):  # ids are text: reading them as numbers is no silent null
        reports.read_audit(spark, f"{tmp_path}/audit").collect()


def test_stream_equals_batch(spark, fitted, tmp_path):
    df = corpus.sample_corpus(spark, 20).select("email_id", "email_text", "language")
    blank = spark.createDataFrame([(-1, " ", "en")], df.schema)
    df.union(blank).repartition(3).write.parquet(str(tmp_path / "in"))
    source = stream.read_email_stream(spark, str(tmp_path / "in"), maxFilesPerTrigger="1")
    out = str(tmp_path / "out")
    stream.start_scoring(source, out, str(tmp_path / "state"), fitted.best).awaitTermination()
    columns = ["email_id", "raw_score", "label", "heuristic_score", "is_risky"]
    expected = scoring.verdicts(scoring.score(df, fitted.best)).select(*columns)
    got = spark.read.parquet(out).where("status = 'OK'").select(*columns)
    assert sorted(got.collect()) == sorted(expected.collect())

    logged = str(tmp_path / "logged")
    stream.start_audit(
        source, logged, str(tmp_path / "state2"), fitted.best
    ).awaitTermination()
    audit = reports.read_audit(spark, f"{logged}/audit")
    assert audit.count() == 81 and audit.where("status = 'EMPTY_TEXT'").count() == 1
    void = audit.where("status = 'EMPTY_TEXT'").first()
    assert void.raw_score is None and void.label is None
    assert audit.select("batch_id").distinct().count() == 3


@pytest.mark.parametrize("parts", [0, 3])
def test_document_stream_reads_a_file_and_a_folder_of_parts(spark, tmp_path, parts):
    """``documents.parquet`` is one file (0 parts) or a folder of part files; other tables are not read."""
    rows = [(i, f"Text number {i}", "en") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    docs.repartition(parts or 1).write.parquet(str(tmp_path / "made"))
    if parts:
        (tmp_path / "made").rename(tmp_path / "documents.parquet")
    else:
        next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    docs.limit(5).write.parquet(str(tmp_path / "documents_old.parquet"))
    scored = queries.q_stream_score(spark, str(tmp_path)).collect()
    assert sorted(r.email_id for r in scored) == list(range(30))
    logged = queries.q_stream_audit(spark, str(tmp_path)).collect()
    assert sorted(r.email_id for r in logged) == list(range(30))


def test_monitoring_stream_equals_batch(spark, tmp_path):
    rows = [(f"2025-01-01 0{h}:{m:02d}:00", "error" if m % 3 else "ok", float(m))
            for h in range(4) for m in range(0, 60, 7)]
    events = spark.createDataFrame(rows, "ts string, kind string, value double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    failed = F.col("kind") == "error"
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = (
        monitoring.monitor(source, "ts", failed, "value")
        .writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    columns = ["n_rows", "error_share", "mean_value"]
    batch = monitoring.monitor(events, "ts", failed, "value").orderBy("window_start")
    closed = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start")
    # The last window stays open: no later record has moved the watermark past it.
    assert closed.select(*columns).collect() == batch.select(*columns).collect()[:3]
