from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.functions import decide


def test_thresholds(spark):
    cases = [
        (0.5, 0.5, "LEGITIMATE", 0.5, False),
        (0.75, 0.5, "PHISHING", 0.75, True),
        (0.75, 0.9, "PHISHING", 0.25, True),
        (0.25, 0.1, "LEGITIMATE", 0.25, False),
    ]
    for score, threshold, label, confidence, phishing in cases:
        row = decide.with_decision(
            spark.createDataFrame([(score,)], "raw_score double"), threshold=threshold
        ).first()
        assert (row.label, row.confidence, row.threshold, row.is_phishing) == (
            label, confidence, threshold, phishing,
        )
    strict = decide.with_decision(
        spark.createDataFrame([(0.75,)], "raw_score double"), threshold=0.9, mode="strict"
    ).first()
    assert (strict.label, strict.is_phishing) == ("LEGITIMATE", False)


def test_verdict(spark):
    rows = [(None, 0.4), (None, 0.41), ("PHISHING", 0.0), ("LEGITIMATE", 0.4)]
    df = spark.createDataFrame(rows, "label string, h double").withColumn(
        "risky", decide.is_risky(F.col("label"), F.col("h"))
    )
    found = df.select("risky", decide.recommendation(F.col("risky")).alias("r")).collect()
    assert [r.risky for r in found] == [False, True, True, False]
    assert [r.r == C.RISKY_HEADLINE for r in found] == [False, True, True, False]


def test_display(spark):
    row = spark.createDataFrame([(1.7, 0.65)], "a double, b double").select(
        decide.clamp(F.col("a")).alias("a"),
        decide.display_score(F.col("b")).alias("b"),
        decide.display_percent(F.col("b")).alias("p"),
        decide.confidence(F.col("b"), F.lit("PHISHING")).alias("c"),
    ).first()
    assert (row.a, row.b, row.p, row.c) == (1.0, "0.650", "65.0%", 0.65)


def test_display_rounds_the_binary_value(spark):
    import random

    rng = random.Random(4)
    values = [0.0625, 0.1875, 0.2875, 0.0005, 0.0015, 0.9995, 1.0, 0.0, 0.12345, 1e-9, 0.4445, 2.675, -0.0625, -0.0001]
    values += [rng.random() for _ in range(2000)] + [rng.randrange(20_000) / 20_000 for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    shown = df.select(
        "v", decide.display_score(F.col("v")).alias("three"), decide.display_score(F.col("v"), 4).alias("four"),
        decide.display_percent(F.col("v")).alias("percent"),
    ).collect()
    for r in shown:
        if r.v is None:
            assert (r.three, r.four, r.percent) == (None, None, None)
        else:
            want = [f"{r.v:.3f}", f"{r.v:.4f}", f"{r.v * 100:.1f}%"]
            assert [r.three, r.four, r.percent] == [w.replace("-0.000", "0.000").replace("-0.0%", "0.0%") if float(w.rstrip("%")) == 0 else w for w in want]
