from collections import Counter
import hashlib

from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.functions import text
from mailsift.operators import augment, corpus


def test_token_ids(spark):
    df = spark.createDataFrame([(" verify  now　x ",), ("",), ("w " * 300,)], "t string")
    rows = df.select(text.sequence_ids(F.col("t")).alias("ids")).collect()
    md5 = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 20000
    assert rows[0].ids == [md5("verify"), md5("now"), md5("x")] + [0] * 253
    assert md5("verify") == 10077
    assert rows[1].ids == [0] * 256
    assert rows[2].ids == [md5("w")] * 256
    fast = df.select(text.sequence_ids(F.col("t"), method="xxhash64").alias("ids")).collect()
    assert all(len(r.ids) == 256 and 0 <= min(r.ids) <= max(r.ids) < 20000 for r in fast)
    mask = df.select(text.padding_mask(text.sequence_ids(F.col("t"))).alias("m")).collect()
    assert [sum(r.m) for r in mask] == [3.0, 0.0, 256.0]


def test_fold_ids(spark):
    df = spark.createDataFrame([([1, 2],), ([19999, 20000, 45000],)], "ids array<int>")
    got = [r[0] for r in df.select(text.fold_ids(F.col("ids"))).collect()]
    assert got == [[1, 2], [19999, 0, 5000]]


def test_languages(spark):
    rows = [
        (t, code)
        for table in (C.PHISHING_TEMPLATES, C.LEGITIMATE_TEMPLATES)
        for code, texts in table.items()
        if code in ("zh", "ru")
        for t in texts
    ]
    rows += [("Asante kwa kutumia Bank. Hapa kuna maelezo ya akaunti yako.", "sw")]
    rows += [("Thank you for the order of your things", "en"), ("  ", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, code string").withColumn(
        "guess", text.detect_language(F.col("t"))
    )
    assert got.where(~F.col("guess").eqNullSafe(F.col("code"))).count() == 0


def test_expansion(spark):
    rows = corpus.expand_templates(spark).collect()
    assert len(rows) == len(set(rows)) == 2072
    assert Counter(r.label for r in rows) == {1: 1568, 0: 504}
    assert not [r for r in rows if "{" in r.email_text]


def test_sample_corpus(spark):
    rows = corpus.sample_corpus(spark, 251).collect()
    cells = Counter((r.language, r.label) for r in rows)
    assert len(rows) == 1000 and set(cells.values()) == {125} and len(cells) == 8
    assert sorted(rows) == sorted(corpus.sample_corpus(spark, 250).collect())
    assert sorted(rows) != sorted(corpus.sample_corpus(spark, 250, seed=7).collect())
    known = {(r.email_text, r.language, r.label) for r in corpus.expand_templates(spark).collect()}
    assert {(r.email_text, r.language, r.label) for r in rows} <= known
    assert corpus.sample_corpus(spark, 1).count() == 0


def test_unknown_language_is_english(spark):
    df = spark.createDataFrame([("xx",), (None,)], "language string")
    rows = df.select(corpus.generate_phishing_email(F.col("language"), F.lit("k"))).collect()
    english = spark.range(1).select(corpus.generate_phishing_email(F.lit("en"), F.lit("k")))
    assert {r[0] for r in rows} == {english.first()[0]}


def test_corpus_over_any_ids(spark):
    ids = spark.range(1003).select((F.col("id") * 977).alias("email_id"))
    rows = corpus.corpus_over(ids).collect()
    # 1003 = 8 * 125 + 3: the ids left over go to the first cells in turn.
    assert sorted(Counter((r.language, r.label) for r in rows).values()) == [125] * 5 + [126] * 3
    assert len({r.email_id for r in rows}) == 1003
    few = corpus.corpus_over(ids.limit(5)).collect()
    assert len({(r.language, r.label) for r in few}) == 5


def test_augment(spark):
    df = spark.createDataFrame(
        [(1, "visit amazon.com, 10 times"), (2, "please VERIFY your password"), (3, "nothing")],
        "email_id long, email_text string",
    )
    rows = augment.augment(df, ("synonym", "url", "digit")).collect()
    found = {(r.email_id, r.aug): r.email_text for r in rows}
    assert found[(1, "url")] == "visit am@z0n.c0m, 10 times"
    assert found[(1, "digit")] == "visit amazon.com, 1O times"
    assert found[(2, "synonym")] == "please validate your passcode"
    assert len(found) == 6
