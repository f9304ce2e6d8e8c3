import pytest

from mailsift.operators import quality
from mailsift.sources.reports import require_valid

SCHEMA = "email_text string, language string, label int"


def labelled(spark, labels, texts=None):
    texts = texts or ["text"] * len(labels)
    return spark.createDataFrame([(t, "en", l) for t, l in zip(texts, labels)], SCHEMA)


@pytest.mark.parametrize(
    "labels, valid",
    [
        ([0, 1] * 5, False),
        ([0, 1] * 5 + [1], True),
        ([0, 1] * 6 + [2], False),
        ([0, 1] * 6 + [None], False),
    ],
)
def test_validity(spark, labels, valid):
    df = labelled(spark, labels)
    ok, report = quality.validate_emails(df)
    assert ok is valid
    entries = {(r.section, r.key): r.value for r in report.collect()}
    assert entries[("valid", "")] == str(valid).lower()
    assert (("error", "") in entries) is not valid
    if valid:
        assert require_valid(df) is df
    else:
        with pytest.raises(ValueError, match="Invalid labels or too few rows"):
            require_valid(df)


def test_null_text_counts_as_three_characters(spark):
    df = labelled(spark, [0] * 11, [None, "ab", "abcd"] + ["abcde"] * 8)
    row = quality.text_length_stats(df).first()
    assert (row.text_len_max, row.text_len_min) == (5, 2)
    assert row.text_len_mean == pytest.approx((3 + 2 + 4 + 40) / 11)
    assert quality.text_length_stats(df, mode="strict").first().text_len_mean == 4.6
    assert quality.validate_emails(df)[0]


def test_missing_columns(spark):
    df = labelled(spark, [0]).drop("language", "label")
    assert quality.missing_columns(df) == ["language", "label"]
    ok, report = quality.validate_emails(df)
    assert not ok and report.first().value == "the table has no column language"
    with pytest.raises(ValueError, match="language.*label"):
        quality.require_columns(df)
    assert [r.present for r in quality.column_check(df).collect()] == [True, False, False]


def test_report_of_an_empty_table(spark):
    ok, report = quality.validate_emails(labelled(spark, [0]).limit(0))
    assert not ok
    assert {(r.section, r.key): r.value for r in report.collect()}[("rows", "total")] == "0"


def test_batches(spark):
    sizes = [0, 1, 100, 101]
    df = spark.createDataFrame(
        [(i, [" "] * n) for i, n in enumerate(sizes)] + [(9, None)],
        "batch_id long, emails array<string>",
    )
    accepted, rejected = quality.guard_batches(df)
    assert sorted(r.batch_id for r in accepted.collect()) == [1, 2]
    assert {r.batch_id: r.reason for r in rejected.collect()} == {
        0: "EMPTY_BATCH", 3: "BATCH_TOO_LARGE", 9: "EMPTY_BATCH",
    }
