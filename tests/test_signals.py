import random
import re

import pytest
from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.functions.signals import extract_urls, social_signals, suspicious_urls
from mailsift.functions.signals import with_heuristic_score
from mailsift.functions.text import is_blank, token_count, tokens
from mailsift.operators.augment import obfuscate_urls

# Fixed value: the URL pattern in its plain form.
PLAIN_URL = r"(https?://\S+|www\\.\S+|\b\S+\.(?:com|ru|tk|cn|xyz|info|ml)\b)"

# Texts with the URLs, suspicious URLs and scores that they must give.
GOLDENS = [
    ("Urgent: Verify your PayPal account immediately. Click here: bit.ly/verify2024", [], [], 0.65),
    ("Hello, your order from Amazon has shipped and will arrive soon.", [], [], 0.0),
    ("go am@z0n-verify.ru now", ["am@z0n-verify.ru"], ["am@z0n-verify.ru"], 0.7),
    ("点击此处：am@z0n-verify.ru", ["点击此处：am@z0n-verify.ru"], ["点击此处：am@z0n-verify.ru"], 0.5),
    ("www.foo.org x", [], [], 0.0),
    ("a　b.com", ["b.com"], [], 0.0),
    ("X.COM y.Tk", ["X.COM", "y.Tk"], ["y.Tk"], 0.25),
    ("foo.community bar.info2", [], [], 0.0),
    ("http://a.com,b.ru/x", ["http://a.com,b.ru/x"], ["http://a.com,b.ru/x"], 0.25),
    ("www\\x1 and www\\ foo then b.com", ["www\\x1", "www\\ foo", "b.com"], [], 0.0),
    ("a\x1cb.com c\xa0d.tk", ["b.com", "d.tk"], ["d.tk"], 0.25),
    ("", [], [], 0.0),
    (None, [], [], 0.0),
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "email_id long, email_text string")


def test_goldens(spark):
    rows = social_signals(frame(spark, [g[0] for g in GOLDENS])).orderBy("email_id").collect()
    for row, (text, urls, suspicious, score) in zip(rows, GOLDENS):
        assert row.urls == urls, text
        assert row.suspicious_urls == suspicious, text
        assert row.heuristic_score == pytest.approx(score), text


def test_score_only_form_is_the_same(spark):
    df = frame(spark, [g[0] for g in GOLDENS])
    full = social_signals(df).select("email_id", "heuristic_score")
    assert sorted(full.collect()) == sorted(
        with_heuristic_score(df).select("email_id", "heuristic_score").collect()
    )


def test_keywords_are_substrings_in_list_order(spark):
    text = "I know. RESET PASSWORD, Dear Valued Customer, suspended! see report.DOCX and Invoice"
    row = social_signals(frame(spark, [text])).first()
    assert row.urgency_found == ["now", "suspend"]
    assert row.creds_found == ["password", "reset password"]
    assert row.generic_salutation == ["dear valued customer", "valued customer"]
    assert row.attachments_mentioned == ["invoice", ".doc"]
    assert row.heuristic_score == 0.99


def test_sender_cue_is_per_line(spark):
    texts = [
        "From: a@b", "from: x\na@b", "From: x\r a@b", "FROM:   a@b", "from: from: z@", "@ from: ",
        "x\nfrom: q@r",
    ]
    rows = social_signals(frame(spark, texts)).orderBy("email_id").collect()
    expected = [bool(re.search(r"from: .*@.*", t, flags=re.IGNORECASE)) for t in texts]
    assert [r.impersonation_cues == [C.IMPERSONATION_CUE] for r in rows] == expected


def nasty_texts(n):
    rng = random.Random(7)
    pieces = [
        "a", "é", "点", "：", "_", "²", ".", "-", "@", "/", "://", "http", "https://", "HTTPS://", "www\\",
        "www.", "WWW\\", ".com", ".COM", ".ru", ".tk", ".info", ".ml", "com", "o0", " ", "\n", "\t",
        "\x1c", "\x85", "\xa0", "　", " ", "\r", "ſ", "K", "ı", "x", "!", "1", "тест",
    ]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_urls_equal_plain_pattern(spark):
    texts = nasty_texts(4000)
    got = frame(spark, texts).select("email_id", extract_urls(F.col("email_text")).alias("u"))
    for row in got.collect():
        text = texts[row.email_id]
        assert row.u == re.findall(PLAIN_URL, text, flags=re.IGNORECASE), repr(text)


def test_suspicious_equal_plain_pattern(spark):
    texts = [t.replace("\n", "") for t in nasty_texts(1500)]
    urls = F.array("email_text")
    got = frame(spark, texts).select("email_id", F.size(suspicious_urls(urls)).alias("n"))
    for row in got.collect():
        hit = re.search(r"\.tk\b|\.ru\b|\.cn\b|\.ml\b", texts[row.email_id], flags=re.IGNORECASE)
        assert bool(row.n) == bool(hit), repr(texts[row.email_id])


def test_disguise_touches_only_matches(spark):
    texts = nasty_texts(3000) + ["see amazon.com, not amazon or oa.community", "plain text a o"]

    def disguise(match):
        url = match.group(0)
        return url[0] + url[1:].replace("a", "@").replace("o", "0")

    got = frame(spark, texts).select("email_id", obfuscate_urls(F.col("email_text")).alias("t"))
    for row in got.collect():
        text = texts[row.email_id]
        assert row.t == re.sub(PLAIN_URL, disguise, text, flags=re.IGNORECASE), repr(text)


def test_whitespace_is_pythons(spark):
    texts = nasty_texts(1500) + ["", " \t", "\x1f ", "x"]
    got = frame(spark, texts).select(
        "email_id",
        tokens(F.col("email_text")).alias("all"),
        tokens(F.col("email_text"), 3).alias("three"),
        token_count(F.col("email_text")).alias("n"),
        is_blank(F.col("email_text")).alias("blank"),
    )
    for row in got.collect():
        words = texts[row.email_id].split()
        assert row["all"] == words
        assert row.three == words[:3]
        assert row.n == len(words)
        assert row.blank == (not texts[row.email_id].strip())


def test_long_runs_stay_linear(spark):
    texts = [
        "a.b-" * 50_000,
        "x.com" + "/y-z" * 50_000,
        "from: " * 40_000,
        "http" * 50_000,
        "." * 100_000,
    ]
    rows = social_signals(frame(spark, texts)).orderBy("email_id").collect()
    assert [len(r.urls) for r in rows] == [0, 1, 0, 0, 0]
    assert rows[1].urls == ["x.com"]
