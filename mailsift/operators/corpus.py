"""Template corpora: filling, the complete expansion, and balanced sampled corpora of any size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.functions.text import stable_int
from mailsift.operators.ordering import global_rank

FALLBACK_LANGUAGE = "en"


def fill(template: Column, service: Column, url: Column, month: Column) -> Column:
    """Put a service, a link and a month in the places a template leaves for them."""
    filled = F.replace(template, F.lit("{service}"), service)
    filled = F.replace(filled, F.lit("{url}"), url)
    return F.replace(filled, F.lit("{month}"), month)


def strings(values: list[str]) -> Column:
    """A constant string array."""
    return F.array(*[F.lit(v) for v in values])


def pick(values: Column, index: Column) -> Column:
    """Zero-based choice from an array."""
    return F.element_at(values, (index + 1).cast("int"))


def _by_language(language: Column, table: dict[str, list[str]]) -> Column:
    """The template list of a language; English for unknown and null languages."""
    others = [code for code in table if code != FALLBACK_LANGUAGE]
    choice = F.when(language == others[0], strings(table[others[0]]))
    for code in others[1:]:
        choice = choice.when(language == code, strings(table[code]))
    return choice.otherwise(strings(table[FALLBACK_LANGUAGE]))


def _draw(key: Column, slot: str, values: Column, size: int) -> Column:
    number = stable_int(F.concat(key, F.lit(f":{slot}")))
    return pick(values, number % F.lit(size))


def generate_email(language: Column, label: Column, key: Column) -> Column:
    """A filled template for a language and a class (1 phishing, otherwise legitimate).

    Every choice is a stable hash of ``key`` and the name of the slot, so equal keys give equal
    mails on any cluster and in any order.
    """
    texts = F.when(label == 1, _by_language(language, C.PHISHING_TEMPLATES)).otherwise(
        _by_language(language, C.LEGITIMATE_TEMPLATES)
    )
    return fill(
        _draw(key, "template", texts, len(C.PHISHING_TEMPLATES[FALLBACK_LANGUAGE])),
        _draw(key, "service", strings(C.SERVICES), len(C.SERVICES)),
        _draw(key, "url", strings(C.LURE_URLS), len(C.LURE_URLS)),
        _draw(key, "month", strings(C.MONTHS), len(C.MONTHS)),
    )


def seed_key(seed: int, id_col: Column) -> Column:
    """Key for ``generate_email``: ``seed:id``."""
    return F.concat(F.lit(f"{seed}:"), id_col.cast("string"))


def generate_phishing_email(language: Column, key: Column) -> Column:
    """A phishing mail in a language."""
    return generate_email(language, F.lit(1), key)


def generate_legitimate_email(language: Column, key: Column) -> Column:
    """A legitimate mail in a language."""
    return generate_email(language, F.lit(0), key)


def template_table(spark: SparkSession) -> DataFrame:
    """The 64 templates: ``language, label, template``."""
    rows = [
        (language, label, text)
        for label, table in ((1, C.PHISHING_TEMPLATES), (0, C.LEGITIMATE_TEMPLATES))
        for language, texts in table.items()
        for text in texts
    ]
    languages, labels, texts = zip(*rows)
    return spark.createDataFrame(
        pa.table(
            {
                "language": pa.array(languages, pa.string()),
                "label": pa.array(labels, pa.int32()),
                "template": pa.array(texts, pa.string()),
            }
        )
    )


def expand_templates(spark: SparkSession) -> DataFrame:
    """Every filling of every template: 2,072 distinct rows ``email_text, language, label``.

    A template is expanded only over the fillers that it has a place for, so no row comes twice.
    """
    template = F.col("template")
    third = (
        F.when(F.contains(template, F.lit("{url}")), strings(C.LURE_URLS))
        .when(F.contains(template, F.lit("{month}")), strings(C.MONTHS))
        .otherwise(strings([""]))
    )
    return (
        template_table(spark)
        .withColumn("service", F.explode(strings(C.SERVICES)))
        .withColumn("third", F.explode(third))
        .select(
            fill(template, F.col("service"), F.col("third"), F.col("third")).alias("email_text"),
            "language",
            "label",
        )
    )


def _corpus_rows(numbered: DataFrame, n: Column, half: Column, languages: list[str], seed: int):
    """Language, class and text of corpus row ``n`` (zero-based) of ``half`` rows per class."""
    return (
        numbered.withColumn("language", pick(strings(languages), F.floor(n / (half * 2))))
        .withColumn("label", F.when(F.floor(n / half) % 2 == 0, 1).otherwise(0))
        .withColumn(
            "email_text",
            generate_email(F.col("language"), F.col("label"), seed_key(seed, F.col("email_id"))),
        )
        .select("email_id", "email_text", "language", "label")
    )


def sample_corpus(
    spark: SparkSession,
    samples_per_language: int = 250,
    languages: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """A balanced corpus of any size: half phishing, half legitimate in each language.

    An odd ``samples_per_language`` loses one row. Rows are made by the executors from a number
    range; nothing is built on the driver and nothing is shuffled. Use ``shuffled`` for an order.
    """
    languages = C.LANGUAGES if languages is None else languages
    half = samples_per_language // 2
    numbers = spark.range(len(languages) * 2 * half).withColumnRenamed("id", "email_id")
    return _corpus_rows(numbers, F.col("email_id"), F.lit(max(half, 1)), languages, seed)


def corpus_over(
    df: DataFrame,
    id_col: str = "email_id",
    languages: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """A balanced corpus whose rows carry the ids of a given table, in seeded random assignment.

    As ``sample_corpus`` with ``samples_per_language`` = rows / languages. Every id gets a mail: those
    left over by the two integer divisions go to the languages and classes in turn.
    """
    languages = C.LANGUAGES if languages is None else languages
    ids = df.select(F.col(id_col).alias("email_id"))
    half = ids.count() // len(languages) // 2
    ranked = global_rank(ids, "email_id", seed, rank="_n").withColumn("_n", F.col("_n") - 1)
    whole = len(languages) * 2 * half
    left_over = F.col("_n") - whole
    n = F.when(left_over < 0, F.col("_n")).otherwise(left_over * max(half, 1))
    return _corpus_rows(ranked, n, F.lit(max(half, 1)), languages, seed)


def match_templates(df: DataFrame, text: str = "email_text") -> DataFrame:
    """Rows of the complete expansion with the number of mails that start with that exact line.

    The expansion has a fixed size, so it is broadcast: mails without a template line are dropped
    in the scan, and only one count per expansion row is shuffled.
    """
    expansion = expand_templates(df.sparkSession)
    lines = df.select(F.substring_index(F.col(text), "\n", 1).alias("line"))
    known = F.broadcast(expansion.select(F.col("email_text").alias("line")))
    counts = (
        lines.join(known, "line", "left_semi").groupBy("line").agg(F.count("*").alias("n_emails"))
    )
    return (
        expansion.join(counts, F.col("email_text") == F.col("line"), "left")
        .withColumn("n_emails", F.coalesce("n_emails", F.lit(0)))
        .drop("line")
    )
