"""Augmentation: disguised links, synonyms of signal words, digit-for-letter swaps.

Each function returns only the changed copies, tagged in ``aug``; ``augment`` adds them to the
table they were made from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.functions.signals import (
    URL_COVER_PATTERN,
    URL_RUN_PATTERN,
    has_url_hint,
    may_cross_runs,
)


def obfuscate_url(url: Column) -> Column:
    """Keep the first character, then write ``@`` for ``a`` and ``0`` for ``o``."""
    return F.concat(F.substring(url, 1, 1), F.translate(F.substr(url, F.lit(2)), "ao", "@0"))


def _weave(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(URL_COVER_PATTERN), F.lit(0))
    links = F.regexp_extract_all(text, F.lit(URL_COVER_PATTERN), F.lit(1))
    changed = F.zip_with(
        pieces, links, lambda piece, link: F.when(link == "", piece).otherwise(obfuscate_url(link))
    )
    return F.array_join(changed, "")


def obfuscate_urls(text: Column) -> Column:
    """The text with every URL match disguised in place; all other characters stay as they are.

    Only the runs that may hold a match are taken apart.
    """
    between = F.split(text, URL_RUN_PATTERN, -1)
    runs = F.transform(F.regexp_extract_all(text, F.lit(URL_RUN_PATTERN), F.lit(0)), _weave)
    woven = F.zip_with(between, F.concat(runs, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return (
        F.when(~has_url_hint(text), text)
        .when(may_cross_runs(text), _weave(text))
        .otherwise(F.array_join(woven, ""))
    )


def substitute_synonyms(text: Column) -> Column:
    """Whole-word, case-insensitive replacement by the synonym table, in table order."""

    def one(current: Column, pair: tuple[str, str]) -> Column:
        word, synonym = pair
        return F.regexp_replace(
            current, F.lit(rf"(?i)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])"), F.lit(synonym)
        )

    return reduce(one, C.SYNONYMS, text)


def swap_digits(text: Column) -> Column:
    """The digit 0 written as the letter O."""
    return F.translate(text, "0", "O")


METHODS = {"url": obfuscate_urls, "synonym": substitute_synonyms, "digit": swap_digits}


def changed_copies(df: DataFrame, method: str, text: str = "email_text") -> DataFrame:
    """Copies of the mails that a method changes, with ``aug`` naming it.

    The new text passes through a generator, below which a filter cannot be pushed; otherwise it
    would be worked out twice, once to compare it and once to return it.
    """
    after = METHODS[method](F.col(text))
    return (
        df.withColumn("_after", F.explode_outer(F.array(after)))
        .where(F.col("_after") != F.col(text))
        .withColumn(text, F.col("_after"))
        .withColumn("aug", F.lit(method))
        .drop("_after")
    )


def augment(
    df: DataFrame, methods: tuple[str, ...] = ("synonym", "url"), text: str = "email_text"
) -> DataFrame:
    """The mails (``aug`` null) together with the changed copies of each method."""
    original = df.withColumn("aug", F.lit(None).cast("string"))
    return reduce(
        DataFrame.unionByName, [changed_copies(df, m, text) for m in methods], original
    )
