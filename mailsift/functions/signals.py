"""Social-engineering signals: keyword hits, URLs, sender cue and the combined score.

Plan shape. The lower-cased text is put in its own projection, so it is computed once per row
and not once per keyword. Keyword arrays are built from ``contains`` tests without a lambda, which
keeps that projection inside whole-stage code generation. There is no shuffle anywhere.

Cost. Each pattern is linear in the length of the text, also for long runs without a space. URLs
are looked for only inside the runs of non-space characters that hold a scheme or a listed ending;
inside a run, the pattern steps over what is known to hold no further match. The sender cue looks
at each line once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.functions.text import SPACE, WORD

_NONSPACE = f"[^{SPACE}]"
_ENDING = rf"\.(?:{'|'.join(C.URL_ENDINGS)})(?![{WORD}])"
_EDGE = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
# A scheme; or `www` with a literal backslash and any character but a line feed (a plain
# `www.` host is deliberately not matched); or a token that holds a listed ending.
_SCHEME = rf"https?://{_NONSPACE}"
_WWW = rf"www\\[^\n]{_NONSPACE}"
_MATCH = rf"{_SCHEME}+|{_WWW}+|{_EDGE}{_NONSPACE}+{_ENDING}"
# Where no branch matches at a word edge, no later edge of the same run can match the third one
# either. The second alternative therefore steps to the next scheme or to the end of the run; its
# matches leave group 1 empty.
_STEP = rf"{_EDGE}{_NONSPACE}+?(?={_SCHEME}|{_WWW}|[{SPACE}]|\z)"

URL_PATTERN = rf"(?iU)({_MATCH})|{_STEP}"
URL_COVER_PATTERN = rf"(?isU)({_MATCH})|{_STEP}|[{SPACE}]+|."
"""As ``URL_PATTERN``, but its matches put together give back the whole text."""

# Every match lies inside one such run, but for the `www` branch, which may cross a space.
URL_RUN_PATTERN = (
    rf"(?iU)(?<!{_NONSPACE}){_NONSPACE}*?"
    rf"(?:https?://|\.(?:{'|'.join(C.URL_ENDINGS)})){_NONSPACE}*"
)
_URL_HINT = rf"(?iU)https?://|www\\|\.(?:{'|'.join(C.URL_ENDINGS)})"
_WWW_HINT = r"(?iU)www\\"
# One whole line that holds a suspicious ending; tried once per line.
_SUSPICIOUS_LINE = (
    rf"(?iU)(?<![^\n])[^\n]*\.(?:{'|'.join(C.SUSPICIOUS_ENDINGS)})(?![{WORD}])[^\n]*"
)
# Atomic: the first `from: ` of a line decides, so a line is never scanned again.
_FROM_LINE = r"(?iU)(?<![^\n])(?>[^\n]*?from: )[^\n]*@"


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def keyword_hits(lowered: Column, words: list[str]) -> Column:
    """Listed words contained in the (already lower-cased) text, as substrings, in list order."""
    candidates = F.array(*[F.when(F.contains(lowered, F.lit(w)), F.lit(w)) for w in words])
    return F.array_except(candidates, F.array(F.lit(None).cast("string")))


def keyword_count(lowered: Column, words: list[str]) -> Column:
    """Number of listed words contained in the text; the cheap form when only it is needed."""
    return reduce(
        lambda a, b: a + b, [F.contains(lowered, F.lit(w)).cast("int") for w in words]
    )


def may_cross_runs(text: Column) -> Column:
    """True for the rare text in which a URL match may hold a space."""
    return F.contains(text, F.lit("\\")) & text.rlike(_WWW_HINT)


def has_url_hint(text: Column) -> Column:
    """False for a text that cannot hold a URL match; one cheap search, made before any other."""
    return text.rlike(_URL_HINT)


def extract_urls(text: Column) -> Column:
    """URL-like strings in order of appearance, duplicates kept."""
    runs = F.array_join(F.regexp_extract_all(text, F.lit(URL_RUN_PATTERN), F.lit(0)), "\n")
    searched = F.when(may_cross_runs(text), text).otherwise(runs)
    found = F.array_remove(F.regexp_extract_all(searched, F.lit(URL_PATTERN), F.lit(1)), "")
    return F.when(has_url_hint(text), found).otherwise(_no_strings())


def suspicious_urls(urls: Column) -> Column:
    """The URLs that hold one of the suspicious endings, at any place.

    A URL never holds a line feed, so the URLs are searched as the lines of one text; unlike a
    lambda over the array this stays in generated code.
    """
    lines = F.array_join(urls, "\n")
    return F.regexp_extract_all(lines, F.lit(_SUSPICIOUS_LINE), F.lit(0))


def impersonation_cues(text: Column, lowered: Column) -> Column:
    """One cue when a line holds a pasted ``From:`` header with an address."""
    pasted = (
        F.contains(lowered, F.lit("from: "))
        & F.contains(text, F.lit("@"))
        & text.rlike(_FROM_LINE)
    )
    return F.when(pasted, F.array(F.lit(C.IMPERSONATION_CUE))).otherwise(_no_strings())


def heuristic_score(
    urgency: Column, credentials: Column, attachments: Column, suspicious: Column
) -> Column:
    """Capped weighted sum of the four counts; added in this order so doubles are equal."""

    def part(count: Column, cap: int, weight: float) -> Column:
        return F.least(count, F.lit(cap)) * F.lit(weight)

    total = (
        part(urgency, C.URGENCY_CAP, C.URGENCY_WEIGHT)
        + part(credentials, C.CREDENTIAL_CAP, C.CREDENTIAL_WEIGHT)
        + part(attachments, C.ATTACHMENT_CAP, C.ATTACHMENT_WEIGHT)
        + part(suspicious, C.SUSPICIOUS_CAP, C.SUSPICIOUS_WEIGHT)
    )
    return F.least(total, F.lit(C.SCORE_CEILING))


def _prepare(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn(
        "_low", F.lower("_text")
    )


def social_signals(df: DataFrame, text: str = "email_text") -> DataFrame:
    """Add the full signal record: seven arrays and ``heuristic_score``."""
    low = F.col("_low")
    return (
        _prepare(df, text)
        .withColumns(
            {
                "urgency_found": keyword_hits(low, C.URGENCY_WORDS),
                "creds_found": keyword_hits(low, C.CREDENTIAL_WORDS),
                "generic_salutation": keyword_hits(low, C.SALUTATION_WORDS),
                "attachments_mentioned": keyword_hits(low, C.ATTACHMENT_WORDS),
                "urls": extract_urls(F.col("_text")),
                "impersonation_cues": impersonation_cues(F.col("_text"), low),
            }
        )
        .withColumn("suspicious_urls", suspicious_urls(F.col("urls")))
        .withColumn(
            "heuristic_score",
            heuristic_score(
                F.size("urgency_found"),
                F.size("creds_found"),
                F.size("attachments_mentioned"),
                F.size("suspicious_urls"),
            ),
        )
        .drop("_text", "_low")
    )


def signal_counts(df: DataFrame, text: str = "email_text") -> DataFrame:
    """Add the four scored counts only: ``n_urgency, n_creds, n_attachments, n_suspicious``."""
    low = F.col("_low")
    return (
        _prepare(df, text)
        .withColumns(
            {
                "n_urgency": keyword_count(low, C.URGENCY_WORDS),
                "n_creds": keyword_count(low, C.CREDENTIAL_WORDS),
                "n_attachments": keyword_count(low, C.ATTACHMENT_WORDS),
                "n_suspicious": F.size(suspicious_urls(extract_urls(F.col("_text")))),
            }
        )
        .drop("_text", "_low")
    )


def with_heuristic_score(df: DataFrame, text: str = "email_text") -> DataFrame:
    """Add ``heuristic_score`` without building the keyword arrays."""
    return (
        signal_counts(df, text)
        .withColumn(
            "heuristic_score",
            heuristic_score(
                F.col("n_urgency"),
                F.col("n_creds"),
                F.col("n_attachments"),
                F.col("n_suspicious"),
            ),
        )
        .drop("n_urgency", "n_creds", "n_attachments", "n_suspicious")
    )
