"""Line-first cleaning and repetition rules, in DataFrame functions only.

Each line is judged by itself: it fails if it is short and ends without punctuation, if runs of
punctuation stand in three places or more, if it is navigation (three separators or more), or if
it holds boilerplate. Failing lines are removed, and
a text that loses more than ``MAX_LOST`` of its characters is rejected, as is one with fewer than
``MIN_WORDS`` words or with more than ``MAX_REPEAT`` percent of its words in repeated windows. One
narrow pass: no shuffle, no Python.

Windows of eight words are compared by a 64-bit hash within one text.

Defined results: a null or empty text has no words and is rejected; a blank line is neither judged
nor counted; equal rows give equal rows; other columns are neither read nor returned, unless named
in ``keep``. Whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import SPACE

# Limits of the base rules and their characters.
MIN_WORDS = 20
MAX_REPEAT = 30  # percent of the words
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

# Patterns of the line rules; they mean the same in Java and in RE2.
HAS_WORD = f"[^{SPACE}]"
ENDED = "[.!?…。！？:;][\"'”’»)\\]]*[\\x20\\x09-\\x0D]*\\z"
LONG_LINE = 8  # lines of so many words need no punctuation at the end
LONG = f"^[{SPACE}]*([^{SPACE}]+[{SPACE}]+){{{LONG_LINE - 1}}}[^{SPACE}]"
_SEPARATOR = "|»›·•>"
NAVIGATION = f"[{_SEPARATOR}][^{_SEPARATOR}]*[{_SEPARATOR}][^{_SEPARATOR}]*[{_SEPARATOR}]"
_NOISE = "#*$%&!"
NOISE = f"[{_NOISE}]{{2}}[^{_NOISE}]+[{_NOISE}]{{2}}[^{_NOISE}]+[{_NOISE}]{{2}}"
BOILERPLATE = (
    "(?i)lorem ipsum|javascript|cookie|terms of (use|service)|privacy policy|all rights reserved"
    "|copyright|licen[sc]ed under|this (file|work|software) is|powered by|subscribe"
    "|click here|sign in|log in|[{}]"
)
MAX_LOST = 50  # percent of the characters of non-blank lines


def line_kept(line: Column) -> Column:
    """Whether a non-blank line passes all rules."""
    return (
        (line.rlike(ENDED) | line.rlike(LONG))
        & ~line.rlike(NOISE)
        & ~line.rlike(NAVIGATION)
        & ~line.rlike(BOILERPLATE)
    )


def repeated_words(words: str, hashes: str) -> Column:
    """Words in windows that occur twice or more, from the sorted hashes of the windows."""

    def twin(x: Column, j: Column) -> Column:
        def same(k: Column) -> Column:
            return F.coalesce(F.get(hashes, k)["h"] == x["h"], F.lit(False))

        return same(j - 1) | same(j + 1)

    places = F.array_sort(F.transform(F.filter(hashes, twin), lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total")),
        lambda acc, p: F.struct(
            p.alias("last"),
            (acc["total"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return F.coalesce(covered, F.lit(0))


def quality(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``id_col``, the counts, ``base_failed``, ``kept``, ``n_lines``, ``n_lines_kept`` and
    ``clean_text`` (the lines that passed)."""
    kept = [F.col(c) for c in (keep or [id_col])]
    names = keep or [id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = df.select(
        *kept,
        text.alias("_text"),
        F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD)).alias("_lines"),
    )
    n = F.size("_words")
    windows = F.when(
        n > WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]),
        ),
    )
    hashed = split.select(
        "*",
        windows.alias("_windows"),
        F.filter("_lines", line_kept).alias("_kept"),
    )
    twins = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = F.when(
        twins,
        F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    counted = hashed.select(
        *names,
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size("_kept").cast("bigint").alias("n_lines_kept"),
        F.length(F.array_join("_lines", "")).alias("_all_chars"),
        F.length(F.array_join("_kept", "")).alias("_kept_chars"),
        F.array_join("_kept", "\n").alias("clean_text"),
        ordered.alias("_ordered"),
    ).withColumn("n_repeat_words", repeated_words("_words", "_ordered").cast("bigint"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")
    )
    lost = 100 * (F.col("_all_chars") - F.col("_kept_chars")) > MAX_LOST * F.col("_all_chars")
    return counted.select(
        *names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~lost).alias("kept"),
        "n_lines", "n_lines_kept", "clean_text",
    )
