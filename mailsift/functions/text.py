"""Text expressions: whitespace, tokens, token ids, padding, previews, language guess.

Everything here is a native Spark expression; no Python runs per row.

Whitespace follows Python's ``str.isspace``: Unicode white space plus the four separators
0x1C-0x1F. The patterns therefore carry the ``U`` flag, which makes ``\\s`` cover Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsift import constants as C

SPACE = r"\s\x1C-\x1F"
"""Body of a character class matching, under ``(?U)``, exactly Python's whitespace."""

WORD = r"\p{L}\p{N}_"
"""Body of a character class matching exactly Python's ``\\w``."""


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return text.isNull() | ~text.rlike(rf"(?U)[^{SPACE}]")


def tokens(text: Column, max_len: int | None = None) -> Column:
    """Whitespace tokens in order, without empties; the first ``max_len`` when given.

    With ``max_len`` the splitter stops after ``max_len + 1`` cuts, so a long mail is not cut into
    pieces that would be thrown away; the tokens kept are the same.
    """
    limit = -1 if max_len is None else max_len + 2
    pieces = F.split(F.coalesce(text, F.lit("")), rf"(?U)[{SPACE}]+", limit)
    kept = F.filter(pieces, lambda piece: piece != "")
    return kept if max_len is None else F.slice(kept, 1, max_len)


def token_count(text: Column) -> Column:
    """Number of whitespace tokens of the whole text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"(?U)[^{SPACE}]+"))


def stable_int(text: Column) -> Column:
    """First 32 bits of the MD5 of a string, as a non-negative BIGINT.

    The same in every process and engine, unlike Python's salted string hash.
    """
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def token_ids(
    token_array: Column, vocab_size: int = C.VOCAB_SIZE, method: str = "md5"
) -> Column:
    """Stable hashed ids in ``[0, vocab_size)``.

    ``md5`` can be recomputed by any engine; ``xxhash64`` is several times faster and is what the
    classifier uses.
    """
    if method == "md5":
        return F.transform(
            token_array, lambda t: (stable_int(t) % F.lit(vocab_size)).cast("int")
        )
    if method == "xxhash64":
        return F.transform(
            token_array, lambda t: F.pmod(F.xxhash64(t), F.lit(vocab_size)).cast("int")
        )
    raise ValueError(f"unknown hash method: {method}")


def pad_ids(ids: Column, max_len: int = C.MAX_SEQ_LEN, pad_id: int = 0) -> Column:
    """Cut at ``max_len`` and fill up to it on the right with ``pad_id``."""
    cut = F.slice(ids, 1, max_len)
    fill = F.array_repeat(F.lit(pad_id).cast("int"), F.lit(max_len) - F.size(cut))
    return F.concat(cut, fill)


def fold_ids(ids: Column, vocab_size: int = C.VOCAB_SIZE) -> Column:
    """Fold ids at or beyond the vocabulary back into it; other arrays are left as they are."""
    size = max(1, vocab_size)
    folded = F.transform(ids, lambda i: i % F.lit(size))
    return F.when(F.array_max(ids) >= vocab_size, folded).otherwise(ids)


def sequence_ids(
    text: Column,
    max_len: int = C.MAX_SEQ_LEN,
    vocab_size: int = C.VOCAB_SIZE,
    method: str = "md5",
) -> Column:
    """Text to a fixed-length id array: tokenise, hash, pad."""
    return pad_ids(token_ids(tokens(text, max_len), vocab_size, method), max_len)


def padding_mask(ids: Column, pad_id: int = 0) -> Column:
    """1.0 where there is a token, 0.0 where there is padding.

    A token whose hash equals the pad id is masked too; that is inherent in sharing the id space.
    """
    return F.transform(ids, lambda i: (i != F.lit(pad_id)).cast("float"))


def preview(text: Column, length: int = C.PREVIEW_CHARS) -> Column:
    """First characters followed by an ellipsis, for display only."""
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def detect_language(text: Column) -> Column:
    """Guess ``zh``, ``ru``, ``sw`` or ``en`` from script shares and function words.

    A text is Chinese or Russian when at least a fifth of its letters are Han or Cyrillic (the
    larger share wins); otherwise it is Swahili when it holds more Swahili than English function
    words, and English in every other case. Blank text gives null.
    """
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    han = F.regexp_count(text, F.lit(r"\p{IsHan}"))
    cyrillic = F.regexp_count(text, F.lit(r"\p{IsCyrillic}"))

    words = F.split(F.lower(text), r"[^\p{L}]+")

    def hits(listed: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(listed)))

    return (
        F.when(is_blank(text), F.lit(None).cast("string"))
        .when((han * 5 >= letters) & (han > 0) & (han >= cyrillic), "zh")
        .when((cyrillic * 5 >= letters) & (cyrillic > 0), "ru")
        .when(hits(C.SWAHILI_STOPWORDS) > hits(C.ENGLISH_STOPWORDS), "sw")
        .otherwise("en")
    )
