"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1-, 2- and 3-grams per language are gathered in the tasks as dense arrays and
added up by Spark. The matrix of log probabilities has one row per language and
``ORDERS * 2 ** BITS`` columns; the number of languages is checked against ``MAX_LANGUAGES``, so
its size has a bound and it is broadcast. A batch of texts is scored at once: its characters are
one array, n-grams never cross texts, and the log probabilities are added up per text.

Defined results: a text that is null or has no letter gives ``und`` with score 0; if nothing was
learned, every text does. The score is the posterior probability of the predicted language, taken
per n-gram of evidence up to ``EVIDENCE`` n-grams so that long texts do not all score 1. Ties go
to the first language in alphabetical order. Rows with a null id are never learned from. Other
columns are neither read nor returned; equal rows give equal rows; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import fold, map_batches, map_stream

BITS = 14
ORDERS = 3
MAX_LANGUAGES = 500
EVIDENCE = 200  # n-grams that count in full for the score
SMOOTHING = 0.5
UNDETERMINED = "und"
MIN_SCORE = 0.5  # below it a filter rejects a text
GROUP_CHARS = 250_000  # characters scored at once, about 15 MB of arrays
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def units(texts: list[str]) -> list[tuple[int, str, int]]:
    """Lower-cased pieces of the texts: number of the text, piece, n-grams' starts in it.

    A long text is cut into pieces that overlap by one n-gram less a character, so its n-grams are
    those of the whole text.
    """
    found = []
    for i, text in enumerate(texts):
        low = text.lower()
        for at in range(0, len(low), GROUP_CHARS):
            piece = low[at : at + GROUP_CHARS + ORDERS - 1]
            found.append((i, piece, min(GROUP_CHARS, len(low) - at)))
    return found


def grouped(pieces: list[tuple[int, str, int]]) -> Iterator[list[tuple[int, str, int]]]:
    """The pieces in groups of at most about ``GROUP_CHARS`` characters, or one piece."""
    now, chars = [], 0
    for piece in pieces:
        if now and chars + piece[2] > GROUP_CHARS:
            yield now
            now, chars = [], 0
        now.append(piece)
        chars += piece[2]
    if now:
        yield now


def hashed_grams(pieces: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Columns of all n-grams of the pieces, and the end of each piece's part."""
    sizes = np.array([len(text) for _, text, _ in pieces], dtype=np.int32)
    joined = "".join([text for _, text, _ in pieces]).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(joined, dtype=np.uint32)
    ends = np.cumsum(sizes, dtype=np.int32)
    starts = np.array([n for _, _, n in pieces], dtype=np.int32)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    position = np.arange(len(codes), dtype=np.int32)
    is_start = position < np.repeat(ends - sizes + starts, sizes)
    text_end = np.repeat(ends, sizes)
    columns, owners = [], []
    key = np.zeros(len(codes), dtype=np.uint32)
    for order in range(ORDERS):
        valid = len(codes) - order
        if valid <= 0:
            break
        key = key[:valid] * np.uint32(31) + codes[order:] * _MULTIPLIERS[order]
        inside = is_start[:valid] & (position[:valid] + order < text_end[:valid])
        mixed = (key ^ (key >> np.uint32(15))) * np.uint32(2654435761)
        column = (mixed >> np.uint32(32 - BITS)) + np.uint32(order << BITS)
        columns.append(column[inside])
        owners.append(owner[:valid][inside])
    if not columns:
        return np.zeros(0, dtype=np.uint32), np.zeros(len(pieces), dtype=np.int64)
    column, owner = np.concatenate(columns), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return column[order], np.cumsum(np.bincount(owner, minlength=len(pieces)))


def learn(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities, from all rows of ``df`` with a language and a letter."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = (batch.column(i).to_pylist() for i in (0, 1))
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(langs, texts):
                if has_letter(text):
                    by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                total = totals.setdefault(lang, np.zeros(ORDERS << BITS, dtype=np.int64))
                for pieces in grouped(units(own)):
                    columns, _ = hashed_grams(pieces)
                    total += np.bincount(columns, minlength=ORDERS << BITS)
        for lang, total in totals.items():
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])],
                ["lang", "column", "n"],
            )

    known = df.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    languages = sorted(r.lang for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counted = (
        map_stream(known, count, "lang string, column bigint, n bigint")
        .groupBy("lang", "column")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # at most MAX_LANGUAGES * ORDERS * 2 ** BITS rows
    )
    counts = np.zeros((len(languages), ORDERS << BITS))
    row = {lang: i for i, lang in enumerate(languages)}
    rows = np.array([row[x] for x in counted.column("lang").to_pylist()], dtype=np.int64)
    counts[rows, np.array(counted.column("column"), dtype=np.int64)] = np.array(counted.column("n"))
    learned = counts.sum(axis=1) > 0
    languages = [x for x, ok in zip(languages, learned) if ok]
    counts = counts[learned] + SMOOTHING
    if not languages:
        return [], np.zeros((0, ORDERS << BITS), dtype=np.float32)
    shares = counts.reshape(len(languages), ORDERS, 1 << BITS)
    logs = np.log(shares / shares.sum(axis=2, keepdims=True))
    return languages, logs.reshape(len(languages), -1).astype(np.float32)


def predict(languages: list[str], logs: np.ndarray, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and the score of each text."""
    predicted, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if has_letter(t)] if languages else []
    if not rows:
        return predicted, scores
    sums, sizes = np.zeros((len(languages), len(rows))), np.zeros(len(rows))
    for pieces in grouped(units([texts[i] for i in rows])):
        columns, ends = hashed_grams(pieces)
        starts = np.concatenate([[0], ends[:-1]])
        text_of = np.array([i for i, _, _ in pieces])
        np.add.at(sizes, text_of, ends - starts)
        for total, log in zip(sums, logs):
            np.add.at(total, text_of, np.add.reduceat(log[columns], starts, dtype=np.float64))
    scaled = sums * np.minimum(1.0, EVIDENCE / sizes)
    scaled -= scaled.max(axis=0)
    odds = np.exp(scaled)
    best = sums.argmax(axis=0)
    share = odds[best, np.arange(len(rows))] / odds.sum(axis=0)
    for i, b, s in zip(rows, best.tolist(), share.tolist()):
        predicted[i], scores[i] = languages[b], s
    return predicted, scores


def identify(
    df: DataFrame,
    model: tuple[list[str], np.ndarray],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, lang_pred, score``, one row per row of ``df``: one narrow pass."""
    packed = df.sparkSession.sparkContext.broadcast(model)

    def setup():
        languages, logs = packed.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            predicted, scores = predict(languages, logs, batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(predicted, pa.string()), pa.array(scores, pa.float64())],
                [id_col, "lang_pred", "score"],
            )

        return work

    chosen = df.select(id_col, text_col)
    kind = chosen.schema[0].dataType.simpleString()
    return map_batches(chosen, setup, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(
    df: DataFrame, model: tuple[list[str], np.ndarray], min_score: float = MIN_SCORE, text_col: str = "text"
) -> DataFrame:
    """The rows of ``df`` whose language is determined with at least ``min_score``."""
    packed = df.sparkSession.sparkContext.broadcast(model)
    position = df.columns.index(text_col)

    def setup():
        languages, logs = packed.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            predicted, scores = predict(languages, logs, batch.column(position).to_pylist())
            kept = [p != UNDETERMINED and s >= min_score for p, s in zip(predicted, scores)]
            return batch.filter(pa.array(kept, pa.bool_()))

        return work

    return map_batches(df, setup, df.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from; a null id is not one of them, but is not learned from either."""
    return F.coalesce(fold(id_col, 3) == 1, F.lit(False))


def learned_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return df.where(fold(id_col, 3) != 1)
