"""Token counts under a sentencepiece BPE model, without moving any pre-token.

A text becomes pre-tokens: runs of the space mark followed by the characters up to the next mark.
No piece of the model has the mark after another character (checked when the model is loaded), so
no merge crosses a pre-token and the count of a text is the sum over its pre-tokens. Tier one is a
broadcast table of the lengths of the pre-tokens that are frequent in all texts, bounded by
``TABLE_SIZE``: each task counts its own in a table of bounded size, which keeps its larger half when it is
full, and gives its most frequent ones, which Spark adds up. Tier two is a
bounded cache in each worker that encodes what the table lacks. Both only save time: which
pre-tokens are in the table never changes a count.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; equal rows give equal
rows; other columns are neither read nor returned. Texts of any length are counted whole.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import BoundedCache, map_batches, map_stream, texts_of

MARK = "▁"  # stands for a space
PRE_TOKENS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
TABLE_SIZE = 50_000  # pre-tokens in the broadcast table
COUNTED = 200_000  # pre-tokens that a task counts at once, to choose the table
CACHE_LIMIT = 400_000  # pre-tokens a worker remembers


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, the mark that the model puts in front included."""
    return PRE_TOKENS.findall(MARK + text.replace(" ", MARK)) if text else []


class PieceCounter:
    """Lengths of pre-tokens: the table first, then the cache, then the model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross spaces; its counts do not add up")
        self.cache = BoundedCache(self.length, CACHE_LIMIT)
        self.table: dict[str, int] = {}
        self.loaded = None

    def length(self, token: str) -> int:
        # encode() puts one mark in front; a lone mark would come out as an empty text.
        rest = token[1:].replace(MARK, " ")
        return len(self.model.encode(rest, num_threads=1)) if rest else 1

    def load(self, name: str, tokens: list[str], lengths: bytes) -> None:
        if self.loaded != name:
            self.table = dict(zip(tokens, np.frombuffer(lengths, dtype=np.uint8).tolist()))
            self.loaded = name

    def count(self, text: str) -> int:
        found = pre_tokens(text)
        first = list(map(self.table.get, found))
        if None not in first:
            return sum(first)
        cache = self.cache
        return sum([cache[t] if n is None else n for t, n in zip(found, first)])


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    """One per worker process and model; its cache lives on from task to task."""
    return PieceCounter(path)


def frequent_lengths(df: DataFrame, path: str, text_col: str = "text") -> tuple[list[str], bytes]:
    """The frequent pre-tokens of all texts and their lengths (one byte each).

    Counted in the tasks, with at most ``TABLE_SIZE`` rows from each, and added up by Spark; at most
    ``TABLE_SIZE`` rows reach the driver.
    """

    def run(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                counts.update(pre_tokens(text))
                if len(counts) > COUNTED:
                    counts = Counter(dict(counts.most_common(COUNTED // 2)))
        kept = [(t, n) for t, n in counts.most_common(TABLE_SIZE) if n > 1]
        if kept:
            tokens, numbers = zip(*kept)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(numbers, pa.int64())], ["token", "n"])

    top = (
        map_stream(df.select(text_col), run, "token string, n bigint")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(TABLE_SIZE)
        .select("token")
        .toArrow()
    )
    tokens = top.column(0).to_pylist()
    counter = piece_counter(path)
    sizes = [counter.length(t) for t in tokens]
    short = [i for i, n in enumerate(sizes) if n < 256]
    return [tokens[i] for i in short], bytes(sizes[i] for i in short)


def token_counts(
    df: DataFrame,
    path: str,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit``, one row per row of ``df``: one narrow pass."""
    spark = df.sparkSession
    packed = spark.sparkContext.broadcast(frequent_lengths(df, path, text_col))
    name = f"{spark.sparkContext.applicationId}-{packed._jbroadcast.id()}"

    def setup():
        counter = piece_counter(path)
        counter.load(name, *packed.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(1))
            counts = np.array([counter.count(t) for t in texts], dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts),
                    pa.array(counts > limit),
                ],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

        return work

    chosen = df.select(id_col, text_col)
    kind = chosen.schema[0].dataType.simpleString()
    return map_batches(
        chosen, setup, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
