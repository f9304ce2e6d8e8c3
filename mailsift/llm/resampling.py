"""Resampling of documents by importance towards a target corpus.

Features are all words and all pairs of neighbouring words of a whole text, repeats counted; a
feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``BUCKETS``. A bucket's gain is the floored
log ratio (in thousandths) of its smoothed share in the target and in the documents, a document's
weight the floored mean of its features' gains, its score the weight plus a Gumbel variate that
follows from its id. The highest scores are drawn, so draws go without replacement in proportion
to exp(weight).

*Head and tail.* A first pass counts words and pairs over all texts in tables of bounded size in each
task and adds them up. The most frequent words are broadcast with their bucket and the exact CRC
state after the word and a space, the most frequent pairs with their bucket, in a table with one
slot per key. Every other feature, the tail, takes the direct CRC: of a word's bytes, or of the
second word's bytes continued from the first one's state. Both add to the same exact totals, so
which features are in the head has no effect on any result.

*Rank.* Scores are sorted in ranges over all tasks; a rank is the size of the ranges before plus
the place in the own range.

Defined results: a null or empty text, or one without words, has 0 features and weight 0. Of the
rows with at least ``MIN_WORDS`` words, ``PERCENT`` per cent (floored) are drawn. A row with a null id has
null score and rank and takes no part in the draw, though its features count in the totals. Rows
with equal ids are rows of their own. With an empty target all shares are smoothed ones. Other
columns, also those named like results, are neither read nor returned.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256
from itertools import count, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import map_stream, place_in_order
from mailsift.session import shared_path

BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
PERCENT = 25
HEAD_WORDS = 32_768
HEAD_PAIRS = 65_536
SLOT_BITS = 18  # slots of the table of frequent pairs
COUNTED = 262_144  # words, and pairs, that a task counts at once
PIECE = 1 << 19  # bytes whose words are held at once
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Characters of words, A-Z as a-z; all others become spaces.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def pieces(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes], int]]:
    """Words of the texts: number of the text, words, how many of them the piece before had already.

    A long text comes in pieces of about ``PIECE`` bytes, each of which begins with the last word
    of the one before, so that no pair is lost.
    """
    for number, text in enumerate(texts):
        raw = (text or b"").translate(_LETTERS)
        at, last = 0, []
        while at < len(raw):
            end = len(raw)
            if end - at > PIECE:
                end = raw.rfind(b" ", at, at + PIECE) + 1 or raw.find(b" ", at + PIECE) + 1 or len(raw)
            words = last + raw[at:end].split()
            if len(words) > len(last):
                yield number, words, len(last)
            at, last = end, words[-1:]


def groups(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words of several pieces, and each piece's text, number of words and of repeated ones."""
    held, sizes = [], []
    for number, words, again in pieces(texts):
        held += words
        sizes.append((number, len(words), again))
        if len(held) * 6 > PIECE:
            yield held, sizes
            held, sizes = [], []
    if sizes:
        yield held, sizes


class Head:
    """Frequent words and pairs with what their features' buckets follow from."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int = BUCKETS):
        """``words`` and ``pairs`` from the most frequent on; of pairs with one slot the first stays."""
        self.buckets = buckets
        self.number = {w: i for i, w in enumerate(words)}
        self.bucket = np.array([crc32(w) % buckets for w in words] + [0], dtype=np.int64)
        self.state = [crc32(w + b" ") for w in words]
        self.keys = np.full(1 << SLOT_BITS, -1, dtype=np.int64)
        self.pair_bucket = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for first, second in pairs:
            a, b = self.number.get(first), self.number.get(second)
            if a is None or b is None:
                continue
            key = a << 32 | b
            slot = int(self.slots(np.array([key]))[0])
            if self.keys[slot] < 0:
                self.keys[slot], self.pair_bucket[slot] = key, crc32(second, self.state[a]) % buckets

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def buckets_of(self, words: list[bytes], sizes: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all features of the pieces, and the texts that they belong to."""
        n = len(words)
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, n)
        single = self.bucket[numbers]
        tail = np.nonzero(numbers < 0)[0]
        single[tail] = [crc32(words[i]) % self.buckets for i in tail.tolist()]
        counts = np.array([s[1] for s in sizes])
        owner = np.repeat(np.array([s[0] for s in sizes]), counts)
        starts = np.cumsum(counts) - counts
        counted = np.ones(n, dtype=bool)
        counted[starts[[s[2] > 0 for s in sizes]]] = False
        first = np.ones(n, dtype=bool)
        first[starts + counts - 1] = False
        first = np.nonzero(first)[0]  # words that a pair begins with
        keys = numbers[first] << 32 | numbers[first + 1]
        slot = self.slots(keys)
        known = (keys >= 0) & (self.keys[slot] == keys)  # a negative number makes the key negative
        pair = self.pair_bucket[slot]
        state, number_of = self.state, numbers.tolist()
        rest = np.nonzero(~known)[0]
        pair[rest] = [
            crc32(words[i + 1], state[number_of[i]] if number_of[i] >= 0 else crc32(words[i] + b" ")) % self.buckets
            for i in first[rest].tolist()
        ]
        return np.concatenate([single[counted], pair]), np.concatenate([owner[counted], owner[first]])


class _Frequent:
    """The most frequent words and pairs of a part of the texts, counted in bounded tables.

    A pair counts where it comes twice in a group of texts; a full table of pairs keeps its larger
    half.
    """

    def __init__(self):
        self.number = defaultdict(count().__next__)
        self.words = np.zeros(0, dtype=np.int64)
        self.keys, self.copies, self.held = [], [], 0

    def add(self, words: list[bytes]) -> None:
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        found = np.bincount(at, minlength=len(self.number))
        found[: len(self.words)] += self.words
        self.words = found
        keys, copies = np.unique(at[:-1] << 32 | at[1:], return_counts=True)
        twice = copies > 1
        self.keys.append(keys[twice])
        self.copies.append(copies[twice])
        self.held += len(self.keys[-1])
        if self.held > COUNTED:
            self.merge(COUNTED // 2)

    def merge(self, most: int) -> None:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        copies = np.bincount(at, np.concatenate(self.copies)).astype(np.int64)
        best = np.argsort(-copies, kind="stable")[:most]
        self.keys, self.copies, self.held = [keys[best]], [copies[best]], len(best)

    def rows(self) -> Iterator[tuple[bytes, bytes | None, int]]:
        """The most frequent words (without a second) and pairs."""
        names = list(self.number)
        for i in np.argsort(-self.words, kind="stable")[: HEAD_WORDS // 2].tolist():
            yield names[i], None, int(self.words[i])
        if self.keys:
            self.merge(HEAD_PAIRS // 2)
            for key, n in zip(self.keys[0].tolist(), self.copies[0].tolist()):
                yield names[key >> 32], names[key & 0xFFFFFFFF], n


def head_of(df: DataFrame, text_col: str = "text") -> Head:
    """The head of all texts of ``df``.

    Each task counts in tables of bounded size and gives its most frequent features; the sums of
    these choose the head.
    """

    def give(found: _Frequent) -> Iterator[pa.RecordBatch]:
        best = [r for r in found.rows() if r[2] > 1]
        if best:
            a, b, n = zip(*best)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"]
            )

    def count_all(batches):
        found = _Frequent()
        for batch in batches:
            for words, _ in groups(_bytes(batch.column(0))):
                found.add(words)  # a few pairs over two texts: of no effect on results
                if len(found.number) > COUNTED:
                    yield from give(found)
                    found = _Frequent()
        yield from give(found)

    found = map_stream(df.select(text_col), count_all, "a binary, b binary, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))

    def most(rows: DataFrame, limit: int) -> list[tuple]:
        best = rows.orderBy(F.desc("n"), "a", "b").limit(limit).select("a", "b").toArrow()
        return list(zip(*[c.to_pylist() for c in best.columns]))

    path = shared_path(df.sparkSession, "head")
    found.write.parquet(path)
    found = df.sparkSession.read.schema(found.schema).parquet(path)
    words = [a for a, _ in most(found.where("b is null"), HEAD_WORDS)]
    return Head(words, most(found.where("b is not null"), HEAD_PAIRS))


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def bucket_totals(df: DataFrame, head: Head, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    packed = df.sparkSession.sparkContext.broadcast(head)

    def count_all(batches):
        own = packed.value
        totals = np.zeros(own.buckets, dtype=np.int64)
        for batch in batches:
            for words, sizes in groups(_bytes(batch.column(0))):
                totals += np.bincount(own.buckets_of(words, sizes)[0], minlength=own.buckets)
        at = np.nonzero(totals)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], ["bucket", "n"])

    summed = map_stream(df.select(text_col), count_all, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(head.buckets, dtype=np.int64)
    for row in summed.collect():  # one row per bucket
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, from the totals of the documents and of the target."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n))))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        dtype=np.int64,
    )


def noise(doc_id: int, seed: int = SEED) -> int:
    """A Gumbel variate in thousandths, floored, from the id."""
    h = int(sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(df: DataFrame, head: Head, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_features, weight, score``, one row per row."""
    packed = df.sparkSession.sparkContext.broadcast((head, gain))
    names = [id_col, "n_words", "n_features", "weight", "score"]

    def work(batches):
        own, gain_of = packed.value
        for batch in batches:
            n = batch.num_rows
            n_words, features, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for words, sizes in groups(_bytes(batch.column(1))):
                for number, size, again in sizes:
                    n_words[number] += size - again
                buckets, texts = own.buckets_of(words, sizes)
                features += np.bincount(texts, minlength=n)
                total += np.bincount(texts, gain_of[buckets], minlength=n).astype(np.int64)  # exact below 2 ** 53
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            ids = batch.column(0).to_pylist()
            scores = [None if i is None else w + noise(i) for i, w in zip(ids, weight.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_words), pa.array(features), pa.array(weight),
                    pa.array(scores, pa.int64()),
                ],
                names,
            )

    chosen = df.select(id_col, text_col)
    kind = chosen.schema[0].dataType.simpleString()
    return map_stream(chosen, work, f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    percent: int = PERCENT, min_words: int = MIN_WORDS,
) -> DataFrame:
    """``id_col, n_features, weight, score, rank``; ``rank`` is null where the row is not drawn."""
    spark = df.sparkSession
    path = shared_path(spark, "resampling")
    head = head_of(df, text_col)
    gain = gains(bucket_totals(df, head, text_col), bucket_totals(target, head, target_col))
    weighed = weigh(df, head, gain, id_col, text_col)
    weighed.write.parquet(f"{path}/weighed")
    weighed = spark.read.schema(weighed.schema).parquet(f"{path}/weighed")
    takes_part = F.col("score").isNotNull() & (F.col("n_words") >= min_words)
    placed = place_in_order(
        weighed.where(takes_part), [F.desc("score"), F.col(id_col), F.col("n_features")], f"{path}/placed"
    )
    sizes = sorted(placed.groupBy("part").count().collect())  # one row per shuffle partition
    parts, total = [], 0
    for part, n in sizes:
        parts.append((part, total))
        total += n
    before = spark.createDataFrame(parts, "part bigint, before bigint")
    rank = F.col("idx") + F.col("before") + 1
    drawn = placed.join(F.broadcast(before), "part").withColumn(
        "rank", F.when(rank <= percent * total // 100, rank)
    )
    out = [id_col, "n_features", "weight", "score"]
    rest = weighed.where(~takes_part).select(*out, F.lit(None).cast("bigint").alias("rank"))
    return drawn.select(*out, "rank").unionAll(rest)
