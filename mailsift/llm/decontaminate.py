"""Benchmark decontamination: BM25 over test items, block-max WAND, then a check of the overlap.

Every passage of every text is a query against an inverted index of the items. A passage is a
window of words; items are put in classes by length, and a class has windows of a length such that
any occurrence of an item lies in one window almost whole. Scores are BM25 with the item as the
document, as a share of the item's score against itself, so one threshold holds for all items.

Pruning is safe, not approximate: the sum of the terms' highest scores in any item bounds a
passage (WAND), the sum of their highest scores within a block of items bounds the block
(block-max), and only blocks whose bound reaches the threshold are scored. All items at or above
the threshold are then verified: enough word triples of the question and enough of the answer must
stand near the passage. An item's answer is the last quarter of its words unless the table has a
column for it.

The index travels as a broadcast in parts of at most ``PART_WORDS`` words; a larger benchmark
takes several passes over the texts, so what is broadcast at once has a bound.

Defined results: null and empty texts and items match nothing; items of fewer than ``SHORT_ITEM``
words must occur word by word; equal rows give equal rows; a match of a row with a null id has a
null id. Other columns are neither read nor returned. Whole texts are queried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mailsift.llm.common import map_stream, texts_of

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
THRESHOLD = 0.5  # share of an item's own score
OVERLAP = 0.6  # share of the triples of the question, and of the answer
SHORT_ITEM = 8
CLASS_WORDS = 48  # items of the first class; each further class holds items twice as long
BLOCK_ITEMS = 8
PART_WORDS = 1 << 20  # words of items in one broadcast
CHUNK_ITEMS = 512  # items in one index
GROUP_CHARS = 1_000_000
PAIRS = 1 << 19  # words of passages whose bounds are added up at once
CELLS = 1 << 22  # bounds of words in blocks that are held at once
ROUNDING = 1e-4  # more than the rounding errors of a bound, so that pruning stays safe


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def triples(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    """The runs of ``n`` words; none where there are fewer words."""
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def own_triples(words: list[str]) -> set[tuple[str, ...]]:
    """The triples of a part of an item; its pair or its only word if it has no three words."""
    return triples(words, min(3, len(words)))


def overlap(own: set[tuple[str, ...]], near: dict[int, set]) -> float:
    """The share of an item's tuples that stand in a passage, whose tuples are given by size."""
    return len(own & near[len(next(iter(own)))]) / len(own) if own else 1.0


def previous_places(ids: np.ndarray) -> np.ndarray:
    """For each place of an array, the last place before it with the same value, or -1."""
    order = np.argsort(ids, kind="stable")
    before = np.full(len(ids), -1, dtype=np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    return before


@dataclass
class Chunk:
    """An index of items of one length class."""

    window: int
    highest: np.ndarray  # per term: highest share in any item; one more entry, 0, for other words
    local: np.ndarray  # per term: row in ``blocks`` or -1
    blocks: np.ndarray  # per local term and block: highest share in the block
    starts: np.ndarray  # per local term: where its postings start
    posted: np.ndarray  # item numbers
    shares: np.ndarray  # their shares
    items: list[int]  # positions in ``Index.items``

    def open_blocks(
        self, ids: np.ndarray, before: np.ndarray, start: np.ndarray, end: np.ndarray
    ) -> Iterator[tuple[int, np.ndarray]]:
        """Passages that may reach the threshold, each with a flag per block that may hold an item.

        A word counts once per passage, where it stands first. First the highest shares of the
        words in any item are added up (WAND), then, for passages still open, those in each block.
        """
        size = end - start
        ends = np.cumsum(size)
        at = 0
        while at < len(size):
            # Passages of at most about PAIRS words together, at least one.
            offset = ends[at] - size[at]
            to = max(at + 1, int(np.searchsorted(ends, offset + PAIRS, side="right")))
            own = np.repeat(np.arange(at, to), size[at:to])
            place = np.arange(len(own)) - np.repeat(ends[at:to] - size[at:to] - offset, size[at:to])
            place += start[own]
            term = self.local[ids[place]]
            kept = (term >= 0) & (before[place] < start[own])
            own, place, term = own[kept], place[kept], term[kept]
            reach = np.bincount(own - at, self.highest[ids[place]], minlength=to - at)
            kept = reach[own - at] >= THRESHOLD - ROUNDING
            own, term = own[kept], term[kept]
            cuts = np.nonzero(np.diff(own, prepend=-1))[0]
            step = max(1, CELLS // self.blocks.shape[1] // max(1, int(size[at:to].max())))
            for k in range(0, len(cuts), step):
                low = cuts[k]
                high = cuts[k + step] if k + step < len(cuts) else len(own)
                sums = np.add.reduceat(self.blocks[term[low:high]], cuts[k : k + step] - low, axis=0)
                flags = sums >= THRESHOLD - ROUNDING
                for row in np.nonzero(flags.any(axis=1))[0].tolist():
                    yield int(own[cuts[k + row]]), flags[row]
            at = to


@dataclass
class Item:
    item_id: int
    question: set
    answer: set
    needed: float


@dataclass
class Statistics:
    """Number of items, of their words, and of the items that hold each word."""

    n: int
    words: int
    df: Counter

    @classmethod
    def of(cls, items: Iterable[list[str]]) -> Statistics:
        found = cls(0, 0, Counter())
        for words in items:
            found.n += 1
            found.words += len(words)
            found.df.update(set(words))
        return found


class Index:
    """Items of one part of the benchmark."""

    def __init__(self, rows: list[tuple[int, list[str], int]], whole: Statistics | None = None):
        """``rows``: id, words, and how many of the last words are the answer; ``whole``: of all parts."""
        whole = whole or Statistics.of(words for _, words, _ in rows)
        self.items: list[Item] = []
        self.vocab: dict[str, int] = {}
        classes: dict[int, list[int]] = {}
        own: set[str] = set()
        for item_id, words, tail in rows:
            own.update(words)
            cut = len(words) - tail
            needed = OVERLAP if len(words) >= SHORT_ITEM else 1.0
            # The answer's triples reach back over the cut, so that short answers have some.
            answer = own_triples(words[max(0, min(cut, len(words) - 3)) :])
            self.items.append(Item(item_id, own_triples(words[:cut]), answer, needed))
            size = 0
            while len(words) > CLASS_WORDS << size:
                size += 1
            classes.setdefault(size, []).append(len(self.items) - 1)
        for word in sorted(own):
            self.vocab[word] = len(self.vocab)
        n, mean = whole.n, whole.words / max(1, whole.n)
        idf = {w: np.log(1 + (n - whole.df[w] + 0.5) / (whole.df[w] + 0.5)) for w in own}
        self.chunks = [
            self._chunk(rows, own[at : at + CHUNK_ITEMS], size, idf, mean)
            for size, own in sorted(classes.items())
            for at in range(0, len(own), CHUNK_ITEMS)
        ]

    def _chunk(self, rows, own: list[int], size: int, idf: dict, mean: float) -> Chunk:
        # Items with a common rarest word stand together, so that blocks have tight bounds.
        own = sorted(own, key=lambda i: (max(rows[i][1], key=lambda w: (idf[w], w)), i))
        posts: dict[int, list[tuple[int, float]]] = {}
        for number, i in enumerate(own):
            words = rows[i][1]
            norm = K1 * (1 - B + B * len(words) / mean)
            score = {w: idf[w] * f * (K1 + 1) / (f + norm) for w, f in Counter(words).items()}
            total = sum(score.values())
            for w, s in score.items():
                posts.setdefault(self.vocab[w], []).append((number, s / total))
        terms = sorted(posts)
        local = np.full(len(self.vocab) + 1, -1, dtype=np.int32)
        local[terms] = np.arange(len(terms))
        blocks = np.zeros((len(terms), -(-len(own) // BLOCK_ITEMS)), dtype=np.float32)
        highest = np.zeros(len(self.vocab) + 1)
        flat: list[tuple[int, float]] = []
        starts = [0]
        for row, term in enumerate(terms):
            for number, share in posts[term]:
                block = number // BLOCK_ITEMS
                blocks[row, block] = max(blocks[row, block], share)
            highest[term] = max(s for _, s in posts[term])
            flat += posts[term]
            starts.append(len(flat))
        return Chunk(
            (CLASS_WORDS * 4 // 3) << size, highest, local, blocks, np.array(starts),
            np.array([p for p, _ in flat], dtype=np.int64), np.array([s for _, s in flat]), own,
        )

    def matches(self, texts: list[str]) -> list[dict[int, tuple[float, float, float, int]]]:
        """For each text: item -> share of the score, overlaps of question and answer, place."""
        words = [words_of(t) for t in texts]
        flat: list[int] = []
        for own in words:
            flat.extend(map(self.vocab.get, own, repeat(len(self.vocab))))
        ids = np.array(flat, dtype=np.int64)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        found: list[dict[int, tuple[float, float, float, int]]] = [{} for _ in texts]
        before = previous_places(ids)
        for chunk in self.chunks:
            stride = chunk.window // 2
            n = np.where(sizes > 0, np.maximum(1, -(-(sizes - chunk.window) // stride) + 1), 0)
            text = np.repeat(np.arange(len(texts)), n)
            start = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * stride
            end = np.minimum(start + chunk.window, sizes[text])
            begin = first[text]
            for at, blocks in chunk.open_blocks(ids, before, begin + start, begin + end):
                i, a, b = int(text[at]), int(start[at]), int(end[at])
                for position, share in self._score(chunk, ids[first[i] + a : first[i] + b], blocks):
                    item = self.items[position]
                    passage = words[i][max(0, a - stride) : b + stride]
                    sizes_of = {len(t) for own in (item.question, item.answer) for t in islice(own, 1)}
                    near = {n: triples(passage, n) for n in sizes_of}
                    q, r = overlap(item.question, near), overlap(item.answer, near)
                    if q >= item.needed and r >= item.needed:
                        row = (round(share, 6), q, r, a)
                        if row[:3] > found[i].get(item.item_id, (-1.0, 0.0, 0.0, 0))[:3]:
                            found[i][item.item_id] = row
        return found

    def _score(
        self, chunk: Chunk, ids: np.ndarray, open_blocks: np.ndarray
    ) -> list[tuple[int, float]]:
        """Items of a chunk's open blocks that a passage reaches, with their exact shares."""
        rows = np.unique(chunk.local[ids])
        rows = rows[rows >= 0]
        size = chunk.starts[rows + 1] - chunk.starts[rows]
        own = np.repeat(chunk.starts[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        own = own[open_blocks[chunk.posted[own] // BLOCK_ITEMS]]
        scores = np.bincount(chunk.posted[own], chunk.shares[own], minlength=len(chunk.items))
        hit = np.nonzero(scores >= THRESHOLD)[0]
        return [(chunk.items[i], float(scores[i])) for i in hit]


def benchmark_parts(
    benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None
) -> list[Index]:
    """Indexes of the whole benchmark, each of at most about ``PART_WORDS`` words.

    The items are read in the order of their ids through an iterator, one partition at a time, twice:
    first for the statistics of the whole benchmark, which every part scores by, so that where the
    parts are cut has no effect on a match. The statistics and the parts stay on the driver.
    """
    columns = [id_col, text_col, *([answer_col] if answer_col else [])]
    chosen = benchmark.select(columns).orderBy(*columns)

    def items() -> Iterator[tuple[int, list[str], int]]:
        for row in chosen.toLocalIterator():
            words = words_of(row[1] or "")
            extra = words_of(row[2] or "") if answer_col else []
            tail = len(extra) if answer_col else max(1, len(words) // 4)
            words += extra
            if words:
                yield row[0], words, min(tail, len(words))

    whole = Statistics.of(words for _, words, _ in items())
    parts: list[Index] = []
    rows: list[tuple[int, list[str], int]] = []
    held = 0
    for row in items():
        if held and held + len(row[1]) > PART_WORDS:
            parts.append(Index(rows, whole))
            rows, held = [], 0
        rows.append(row)
        held += len(row[1])
    return [*parts, Index(rows, whole)] if rows else parts


def _groups(texts: list[str]):
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= GROUP_CHARS):
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end


def find_contamination(
    df: DataFrame, parts: list[Index], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per text and item found in it: ``id_col, item_id, bm25_share, question_overlap,
    answer_overlap, word_start``."""
    spark = df.sparkSession
    chosen = df.select(id_col, text_col)
    kind = chosen.schema[0].dataType
    names = [id_col, "item_id", "bm25_share", "question_overlap", "answer_overlap", "word_start"]
    schema = (
        f"`{id_col}` {kind.simpleString()}, item_id bigint, bm25_share double, "
        "question_overlap double, answer_overlap double, word_start bigint"
    )

    def search(index: Index) -> DataFrame:
        packed = spark.sparkContext.broadcast(index)

        def run(batches):
            own = packed.value
            for batch in batches:
                texts = texts_of(batch.column(1))
                rows = []
                for a, b in _groups(texts):
                    for i, found in enumerate(own.matches(texts[a:b]), a):
                        rows += [(i, item, *what) for item, what in sorted(found.items())]
                if rows:
                    which, *columns = zip(*rows)
                    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                    ids = batch.column(0).take(pa.array(which))
                    yield pa.RecordBatch.from_arrays(
                        [ids, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names
                    )

        return map_stream(chosen, run, schema)

    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, map(search, parts))


def remove_contaminated(df: DataFrame, parts: list[Index], text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text holds no item; all columns are kept."""
    position = df.columns.index(text_col)

    def without(frame: DataFrame, index: Index) -> DataFrame:
        packed = frame.sparkSession.sparkContext.broadcast(index)

        def run(batches):
            own = packed.value
            for batch in batches:
                texts = texts_of(batch.column(position))
                clean = [not m for a, b in _groups(texts) for m in own.matches(texts[a:b])]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return map_stream(frame, run, df.schema)

    return reduce(without, parts, df)
