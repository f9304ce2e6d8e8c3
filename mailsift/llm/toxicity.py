"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

A text's vector holds a weight for every word: (1 + ln tf) x idf x association, where the association is the
square root of what the word's chi-squared statistic with the label has above ``CHANCE``. So all words of
the sample take part by term frequency and idf, those that go with neither label at weight 0, and
examples of both classes are kept whatever their words. Without the association the nearest neighbours
follow the prose and hardly any toxic text is found (README).

Fitting is bounded: at most ``EXAMPLES`` labelled rows of each class, the first by the hash of
their ids, and of these, classes in turn, as many as hold ``POSTINGS`` different words in all. The bounds make
the index a broadcast of proven size. Scoring covers every text whole, in one narrow pass.

The index is inverted and cut into blocks of examples; it holds each word's highest weight per
block. The blocks with the highest bounds are scored first; of the others only those whose bound
reaches the k-th nearest found so far, so the neighbours are exact. Votes weigh the squared cosine
and the share of the population that an example stands for; a prior of weight ``PRIOR_WEIGHT`` at the
population's rate pulls weak evidence towards it, which keeps scores calibrated. The nearest ids
are evidence.

Defined results: null and empty texts, and texts without any word of weight, score the population's rate;
without labelled rows every score is 0. Rows with a null id are scored but not learned from; a
null label counts as no label; of equal ids in the labels the highest label counts. Ties among
neighbours go to the earlier example. Other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import fold, map_batches, texts_of
from mailsift.session import shared_path

WORD = re.compile(r"\w+")
EXAMPLES = 3_000
POSTINGS = 4_000_000
LONG_TEXT = 1 << 20  # characters, from which on words are not listed all at once
CHANCE = 3.84  # chi-squared that one word in twenty has by chance (one degree of freedom)
NEIGHBOURS = 25
BLOCK = 32
FIRST_BLOCKS = 8  # scored before any is left out
PRIOR_WEIGHT = 0.5
EVIDENCE = 3


def words_of(text: str) -> Counter:
    """How often each word occurs."""
    low = text.lower()
    return Counter(WORD.findall(low) if len(low) < LONG_TEXT else (m.group() for m in WORD.finditer(low)))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Examples:
    """The block-max index: postings by word, in blocks of examples."""

    def __init__(
        self, words: list[str], weight: np.ndarray, rows: list[tuple[int, int]], owner: np.ndarray,
        word: np.ndarray, tf: np.ndarray, rates: dict[int, float], prior: float,
    ):
        """``rows``: id and label of each example; ``owner, word, tf``: what words it holds, how often.

        ``weight`` is that of each of the ``words``; ``rates``: rows of a class that one example
        stands for.
        """
        self.number = {w: i for i, w in enumerate(words)}
        self.weight, self.prior = weight, prior
        value = (1 + np.log(tf)) * weight[word]
        kept = value > 0
        owner, word, value = owner[kept], word[kept], value[kept]
        norm = np.sqrt(np.bincount(owner, value * value, minlength=len(rows)))
        value = value / norm[owner]
        # Examples with the same heaviest word are neighbours in a block.
        heaviest = np.full(len(rows), len(words), dtype=np.int64)
        by_value = np.lexsort((value, owner))
        last = np.concatenate([owner[by_value][1:] != owner[by_value][:-1], [True]]) if len(owner) else owner.astype(bool)
        heaviest[owner[by_value][last]] = word[by_value][last]
        order = np.lexsort(([r[0] for r in rows], heaviest)) if rows else np.zeros(0, dtype=np.int64)
        place = np.empty(len(rows), dtype=np.int64)
        place[order] = np.arange(len(rows))
        self.ids = [rows[i][0] for i in order.tolist()]
        self.labels = np.array([rows[i][1] for i in order.tolist()], dtype=np.float64)
        mean = np.mean([rates[r[1]] for r in rows]) if rows else 1.0
        self.stands_for = np.array([rates[rows[i][1]] / mean for i in order.tolist()])
        self.n_blocks = -(-len(rows) // BLOCK)
        # Postings by word and example; runs are the postings of a word in a block.
        at = np.lexsort((place[owner], word))
        word, self.example, self.value = word[at], place[owner][at], value[at]
        block = self.example // BLOCK
        new = np.ones(len(word), dtype=bool)
        new[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
        self.run_start = np.nonzero(new)[0]
        self.run_size = np.diff(np.concatenate([self.run_start, [len(word)]]))
        self.run_block = block[self.run_start]
        self.run_max = np.maximum.reduceat(self.value, self.run_start) if len(word) else self.value
        runs = np.bincount(word[self.run_start], minlength=len(words))
        self.first_run, self.n_runs = np.cumsum(runs) - runs, runs

    def nearest(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Cosine and number of the nearest examples to a text with these words, nearest first."""
        known = [(self.number[w], n) for w, n in counts.items() if w in self.number]
        nothing = np.zeros(0), np.zeros(0, dtype=np.int64)
        if not known:
            return nothing
        known.sort()
        word, tf = (np.array(c) for c in zip(*known))
        query = (1 + np.log(tf)) * self.weight[word]
        norm = np.sqrt((query * query).sum())
        if not norm:
            return nothing
        run = _ranges(self.first_run[word], self.n_runs[word])
        share = np.repeat(query / norm, self.n_runs[word])
        block = self.run_block[run]
        bounds = np.bincount(block, share * self.run_max[run], minlength=self.n_blocks)

        def scored(open_: np.ndarray) -> np.ndarray:
            chosen = open_[block]
            sizes = self.run_size[run[chosen]]
            post = _ranges(self.run_start[run[chosen]], sizes)
            return np.bincount(
                self.example[post], np.repeat(share[chosen], sizes) * self.value[post], minlength=len(self.ids)
            )

        first = np.zeros(self.n_blocks, dtype=bool)
        first[np.argsort(-bounds, kind="stable")[:FIRST_BLOCKS]] = True
        scores = scored(first)
        least = np.partition(scores, -NEIGHBOURS)[-NEIGHBOURS] if len(scores) >= NEIGHBOURS else 0.0
        rest = ~first & (bounds > 0) & (bounds >= least - 1e-9)
        if rest.any():
            scores += scored(rest)
        scores = np.round(scores, 9)
        found = np.nonzero(scores)[0]
        if len(found) > NEIGHBOURS:
            found = found[scores[found] >= np.partition(scores[found], -NEIGHBOURS)[-NEIGHBOURS]]
        found = found[np.lexsort((found, -scores[found]))][:NEIGHBOURS]
        return scores[found], found

    def score(self, text: str) -> tuple[float, list[int]]:
        cosine, at = self.nearest(words_of(text)) if text else ((), ())
        if not len(at):
            return self.prior, []
        weights = cosine * cosine * self.stands_for[at]
        total = weights.sum() + PRIOR_WEIGHT
        score = float((weights @ self.labels[at] + PRIOR_WEIGHT * self.prior) / total)
        return min(1.0, max(0.0, score)), [self.ids[i] for i in at[:EVIDENCE].tolist()]


def learned(id_col: str) -> Column:
    return fold(id_col, 5) != 0


def weights_of(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """idf x association of words, from the examples of each class that hold them."""
    n, held = n_toxic + n_clean, toxic + clean
    idf = np.log(1 + n / np.maximum(held, 1))
    difference = toxic * (n_clean - clean) - clean * (n_toxic - toxic)
    below = held * (n - held) * float(n_toxic * n_clean)
    chi2 = np.divide(n * difference * difference, below, out=np.zeros(len(held)), where=below > 0)
    return idf * np.sqrt(np.maximum(0.0, chi2 - CHANCE))


def fit(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Examples | None:
    """The index over the labelled rows outside the held-out fold; None without labelled rows."""
    spark = df.sparkSession
    known = (
        labels.where(F.col(label_col).isNotNull() & learned(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("label"))
    )
    population = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not population:
        return None
    chosen = None
    for label in (0, 1):
        first = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(EXAMPLES)
        chosen = first if chosen is None else chosen.unionAll(first)
    picked = spark.createDataFrame(chosen.toArrow(), "id bigint, label int")  # 2 * EXAMPLES rows
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def setup():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [words_of(t) for t in texts_of(batch.column(2))]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([len(f) for f in found], pa.int64()),
                    pa.array([list(f) for f in found], pa.list_(pa.string())),
                    pa.array([list(f.values()) for f in found], pa.list_(pa.int32())),
                ],
                ["id", "label", "n_words", "words", "tf"],
            )

        return work

    sample = texts.join(F.broadcast(picked), "id").select("id", "label", "text")
    schema = "id bigint, label int, n_words bigint, words array<string>, tf array<int>"
    path = shared_path(spark, "examples")
    map_batches(sample, setup, schema).write.parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    # At most 2 * EXAMPLES narrow rows; equal ids in the texts make more, of which the first count.
    in_class = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", "n_words")
    upto = Window.orderBy("_rank", "label").rowsBetween(Window.unboundedPreceding, 0)
    used = (
        stored.withColumn("_rank", F.row_number().over(in_class))
        .where(F.col("_rank") <= EXAMPLES)
        .withColumn("_upto", F.sum("n_words").over(upto))
        .where(F.col("_upto") <= POSTINGS)
        .orderBy("id", "label", "n_words", "words")
        .select("id", "label", "words", "tf")
        .toArrow()
    )
    prior = population.get(1, 0) / sum(population.values())
    label = used.column("label").to_numpy().astype(np.int64)
    sizes = np.array(pa.compute.list_value_length(used.column("words")).to_pylist(), dtype=np.int64)
    flat = pa.compute.list_flatten(used.column("words")).combine_chunks().dictionary_encode()
    words, word = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    tf = pa.compute.list_flatten(used.column("tf")).to_numpy().astype(np.float64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    held = [np.bincount(word[label[owner] == k], minlength=len(words)).astype(np.float64) for k in (0, 1)]
    n = [int((label == k).sum()) for k in (0, 1)]
    weight = weights_of(held[1], held[0], n[1], n[0])
    useful = np.nonzero(weight > 0)[0]
    number = np.full(len(words), -1)
    number[useful] = np.arange(len(useful))
    kept = number[word] >= 0
    rates = {k: population.get(k, 0) / max(1, n[k]) for k in (0, 1)}
    rows = list(zip(used.column("id").to_pylist(), label.tolist()))
    return Examples(
        [words[i] for i in useful.tolist()], weight[useful], rows, owner[kept], number[word][kept], tf[kept], rates, prior
    )


def score_toxicity(
    df: DataFrame, examples: Examples | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, score, predicted, evidence`` (ids of the nearest examples), one row per row."""
    packed = df.sparkSession.sparkContext.broadcast(examples)

    def setup():
        index = packed.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [index.score(t) if index else (0.0, []) for t in texts_of(batch.column(1))]
            scores = [s for s, _ in found]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array([e for _, e in found], pa.list_(pa.int64())),
                ],
                [id_col, "score", "predicted", "evidence"],
            )

        return work

    chosen = df.select(id_col, text_col)
    kind = chosen.schema[0].dataType.simpleString()
    return map_batches(
        chosen, setup, f"`{id_col}` {kind}, score double, predicted int, evidence array<bigint>"
    )
