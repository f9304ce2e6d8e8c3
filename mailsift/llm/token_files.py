"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Three passes over the corpus, the texts being read in the first only. (1) The texts are split into
words many at once, the tokenizers library encodes each distinct word that a bounded table does not
hold yet, other texts go to it whole, and the ids are stored. (2) The ids are counted in the tasks
and added up: one row per id of the vocabulary, so the ranks are a broadcast of proven size. (3) Each
document's ranks are coded, the documents are dealt out by ranges of the document id and sorted, and
each range is written as blocks.

A block holds, in this order: magic, number of documents, number of ids, document ids, ids per
document, control bytes (two bits per id: bytes of its rank less one; each document starts on a
byte) and data bytes (ranks, low byte first). Blocks are rows of Parquet files, so that any file
system that Spark writes to will do and a lost task leaves nothing behind. Decoding looks up each
control byte in tables of four lengths, in numpy.

Defined results: a null text is empty and gives the end id alone; a null document id sorts first;
equal document ids stand in the order of their ids; other columns are neither read nor returned.
Whole texts are encoded.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from mailsift.llm.common import map_batches, map_stream, texts_of

MAGIC = b"RVB1"
END_ID = 2
BLOCK_IDS = 1 << 18  # a block is closed when it holds so many ids
STEP_IDS = 1 << 18  # ids that a pass takes up at once
TABLE_LIMIT = 400_000  # words that a worker keeps; beyond that the half used last stays
NULL_DOC = -(1 << 63)

#: Texts of characters below this one are split here; all others go to the library whole. Composition
#: leaves these alone, and lower-casing acts on each by itself; the few that it makes two characters of,
#: or takes out of the range, go to the library.
LATIN_END = 0x250
SPACE, LETTER, DIGIT, OTHER, STOP = range(5)


def _kind(c: int) -> int:
    if c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0):
        return SPACE
    return {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], OTHER)


KINDS = np.array([_kind(c) for c in range(LATIN_END)], dtype=np.uint8)
STOP_BYTE = 0xFF  # after each text; no byte of UTF-8
BYTE_KINDS = np.full(256, STOP, dtype=np.uint8)
BYTE_KINDS[:0x80] = KINDS[:0x80]
_PLAIN = "".join(f"\\u{c:04x}" for c in range(LATIN_END) if all(map("\u0250".__gt__, chr(c).lower() + chr(c))))
BEYOND_LATIN = re.compile(f"[^{_PLAIN}]")
CHUNK_BYTES = 8 << 20  # of text split at once


def is_plain(text: str) -> bool:
    return "<|" not in text and (text.isascii() or not BEYOND_LATIN.search(text))


def split_words(raw: np.ndarray) -> pa.Array:
    """The words of plain lower-case texts in UTF-8, each text followed by ``STOP_BYTE``, which is a word too.

    As the vocabulary's own pattern: 's, 't, 're, 've, 'm, 'll, 'd; runs of letters; single digits; runs
    of anything else but white space.
    """
    kinds = BYTE_KINDS[raw]
    leads = np.flatnonzero((raw >= 0xC0) & (raw != STOP_BYTE))  # of two bytes each
    kinds[leads] = kinds[leads + 1] = KINDS[(raw[leads] & 0x1F).astype(np.intp) << 6 | raw[leads + 1] & 0x3F]
    first = (kinds == DIGIT) | (kinds == STOP)
    first[0] = True
    first[1:] |= kinds[1:] != kinds[:-1]
    first[leads + 1] = False
    marks = np.flatnonzero((raw[:-2] == ord("'")) & first[:-2])
    one, two = raw[marks + 1], raw[marks + 2]
    short = np.isin(one, list(b"stmd"))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for sort, size in ((short, 2), (long, 3)):
        first[marks[sort] + 1] = False
        first[marks[sort] + size] = True
    keep = kinds != SPACE
    data = raw[keep]
    ends = np.append(np.flatnonzero(first[keep]), len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


class WordEncoder:
    """Ids of texts, as packed little-endian numbers of ``width`` bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # For words that are split and normal already: the same model on words set apart by spaces.
        self.by_word = Tokenizer.from_str(self.library.to_str())
        self.by_word.normalizer = normalizers.Sequence([])
        self.by_word.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([END_ID], dtype=self.kind).tobytes()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # Words of earlier chunks, their packed ids, and the chunk that last had them.
        self.words = pa.array([bytes([STOP_BYTE])], pa.binary())
        self.codes = pa.array([self.end], pa.large_binary())
        self.used = np.zeros(1, dtype=np.int64)
        self.chunks = 0

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.kind).tobytes()

    def learn(self, words: pa.Array) -> list[pa.Array]:
        """Encode words many to a text; the last id of each word carries the mark of a word end."""
        found = []
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), b" ")[0].as_py().decode()
            ids = np.array(self.by_word.encode_batch_fast([text], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part):
                offsets = np.append(0, ends * self.kind.itemsize)
                buffers = [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(self.kind))]
                found.append(pa.Array.from_buffers(pa.large_binary(), len(part), buffers))
            else:
                alone = self.library.encode_batch([w.decode() for w in part.to_pylist()], add_special_tokens=False)
                found.append(pa.array([self.packed(e.ids) for e in alone], pa.large_binary()))
        return found

    def codes_of(self, words: pa.Array) -> pa.Array:
        """Packed ids of distinct words, ``STOP_BYTE`` being one of them."""
        if len(self.words) > TABLE_LIMIT:
            kept = np.argsort(-self.used, kind="stable")[: TABLE_LIMIT // 2]
            self.words, self.codes, self.used = self.words.take(kept), self.codes.take(kept), self.used[kept]
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.words) + np.arange(len(new))
        self.codes = pa.concat_arrays([self.codes, *self.learn(new)])
        self.words = pa.concat_arrays([self.words, new])
        self.chunks += 1
        self.used = np.append(self.used, np.zeros(len(new), dtype=np.int64))
        self.used[at] = self.chunks
        return self.codes.take(at)

    def encode_plain(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of plain lower-case texts: each distinct word is looked up once."""
        raw = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
        words = split_words(raw).dictionary_encode()
        stop = words.dictionary.index(b"\xff").as_py()
        offsets, ids = byte_runs(self.codes_of(words.dictionary).take(words.indices))
        ends = offsets[np.flatnonzero(words.indices.to_numpy() == stop) + 1].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, the end id included."""
        out: list[bytes | None] = [None] * len(texts)
        rows: list[int] = []
        held: list[bytes] = []
        size = 0
        for i, text in enumerate(texts):
            if not is_plain(text):
                ids = self.library.encode(text, add_special_tokens=False).ids
                out[i] = self.packed(ids) + self.end
            else:
                rows.append(i)
                held.append(text.lower().encode())
                size += len(held[-1])
            if held and (size >= CHUNK_BYTES or i == len(texts) - 1):
                for row, packed in zip(rows, self.encode_plain(held)):
                    out[row] = packed
                rows, held, size = [], [], 0
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One per worker process and vocabulary; its cache lives on from task to task."""
    return WordEncoder(path)


def byte_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of a column of byte strings, the first being 0, and all their bytes in a row."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(len(column) + 1, dtype=np.int64), np.empty(0, dtype=np.uint8)
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]


def code_documents(values: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of each document; ``counts`` of the unsigned 32-bit values are its own."""
    values, counts = values.astype("<u4"), np.asarray(counts, dtype=np.int64)
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    ends, quad_ends = np.cumsum(counts), np.cumsum(-(-counts // 4))
    padded = np.zeros(4 * int(quad_ends[-1]) if len(counts) else 0, dtype=np.uint8)
    quad_starts = quad_ends - -(-counts // 4)
    padded[np.arange(len(values)) + np.repeat(4 * quad_starts - (ends - counts), counts)] = extra
    quads = padded.reshape(-1, 4)
    control = (quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6).tobytes()
    width = 2 if values.max(initial=0) <= 0xFFFF else 4
    used = np.empty((len(values), width), dtype=bool)
    for k in range(width):
        used[:, k] = extra >= k
    data = values.astype(f"<u{width}").view(np.uint8)[used.ravel()].tobytes()
    sizes = np.concatenate([[0], np.cumsum(extra, dtype=np.int64)])
    data_ends = (ends + sizes[ends]).tolist()
    quad_ends = quad_ends.tolist()
    return (
        [control[a:b] for a, b in zip([0, *quad_ends], quad_ends)],
        [data[a:b] for a, b in zip([0, *data_ends], data_ends)],
    )


def code_column(column: pa.Array, ranks: np.ndarray, kind: np.dtype) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of the ranks of each row's packed ids."""
    offsets, ids = byte_runs(column)
    offsets, ids = offsets // kind.itemsize, ids.view(kind)
    controls, datas = [], []
    at = 0
    while at < len(column):
        # As many documents as hold STEP_IDS ids, one at least.
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_IDS, side="right")) - 1)
        found = code_documents(ranks[ids[offsets[at] : offsets[to]]], np.diff(offsets[at : to + 1]))
        controls += found[0]
        datas += found[1]
        at = to
    return controls, datas


def code_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    controls, datas = code_documents(values, [len(values)])
    return controls[0], datas[0]


#: Lengths of the four values of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1


def decode_values(control: np.ndarray, data: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Values of whole control bytes; ``keep`` tells which of the four slots of each are in use."""
    sizes = LENGTHS[control].ravel()[keep]
    starts = np.cumsum(sizes) - sizes
    padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.uint32)
    values = padded[starts]
    for k in (1, 2, 3):
        more = sizes > k
        values[more] |= padded[starts[more] + k] << np.uint32(8 * k)
    return values


def pack_block(doc_ids: list[int], counts: list[int], controls: list[bytes], datas: list[bytes]) -> bytes:
    head = MAGIC + struct.pack("<IQ", len(doc_ids), sum(counts))
    docs = np.array(doc_ids, dtype="<i8").tobytes()
    return b"".join([head, docs, np.array(counts, dtype="<u4").tobytes(), *controls, *datas])


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, ids per document, and the ranks of all documents in order."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n_docs, _ = struct.unpack_from("<IQ", block, 4)
    doc_ids = np.frombuffer(block, "<i8", n_docs, 16)
    counts = np.frombuffer(block, "<u4", n_docs, 16 + 8 * n_docs).astype(np.int64)
    quads = -(-counts // 4)
    at = 16 + 12 * n_docs
    control = np.frombuffer(block, np.uint8, int(quads.sum()), at)
    data = np.frombuffer(block, np.uint8, -1, at + len(control))
    slot = np.arange(4 * len(control)) - np.repeat(4 * (np.cumsum(quads) - quads), 4 * quads)
    return doc_ids, counts, decode_values(control, data, slot < np.repeat(counts, 4 * quads))


def store_ids(df: DataFrame, tokenizer: str, path: str, id_col: str, text_col: str) -> DataFrame:
    """Pass one: ``doc_id, n, ids`` (packed) of every text, stored at ``path``."""

    def setup():
        encoder = word_encoder(tokenizer)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = encoder.encode_all(texts_of(batch.column(1)))
            sizes = [len(p) // encoder.kind.itemsize for p in packed]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                ["doc_id", "n", "ids"],
            )

        return work

    chosen = df.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col)
    encoded = map_batches(chosen, setup, "doc_id bigint, n bigint, ids binary")
    encoded.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(encoded.schema).parquet(path)


def ranks_by_frequency(stored: DataFrame, size: int, kind: np.dtype) -> np.ndarray:
    """Pass two: the ids in the order of their counts over all documents, ties by id."""

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            ids = byte_runs(batch.column(0))[1].view(kind)
            for at in range(0, len(ids), STEP_IDS):
                total += np.bincount(ids[at : at + STEP_IDS], minlength=size)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counted = map_stream(stored.select("ids"), count, "id bigint, n bigint")
    rows = counted.groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most ``size`` rows
    counts = np.zeros(size, dtype=np.int64)
    counts[np.array(rows.column("id"), dtype=np.int64)] = np.array(rows.column("n"))
    return np.argsort(-counts, kind="stable")


def range_bounds(stored: DataFrame, n_ranges: int) -> list[int]:
    """Document ids that cut the table into ranges of like size; they only divide the work."""
    shares = [i / n_ranges for i in range(1, n_ranges)]
    if not shares:
        return []
    found = stored.agg(F.percentile_approx("doc_id", shares, 100 * n_ranges)).first()[0]
    return sorted(set(found or []))


def write_token_files(
    df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the token-id files of ``df`` under ``path``: ``blocks`` and ``ranks``."""
    spark = df.sparkSession
    encoder = word_encoder(tokenizer)
    size, kind = encoder.size, encoder.kind
    stored = store_ids(df, tokenizer, f"{path}/ids", id_col, text_col)
    order = ranks_by_frequency(stored, size, kind)
    ranks = np.empty(size, dtype=np.uint32)
    ranks[order] = np.arange(size, dtype=np.uint32)
    spark.createDataFrame(
        pa.table({"rank": np.arange(size, dtype=np.int64), "id": order.astype(np.int64)})
    ).coalesce(1).write.parquet(f"{path}/ranks")
    n_ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # At most one bound per shuffle partition; equal ids stay together.
    bounds = np.array(range_bounds(stored, n_ranges), dtype=np.int64)
    packed = spark.sparkContext.broadcast((ranks, bounds))

    def setup():
        own, edges = packed.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            controls, datas = code_column(batch.column(2), own, kind)
            docs = batch.column(0).fill_null(NULL_DOC).to_numpy(zero_copy_only=False)
            shards = np.searchsorted(edges, docs, side="right").astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(shards),
                    *batch.columns[:2],
                    pa.array(controls, pa.binary()),
                    pa.array(datas, pa.binary()),
                ],
                ["shard", "doc_id", "n", "control", "data"],
            )

        return work

    coded = map_batches(
        stored.select("doc_id", "n", "ids"),
        setup,
        "shard int, doc_id bigint, n bigint, control binary, data binary",
    )

    def blocks(batches):
        docs, counts, controls, datas = [], [], [], []
        shard, block, before, held = None, 0, 0, 0

        def closed():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([block], pa.int64()),
                    pa.array([before], pa.int64()), pa.array([held], pa.int64()),
                    pa.array([pack_block(docs, counts, controls, datas)], pa.binary()),
                ],
                ["shard", "block", "ids_before", "n_ids", "payload"],
            )

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(5)))
            for own, doc, n, control, data in rows:
                if docs and (own != shard or held >= BLOCK_IDS):
                    yield closed()
                    block, before = block + 1, before + held
                    docs, counts, controls, datas, held = [], [], [], [], 0
                if own != shard:
                    shard, block, before = own, 0, 0
                docs.append(NULL_DOC if doc is None else doc)
                counts.append(n)
                controls.append(control)
                datas.append(data)
                held += n
        if docs:
            yield closed()

    placed = coded.repartitionById(n_ranges, "shard").sortWithinPartitions(
        "shard", F.col("doc_id").asc_nulls_first(), "n", "control", "data"
    )
    map_stream(
        placed, blocks, "shard int, block bigint, ids_before bigint, n_ids bigint, payload binary"
    ).write.option("compression", "none").parquet(f"{path}/blocks")


_BLOCKS = "shard int, block bigint, ids_before bigint, n_ids bigint, payload binary"


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of token-id files: ``doc_id, start, n_tokens, ids_crc32`` and, on request, ``ids``."""
    order = spark.read.schema("rank bigint, id bigint").parquet(f"{path}/ranks").toArrow()
    back = np.empty(order.num_rows, dtype="<u4")  # one entry per id of the vocabulary
    back[np.array(order.column("rank"))] = np.array(order.column("id"))
    packed = spark.sparkContext.broadcast(back)
    stored = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # One row per shard: as many as there are shuffle partitions, whatever the corpus holds.
    along = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("shard")
        .agg(F.sum("n_ids").alias("_n"))
        .select("shard", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_offset"))
    )
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def decode(batches):
        ids_of = packed.value
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs, counts, ranks = unpack_block(payload.as_buffer().to_pybytes())
                ids = ids_of[ranks]
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                columns = [
                    pa.array(docs, mask=docs == NULL_DOC), pa.array(start + ends - counts),
                    pa.array(counts), pa.array(sums, pa.int64()),
                ]
                if with_ids:
                    lists = pa.array(np.concatenate([[0], ends]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(lists, pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    placed = stored.join(F.broadcast(offsets), "shard").select(
        (F.col("ids_before") + F.col("_offset")).alias("start"), "payload"
    )
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return map_stream(placed, decode, schema + ", ids array<int>" * with_ids)
