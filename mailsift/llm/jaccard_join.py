"""N-gram Jaccard join with token-combination prefixes, and its connected components.

A document is the set of its distinct five-word shingles (64-bit hashes, the *tokens*). Two documents
link when ``100 * |intersection| >= 75 * |union|``; the result is one component per document.

*Frequencies.* Tokens are dealt out by hash, in blobs of a group of texts, and each task counts in how many
documents its tokens occur. Tokens of one document only go no further; all others return to
their group with that count, ``FREQUENT`` for more than ``RARE`` documents. A token in more than ``RARE``
documents of one group is frequent without being dealt out; its bucket gets one mark per group, so
a token that a third of all documents hold does not fill a task. The global order is: tokens of one
document, rare ones by count and hash, frequent ones by hash.

*Keys.* With o = ceil(0.75 n), the first n - o + 1 tokens of two linked sets share one (prefix
filter). A document with more tokens of its own than that has no link. Rare tokens of the prefix
are keys by themselves, of at most ``RARE`` documents. If the prefix reaches the frequent tokens, a pair may
have frequent tokens in common only; then the prefix is extended to n - o + floor(n / 3) + 2 tokens
and pairs of neighbouring frequent tokens are keys. Linked sets have at most floor(n / 3) tokens
not in common, so of the first floor(n / 3) + 2 common ones two stand next to each other in
both sets: no link is lost, and the keys stay linear in the text. Sets of up to five tokens use all
their prefix tokens.

*Classes.* Documents with the same set F of frequent tokens are a class. Two of them with r and s
other tokens and no rare one in common link exactly if |F| >= 3 (r + s). So if any do, each of them links
with the document of the least r, the hub: a star finds all these links, however many documents share
one passage. A document that hangs on its hub needs no combined keys, because whatever it links with
without a common rare token the hub links with too (it has the same F and fewer others).

*Links.* Copies (equal sets) are one representative. Stars first: in each group the documents are
paired with one hub, each document is verified against its best hubs only, and components are
merged; groups within one component are done. A further round takes other hubs. What is left, pairs
of different components, is joined in full under exact bounds: the sizes, the key's places in both sets, the
rare keys in common, and a parity bitmap of the tokens, whose differing bits are at most the tokens not in common. So no pairs
are made within what already hangs together, hardly any that do not link, and no link between
components is missed. Verification computes both sets again from the texts.

Texts are hashed in pieces of bounded bytes, pairs are verified in slices of bounded bytes, and Arrow
batches are bounded too (:func:`mailsift.llm.common.bound_batches`).

Defined results: a null or empty text, or one without words, has 0 shingles and is its own
component. Rows with equal ids are one node. A row with a null id is returned with a null
component and takes no part. Other columns are neither read nor returned; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import bound_batches, map_stream, texts_of
from mailsift.session import materialize, shared_path, shuffles_dropped

SHINGLE = 5
PERCENT = 75
RARE = 64  # documents that a rare token occurs in, at most
FREQUENT = 255  # stands for any number above RARE
PIECE = 1 << 18  # bytes hashed at once
SLICE = 1 << 20  # bytes of texts whose sets are held at once
GROUP_TOKENS = 500_000  # tokens that a task holds before it writes blobs
GROUP_DOCS = 50_000
HASH_BYTES = 6  # of a token that is dealt out or a part of a key
BITMAP = 8  # longs of a parity bitmap
STARS = 2  # rounds of stars
HUBS = 3  # hubs that a document is verified against in a round of stars
BUCKETS = 4  # buckets of tokens per shuffle partition; a task holds one bucket's tokens
FILTER_BITS = 23
FILTER_TASKS = 16  # filters that reach the driver, one after the other
_U = np.uint64
_BASE, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_LOWER = bytes(
    0x20 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_ROOT = 0xD6E8FEB86659FD93
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_PLACES = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _MIX2) | _U(1)
_TABLES: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the root and of its inverse modulo 2 ** 64."""
    if not _TABLES or len(_TABLES[0]) < n:
        _TABLES[:] = [_powers(_ROOT, n), _powers(pow(_ROOT, -1, 1 << 64), n)]
    return _TABLES


def _hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of lower-cased bytes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = np.concatenate([[False], data != 32, [False]])
    edges = np.nonzero(inside[1:] != inside[:-1])[0]
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    up, down = _tables(max(PIECE, len(data)))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the words of each text; bytes go in pieces that end at a space."""
    encoded = [t.encode().translate(_LOWER) for t in texts]
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(texts)
    group: list[int] = []

    def flush() -> None:
        if group:
            sizes = np.array([len(encoded[i]) + 1 for i in group])
            hashes, starts = _hash_words(b" ".join([encoded[i] for i in group]))
            cuts = np.searchsorted(starts, np.cumsum(sizes))
            for i, part in zip(group, np.split(hashes, cuts[:-1])):
                out[i] = part
            group.clear()

    held = 0
    for i, raw in enumerate(encoded):
        if len(raw) > PIECE:
            parts, at = [], 0
            while at < len(raw):
                end = len(raw)
                if end - at > PIECE:
                    end = raw.rfind(b" ", at, at + PIECE) + 1 or raw.find(b" ", at + PIECE) + 1 or len(raw)
                parts.append(_hash_words(raw[at:end])[0])
                at = end
            out[i] = np.concatenate(parts)
            continue
        if held + len(raw) > PIECE:
            flush()
            held = 0
        group.append(i)
        held += len(raw) + 1
    flush()
    return out


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for words in word_hashes(texts):
        n = len(words)
        if n >= SHINGLE:
            total = words[: n - SHINGLE + 1] * _PLACES[0]
            for k in range(1, SHINGLE):
                total = total + words[k : n - SHINGLE + 1 + k] * _PLACES[k]
            out.append(np.unique(mix(total)))
        elif n:
            tag = np.array([n], dtype=np.uint64) * _BASE
            out.append(mix((words * _PLACES[:n]).sum(keepdims=True) + tag))
        else:
            out.append(words)
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a) and len(b)) and 100 * both >= PERCENT * (len(a) + len(b) - both)


def overlap_needed(n: int) -> int:
    return -(-PERCENT * n // 100)


def slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most ``SLICE`` bytes, or of one text."""
    first, held = 0, 0
    for at, size in enumerate(sizes):
        if at > first and held + size > SLICE:
            yield first, at
            first, held = at, 0
        held += size
    if len(sizes) > first:
        yield first, len(sizes)


def sets_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and shingle set of each text of a batch, a bounded slice of texts at a time."""
    texts = batch.column(column)
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    for first, last in slices(lengths):
        yield from enumerate(shingle_sets(texts_of(texts[first:last])), first)


# --- first pass: sizes, fingerprints, tokens dealt out by hash --------------------------------

_DOC, _DEALT, _LOCAL = 0, 1, 2  # kinds of rows: a document, tokens for a bucket, tokens frequent in a group
_MARK = 0xFFFF  # instead of a place: the token is frequent in this group
_NAMES = ["kind", "bucket", "grp", "doc", "n", "fp1", "fp2", "place", "tokens", "places", "counts"]
_KINDS = [
    pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(),
    pa.binary(), pa.binary(), pa.binary(),
]
_ROW = (
    "kind tinyint, bucket int, grp bigint, doc bigint, n bigint, fp1 bigint, fp2 bigint, place int, "
    "tokens binary, places binary, counts binary"
)


def _rows(**columns) -> pa.RecordBatch:
    size = max(len(c) for c in columns.values() if not isinstance(c, int))
    made = []
    for name, kind in zip(_NAMES, _KINDS):
        value = columns.get(name)
        if isinstance(value, int):
            value = np.full(size, value)
        made.append(pa.nulls(size, kind) if value is None else pa.array(value, kind))
    return pa.RecordBatch.from_arrays(made, _NAMES)


def _packed(tokens: np.ndarray) -> bytes:
    """The lowest ``HASH_BYTES`` bytes of each token."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _unpacked(raw) -> np.ndarray:
    cut = np.frombuffer(raw, dtype=np.uint8).reshape(-1, HASH_BYTES)
    out = np.zeros((len(cut), 8), dtype=np.uint8)
    out[:, :HASH_BYTES] = cut
    return out.reshape(-1).view("<u8")


def deal(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Rows of ``docs`` (``doc, text``) as documents of groups, and their tokens in blobs by bucket."""

    def blobs(grp: int, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate(sets) & _U((1 << 8 * HASH_BYTES) - 1)
        places = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, places = tokens[order], places[order]
        first = np.nonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))[0]
        sizes = np.diff(np.concatenate([first, [len(tokens)]]))
        local = np.repeat(sizes > RARE, sizes)
        if local.any():
            yield _rows(
                kind=_LOCAL, bucket=[grp % n_buckets], grp=[grp], tokens=[_packed(tokens[local])],
                places=[places[local].tobytes()],
            )
        marks = tokens[first[sizes > RARE]]
        tokens = np.concatenate([tokens[~local], marks])
        places = np.concatenate([places[~local], np.full(len(marks), _MARK, dtype=np.uint16)])
        bucket = _bucket(tokens, n_buckets)
        order = np.argsort(bucket, kind="stable")
        tokens, places, bucket = tokens[order], places[order], bucket[order]
        cuts = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(bucket)]])
        ranges = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        yield _rows(
            kind=_DEALT, bucket=[int(bucket[a]) for a, _ in ranges], grp=grp,
            tokens=[_packed(tokens[a:b]) for a, b in ranges], places=[places[a:b].tobytes() for a, b in ranges],
        )

    def run(batches):
        grp = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_pylist()
            rows: tuple[list, ...] = ([], [], [], [], [], [])

            def documents() -> pa.RecordBatch:
                at, groups, n, sums, xors, places = rows
                out = _rows(
                    kind=_DOC, bucket=[g % n_buckets for g in groups], grp=groups, doc=ids.take(pa.array(at, pa.int64())),
                    n=n, fp1=sums, fp2=xors, place=places,
                )
                for column in rows:
                    column.clear()
                return out

            for at, tokens in sets_of(batch, 1):
                takes_part = known[at] and len(tokens)
                values = (
                    at, grp, len(tokens), int(mix(tokens).sum(dtype=np.uint64).astype(np.int64)) if len(tokens) else 0,
                    int(np.bitwise_xor.reduce(mix(tokens ^ _BASE)).astype(np.int64)) if len(tokens) else 0,
                    len(held) if takes_part else None,
                )
                for column, value in zip(rows, values):
                    column.append(value)
                if not takes_part:
                    continue
                held.append(tokens)
                size += len(tokens)
                if size >= GROUP_TOKENS or len(held) >= GROUP_DOCS:
                    yield from blobs(grp, held)
                    grp, size = grp + 1, 0
                    held.clear()
            if rows[0]:
                yield documents()
        if held:
            yield from blobs(grp, held)

    return map_stream(docs, run, _ROW)


def _bucket(tokens: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((mix(tokens) >> _U(33)) % _U(n_buckets)).astype(np.int32)


def count_tokens(dealt: DataFrame, n_buckets: int, path: str) -> DataFrame:
    """Rows of documents and, per group, the tokens that more than one document has, with counts; stored."""

    def run(batches):
        tokens, groups, places = [], [], []
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            kept = batch.filter(pa.array(kinds != _DEALT))
            if kept.num_rows:
                yield kept
            own = batch.filter(pa.array(kinds == _DEALT))
            for grp, raw, at in zip(*(own.column(c) for c in (2, 8, 9))):
                tokens.append(_unpacked(raw.as_buffer()))
                places.append(np.frombuffer(at.as_buffer(), dtype=np.uint16).copy())
                groups.append(np.full(len(places[-1]), grp.as_py(), dtype=np.int64))
        if not tokens:
            return
        token, grp, place = (np.concatenate(c) for c in (tokens, groups, places))
        for column in (tokens, groups, places):
            column.clear()
        order = np.argsort(token, kind="stable")
        token, grp, place = token[order], grp[order], place[order]
        first = np.nonzero(np.concatenate([[True], token[1:] != token[:-1]]))[0]
        sizes = np.diff(np.concatenate([first, [len(token)]]))
        marked = np.bincount(np.repeat(np.arange(len(first)), sizes), place == _MARK) > 0
        counts = np.where(marked | (sizes > RARE), FREQUENT, sizes).astype(np.uint8)
        count = np.repeat(counts, sizes)
        shared = (count > 1) & (place != _MARK)
        token, grp, place, count = token[shared], grp[shared], place[shared], count[shared]
        order = np.argsort(grp, kind="stable")
        token, grp, place, count = token[order], grp[order], place[order], count[order]
        cuts = np.concatenate([[0], np.nonzero(np.diff(grp))[0] + 1, [len(grp)]])
        for a in range(0, len(cuts) - 1, 256):
            ranges = list(zip(cuts[a : a + 256].tolist(), cuts[a + 1 : a + 257].tolist()))
            if ranges[0][0] < ranges[0][1]:
                yield _rows(
                    kind=_DEALT, bucket=0, grp=[int(grp[x]) for x, _ in ranges], tokens=[_packed(token[x:y]) for x, y in ranges],
                    places=[place[x:y].tobytes() for x, y in ranges], counts=[count[x:y].tobytes() for x, y in ranges],
                )

    map_stream(dealt.repartitionById(n_buckets, "bucket"), run, _ROW).write.parquet(path)
    return dealt.sparkSession.read.schema(_ROW).parquet(path)


# --- second pass: keys ------------------------------------------------------------------------

_SINGLE, _COMBINED, _CLASS, _INFO = 1, 0, 2, 3  # kinds of rows


def keys_of(
    tokens: np.ndarray, counts: np.ndarray, n: int
) -> tuple[np.ndarray, np.ndarray, tuple[int, int] | None, list[int]]:
    """Rare keys, combined keys, class key (two hashes) of a set of ``n`` tokens, and where the keys stand.

    Places in the global order count from 0; that of a combined key is its first token's.

    ``tokens`` are those that other documents have, in the global order, with their ``counts``. The
    class key is None where the prefix holds no frequent token.
    """
    own = n - len(tokens)
    prefix = n - overlap_needed(n) + 1
    rare = int((counts < FREQUENT).sum())
    none = tokens[:0]
    if own >= prefix:
        return none, none, None, []
    singles, frequent = tokens[: min(prefix - own, rare)], tokens[rare:]
    places = list(range(own, own + len(singles)))
    if own + rare >= prefix:
        return singles, none, None, places
    combined = [frequent[: prefix - own - rare] if n <= SHINGLE else none]
    if n >= SHINGLE:
        row = frequent[: n - overlap_needed(n) + n // 3 + 2 - own - rare]
        combined.append(mix(row[:-1] * _PLACES[0] + row[1:] * _PLACES[1]))
    sums = [mix(frequent).sum(dtype=np.uint64), mix(frequent ^ _BASE).sum(dtype=np.uint64)]
    named = mix(np.array(sums) + _U(len(frequent))).astype(np.int64).tolist()
    places += [own + rare + i for part in combined for i in range(len(part))]
    return singles, np.concatenate(combined), (named[0], named[1]), places


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bit i of 512 is the parity of the number of tokens that fall on it."""
    at = (mix(tokens + _BASE) >> _U(64 - 9)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=512) & 1).astype(np.uint8).view(np.int64)


def index(counted: DataFrame, path: str) -> DataFrame:
    """``kind, key, cls, cls2, doc, fp, n, uniq, rare, pos`` and the bitmap of every document that may have links; stored.

    A row per key, and one per document (kind ``_INFO``). ``uniq`` counts the tokens that no other
    document has, ``rare`` those that are not frequent, these included; ``cls, cls2`` is the class key, ``pos`` the place of a key.
    """
    names = ["kind", "key", "cls", "cls2", "doc", "fp", "n", "uniq", "rare", "pos", *[f"b{i}" for i in range(BITMAP)]]
    schema = "kind tinyint, " + ", ".join(f"{c} bigint" for c in names[1:])

    def run(batches):
        def parts():
            for batch in batches:
                columns = [batch.column(c) for c in (0, 2, 3, 4, 5, 7, 8, 9, 10)]
                yield from zip(*[c.to_pylist() for c in columns])

        for _, rows in groupby(parts(), key=lambda r: r[1]):
            docs, tokens, places, counts = {}, [], [], []
            for kind, _, doc, n, fp, place, raw, at, count in rows:
                if kind == _DOC:
                    docs[place] = (doc, n, fp)
                    continue
                tokens.append(_unpacked(raw))
                places.append(np.frombuffer(at, dtype=np.uint16))
                counts.append(
                    np.full(len(tokens[-1]), FREQUENT, dtype=np.uint8) if kind == _LOCAL else np.frombuffer(count, dtype=np.uint8)
                )
            if not tokens:
                continue
            token, place, count = (np.concatenate(c) for c in (tokens, places, counts))
            order = np.lexsort((token, count, place))
            token, place, count = token[order], place[order], count[order]
            cuts = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1, [len(place)]])
            columns: list[list] = [[] for _ in names]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                doc, n, fp = docs[int(place[a])]
                own = n - (b - a)
                if own >= n - overlap_needed(n) + 1:
                    continue
                singles, combined, named, pos = keys_of(token[a:b], count[a:b], n)
                rare = own + int((count[a:b] < FREQUENT).sum())
                keys = np.concatenate([singles, combined]).view(np.int64).tolist()
                kinds = [_SINGLE] * len(singles) + [_COMBINED] * len(combined)
                if named is not None:
                    keys.append(named[0])
                    kinds.append(_CLASS)
                one, two = named or (None, None)
                size = len(keys) + 1
                pos += [None] * (size - len(pos))
                bits = bitmap(token[a:b]).tolist()
                values = [[*kinds, _INFO], [*keys, None], *[[v] * size for v in (one, two, doc, fp, n, own, rare)], pos]
                values += [[None] * (size - 1) + [b_] for b_ in bits]
                for column, value in zip(columns, values):
                    column += value
                if len(columns[0]) > 50_000:
                    yield made(columns)
            if columns[0]:
                yield made(columns)

    def made(columns):
        kinds = [pa.int8(), *[pa.int64()] * (len(names) - 1)]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        for column in columns:
            column.clear()
        return out

    grouped = counted.where("kind <> 0 or place is not null").repartition("grp").sortWithinPartitions("grp")
    map_stream(grouped, run, schema).write.parquet(path)
    return counted.sparkSession.read.schema(schema).parquet(path)


# --- verification -----------------------------------------------------------------------------


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of documents that link, by the sets of their texts.

    A bit filter of fixed size keeps most of the texts that no pair names out of the shuffle; it
    never drops one that a pair names.
    """
    named = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    bits = 1 << FILTER_BITS

    def mark(batches):
        seen = np.zeros(bits, dtype=bool)
        for batch in batches:
            seen[_filter_bit(batch.column(0).to_numpy(zero_copy_only=False))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["bits"])

    flags = np.zeros(bits // 8, dtype=np.uint8)
    marks = materialize(map_stream(named.coalesce(FILTER_TASKS), mark, "bits binary"))
    for row in marks.toLocalIterator():
        flags |= np.frombuffer(row.bits, dtype=np.uint8)
    packed = docs.sparkSession.sparkContext.broadcast(flags)

    def pick(batches):
        wanted = packed.value
        for batch in batches:
            bit = _filter_bit(batch.column(0).to_numpy(zero_copy_only=False))
            kept = (wanted[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
            yield batch.filter(pa.array(kept.astype(bool)))

    texts = map_stream(docs, pick, "doc bigint, text string")
    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def compare(batches):
        for batch in batches:
            sizes = [pa.compute.fill_null(pa.compute.binary_length(batch.column(c)), 0).to_numpy() for c in (2, 3)]
            for first, last in slices(np.add(*sizes).tolist()):
                part = batch.slice(first, last - first)
                sets = [shingle_sets(texts_of(part.column(c))) for c in (2, 3)]
                kept = [linked(a, b) for a, b in zip(*sets)]
                yield part.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return map_stream(both, compare, "a bigint, b bigint").distinct()


def _filter_bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) + _BASE) >> _U(64 - FILTER_BITS)).astype(np.int64)


# --- components -------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``doc, comp`` (smallest id reachable) of every document in ``edges`` ``a, b``.

    Each round hooks every label to its smallest neighbour, follows the hooks once more, and
    contracts the edges; rounds are stored by checkpoint.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("doc")).distinct().withColumn("comp", F.col("doc"))
    while True:
        both = edges.unionAll(edges.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("comp")).agg(F.min("b").alias("to"))
        hooks = hooks.select("comp", F.least("comp", "to").alias("to"))
        further = hooks.select(F.col("comp").alias("to"), F.col("to").alias("far"))
        hooks = materialize(
            hooks.join(further, "to", "left").select("comp", F.coalesce("far", "to").alias("to"))
        )
        labels = materialize(
            labels.join(hooks, "comp", "left").select("doc", F.coalesce("to", "comp").alias("comp"))
        )
        a = hooks.select(F.col("comp").alias("a"), F.col("to").alias("to_a"))
        b = hooks.select(F.col("comp").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(a, "a").join(b, "b").where("to_a <> to_b")
        edges = materialize(
            moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        )
        if edges.isEmpty():
            return labels


def _prefix(n: Column) -> Column:
    return n - F.ceil(n * PERCENT / 100 - 1e-9) + 1


_FIELDS = ["n", "uniq", "rare"]


def _can_link(a: str, b: str, singles: Column) -> Column:
    """Whether two sets can link that have at most ``singles`` rare keys in common.

    The sets' ``n, uniq, rare`` are the columns with the suffixes ``a`` and ``b``. Rare tokens in
    common are keys in common or lie beyond a prefix; frequent ones are at most those of the set
    with fewer; tokens of one document are never in common.
    """
    (na, ua, ra), (nb, ub, rb) = ([F.col(f"{c}{x}") for c in _FIELDS] for x in (a, b))
    beyond = F.greatest(F.lit(0), ra - _prefix(na), rb - _prefix(nb))
    most = F.least(ra - ua, rb - ub, singles + beyond) + F.least(na - ra, nb - rb)
    needed = F.ceil((na + nb) * PERCENT / (100 + PERCENT) - 1e-9)
    return (100 * na >= PERCENT * nb) & (100 * nb >= PERCENT * na) & (most >= needed)


_BITS = [f"b{i}" for i in range(BITMAP)]


def _differ(a: str, b: str) -> Column:
    """At least so many tokens are in one of two sets only: bits that differ, and tokens of one document."""
    found = F.col(f"uniq{a}") + F.col(f"uniq{b}")
    for i in _BITS:
        found = found + F.bit_count(F.col(f"{i}{a}").bitwiseXOR(F.col(f"{i}{b}")))
    return found


def _bits_allow(a: str, b: str) -> Column:
    """Whether the bitmaps leave room for a link."""
    # |x - y| + |y - x| <= (1 - J) / (1 + J) * (|x| + |y|) for J = PERCENT / 100
    return (100 + PERCENT) * _differ(a, b) <= (100 - PERCENT) * (F.col(f"n{a}") + F.col(f"n{b}"))


def _in_prefixes(a: str, b: str) -> Column:
    """Whether a common key may be the first one of a link, by its places in both sets.

    Before the first token that two sets have in common stand at most the n - o tokens that a set
    does not share, with o the overlap that these two sizes need; before the first neighbours in
    common at most as many common ones more as there are tokens not in common.
    """
    na, nb = F.col(f"n{a}"), F.col(f"n{b}")
    needed = F.ceil((na + nb) * PERCENT / (100 + PERCENT) - 1e-9)
    more = F.when((F.col(f"kind{a}") == _SINGLE) & (F.col(f"kind{b}") == _SINGLE), 0).otherwise(na + nb - 2 * needed)
    return (F.col(f"pos{a}") <= na - needed + more) & (F.col(f"pos{b}") <= nb - needed + more)


def _more_than_one(entries: DataFrame, key: str = "key") -> DataFrame:
    """The entries of keys that more than one document has."""
    span = entries.groupBy(key).agg(F.min("doc").alias("_lo"), F.max("doc").alias("_hi")).where("_lo < _hi")
    return entries.join(span.select(key), key, "left_semi")


def _class_stars(entries: DataFrame) -> DataFrame:
    """``cls, a, fp, b``: documents that link with the hub of their class by sizes alone."""
    own = entries.where(F.col("kind") == _CLASS)
    hubs = own.groupBy("cls", "cls2").agg(F.min(F.struct("rare", "doc")).alias("h"))
    return own.join(hubs, ["cls", "cls2"]).where(
        (F.col("doc") != F.col("h.doc")) & (F.col("n") - F.col("rare") >= 3 * (F.col("rare") + F.col("h.rare")))
    ).select("cls", F.col("doc").alias("a"), "fp", F.col("h.doc").alias("b"))


def _open_groups(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries with their component, of keys that more than one component has."""
    known = entries.drop("comp")
    if labels is None:
        known = known.withColumn("comp", F.col("doc"))
    else:
        known = known.join(labels, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    span = known.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi")
    return known.join(span.select("key"), "key", "left_semi")


def _star_pairs(entries: DataFrame, info: DataFrame, turn: int) -> DataFrame:
    """Each document with its best hubs; which document of a group is its hub changes by turn.

    The best are those whose bitmaps differ least, of those that they, the sizes and the keys in
    common allow.
    """
    place = F.xxhash64(F.lit(turn), "doc")
    hubs = entries.groupBy("key").agg(F.min_by(F.struct("doc", "fp", "comp", *_FIELDS), place).alias("h"))
    sizes = [F.col(f"h.{c}").alias(f"{c}_hub") for c in ("doc", "fp", *_FIELDS)]
    met = entries.join(hubs, "key").where("comp <> h.comp").select("doc", "fp", *_FIELDS, "kind", *sizes)
    own = ["doc", "fp", *_FIELDS]
    counted = (
        met.groupBy(*own, *[f"{c}_hub" for c in own])
        .agg(F.count_if(F.col("kind") == _SINGLE).alias("singles"))
        .where(_can_link("", "_hub", F.col("singles")))
    )
    bits = info.select("doc", "fp", *_BITS)
    hub_bits = bits.select(*[F.col(c).alias(f"{c}_hub") for c in bits.columns])
    near = counted.join(bits, ["doc", "fp"]).join(hub_bits, ["doc_hub", "fp_hub"]).where(_bits_allow("", "_hub"))
    return (
        near.groupBy(F.col("doc").alias("a"))
        .agg(F.collect_list(F.struct(_differ("", "_hub").alias("differ"), "doc_hub")).alias("hubs"))
        .select("a", F.explode(F.slice(F.sort_array("hubs"), 1, HUBS)).alias("h"))
        .select("a", F.col("h.doc_hub").alias("b"))
    )


def _cross_rows(entries: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs of documents of different components that can link by sizes, keys and bitmaps, once per common key."""
    own = entries.groupBy("doc", "fp").agg(F.count_if(F.col("kind") == _SINGLE).alias("singles"))
    rows = entries.join(own.join(info.select("doc", "fp", *_BITS), ["doc", "fp"]), ["doc", "fp"])
    fields = ["kind", "pos", "doc", "comp", "singles", *_FIELDS, *_BITS]
    a = rows.select("key", *[F.col(c).alias(f"{c}_a") for c in fields])
    b = rows.select("key", *[F.col(c).alias(f"{c}_b") for c in fields])
    met = (
        (a["key"] == b["key"]) & (F.col("comp_a") < F.col("comp_b"))
        & _in_prefixes("_a", "_b") & _bits_allow("_a", "_b")
        & _can_link("_a", "_b", F.least("singles_a", "singles_b"))
    )
    return a.join(b, met).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))


def _find(df: DataFrame, id_col: str, text_col: str) -> tuple[str, DataFrame | None]:
    """Where the counted tokens are stored, and the components of all linked documents."""
    spark = df.sparkSession
    path = shared_path(spark, "jaccard")
    docs = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    n_buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = count_tokens(deal(docs, n_buckets), n_buckets, f"{path}/counted")
    described = counted.where(F.col("kind") == _DOC).select("doc", "n", "fp1", "fp2")
    known = docs.where("doc is not null")
    groups = (
        described.where("doc is not null and n > 0")
        .groupBy("fp1", "fp2", "n")
        .agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        .where("first < last")
        .drop("last")
    )
    same = described.where("doc is not null and n > 0").join(groups, ["fp1", "fp2", "n"])
    copies = materialize(
        same.where("doc <> first").select(F.col("doc").alias("a"), F.col("first").alias("b"), F.col("fp1").alias("fp")).distinct()
    )
    indexed = index(counted, f"{path}/index")
    info = indexed.where(F.col("kind") == _INFO)
    # A copy has the keys of its representative.
    gone = copies.select(F.col("a").alias("doc"), "fp")
    keyed = indexed.where(F.col("kind") != _INFO).select("kind", "key", "cls", "cls2", "doc", "fp", "pos", *_FIELDS)
    keyed = materialize(_more_than_one(keyed.join(gone, ["doc", "fp"], "left_anti")))
    stars = materialize(_class_stars(keyed))
    hanging = stars.select("cls", F.col("a").alias("doc"), "fp")
    combined = keyed.where(F.col("kind") == _COMBINED).join(hanging, ["cls", "doc", "fp"], "left_anti")
    entries = keyed.where(F.col("kind") == _SINGLE).unionByName(combined).select("kind", "key", "doc", "fp", "pos", *_FIELDS)

    links = copies.select("a", "b").unionAll(stars.select("a", "b"))
    labels = None if links.isEmpty() else components(links)
    for turn in range(STARS + 1):
        entries = materialize(_open_groups(entries, labels))
        if entries.isEmpty():
            break
        # Rounds of stars with different hubs; then all that is left is paired.
        pairs = materialize(_star_pairs(entries, info, turn) if turn < STARS else _cross_rows(entries, info).distinct())
        found = materialize(verify(known, pairs))
        if not found.isEmpty():
            links = links.unionAll(found)
            labels = components(links)
    return f"{path}/counted", labels


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id``, one row per row of ``df``."""
    spark = df.sparkSession
    bound_batches(spark)
    with shuffles_dropped(spark):
        counted, labels = _find(df, id_col, text_col)
    described = spark.read.schema(_ROW).parquet(counted).where(F.col("kind") == _DOC)
    result = described.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"))
    if labels is None:
        return result.withColumn("component_id", F.col(id_col))
    named = labels.select(F.col("doc").alias(id_col), "comp")
    return result.join(named, id_col, "left").select(
        id_col, "n_shingles", F.coalesce("comp", id_col).alias("component_id")
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with the smallest id of each component; all columns are kept.

    Of rows with equal ids the one with the smallest SHA-256 of all its columns stays. Rows with a
    null id all stay.
    """
    found = jaccard_components(df, id_col, text_col)
    ids = materialize(found.where(F.col(id_col).isNotNull()))
    gone = ids.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    kept = df.join(gone, id_col, "left_anti").select(df.columns)
    repeated = ids.groupBy(id_col).agg(F.count("*").alias("_n")).where("_n > 1").select(id_col)
    if repeated.isEmpty():
        return kept
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    marked = kept.join(repeated, id_col, "left_semi").select(*df.columns, row.alias("_row"))
    chosen = marked.groupBy(id_col).agg(F.min("_row").alias("_row"))
    once = marked.join(chosen, [id_col, "_row"], "left_semi").dropDuplicates([id_col, "_row"])  # equal rows
    return kept.join(repeated, id_col, "left_anti").unionAll(once.select(df.columns))
