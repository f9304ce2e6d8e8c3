"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of a tree hold ``rank * width + position`` of each adjacent pair of symbols, so the root
is the leftmost pair of the lowest rank. A merge changes three leaves (the merged pair, its left
and its right neighbour); each change goes up one path, so a word of n bytes costs O(n log n).
Short pre-tokens are merged many at a time, one row of a matrix of trees each; long ones one at a
time.

Defined results: a null text is an empty text and gives no ids; the strings of added tokens inside
a text give their own ids, as the tokenizers library does by default; equal rows give equal rows.
Other columns of the input are neither read nor returned. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from mailsift.llm.common import TwoGenerations, map_batches, texts_of

NONE = np.iinfo(np.int64).max
#: White space as in the Unicode property White_Space.
_WS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN_END = 0x250  # texts below this code point take the standard library's faster patterns


def latin_class(major: str) -> str:
    """The characters of a major category (L, N) below ``LATIN_END``, for a set of a pattern."""
    found = [c for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == major]
    return "".join(f"\\u{c:04x}" for c in found)


def pre_token_pattern(letters: str, digits: str) -> str:
    return (
        rf" ?[{letters}]+| ?[{digits}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_WS}{letters}{digits}]+"
        rf"|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
    )


LATIN_TOKENS = re.compile(pre_token_pattern(latin_class("L"), latin_class("N")))
ANY_TOKENS = regex.compile(pre_token_pattern(r"\p{L}", r"\p{N}"))
BEYOND_LATIN = re.compile(f"[^\x00-{chr(LATIN_END - 1)}]")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a byte-level vocabulary; joined, they are the text."""
    return (ANY_TOKENS if BEYOND_LATIN.search(text) else LATIN_TOKENS).findall(text)


CACHE_LIMIT = 300_000  # pre-tokens in each generation of a worker's cache
GROUP_CHARS = 1_000_000
BATCH_WIDTH = 64  # pre-tokens of up to so many bytes are merged many at a time


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Merges:
    """The merge rules of a vocabulary as sorted arrays: pair key, rank, id of the merged symbol."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.base = max(vocab.values()) + 1
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        self.symbol = np.array([vocab[c] for c in byte_alphabet()], dtype=np.int64)

    def ranks_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)


def merge_rows(merges: Merges, words: list[bytes]) -> list[list[int]]:
    """Ids of many short byte strings: one segment tree per row of a matrix.

    The matrices are kept flat: row r of a matrix of width w starts at r * w.
    """
    n, sizes = len(words), np.array([len(w) for w in words])
    width = 1 << max(1, int(sizes.max() - 1).bit_length())
    wide = width + 1
    filled = np.arange(width)[None, :] < sizes[:, None]
    symbols = np.zeros((n, wide), dtype=np.int64)
    symbols[:, :width][filled] = merges.symbol[np.frombuffer(b"".join(words), dtype=np.uint8)]
    ranks = merges.ranks_of_pairs(symbols[:, : width - 1], symbols[:, 1:width])
    ranks[~filled[:, 1:]] = NONE
    tree = np.full((n, 2 * width), NONE)
    positions = np.arange(width - 1)
    tree[:, width : 2 * width - 1] = np.where(ranks == NONE, NONE, ranks * width + positions)
    level = width
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(
            tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2]
        )
        level = half
    after = np.tile(np.arange(1, wide + 1), n)
    before = np.tile(np.arange(-1, width), n)
    tree, symbols, alive = tree.ravel(), symbols.ravel(), np.zeros((n, wide), dtype=bool)
    alive[:, :width] = filled
    alive = alive.ravel()
    rows = np.arange(n)
    root = tree[1 :: 2 * width]
    steps = width.bit_length() - 1
    while True:
        kept = root != NONE
        if not kept.all():
            rows, root = rows[kept], root[kept]
        if not rows.size:
            break
        line, trunk, ends = rows * wide, rows * (2 * width), sizes[rows]
        rank, at = root // width, root % width
        here = line + at
        gone = after[here]
        alive[line + gone] = False
        symbol = merges.merged[rank]
        symbols[here] = symbol
        right, left = after[line + gone], before[here]
        after[here] = right
        beside = np.minimum(right, width)
        before[line + beside] = at
        r = merges.ranks_of_pairs(symbol, symbols[line + beside])
        r[(right >= ends)] = NONE
        tree[trunk + width + at] = np.where(r == NONE, NONE, r * width + at)
        tree[trunk + width + gone] = NONE
        first = left < 0
        r = merges.ranks_of_pairs(symbols[line + np.maximum(left, 0)], symbol)
        r[first] = NONE
        # Node 0 of a tree is not used: a first symbol writes its missing left pair there.
        leaf = np.where(first, 0, width + left)
        tree[trunk + leaf] = np.where(r == NONE, NONE, r * width + left)
        nodes = np.concatenate([width + gone, width + at, leaf])
        trunks = np.concatenate([trunk, trunk, trunk])
        for _ in range(steps):
            nodes = np.maximum(nodes >> 1, 1)
            child = trunks + 2 * nodes
            tree[trunks + nodes] = np.minimum(tree[child], tree[child + 1])
        root = tree[trunk + 1]
    flat = symbols[alive].tolist()
    stops = np.cumsum(alive.reshape(n, wide).sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *stops], stops)]


def merge_one(merges: Merges, word: bytes) -> list[int]:
    """Ids of one byte string of any length, by one segment tree."""
    n = len(word)
    start = merges.symbol[np.frombuffer(word, dtype=np.uint8)]
    if n < 2:
        return start.tolist()
    width = 1 << (n - 1).bit_length()
    leaves = np.full(width, NONE)
    ranks = merges.ranks_of_pairs(start[:-1], start[1:])
    leaves[: n - 1] = np.where(ranks == NONE, NONE, ranks * 1)
    known = np.nonzero(ranks != NONE)[0]
    leaves[known] = ranks[known] * width + known
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][0::2], levels[-1][1::2]))
    tree = [NONE, *np.concatenate(levels[::-1]).tolist()]
    symbols, merged = start.tolist(), merges.merged.tolist()
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\x01" * n)
    none, rank_of, base = int(NONE), merges.rank_of, merges.base

    def put(position: int, value: int) -> None:
        node = width + position
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    def pair(i: int, j: int) -> int:
        rank = rank_of.get(symbols[i] * base + symbols[j])
        return none if rank is None else rank * width + i

    while tree[1] != none:
        rank, at = divmod(tree[1], width)
        gone = after[at]
        symbols[at] = merged[rank]
        alive[gone] = 0
        right, left = after[gone], before[at]
        after[at] = right
        put(gone, none)
        if right < n:
            before[right] = at
            put(at, pair(at, right))
        else:
            put(at, none)
        if left >= 0:
            put(left, pair(left, at))
    return [s for s, keep in zip(symbols, alive) if keep]


class ByteBpe:
    """Encoder and decoder of a byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"])
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = added
        ordered = sorted(added, key=len, reverse=True)
        self.split_added = regex.compile("|".join(map(regex.escape, ordered))) if added else None
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        size = max([*spec["model"]["vocab"].values(), *added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in [*spec["model"]["vocab"].items(), *added.items()]:
            plain = all(c in byte_of for c in token)
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if plain else token.encode()
        self.bytes_by_text = {str(i): b for i, b in enumerate(self.bytes_of)}
        self.text_of = [str(i) for i in range(size)]
        #: Pre-token -> its ids as decimal numbers joined by commas.
        self.cache = TwoGenerations(CACHE_LIMIT)

    def _one(self, token: str) -> str:
        return self._joined(merge_one(self.merges, token.encode()))

    def _joined(self, ids: list[int]) -> str:
        return ",".join([self.text_of[i] for i in ids])

    def learn(self, tokens: set[str]) -> None:
        """Encode pre-tokens that the cache lacks, those of a like length together."""
        cache = self.cache
        groups: dict[int, list[str]] = {}
        for token in tokens:
            size = len(token.encode())
            groups.setdefault((size - 1).bit_length() if size <= BATCH_WIDTH else -1, []).append(token)
        for kind, group in groups.items():
            if kind < 0:
                for token in group:
                    cache[token] = self._one(token)
                continue
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                found = merge_rows(self.merges, [t.encode() for t in part])
                cache.update(zip(part, map(self._joined, found)))

    def _parts(self, text: str) -> list[tuple[str, list[str]]]:
        """Pieces of a text between added tokens: (id of the added token before or '', pre-tokens)."""
        parts, end, before = [], 0, ""
        for m in self.split_added.finditer(text) if self.split_added and "<" in text else ():
            parts.append((before, pre_tokens(text[end : m.start()])))
            before, end = self.text_of[self.added[m[0]]], m.end()
        parts.append((before, pre_tokens(text[end:] if end else text)))
        return parts

    def encode_all(self, texts: list[str]) -> list[str]:
        """The ids of each text as decimal numbers joined by commas.

        Texts go in groups of about ``GROUP_CHARS`` characters, so that the pre-tokens that the
        cache lacks are merged many at a time.
        """
        out: list[str] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= GROUP_CHARS):
                chars += len(texts[end])
                end += 1
            group = [self._parts(t) for t in texts[at:end]]
            wanted: set[str] = set()
            for parts in group:
                for _, tokens in parts:
                    wanted.update(tokens)
            self.learn(self.cache.missing(wanted))
            get = self.cache.__getitem__
            for parts in group:
                pieces: list[str] = []
                for before, tokens in parts:
                    if before:
                        pieces.append(before)
                    pieces.extend(map(get, tokens))
                out.append(",".join(pieces))
            at = end
        return out

    def encode_joined(self, text: str) -> str:
        return self.encode_all([text])[0]

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return [int(i) for i in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids out of range nothing."""
        table, size = self.bytes_of, len(self.bytes_of)
        return b"".join([table[i] for i in ids if i is not None and 0 <= i < size]).decode("utf-8", "replace")

    def decode_joined(self, joined: str) -> str:
        if not joined:
            return ""
        return b"".join(map(self.bytes_by_text.__getitem__, joined.split(","))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One per worker process and vocabulary; its cache lives on from task to task."""
    return ByteBpe(path)


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int), one row per row of ``df``."""

    def setup():
        bpe = byte_bpe(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            joined = bpe.encode_all(texts_of(batch.column(1)))
            ids = [[int(i) for i in j.split(",")] if j else [] for j in joined]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"]
            )

        return work

    chosen = df.select(id_col, text_col)
    kind = chosen.schema[0].dataType.simpleString()
    return map_batches(chosen, setup, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text``, one row per row of ``df``; a null list is empty."""

    def setup():
        bpe = byte_bpe(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], [id_col, "text"]
            )

        return work

    chosen = df.select(id_col, ids_col)
    kind = chosen.schema[0].dataType.simpleString()
    return map_batches(chosen, setup, f"`{id_col}` {kind}, text string")


def bpe_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids again, and return digests of both in one pass over the texts.

    ``id_col, n_tokens, ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256`` (of
    the decoded text in UTF-8).
    """

    def setup():
        bpe = byte_bpe(path)

        def digest(text: str) -> str:
            return hashlib.sha256(text.encode()).hexdigest()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            joined = bpe.encode_all(texts_of(batch.column(1)))
            counts = [j.count(",") + 1 if j else 0 for j in joined]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array([digest(j) for j in joined], pa.string()),
                    pa.array([digest(bpe.decode_joined(j)) for j in joined], pa.string()),
                ],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return work

    chosen = df.select(id_col, text_col)
    kind = chosen.schema[0].dataType.simpleString()
    return map_batches(
        chosen,
        setup,
        f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
