"""Terms of texts, worked out for many texts at once: hashes of all runs of 1 to 3 tokens.

The hashes are those of Spark's ``xxhash64`` and ``hash``, bit for bit, so a model does not depend on
which of the two forms counted its terms. Spark evaluates a lambda over an array element by element;
here each step is one numpy operation over all tokens of a slice of texts, of bounded bytes. Texts
come lower-cased by Spark; tokens are cut at Python's white space, as in
:func:`mailsift.functions.text.tokens`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE = 1 << 20  # bytes of text whose terms are held at once, or one text
_SEED = 42  # of Spark's hash functions
_U, _V = np.uint64, np.uint32
_P1, _P2, _P3 = _U(0x9E3779B185EBCA87), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_P4, _P5 = _U(0x85EBCA77C2B2AE63), _U(0x27D4EB2F165667C5)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    size = 8 * x.dtype.itemsize
    return (x << x.dtype.type(by)) | (x >> x.dtype.type(size - by))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _P2
    x = (x ^ (x >> _U(29))) * _P3
    return x ^ (x >> _U(32))


def _with_eight(found: np.ndarray, eight: np.ndarray) -> np.ndarray:
    return _turn(found ^ (_turn(eight * _P2, 31) * _P1), 27) * _P1 + _P4


def long_hashes(values: np.ndarray) -> np.ndarray:
    """``xxhash64`` of longs."""
    return _mixed(_with_eight(np.full(len(values), _U(_SEED) + _P5 + _U(8)), values))


def string_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray | None = None) -> np.ndarray:
    """``xxhash64`` of the strings ``raw[starts[i]:ends[i]]``; a seed is the hash of what stands before a string."""
    held = raw + bytes(8)
    eights = np.ndarray(len(raw) + 1, "<u8", held, strides=(1,))
    fours = np.ndarray(len(raw) + 1, "<u4", held, strides=(1,))
    ones = np.frombuffer(held, np.uint8)
    sizes = ends - starts
    at = starts.copy()
    seeds = np.full(len(starts), _U(_SEED)) if seeds is None else seeds
    found = seeds + _P5
    rows = np.nonzero(sizes >= 32)[0]
    if len(rows):
        seed = seeds[rows]
        lanes = [seed + _P1 + _P2, seed + _P2, seed.copy(), seed - _P1]
        going = np.arange(len(rows))
        while len(going):
            place = at[rows[going]]
            for i, lane in enumerate(lanes):
                lane[going] = _turn(lane[going] + eights[place + 8 * i] * _P2, 31) * _P1
            at[rows[going]] += 32
            going = going[at[rows[going]] + 32 <= ends[rows[going]]]
        total = sum(_turn(lane, by) for lane, by in zip(lanes, (1, 7, 12, 18)))
        for lane in lanes:
            total = (total ^ (_turn(lane * _P2, 31) * _P1)) * _P1 + _P4
        found[rows] = total
    found += sizes.astype(_U)
    rows = np.nonzero(at + 8 <= ends)[0]
    while len(rows):
        found[rows] = _with_eight(found[rows], eights[at[rows]])
        at[rows] += 8
        rows = rows[at[rows] + 8 <= ends[rows]]
    rows = np.nonzero(at + 4 <= ends)[0]
    found[rows] = _turn(found[rows] ^ (fours[at[rows]].astype(_U) * _P1), 23) * _P2 + _P3
    at[rows] += 4
    rows = np.nonzero(at < ends)[0]
    while len(rows):
        found[rows] = _turn(found[rows] ^ (ones[at[rows]].astype(_U) * _P5), 11) * _P1
        at[rows] += 1
        rows = rows[at[rows] < ends[rows]]
    return _mixed(found)


def term_indexes(terms: np.ndarray, vocab_size: int) -> np.ndarray:
    """Feature index of each term hash: ``pmod(hash(term), vocab_size)``."""
    bits = terms.view(_U)
    found = np.full(len(bits), _V(_SEED))
    for half in ((bits & _U(0xFFFFFFFF)).astype(_V), (bits >> _U(32)).astype(_V)):
        found ^= _turn(half * _V(0xCC9E2D51), 15) * _V(0x1B873593)
        found = _turn(found, 13) * _V(5) + _V(0xE6546B64)
    found ^= _V(8)
    found = (found ^ (found >> _V(16))) * _V(0x85EBCA6B)
    found = (found ^ (found >> _V(13))) * _V(0xC2B2AE35)
    return (found ^ (found >> _V(16))).view(np.int32) % np.int32(vocab_size)


def hash_of(text: str) -> int:
    """``xxhash64`` of one string, as a signed long."""
    raw = text.encode()
    return int(string_hashes(raw, np.array([0]), np.array([len(raw)])).view(np.int64)[0])


class Terms:
    """The terms of a slice of texts: ``terms``, and in ``row`` the text of each.

    Tokens of all texts stand first, then pairs, then triples, then one hash per hit of a signal; a
    stable sort by ``row`` gives each text its terms in that order. ``words`` are the tokens.
    """

    def __init__(self, texts: list[str], hits: np.ndarray, names: list[int]):
        self.words = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        raw = " ".join([" ".join(w) for w in self.words if w]).encode()
        gaps = np.nonzero(np.frombuffer(raw, np.uint8) == 32)[0]
        some = [1] if raw else []
        starts = np.concatenate([np.zeros(len(some), np.int64), gaps + 1])
        ends = np.concatenate([gaps, np.full(len(some), len(raw))])
        one = string_hashes(raw, starts, ends)
        row = np.repeat(np.arange(len(texts)), self.sizes)
        both = np.nonzero(row[1:] == row[:-1])[0]
        two = string_hashes(raw, starts[both + 1], ends[both + 1], one[both])
        all_three = np.nonzero(row[2:] == row[:-2])[0]
        # A pair is followed by a triple unless it ends its text: both go by their first token.
        leading = long_hashes(two[np.searchsorted(both, all_three)])
        three = string_hashes(raw, starts[all_three + 2], ends[all_three + 2], leading)
        signal = np.repeat(np.tile(np.array(names, dtype=np.int64), len(texts)), hits.reshape(-1))
        signal_row = np.repeat(np.arange(len(texts)), hits.sum(axis=1))
        self.terms = np.concatenate([one.view(np.int64), two.view(np.int64), three.view(np.int64), signal])
        self.row = np.concatenate([row, row[both], row[all_three], signal_row])

    def by_text(self) -> tuple[np.ndarray, np.ndarray]:
        """The terms, text after text, and where the terms of each text begin and end."""
        counts = np.bincount(self.row, minlength=len(self.sizes))
        return self.terms[np.argsort(self.row, kind="stable")], np.concatenate([[0], np.cumsum(counts)])


def slices(texts: pa.Array, counts: tuple[pa.Array, ...], names: list[int]) -> Iterator[Terms]:
    """The terms of a batch of texts with the hits of each signal, a slice at a time; null is empty."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    hits = np.array([pa.compute.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in counts], dtype=np.int64).T
    cuts = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = cuts[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(cuts, before + SLICE, side="right")))
        part = texts.slice(first, last - first).cast(pa.binary()).to_pylist()
        yield Terms([(t or b"").decode("utf-8", "replace") for t in part], hits[first:last], names)
        first = last


def _keys(names: list[int]):
    def run(texts: pa.Array, *counts: pa.Array) -> pa.Array:
        made = []
        for part in slices(texts, counts, names):
            terms, cuts = part.by_text()
            made.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(terms, pa.int64())))
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int64()))

    return run


def _indexes(vocab_size: int):
    def run(keys: pa.Array) -> pa.Array:
        found = term_indexes(keys.flatten().to_numpy(zero_copy_only=False), vocab_size)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(keys), 0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found, pa.int32()))

    return run


VECTOR = ["type", "size", "indices", "values"]  # the fields in which Spark stores a vector; type 0 is sparse


def _vectors(vocab_size: int):
    def run(ids: pa.Array) -> pa.Array:
        sizes = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(ids), dtype=np.int64), sizes)
        found, times = np.unique(row * vocab_size + ids.flatten().to_numpy(zero_copy_only=False), return_counts=True)
        cuts = pa.array(np.searchsorted(found, np.arange(len(ids) + 1) * vocab_size), pa.int32())
        columns = [
            pa.array(np.zeros(len(ids)), pa.int8()),
            pa.array(np.full(len(ids), vocab_size), pa.int32()),
            pa.ListArray.from_arrays(cuts, pa.array(found % vocab_size, pa.int32())),
            pa.ListArray.from_arrays(cuts, pa.array(times, pa.float64())),
        ]
        return pa.StructArray.from_arrays(columns, VECTOR)

    return run


def _margins(names: list[int], weights: np.ndarray, intercept: float):
    def run(texts: pa.Array, *counts: pa.Array) -> pa.Array:
        found = [np.zeros(0)]
        for part in slices(texts, counts, names):
            n = len(part.sizes)
            # Added one by one, the intercept first, in the order of the terms.
            row = np.concatenate([np.arange(n), part.row])
            each = np.concatenate([np.full(n, intercept), weights[term_indexes(part.terms, len(weights))]])
            found.append(np.bincount(row, each, minlength=n))
        return pa.array(np.concatenate(found), pa.float64())

    return run


TOP = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32()), ("contribution", pa.float64())]))


def _top(names: dict[int, str], weights: np.ndarray, k: int):
    def best(words: list[str], terms: np.ndarray) -> list[dict]:
        order = np.argsort(terms, kind="stable")
        ordered = terms[order]
        starts = np.nonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))[0] if len(ordered) else order
        tf = np.diff(np.concatenate([starts, [len(ordered)]]))
        down = weights[term_indexes(ordered[starts], len(weights))] * -tf
        n = len(words)
        pairs_from, triples_from = n, n + max(n - 1, 0)
        out = []
        for i in np.argsort(down, kind="stable")[:k].tolist():
            at = int(order[starts[i]])
            if at < pairs_from:
                name = words[at]
            elif at < triples_from:
                name = " ".join(words[at - pairs_from : at - pairs_from + 2])
            elif at < triples_from + max(n - 2, 0):
                name = " ".join(words[at - triples_from : at - triples_from + 3])
            else:
                name = names[int(ordered[starts[i]])]
            out.append({"term": name, "tf": int(tf[i]), "contribution": -float(down[i])})
        return out

    def run(texts: pa.Array, *counts: pa.Array) -> pa.Array:
        made = []
        for part in slices(texts, counts, list(names)):
            terms, cuts = part.by_text()
            made += [best(w, terms[a:b]) for w, a, b in zip(part.words, cuts[:-1].tolist(), cuts[1:].tolist())]
        return pa.array(made, TOP)

    return run


def _columns(text: str, signals: list[str]) -> list[Column]:
    return [F.lower(F.col(text)), *[F.col(s) for s in signals]]


def term_keys(text: str, signals: list[str]) -> Column:
    """All term hashes of a text: tokens, pairs, triples, then one per hit of each signal column."""
    run = _keys([hash_of(f"<{s}>") for s in signals])
    return F.arrow_udf(run, "array<bigint>")(*_columns(text, signals))


def indexes(keys: str, vocab_size: int) -> Column:
    """The feature index of each term hash of an array."""
    return F.arrow_udf(_indexes(vocab_size), "array<int>")(F.col(keys))


def count_vectors(ids: str, vocab_size: int) -> Column:
    """The fields of the sparse vector of how often each feature index occurs, as ``HashingTF`` makes it."""
    kind = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
    return F.arrow_udf(_vectors(vocab_size), kind)(F.col(ids))


def margin(text: str, signals: list[str], weights: list[float], intercept: float) -> Column:
    """The intercept and the weights of the feature indexes of all terms, added up."""
    run = _margins([hash_of(f"<{s}>") for s in signals], np.array(weights), float(intercept))
    return F.arrow_udf(run, "double")(*_columns(text, signals))


def top_terms(text: str, signals: list[str], weights: list[float], k: int) -> Column:
    """Array of the ``k`` terms with the largest tf x weight, ties by hash: ``term, tf, contribution``."""
    run = _top({hash_of(f"<{s}>"): f"<{s}>" for s in signals}, np.array(weights), k)
    kind = "array<struct<term:string,tf:int,contribution:double>>"
    return F.arrow_udf(run, kind)(*_columns(text, signals))
