"""Merkle manifest of a table: a tree of digests per source, and one over the sources' roots.

H is the lowercase hex SHA-256 of the concatenated inputs. The leaf of a row hashes its fields,
each ``-`` if null, else its length in UTF-8 bytes, ``:`` and the value. Leaves of a source are
ordered by id (null first); while a level has more than one node, every ``FANOUT`` consecutive ones
(the last run: fewer, even one) become their H.

*Time-forward processing.* A node's label is the last leaf below it, then its level, so a node
comes after all its children. A sweep in label order keeps digests on their way in a priority queue
ordered by the receiver's label; when a node's label is reached, the queue delivers its children.
The reversed sweep delivers to each node the siblings on its path to the root (its proof suffix)
and ends at the leaves. The queue holds at most a run of nodes per level.

*Rounds.* A sweep covers a block of ``FANOUT ** LEVELS`` consecutive nodes of a tree, so that no
task holds more of a source than that. The blocks' roots are stored and are the nodes of the next
round; on the way back their proof suffixes are stored and travel with the block's nodes. Both
ways are one shuffle of digests a round, and texts are hashed where they are read.

Defined results: an empty table has no rows. Rows with equal ids of a source are ordered by their
leaf; equal rows are leaves of their own. A null id is field ``-`` and never tampered with. Other
columns, also those named like results, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import map_stream, place_in_order
from mailsift.session import shared_path

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
LEVELS = 3  # of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def leaf_of(fields: list[Column]) -> Column:
    """The leaf of a row with these fields."""
    texts = [f.cast("string") for f in fields]
    named = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.sha2(F.concat(*[F.coalesce(n, F.lit("-")) for n in named]), 256)


# --- sweeps over one block --------------------------------------------------------------------


def height(n: int, most: int = LEVELS) -> int:
    """Levels above the nodes of a block whose tree has ``n`` nodes on the block's lowest level."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def sweep(leaves: list[bytes], levels: int) -> tuple[bytes, list[tuple[int, int, list[bytes]]]]:
    """The block's root, and its inner nodes in label order: last leaf, level, children."""
    nodes: list[tuple[int, int, list[bytes]]] = []
    if not levels:
        return leaves[0], nodes
    queue: list[tuple[int, int, int, bytes]] = []

    def send(at: int, level: int, value: bytes) -> None:
        bits = FANOUT_BITS * level
        heappush(queue, (min(((at >> bits) + 1) << bits, len(leaves)) - 1, level, at, value))

    root = b""
    for at, leaf in enumerate(leaves):
        send(at, 1, leaf)
        while queue and queue[0][0] == at:
            level = queue[0][1]
            children = []
            while queue and queue[0][:2] == (at, level):
                children.append(heappop(queue)[3])
            nodes.append((at, level, children))
            root = digest(*children)
            if level < levels:
                send(at, level + 1, root)
    return root, nodes


class Suffix:
    """Siblings of a node, left and right of it, and the suffix of its parent."""

    __slots__ = ("left", "right", "parent", "joined")

    def __init__(self, left: bytes, right: bytes, parent: Suffix | None):
        self.left, self.right, self.parent = left, right, parent
        self.joined = left + right + (parent.joined if parent else b"")

    def path(self) -> Iterator[Suffix]:
        at: Suffix | None = self
        while at is not None:
            yield at
            at = at.parent


def fold(value: bytes, suffix: Suffix | None) -> bytes:
    """The root that follows from a node's digest and the siblings on its path."""
    for step in suffix.path() if suffix else ():
        value = digest(step.left, value, step.right)
    return value


def reversed_sweep(
    size: int, nodes: list[tuple[int, int, list[bytes]]], levels: int, suffix: Suffix | None
) -> Iterator[tuple[int, Suffix | None]]:
    """Each leaf of the block with its suffix, last leaf first. ``nodes`` is used up."""
    queue: list[tuple[int, int, Suffix | None]] = [(1 - size, -levels, suffix)]
    while queue:
        end, level, own = heappop(queue)
        end, level = -end, -level
        if not level:
            yield end, own
            continue
        _, _, children = nodes.pop()
        first = end >> FANOUT_BITS * level << FANOUT_BITS * level
        step = 1 << FANOUT_BITS * (level - 1)
        for i in range(len(children)):
            below = Suffix(b"".join(children[:i]), b"".join(children[i + 1 :]), own)
            heappush(queue, (1 - min(first + (i + 1) * step, size), 1 - level, below))


# --- rounds -----------------------------------------------------------------------------------

_NODE = "tree string, pos bigint, n bigint, digest string"


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows ``tree, pos, ...`` dealt out by block and sorted."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _put(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def climb(nodes: DataFrame, path: str, levels: int = LEVELS) -> DataFrame:
    """The roots of all blocks of ``nodes`` (``tree, pos, n, digest``), stored as the next round's nodes."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
    bits = FANOUT_BITS * levels

    def roots(batches):
        for (tree, block), own in groupby(_rows(batches), key=lambda r: (r[0], r[1])):
            rows = list(own)
            n = rows[0][3]
            root, _ = sweep([r[4].encode() for r in rows], height(n, levels))
            yield tree, block, -(-n >> bits), root.decode()

    dealt = _blocks(nodes.select("tree", F.shiftright("pos", bits).alias("block"), "pos", "n", "digest"))
    map_stream(dealt, lambda batches: _put(roots(batches), schema), _NODE).write.parquet(path)
    return nodes.sparkSession.read.schema(_NODE).parquet(path)


def grow(nodes: DataFrame, most: int, path: str, levels: int = LEVELS) -> list[DataFrame]:
    """``nodes`` and the nodes of all further rounds; the last has one node per tree.

    ``most`` is the largest number of nodes that a tree has.
    """
    rounds = [nodes]
    while len(rounds) == 1 or most > 1:
        rounds.append(climb(rounds[-1], f"{path}/round-{len(rounds)}", levels))
        most = -(-most >> FANOUT_BITS * levels)
    return rounds


_SUFFIX = "lefts array<string>, rights array<string>, subroot string, root string"
_CHAIN_KINDS = f"tree string, pos bigint, {_SUFFIX}"
_TEXTS = pa.list_(pa.string())


def descend(
    nodes: DataFrame, suffixes: DataFrame, keep: dict[str, str], finish: Callable, schema: pa.Schema, kinds: str,
    levels: int = LEVELS,
) -> DataFrame:
    """Deliver the suffixes of a round's blocks (``tree, pos`` and ``_SUFFIX``) to their nodes.

    ``finish(node, suffix, subroot, root)`` makes a result row of a node, its columns being
    ``tree, pos, digest`` and those of ``keep`` (name and type).
    """
    names = ["lefts", "rights", "subroot", "root"]
    nothing = {k: F.lit(None).cast(t) for k, t in keep.items()}
    own = nodes.withColumns({"block": F.shiftright("pos", FANOUT_BITS * levels)} | {c: F.lit(None) for c in names})
    sent = suffixes.withColumns(
        {"block": F.col("pos"), "pos": F.lit(-1).cast("bigint"), "n": F.lit(None), "digest": F.lit(None), **nothing}
    )
    columns = ["tree", "block", "pos", "n", "digest", *names, *keep]
    dealt = _blocks(sent.select(columns).unionByName(own.select(columns)))

    def results(batches):
        for (tree, _), rows in groupby(_rows(batches), key=lambda r: (r[0], r[1])):
            head, *rows = rows
            lefts, rights, subroot, root = head[5:9]
            suffix = None
            for left, right in zip(reversed(lefts), reversed(rights)):
                suffix = Suffix(left.encode(), right.encode(), suffix)
            above = height(rows[0][3], levels)
            _, inner = sweep([r[4].encode() for r in rows], above)
            for at, found in reversed_sweep(len(rows), inner, above, suffix):
                row = rows[at]
                yield finish((tree, row[2], row[4], *row[9:]), found, subroot, root)

    return map_stream(dealt, lambda batches: _put(results(batches), schema), kinds)


def _chain(node: tuple, suffix: Suffix | None, subroot: str, root: str) -> tuple:
    steps = list(suffix.path()) if suffix else []
    return node[0], node[1], [s.left.decode() for s in steps], [s.right.decode() for s in steps], subroot, root


_CHAIN = pa.schema(
    [("tree", pa.string()), ("pos", pa.int64()), ("lefts", _TEXTS), ("rights", _TEXTS),
     ("subroot", pa.string()), ("root", pa.string())]
)


def deliver(rounds: list[DataFrame], suffixes: DataFrame, path: str, levels: int = LEVELS) -> DataFrame:
    """The suffixes of the blocks of the first round, from those of the trees' roots."""
    for number in range(len(rounds) - 2, 0, -1):
        down = descend(rounds[number], suffixes, {}, _chain, _CHAIN, _CHAIN_KINDS, levels)
        down.write.parquet(f"{path}/down-{number}")
        suffixes = down.sparkSession.read.schema(down.schema).parquet(f"{path}/down-{number}")
    return suffixes


# --- the manifest -----------------------------------------------------------------------------


def number_leaves(leaves: DataFrame, order: list[str], path: str) -> tuple[DataFrame, int]:
    """``leaves`` with ``pos`` in its tree and the tree's size ``n``, and the largest size."""
    placed = place_in_order(leaves, [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order]], f"{path}/placed")
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    (
        placed.groupBy("tree", "part")
        .agg(F.count("*").alias("rows"), F.min("idx").alias("first"))
        .select(
            "tree", "part",
            (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("base"),
            F.sum("rows").over(Window.partitionBy("tree")).alias("n"),
        )
        .write.parquet(f"{path}/bases")
    )
    bases = leaves.sparkSession.read.parquet(f"{path}/bases")
    most = bases.agg(F.max("n")).first()[0] or 0
    return placed.join(bases, ["tree", "part"]).withColumn("pos", F.col("idx") + F.col("base")), most


def manifest(
    df: DataFrame, altered: Column | None = None, fields: tuple[str, ...] = FIELDS,
    id_col: str = "doc_id", source_col: str = "source", levels: int = LEVELS,
) -> DataFrame:
    """``id_col, leaf, subroot, root, proof_sha256, folded_root, verified``, one row per row.

    ``altered`` is the leaf that a later reader finds, null where it is the original one;
    ``folded_root`` follows from it and the original siblings. ``levels`` bounds a block: its size
    has no effect on the result.
    """
    spark = df.sparkSession
    path = shared_path(spark, "merkle")
    # Null sorts before every source, and sources sort by their bytes.
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    kind = df.schema[id_col].dataType.simpleString()
    leaves = df.select(
        tree.alias("tree"), F.col(id_col).alias("id"), leaf_of([F.col(c) for c in fields]).alias("digest"),
        (F.lit(None).cast("string") if altered is None else altered).alias("altered"),
    )
    numbered, most = number_leaves(leaves, ["id", "digest"], f"{path}/leaves")
    rounds = grow(numbered.select("tree", "pos", "n", "digest", "id", "altered"), most, f"{path}/leaves", levels)

    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    sources, n_sources = number_leaves(subroots, ["name"], f"{path}/sources")
    upper = grow(sources.select("tree", "pos", "n", "digest", "name"), n_sources, f"{path}/sources", levels)
    nothing = F.array().cast("array<string>")
    top = upper[-1].select(
        "tree", "pos", nothing.alias("lefts"), nothing.alias("rights"),
        F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
    )

    def of_source(node, suffix, _, root):
        return node[3], 0, *_chain(node, suffix, node[2], root)[2:]

    given = deliver(upper, top, f"{path}/sources", levels)
    to_sources = descend(upper[0], given, {"name": "string"}, of_source, _CHAIN, _CHAIN_KINDS, levels)
    to_sources.write.parquet(f"{path}/to-sources")
    given = deliver(rounds, spark.read.schema(to_sources.schema).parquet(f"{path}/to-sources"), f"{path}/leaves", levels)

    def of_row(node, suffix, subroot, root):
        _, _, leaf, own, other = node
        folded = fold((other or leaf).encode(), suffix).decode()
        return own, leaf, subroot, root, digest(suffix.joined if suffix else b"").decode(), folded, folded == root

    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = pa.schema(
        [("id", pa.int64() if kind == "bigint" else pa.string()), *[(c, pa.string()) for c in names], ("verified", pa.bool_())]
    )
    kinds = f"id {kind if kind == 'bigint' else 'string'}, {', '.join(f'{c} string' for c in names)}, verified boolean"
    keep = {"id": "bigint" if kind == "bigint" else "string", "altered": "string"}
    leaves_back = rounds[0].withColumn("id", F.col("id").cast(keep["id"]))
    found = descend(leaves_back, given, keep, of_row, schema, kinds, levels)
    return found.select(F.col("id").cast(kind).alias(id_col), *names, "verified")


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case."""
    return F.translate(text, _UPPER, _LOWER)
