"""A Merkle manifest of a dataset: roots upwards, proofs downwards, by time-forward processing.

Nodes are processed in the order of their labels (tree, last leaf below, height), which puts every
node behind its children. A node that is done sends its digest forward to its parent through a
priority queue ordered by label. The sweep back takes labels in reverse: a node receives what leads
from it to the root, and sends each child its siblings and the rest. Sweeps run over blocks of
``ARITY ** BLOCK_LEVELS`` neighbouring nodes: inside a block the queue is a heap, between blocks it
is a table in the shared folder, dealt and sorted by label.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rows import pack, unpack

ARITY = 8
BLOCK_LEVELS = 3
OUT_ROWS = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = "tree string, pos long, n long, digest string"
PATH = "lefts array<string>, rights array<string>"
Path = list[tuple[str, str]]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves: none above one."""
    up = 0
    while ARITY ** up < n:
        up += 1
    return up


def coded(value: Column) -> Column:
    """``-`` for null, else the number of its bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[coded(c) for c in columns]), 256)


def proof_digest(lefts: str = "lefts", rights: str = "rights") -> Column:
    """Digest of a proof: its siblings level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), ""), 256)


def folded(leaf: Column, lefts: str = "lefts", rights: str = "rights") -> Column:
    """The root that a leaf's digest leads to beside the siblings of a proof."""
    steps = F.zip_with(lefts, rights, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(steps, leaf, lambda at, s: F.sha2(F.concat(s["a"], at, s["b"]), 256))


# ---- inside a block ------------------------------------------------------------------

class Block:
    """Neighbouring nodes of level ``base`` of one tree, and the ``up`` levels above them."""

    def __init__(self, tree: str, n: int, base: int, levels: int) -> None:
        self.tree, self.n = tree, n
        self.up = max(0, min(levels, height(n) - base))
        self.width = -(-n // ARITY ** base)  # nodes of the base level in the whole tree
        self.queue: list[tuple[int, int, int, str]] = []  # (parent's last node below, its level, sender, digest)
        self.runs: list[tuple[int, int, int, list[str]]] = []  # nodes in the order of labels, with their children
        self.top = ""

    def last(self, number: int, level: int) -> int:
        return min((number + 1) * ARITY ** level, self.width) - 1

    def send(self, level: int, number: int, digest: str) -> None:
        """The digest of a node goes forward to its parent, or out of the block."""
        if level == self.up:
            self.top = digest
        else:
            heapq.heappush(self.queue, (self.last(number // ARITY, level + 1), level + 1, number, digest))

    def take(self, pos: int, digest: str, keep: bool = False) -> None:
        """The next base node; every node above that has all its children by now is processed."""
        self.send(0, pos, digest)
        while self.queue and self.queue[0][0] <= pos:
            last, level, number, first = heapq.heappop(self.queue)
            children = [first]
            while self.queue and self.queue[0][:2] == (last, level):
                children.append(heapq.heappop(self.queue)[3])
            if keep:
                self.runs.append((last, level, number // ARITY, children))
            self.send(level, number // ARITY, sha("".join(children)))

    def back(self, path: Path) -> Iterator[tuple[int, Path]]:
        """Position and path to the root of every base node, the last one first.

        A path lists (siblings to the left, siblings to the right) from the bottom up; ``path`` is that of the block's top.
        """
        queue = [(-last, -level, path) for last, level, _, _ in self.runs[-1:]]
        for last, level, number, children in reversed(self.runs):
            above = heapq.heappop(queue)[2]  # labels are processed in reverse, so the message in front is this node's
            for k in reversed(range(len(children))):
                own = [("".join(children[:k]), "".join(children[k + 1:])), *above]
                child = number * ARITY + k
                if level == 1:
                    yield child, own
                else:
                    heapq.heappush(queue, (-self.last(child, level - 1), 1 - level, own))


def blocks(batches: Iterator[pa.RecordBatch], base: int, levels: int) -> Iterator[tuple[Block, list[dict]]]:
    """The rows of a partition sorted by (tree, pos), block by block."""
    block, rows, key = None, [], None
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["tree"], row["pos"] // ARITY ** levels)
            if own != key:
                if block:
                    yield block, rows
                block, rows, key = Block(row["tree"], row["n"], base, levels), [], own
            rows.append(row)
    if block:
        yield block, rows


def _sent(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


TEXTS = pa.list_(pa.string())
NODES = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
HEADS = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("top", pa.string()), ("lefts", TEXTS), ("rights", TEXTS)])


def up_sweep(base: int, levels: int):
    def tops(batches):
        for block, rows in blocks(batches, base, levels):
            for r in rows:
                block.take(r["pos"], r["digest"])
            yield block.tree, rows[0]["pos"] // ARITY ** levels, block.n, block.top

    return lambda batches: _sent(tops(batches), NODES)


def _paths(batches, base: int, levels: int) -> Iterator[tuple[dict, dict, Path]]:
    """(block's head, node, path) for every node; a block's head, its first row, brings the path of the block's top."""
    for block, (head, *rows) in blocks(batches, base, levels):
        for r in rows:
            block.take(r["pos"], r["digest"], keep=True)
        whole = list(zip(head["lefts"], head["rights"]))
        for r, (pos, path) in zip(reversed(rows), block.back(whole) if block.up else [(rows[0]["pos"], whole)], strict=True):
            if pos != r["pos"]:
                raise ValueError(f"tree {block.tree}: node {r['pos']} where {pos} belongs")
            yield head, r, path


def down_sweep(base: int, levels: int):
    def heads(batches):
        for head, r, path in _paths(batches, base, levels):
            yield r["tree"], r["pos"], r["n"], head["top"], [a for a, _ in path], [b for _, b in path]

    return lambda batches: _sent(heads(batches), HEADS)


def leaf_sweep(base: int, levels: int):
    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("_row", first.schema.field("_row").type), ("digest", pa.string()), ("top", pa.string()), ("lefts", TEXTS), ("rights", TEXTS)])

        def leaves():
            for head, r, path in _paths((b for part in ([first], batches) for b in part), base, levels):
                yield r["_row"], r["digest"], head["top"], [a for a, _ in path], [b for _, b in path]

        yield from _sent(leaves(), schema)
    return run


# ---- over all blocks -------------------------------------------------------------------

def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``pos`` (from 0 in the order of ``order``) and ``n`` (rows) within each ``tree``.

    Rows are dealt by range into partitions of even size, whatever the size of a tree, and
    written once; they are counted inside a partition, and a table with a row per partition
    and tree says what comes before.
    """
    keys = ["tree", *order]
    dealt = cut_lineage(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).withColumn("_part", F.spark_partition_id()))
    across = Window.partitionBy("tree").orderBy("_part")
    before = dealt.groupBy("tree", "_part").count().select(
        "tree", "_part", (F.sum("count").over(across) - F.col("count")).alias("_before"), F.sum("count").over(Window.partitionBy("tree")).alias("n"))
    inside = Window.partitionBy("tree", "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (dealt.withColumn("_nr", F.row_number().over(inside)).join(before, ["tree", "_part"])
            .withColumn("pos", F.col("_before") + F.col("_nr") - 1).drop("_part", "_before", "_nr"))


def _dealt(nodes: DataFrame, levels: int, *order: str) -> DataFrame:
    return nodes.repartition(F.col("tree"), F.expr(f"pos div {ARITY ** levels}")).sortWithinPartitions("tree", "pos", *order)


def climb(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Node tables from the leaves (``tree, pos, n, digest`` and more) to one node per tree, ``levels`` levels apart."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    found = [leaves]
    for r in range(max(1, -(-height(most) // levels))):
        given = _dealt(found[-1].select("tree", "pos", "n", "digest"), levels)
        found.append(cut_lineage(given.mapInArrow(up_sweep(r * levels, levels), NODE)))
    return found


def descend(nodes: list[DataFrame], heads: DataFrame, levels: int) -> DataFrame:
    """``_row, digest, top, lefts, rights`` of every leaf; ``heads`` has the path of every tree's top."""
    row = nodes[0].schema["_row"].dataType.simpleString()
    for r in reversed(range(len(nodes) - 1)):
        none = F.lit(None).cast(row)
        first = heads.select("tree", (F.col("pos") * ARITY ** levels).alias("pos"), "n", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("digest"),
                             "top", "lefts", "rights", none.alias("_row"))
        empty = F.lit(None).cast("array<string>")
        rest = nodes[r].select("tree", "pos", "n", F.lit(1).alias("kind"), "digest", F.lit(None).cast("string").alias("top"),
                               empty.alias("lefts"), empty.alias("rights"), (F.col("_row") if r == 0 else none).alias("_row"))
        given = _dealt(first.unionAll(rest), levels, "kind")
        if r == 0:
            return given.mapInArrow(leaf_sweep(0, levels), f"_row {row}, digest string, top string, {PATH}")
        heads = cut_lineage(given.drop("_row").mapInArrow(down_sweep(r * levels, levels), f"tree string, pos long, n long, top string, {PATH}"))
    raise ValueError("no levels to descend")


def manifest(leaves: DataFrame, leaf_col: str = "leaf", tree_col: str = "lang", order_col: str = "doc_id",
             levels: int = BLOCK_LEVELS) -> DataFrame:
    """Every leaf with its tree's root, the dataset's root and its proof.

    ``leaf_col`` holds hexadecimal digests (see ``leaf_digest``). The leaves of a tree ascend by ``order_col``
    (nulls first, equal ones by digest); every 8 neighbours become the digest of their digests,
    until one node is left. The trees' roots, ascending by ``tree_col`` (null first), likewise.

    Adds ``subroot``, ``root``, and the proof as ``lefts`` and ``rights``: per level from the leaf up, the
    siblings before and behind, as one text each (``proof_digest`` and ``folded`` read them). Null is a
    tree of its own; repeated rows are leaves of their own; a null leaf is the text ``-``; an empty table stays
    empty; other columns are carried along, those of the added names are replaced.
    """
    added = ("subroot", "root", "lefts", "rights")
    own = [c for c in leaves.columns if c not in added]
    col = lambda c: F.col(f"`{c}`")
    given = leaves.select(F.coalesce(F.concat(F.lit("s"), col(tree_col).cast("string")), F.lit("")).alias("tree"), col(order_col).alias("_order"),
                          F.coalesce(col(leaf_col).cast("string"), F.lit("-")).alias("digest"), F.monotonically_increasing_id().alias("_place"),
                          pack(own).alias("_row"))
    trees = climb(cut_lineage(ranked(given, ["_order", "digest", "_place"]).drop("_order", "_place")), levels)
    tops = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("_of"), "digest", F.struct("tree", "n").alias("_row"))
    above = climb(cut_lineage(ranked(tops, ["_of"]).drop("_of")), levels)
    found = above[-1].first()
    root = found["digest"] if found else None
    none = F.array().cast("array<string>")
    heads = above[-1].select("tree", "pos", "n", F.col("digest").alias("top"), none.alias("lefts"), none.alias("rights"))
    roots = descend(above, heads, levels).select(F.col("_row.tree").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("_row.n").alias("n"),
                                                 F.col("digest").alias("top"), "lefts", "rights")
    return descend(trees, cut_lineage(roots), levels).select(
        *unpack("_row", own), F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"), "lefts", "rights")
