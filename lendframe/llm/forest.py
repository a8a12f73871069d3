"""Embedding near-deduplication by a forest of random-projection trees."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import Union, components
from .nearby import bounds, grouped

COSINE = 0.9
TREES = 6
LEAF = 512
SAMPLE = 8192
DEPTH = 10
SPILL = 0.45
ROUTED = 16_384
BLOCK = 1024
MOST_ROUNDS = 5
NODE = ["dim", "tree", "node"]


def direction(dim: int, tree: int, node: int, at: int, attempt: int) -> np.ndarray:
    v = np.random.default_rng([dim, tree, node, at, attempt]).normal(size=dim)
    return v / np.linalg.norm(v)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spill_width(dim: int, cosine: float) -> float:
    """Half-width of the strip that goes to both sides: a share of the deviation between the projections of two vectors at the limit."""
    return SPILL * math.sqrt((2 - 2 * cosine) / dim)


def _fit(cosine: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Splits of one node from its sample: thresholds by heap position, NaN at leaves; ``tries`` names the direction, -1 a leaf that no direction splits."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, tree, node = map(int, key)
        rows = rows.sort_values("cid")
        x, every = _unit(rows["vec"]), int(rows["members"].iloc[0])
        strip = spill_width(dim, cosine)
        limits, tries = np.full(1 << (DEPTH + 1), np.nan), np.zeros(1 << (DEPTH + 1), dtype=np.int8)
        todo = [(1, np.arange(len(x)))]
        while todo:
            at, own = todo.pop()
            if at >= 1 << DEPTH or len(own) < 8 or len(own) / len(x) * every <= 0.8 * LEAF:
                continue
            for attempt in range(3):
                p = x[own] @ direction(dim, tree, node, at, attempt)
                limit = float(np.median(p))
                low, high = own[p <= limit + strip], own[p > limit - strip]
                if max(len(low), len(high)) <= 0.8 * len(own):
                    limits[at], tries[at] = limit, attempt
                    todo += [(2 * at, low), (2 * at + 1, high)]
                    break
            else:
                tries[at] = -1
        return pd.DataFrame({"dim": [dim], "tree": [tree], "node": [node], "splits": [limits.tobytes() + tries.tobytes()]})

    return run


def _route(cosine: float) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The leaves that each vector of a piece of a node reaches; those in the strip of a split go both ways."""
    def run(key: tuple, rows: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        dim, tree, node = (int(k) for k in key[:3])
        if rows.empty or fitted.empty:
            return pd.DataFrame({"dim": [], "tree": [], "node": [], "cid": [], "dense": []})
        raw = fitted["splits"].iloc[0]
        cells = 1 << (DEPTH + 1)
        limits, tries = np.frombuffer(raw[:8 * cells]), np.frombuffer(raw[8 * cells:], dtype=np.int8)
        x, ids, strip = _unit(rows["vec"]), rows["cid"].to_numpy(), spill_width(dim, cosine)
        found, todo = [], [(1, np.arange(len(x)))]
        while todo:
            at, own = todo.pop()
            if math.isnan(limits[at]):
                found.append((at, own))
                continue
            p = x[own] @ direction(dim, tree, node, at, int(tries[at]))
            todo += [(2 * at, own[p <= limits[at] + strip]), (2 * at + 1, own[p > limits[at] - strip])]
        return pd.DataFrame({"dim": dim, "tree": tree, "node": np.concatenate([np.full(len(o), node * cells + a) for a, o in found]),
                             "cid": np.concatenate([ids[o] for _, o in found]),
                             "dense": np.concatenate([np.full(len(o), tries[a] < 0) for a, o in found])})

    return run


def leaves(classes: DataFrame, cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """``dim, tree, node, cid, members``: the leaves of every vector in every tree.

    Nodes with more than ``LEAF`` vectors are split in rounds. A node's splits (random directions,
    medians) are fitted on a sample of its vectors, about ``SAMPLE`` by hash, up to ``DEPTH`` levels;
    then all its vectors are routed, in pieces of bounded size. A node that no random direction
    divides is a dense group of near vectors and stays a leaf of any size.
    """
    roots = F.explode(F.sequence(F.lit(1), F.lit(trees)))
    opened = classes.select("dim", roots.alias("tree"), "cid").withColumn("node", F.col("tree").cast("long"))
    done: DataFrame | None = None
    for turn in range(MOST_ROUNDS + 1):
        dense = F.max("dense") if turn else F.lit(False)
        sized = cut_lineage(opened.groupBy(*NODE).agg(F.count(F.lit(1)).alias("members"), dense.alias("dense")))
        rows = cut_lineage(opened.select(*NODE, "cid").join(sized, NODE))
        last = F.lit(turn == MOST_ROUNDS) | (F.col("members") <= LEAF) | F.col("dense")
        closed = rows.filter(last).select(*NODE, "cid", "members")
        done = closed if done is None else done.unionAll(closed)
        rows = rows.filter(~last)
        if rows.isEmpty():
            break
        rows = rows.join(classes.select("dim", "cid", "vec"), ["dim", "cid"])
        share = F.pmod(F.xxhash64("cid", "tree", "node"), F.lit(1 << 40)) / float(1 << 40)
        fitted = rows.filter(share * F.col("members") < SAMPLE).groupBy(*NODE).applyInPandas(
            _fit(cosine), "dim int, tree int, node long, splits binary")
        pieces = F.ceil(F.col("members") / ROUTED).cast("long")
        dealt = rows.select(*NODE, "cid", "vec", F.pmod(F.xxhash64(F.lit(3), "cid"), pieces).alias("piece"))
        sent = fitted.join(rows.select(*NODE, pieces.alias("pieces")).distinct(), NODE).select(
            *NODE, "splits", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
        opened = cut_lineage(dealt.groupBy(*NODE, "piece").cogroup(sent.groupBy(*NODE, "piece"))
                             .applyInPandas(_route(cosine), "dim int, tree int, node long, cid long, dense boolean"))
    return done


def _compare(cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Verified links inside one leaf, or between two blocks of a large one.

    Gives for each vector how many vectors it links to (``b`` null), and links that connect what
    is linked (``n`` null), fewer than vectors. A pair that shares an earlier leaf, or an
    earlier pair of blocks, is counted there.
    """
    keys = ["dim", "node", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            columns = [table.column(k).to_numpy() for k in keys]
            ids, copies, block = (table.column(c).to_numpy() for c in ("cid", "copies", "block"))
            vectors, nodes = table.column("vec").combine_chunks(), table.column("nodes").combine_chunks()
            values, cuts = vectors.flatten().to_numpy(), np.cumsum(np.append(0, vectors.value_lengths().to_numpy()))
            codes, ends = nodes.flatten().to_numpy(), np.cumsum(np.append(0, nodes.value_lengths().to_numpy()))
            a, b, n = [], [], []
            for i, j in bounds(columns):
                x = values[cuts[i]:cuts[j]].reshape(j - i, -1).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                near = np.triu(x @ x.T >= cosine, 1)
                if columns[2][i] != columns[3][i]:
                    near &= block[i:j, None] != block[None, i:j]
                if not near.any():
                    continue
                p, q = np.nonzero(near)
                own, owner = codes[ends[i]:ends[j]], np.repeat(np.arange(j - i), np.diff(ends[i:j + 1]))
                before = own < columns[1][i]
                kinds, at = np.unique(own[before], return_inverse=True)
                if len(kinds):
                    shares = np.zeros((j - i, len(kinds)), dtype=np.float32)
                    shares[owner[before], at] = 1
                    new = (shares @ shares.T)[p, q] == 0
                    p, q = p[new], q[new]
                links = np.bincount(p, copies[i + q], j - i) + np.bincount(q, copies[i + p], j - i)
                some = np.flatnonzero(links)
                union = Union(j - i)
                joined = [(s, t) for s, t in zip(p.tolist(), q.tolist()) if union.join(s, t)]
                a += ids[i + some].tolist() + ids[[i + s for s, _ in joined]].tolist()
                b += [None] * len(some) + ids[[i + t for _, t in joined]].tolist()
                n += links[some].astype(np.int64).tolist() + [None] * len(joined)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """Groups of vectors linked by a cosine of ``cosine`` or more.

    Equal vectors are one class. Each of ``trees`` trees splits the classes by random directions at
    medians, with a strip round each median that goes to both sides; inside a leaf all pairs are
    compared in double precision, large leaves in pairs of blocks. Classes found in any leaf are
    united. A pair at the limit is missed if every tree separates it; nothing below is linked.

    Rows out: ``vec_id, n_links`` (other rows linked directly), ``component_id`` (smallest id reached),
    ``kept``. Vectors that are null, empty, zero, or hold a null or non-finite component, and rows
    without an id, link with nothing and stay. Vectors of different lengths do not link. Rows with
    one id and one vector count as two; with different vectors their links add up. An empty table
    gives no rows. Other columns are not read.
    """
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vec"))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    if kind == "double":  # squares of finite doubles may over- or underflow: such vectors are scaled by their largest component
        largest = F.array_max(F.transform("vec", F.abs))
        extreme = ~norm.between(1e-200, 1e200) & (largest > 0) & (largest < F.lit(float("inf")))
        given = given.withColumn("vec", F.when(extreme, F.transform("vec", lambda x: x / largest)).otherwise(F.col("vec")))
    sound = F.coalesce(~F.exists("vec", lambda x: x.isNull()) & (norm > 0) & (norm < F.lit(float("inf"))), F.lit(False)) & F.col("id").isNotNull()
    given = given.withColumn("sound", sound)
    classes = cut_lineage(given.filter("sound").groupBy("vec").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("copies"))
                          .withColumn("dim", F.size("vec")))
    members = cut_lineage(leaves(classes, cosine, trees))
    placed = members.groupBy("dim", "cid").agg(F.collect_list(F.struct("node", "members")).alias("at"))
    blocks = F.ceil(F.col("leaf.members") / BLOCK).cast("long")
    spread = (classes.join(placed, ["dim", "cid"]).withColumn("nodes", F.transform("at", lambda x: x["node"])).withColumn("leaf", F.explode("at"))
              .select("dim", F.col("leaf.node").alias("node"), "cid", "copies", "vec", "nodes", blocks.alias("blocks"),
                      F.pmod(F.xxhash64(F.lit(4), "cid"), blocks).alias("block"))
              .withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .select("dim", "node", "cid", "copies", "vec", "nodes", "block", F.least("_k", "block").alias("one"), F.greatest("_k", "block").alias("two")))
    order = ["dim", "node", "one", "two"]
    found = cut_lineage(spread.repartition(*order).sortWithinPartitions(*order, "cid").mapInArrow(_compare(cosine), "a long, b long, n long"))
    counts = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    comp = components(found.filter("b IS NOT NULL").select("a", "b"))
    named = (classes.join(counts, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
             .select(F.col("vec").alias("_vec"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("component")))
    joined = given.join(named, F.col("sound") & (F.col("vec") == F.col("_vec")), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias("vec_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
