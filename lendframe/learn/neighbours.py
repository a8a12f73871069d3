"""Nearest neighbours by hash bands or exactly, and the resampling built on them.

``nearest_by_bands`` reads a point once per band, whatever the table's size: bits of random
hyperplanes put it into a leaf of bounded size, and only points of a leaf are compared.

``nearest`` is the exact way. Points are split into cells around pivots; for a query cell the
triangle inequality tells which other cells can hold a neighbour, and only those are sent to
it, in blocks of bounded size. Identical points are found exactly like any others.

Both keep just the k best per query and group, by NumPy inside the task, and merge them by
an aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import hash_order_cuts, hash_position
from ..session import cut_lineage

BLOCK_ROWS = 32_768  # rows of a block; two blocks and a strip of distances fit any task
MAX_PIVOTS = 64
LEAF_ROWS = 4096   # largest leaf of a band
SAMPLE_ROWS = 4096  # rows that place the hyperplanes, in hash order
NEAR = "id long, neighbour long, distance double"


def as_array(df: DataFrame, features: str) -> Column:
    from pyspark.ml.linalg import VectorUDT
    c = F.col(features)
    return vector_to_array(c) if isinstance(df.schema[features].dataType, VectorUDT) else c.cast("array<double>")


def _distance(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, z: s + z))


def _best_of_block(k: int):
    """k nearest candidates of every query within one pair of blocks."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
        a, ia = np.stack(left["x"].to_numpy()), left["id"].to_numpy()
        right = right.sort_values("nid", kind="stable")
        b, ib = np.stack(right["nx"].to_numpy()), right["nid"].to_numpy()
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        out = []
        for lo in range(0, len(a), 256):
            ids = ia[lo:lo + 256]
            # a matrix product finds a superset; the exact distances are taken on that
            d2 = aa[lo:lo + 256, None] + bb[None, :] - 2.0 * (a[lo:lo + 256] @ b.T)
            d2[ids[:, None] == ib[None, :]] = np.inf
            if len(b) > k:
                margin = 1e-9 * (aa[lo:lo + 256] + bb.max() + 1.0)
                limit = np.partition(d2, k - 1, axis=1)[:, k - 1] + margin
            else:
                limit = np.full(len(ids), np.inf)
            for i, (one, top) in enumerate(zip(ids, limit)):
                near = np.nonzero((d2[i] <= top) & np.isfinite(d2[i]))[0]
                exact = np.sqrt(((b[near] - a[lo + i]) ** 2).sum(axis=1))
                best = np.argsort(exact, kind="stable")[:k]
                out.append((np.full(len(best), one), ib[near[best]], exact[best]))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pd.DataFrame({"id": cols[0], "neighbour": cols[1], "distance": cols[2]})

    return run


def _nothing(pts: DataFrame) -> DataFrame:
    return pts.limit(0).select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))


def _merged(partial: DataFrame, k: int) -> DataFrame:
    """The k best of each point; ``partial`` holds at most k rows per point and group."""
    best = partial.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "neighbour"))), 1, k).alias("best"))
    return best.select("id", F.posexplode("best").alias("pos", "b")).select(
        "id", F.col("b.neighbour").alias("neighbour"), F.col("b.distance").alias("distance"), (F.col("pos") + 1).cast("int").alias("rank"))


def nearest_by_bands(points: DataFrame, id_col: str, features: str, k: int = 5, probe: Column | None = None,
                     bands: int = 8, leaf_rows: int = LEAF_ROWS, seed: int = 42) -> DataFrame:
    """(id, neighbour, distance, rank): the k nearest other points found for each point (of those where ``probe`` holds).

    Every band has its own random hyperplanes, placed near the medians of a sample of ``SAMPLE_ROWS`` points. A
    point's leaf is the shortest prefix of its bits that at most ``leaf_rows`` points share; a crowd that no
    plane divides is divided by a hash of the id, in another way in each band. Distances are exact, ties go to the
    smaller id. A table of one leaf is searched exactly; otherwise a neighbour is missed where no band
    keeps the two together (``bands`` is the price of recall), and ``nearest`` is the exact way. A point all
    alone in every leaf has no row. Work and copies: ``bands`` times the table, ``leaf_rows`` distances per copy.
    """
    pts = points.select(F.col(id_col).cast("long").alias("id"), as_array(points, features).alias("x"),
                        F.coalesce(F.lit(True) if probe is None else probe, F.lit(False)).alias("probe"))
    n = pts.count()
    if n < 2:
        return _nothing(pts)
    depth = max(0, math.ceil(math.log2(n / leaf_rows)) + 4) if n > leaf_rows else 0
    bands = bands if depth else 1
    sample = np.array([r["x"] for r in pts.select("x", "id").orderBy(hash_position("id", seed), "id").limit(SAMPLE_ROWS).collect()], dtype=float)
    draw = np.random.default_rng(seed)
    planes = draw.normal(size=(bands * depth, sample.shape[1])) / np.maximum(sample.std(axis=0), 1e-12)
    at = np.array([np.quantile(sample @ w, draw.uniform(0.35, 0.65)) for w in planes])

    @F.pandas_udf("array<long>")
    def codes(x: pd.Series) -> pd.Series:
        a = np.stack(x.to_numpy())
        bits = (a @ planes.T > at).reshape(len(a), bands, depth) if depth else np.zeros((len(a), bands, 0))
        return pd.Series(list((bits.astype(np.int64) << np.arange(depth)[::-1]).sum(axis=2)))

    coded = cut_lineage(pts.withColumn("codes", codes("x")))
    spread = coded.select("id", "x", "probe", F.posexplode("codes").alias("band", "code"))
    counts = coded.select(F.posexplode("codes").alias("band", "code")).groupBy("band", "code").agg(F.count(F.lit(1)).alias("n"))
    prefixes = counts.withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn(
        "prefix", F.expr(f"shiftright(code, {depth} - bits)"))
    node = ["band", "bits", "prefix"]
    sizes = prefixes.groupBy(*node).agg(F.sum("n").alias("rows"))
    leaf = (prefixes.drop("n").join(sizes, node).filter((F.col("rows") <= leaf_rows) | (F.col("bits") == depth))
            .groupBy("band", "code").agg(F.min(F.struct("bits", "prefix", "rows")).alias("leaf")))
    placed = spread.join(leaf, ["band", "code"]).select(
        "id", "x", "probe", "band", "leaf.bits", "leaf.prefix",
        F.pmod(F.xxhash64("id", "band"), F.ceil(F.col("leaf.rows") / F.lit(leaf_rows))).alias("part"))
    one = _best_of_block(k)

    def best(group: pd.DataFrame) -> pd.DataFrame:
        return one(group[group["probe"]], group.rename(columns={"id": "nid", "x": "nx"}))

    return _merged(placed.groupBy(*node, "part").applyInPandas(best, NEAR), k)


def nearest(points: DataFrame, id_col: str, features: str, k: int = 5, pivots: int | None = None,
            seed: int = 42, probe: Column | None = None) -> DataFrame:
    """(id, neighbour, distance, rank) for the k nearest other points of each point (of those where ``probe`` holds).

    Ties in distance go to the smaller id. Pass 1 assigns each point to its nearest
    pivot and records per cell the radius and the number of points. For each cell this
    bounds the distance of a k-th neighbour: cells whose nearest possible point lies
    beyond the bound are left out. Pass 2 joins blocks of a cell with the blocks of
    the cells it can reach; a hot cell is simply many blocks.

    The cost is that of an exact search: where pivots cannot separate the points (many
    dimensions, no clusters) the number of block pairs grows with the square of the
    number of blocks. Only the plan constants below grow with ``pivots``, nothing on
    the driver grows with the table.
    """
    pts = points.select(F.col(id_col).cast("long").alias("id"), as_array(points, features).alias("x"),
                        F.coalesce(F.lit(True) if probe is None else probe, F.lit(False)).alias("probe"))
    n = pts.count()
    if n < 2:
        return _nothing(pts)
    pivots = pivots or min(MAX_PIVOTS, max(1, n // (BLOCK_ROWS // 4)))
    centres = [r["x"] for r in pts.orderBy(hash_position("id", seed), "id").limit(pivots).collect()]
    P = np.array(centres, dtype=float)
    between = np.sqrt(((P[:, None, :] - P[None, :, :]) ** 2).sum(-1))

    dist = F.array(*[_distance(F.col("x"), F.array(*[F.lit(float(a)) for a in c])) for c in centres])
    best = F.array_min(F.transform(dist, lambda e, i: F.struct(e.alias("d"), i.alias("c"))))
    cells = pts.withColumn("_b", best).select("id", "x", "probe", F.col("_b.c").alias("cell"), F.col("_b.d").alias("r"))

    # one row per pivot
    stats = cells.groupBy("cell").agg(F.max("r").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    radius, size = {s["cell"]: s["radius"] for s in stats}, {s["cell"]: s["n"] for s in stats}
    reach: dict[int, list[int]] = {}
    for a in radius:
        seen, bound = 0, float("inf")
        # any point of cell c is at most this far from any point of cell a
        for far, m in sorted((between[a, c] + radius[c] + radius[a], size[c]) for c in radius):
            seen += m
            if seen >= k + 1:  # the query itself is among them
                bound = far * (1.0 + 1e-9) + 1e-9
                break
        reach[a] = [c for c in radius if between[a, c] - radius[c] - radius[a] <= bound]
    reached_by = {c: [a for a in radius if c in reach[a]] for c in radius}
    blocks = {c: max(1, -(-m // BLOCK_ROWS)) for c, m in size.items()}

    table = lambda d, f: F.create_map(*[z for key, x in d.items() for z in (F.lit(key), f(x))])
    n_blocks = table(blocks, F.lit)
    block = F.pmod(F.xxhash64("id"), F.try_element_at(n_blocks, F.col("cell"))).cast("int")

    def fan_out(d: DataFrame, targets: dict[int, list[int]], cell: str, number: str) -> DataFrame:
        """One copy of each row per block of the cells it meets."""
        cs = F.try_element_at(table(targets, lambda x: F.array(*[F.lit(c) for c in x])), F.col("cell"))
        one = d.withColumn("_blk", block).withColumn(cell, F.explode(cs))
        return one.withColumn(number, F.explode(F.sequence(F.lit(0), F.try_element_at(n_blocks, F.col(cell)) - 1)))

    q = fan_out(cells.filter("probe"), reach, "tc", "tb").select(
        "id", "x", F.col("cell").alias("qc"), F.col("_blk").alias("qb"), "tc", "tb")
    s = fan_out(cells, reached_by, "qc", "qb").select(
        F.col("id").alias("nid"), F.col("x").alias("nx"), "qc", "qb", F.col("cell").alias("tc"), F.col("_blk").alias("tb"))
    keys = ["qc", "qb", "tc", "tb"]
    return _merged(q.groupBy(*keys).cogroup(s.groupBy(*keys)).applyInPandas(_best_of_block(k), NEAR), k)


Search = Callable[..., DataFrame]


def smote(df: DataFrame, target: str, id_col: str, features: str, k: int = 5, seed: int = 42,
          search: Search = nearest_by_bands) -> DataFrame:
    """Original rows plus synthetic minority rows up to the size of the majority.

    A synthetic row lies between a minority point and one of its k nearest minority
    neighbours, as ``search`` finds them (``nearest`` is the exact way); a point without any is repeated. Each point gets the same number of copies, the remainder going to the
    first points in hash order; neighbour and position come from a hash of point and
    copy number, so a re-run gives the same rows. Columns: id (NULL for a synthetic
    row), target, features as an array, ``synthetic``.
    """
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(target).cast("int").alias(target),
                     as_array(df, features).alias("x"))
    n = {r[target]: r["count"] for r in base.groupBy(target).count().collect()}  # two rows
    original = base.select("id", target, F.col("x").alias(features), F.lit(False).alias("synthetic"))
    if len(n) < 2 or min(n.values()) < 2:
        return original
    small = min(n, key=lambda c: (n[c], c))
    missing = max(n.values()) - n[small]
    each, rest = divmod(missing, n[small])
    minority = base.filter(F.col(target) == small).select("id", "x")
    near = search(minority.withColumnRenamed("id", id_col), id_col, "x", min(k, n[small] - 1), seed=seed)
    # at most k a point
    near = near.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda e: e["neighbour"]).alias("near"))
    # who gets one copy more: the first ``rest`` points in hash order, found as a cut value
    spots = minority.select("id", F.lit(1).alias("_all"), hash_position("id", seed).alias("_pos"))
    cut = hash_order_cuts(spots, "_all", "_pos", "id", {"cut": F.lit(rest)}).select("cut").scalar()
    first = F.coalesce(F.struct(hash_position("id", seed).alias("_u"), F.col("id").alias("_id")) <= cut,
                       F.lit(False))
    copies = F.lit(each) + first.cast("int")
    wanted = (minority.withColumn("copies", copies).filter("copies > 0")
              .select("id", "x", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")))
    draw = lambda salt: F.pmod(F.xxhash64("id", "copy", F.lit(seed), F.lit(salt)), F.lit(1 << 30))
    chosen = F.coalesce(F.element_at("near", (draw(1) % F.size("near") + 1).cast("int")), F.col("id"))
    pick = wanted.join(near, "id", "left").withColumns({"neighbour": chosen, "gap": draw(2).cast("double") / F.lit(float(1 << 30))})
    other = minority.select(F.col("id").alias("neighbour"), F.col("x").alias("nx"))
    made = pick.join(other, "neighbour").select(
        F.lit(None).cast("long").alias("id"), F.lit(small).alias(target),
        F.zip_with(F.transform("x", lambda e, i: F.struct(e.alias("a"), F.element_at("nx", i + 1).alias("b"))),
                   F.array_repeat("gap", F.size("x")), lambda ab, g: ab["a"] + g * (ab["b"] - ab["a"])).alias(features),
        F.lit(True).alias("synthetic"))
    return original.unionByName(made)


def tomek_links(df: DataFrame, target: str, id_col: str, features: str, search: Search = nearest_by_bands) -> DataFrame:
    """Pairs of mutually nearest points of opposite class, the smaller id first.

    Points of the smaller class are probed against all; then, in the other direction, only the points of the
    other class that were found.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(target).alias("c"), F.col(features).alias("x"))
    n = {r["c"]: r["count"] for r in rows.groupBy("c").count().collect()}  # two rows
    small = min(n, key=lambda c: (n[c], c)) if n else None
    there = search(rows, "id", "x", 1, probe=F.col("c") == small).select("id", "neighbour")
    cls = rows.select(F.col("id").alias("neighbour"), "c")
    asked = cut_lineage(there.join(cls, "neighbour").filter(F.col("c") != small).select("id", "neighbour"))
    marked = rows.join(asked.select(F.col("neighbour").alias("id")).distinct().withColumn("_asked", F.lit(True)), "id", "left")
    back = search(marked, "id", "x", 1, probe=F.col("_asked")).select(F.col("id").alias("neighbour"), F.col("neighbour").alias("id"))
    return asked.join(back, ["id", "neighbour"]).select(F.least("id", "neighbour").alias("id"), F.greatest("id", "neighbour").alias("neighbour"))


def smote_tomek(df: DataFrame, target: str, id_col: str, features: str, k: int = 5, seed: int = 42,
                search: Search = nearest_by_bands) -> DataFrame:
    """SMOTE, then both ends of every Tomek link of the result are removed.

    The grown table is written once under keys of its own, so that equal synthetic rows, or an id met twice, stay rows
    of their own."""
    grown = cut_lineage(smote(df, target, id_col, features, k, seed, search).withColumn("_key", F.monotonically_increasing_id()))
    links = tomek_links(grown, target, "_key", features, search)
    ends = links.select(F.explode(F.array("id", "neighbour")).alias("_key"))
    return grown.join(ends, "_key", "left_anti").drop("_key")
