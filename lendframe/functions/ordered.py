"""Exact order statistics without ever sorting everything in one task.

``running_totals``   cumulative sums along a probability axis
``exact_quantiles``  interpolated percentiles of many columns in two levels, from mergeable sketches
``hash_order_cuts``  "the first k rows per class in hash order" without a full sort
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = 1 << 20  # cells of the [0, 1] axis; also the bound on rows of a per-key window


def axis_cell(p: Column, cells: int = CELLS) -> Column:
    """Cell of a probability, growing with it: equal widths in the middle, equal ratios in the
    outer thousandths, where scores of rare events crowd. Their number is bounded by a
    few times ``cells``; values outside [0, 1] fall into the outermost."""
    edge, per = 2.0 ** -10, cells / 1024.0
    tail = lambda x: F.lit(per) * (F.lit(1.0) + F.log2(F.greatest(x, F.lit(2.0 ** -1000)) / F.lit(edge)))
    rest = F.lit(1.0) - p
    return F.floor(F.when(p < edge, tail(p)).when(rest < edge, F.lit(float(cells)) - tail(rest)).otherwise(p * F.lit(float(cells))))


def running_totals(df: DataFrame, keys: Sequence[str], p: str, measures: Sequence[str],
                   cells: int = CELLS) -> DataFrame:
    """One row per (keys, distinct p) with sums of ``measures`` there and from the top.

    Adds ``cum_<m>`` (sum over all rows with probability >= p) to each measure, and
    ``place``, the number of distinct probabilities >= p.
    Equal probabilities are first combined (map-side), so ties cost nothing. The axis
    is then cut into cells: one window runs inside each cell, another over the cell
    totals of a key, and the two are added. No window ever holds a whole table, whatever
    the distribution over keys is.
    """
    keys = list(keys)
    cell = axis_cell(F.col(p), cells).alias("_cell")
    counts = (df.groupBy(*keys, cell, F.col(p)).agg(*[F.sum(m).alias(m) for m in measures])
              .withColumn("_one", F.lit(1).cast("long")))
    asked, measures = list(measures), [*measures, "_one"]

    inside = W.partitionBy(*keys, "_cell").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    local = counts.select("*", *[F.sum(m).over(inside).alias(f"_in_{m}") for m in measures])

    above = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy(F.desc("_cell")) \
        .rowsBetween(W.unboundedPreceding, -1)
    offsets = (counts.groupBy(*keys, "_cell").agg(*[F.sum(m).alias(m) for m in measures])
               .select(*keys, "_cell",
                       *[F.coalesce(F.sum(m).over(above), F.lit(0)).alias(f"_up_{m}") for m in measures]))
    return local.join(offsets, [*keys, "_cell"]).select(
        *keys, p, *asked,
        *[(F.col(f"_in_{m}") + F.col(f"_up_{m}")).alias("place" if m == "_one" else f"cum_{m}") for m in measures])


SKETCH_K = 4096      # size of a quantile sketch: about 80 KB, rank error about 0.13 % of the rows
SKETCH_SLACK = 0.004  # three such errors on either side of a wanted rank
SKETCH_FAN = 256     # partial sketches are merged in so many groups first, then the groups
BRACKET_CELLS = 1 << 16  # cells of a bracket; also the bound on rows of a per-bracket window


def _finite_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.when(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.col(c).cast("double")).alias(c)
                       for c in columns])


def sketches(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with a mergeable KLL sketch of every column (NULL and non-finite values left out).

    Sketches can be stored: those of several tables or days are united by ``merged_sketches`` and serve
    ``exact_quantiles`` of the united tables. No task merges more than a share of the partial sketches.
    """
    clean = _finite_columns(df, columns)
    groups = clean.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(SKETCH_FAN))).groupBy("_group").agg(
        *[F.kll_sketch_agg_double(c, F.lit(SKETCH_K)).alias(c) for c in columns])
    return merged_sketches(groups.drop("_group"))


def merged_sketches(rows: DataFrame) -> DataFrame:
    """The sketches of several rows as one row."""
    return rows.agg(*[F.kll_merge_agg_double(c, F.lit(SKETCH_K)).alias(c) for c in rows.columns])


def _brackets(sketched: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> list[tuple[int, float, float, list]]:
    """Per column (rows, smallest, largest, [(low, middle, high) per percentile]), read from the sketches."""
    ranks = [0.0, 1.0]
    for p in probs:
        low, high = max(p - SKETCH_SLACK, 0.0), min(p + SKETCH_SLACK, 1.0)
        ranks += [low, (low + high) / 2, high]
    asked = F.array(*[F.lit(r) for r in ranks])

    def of(c: str) -> Column:
        n = F.kll_sketch_get_n_double(c)
        return F.struct(n.alias("n"), F.when(n > 0, F.kll_sketch_get_quantile_double(c, asked)).alias("q"))

    row = sketched.select(*[of(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    out = []
    for n, q in row:
        q = list(q) if n else [0.0] * (2 + 3 * len(probs))
        out.append((n, q[0], q[1], [tuple(q[k:k + 3]) for k in range(2, len(q), 3)]))
    return out


def _bracket_cell(x: Column, low: Column, middle: Column, high: Column) -> Column:
    """Cell of a value inside its bracket, growing with it. Cells have equal widths up to the bracket's median
    and equal ratios beyond, counted from the end where values are dense, so that a long tail on either side
    does not leave one cell with all rows. (Halves, so that no difference overflows.)"""
    up, down = middle / 2 - low / 2, high / 2 - middle / 2
    left = up <= down
    width = high / 2 - low / 2
    unit = F.greatest(F.least(up, down), width * F.lit(2.0 ** -30), F.lit(2.0 ** -1000))
    far = F.when(left, x / 2 - low / 2).otherwise(high / 2 - x / 2)
    share = F.log1p(far / unit) / F.log1p(width / unit)
    cell = F.least(F.floor(share * F.lit(float(BRACKET_CELLS))), F.lit(BRACKET_CELLS - 1))
    return F.when(width <= 0, F.lit(0).cast("long")).when(left, cell).otherwise(-cell)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    sketched: DataFrame | None = None) -> DataFrame:
    """Linearly interpolated percentiles: rows (feature, prob, n, value), exact whatever the sketches say.

    First level: KLL sketches (``sketched`` takes stored ones of the same rows) give every percentile a bracket of
    values, below 1 % of the rows, and one scan counts the rows below and inside. A bracket that misses its rank is
    replaced by the column's whole range. Second level: the values inside a bracket, equal ones combined, fall
    into at most 2^16 cells; a window over the cells finds the one or two that hold the rank, and only their values
    are ranked. Brackets and counts come to the driver: a few numbers per column and percentile.
    NULL and non-finite values are left out.
    """
    columns, probs = list(columns), [float(p) for p in probs]
    clean = _finite_columns(df, columns)
    name = [f"`{c}`" for c in columns]
    read = _brackets(sketches(df, columns) if sketched is None else sketched, columns, probs)
    chosen = [list(near) for _, _, _, near in read]
    # One row per value: a pass per column and percentile over wide rows would be one method that no JVM compiles. The
    # brackets are literal arrays over the columns.
    values = clean.select(F.posexplode(F.array(*[F.col(x) for x in name])).alias("i", "x")).filter("x IS NOT NULL")
    edge = lambda numbers: f"array({', '.join(f'{float(x)!r}D' for x in numbers)})[i]"
    lows, highs = ([edge(near[j][k] for near in chosen) for j in range(len(probs))] for k in (0, 2))
    counted = {r["i"]: r for r in values.groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(f"count_if(x < {low}) AS b{j}") for j, low in enumerate(lows)],
        *[F.expr(f"count_if(x <= {high}) AS t{j}") for j, high in enumerate(highs)]).collect()}  # one row per column
    spec = []
    for i, (_, least, most, near) in enumerate(read):
        row = counted.get(i)
        n = row["n"] if row else 0
        for j, p in enumerate(probs if n else []):
            h, below, upto = p * (n - 1), row[f"b{j}"], row[f"t{j}"]
            if not (below <= math.floor(h) and upto > math.ceil(h)):
                chosen[i][j], below = (least, near[j][1], most), 0
            spec.append((i, chosen[i].index(chosen[i][j]), columns[i], p, n, h, below, *map(float, chosen[i][j])))
    spark = df.sparkSession
    wanted = spark.createDataFrame(spec, "i int, j int, feature string, prob double, n long, h double, b long, "
                                         "low double, middle double, high double")
    # identical brackets (of neighbouring percentiles) are read once and shared
    kept = {(s[0], s[1]): (s[7], s[9]) for s in spec}
    if not kept:
        return wanted.select("feature", "prob", "n", F.col("h").alias("value"))
    # tables of one row per column and percentile are broadcast: their size is fixed by the call
    edges = F.broadcast(wanted.select("i", "j", "low", "middle", "high").distinct())
    none = (1.0, 0.0)  # holds no value
    ranges = [[kept.get((i, j), none) for i in range(len(columns))] for j in range(len(probs))]
    tests = [f"x >= {edge(r[0] for r in one)} AND x <= {edge(r[1] for r in one)}" for one in ranges]
    inside = ", ".join(f"CASE WHEN {t} THEN {j} END" for j, t in enumerate(tests))
    found = (values.filter(" OR ".join(f"({t})" for t in tests)).select("i", "x", F.expr(f"explode(array_compact(array({inside}))) AS j"))
             .groupBy("i", "j", "x").agg(F.count(F.lit(1)).alias("c")).join(edges, ["i", "j"])
             .select("i", "j", "x", "c", _bracket_cell(F.col("x"), F.col("low"), F.col("middle"), F.col("high")).alias("cell")))
    cells = found.groupBy("i", "j", "cell").agg(F.sum("c").alias("m"))
    before = F.sum("m").over(W.partitionBy("i", "j").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("m")
    lo_rank, hi_rank = F.floor("h"), F.ceil("h")
    hit = (cells.withColumn("before", before).join(F.broadcast(wanted), ["i", "j"])
           .filter((F.col("b") + F.col("before") <= hi_rank) & (F.col("b") + F.col("before") + F.col("m") > lo_rank))
           .select("i", "j", "cell", "before").distinct())
    upto = W.partitionBy("i", "j", "cell").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    ranked = (found.join(F.broadcast(hit), ["i", "j", "cell"])  # at most two cells per column and percentile
              .withColumn("to", F.col("before") + F.sum("c").over(upto)))
    at = lambda r: (F.col("b") + F.col("to") > r) & (F.col("b") + F.col("to") - F.col("c") <= r)
    return (ranked.join(F.broadcast(wanted), ["i", "j"])
            .groupBy("feature", "prob", "n", "h")
            .agg(F.min(F.when(at(lo_rank), F.col("x"))).alias("x0"),
                 F.min(F.when(at(hi_rank), F.col("x"))).alias("x1"))
            .select("feature", "prob", "n",
                    (F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("h") - F.floor("h"))).alias("value")))


def quantile_constants(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """``exact_quantiles`` brought to the driver as fitted constants."""
    out: dict[str, list] = {c: [None] * len(probs) for c in columns}
    index = {float(p): j for j, p in enumerate(probs)}
    for r in exact_quantiles(df, columns, probs).collect():  # len(columns) * len(probs) rows
        out[r["feature"]][index[r["prob"]]] = r["value"]
    return out


def hash_position(id_col: Column | str, seed: int | None = None) -> Column:
    """Reproducible pseudo-random position of a row in [0, 2^32).

    Without a seed it is Knuth's multiplicative hash of an integer key; with one it
    is ``xxhash64`` of key and seed.
    """
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    if seed is None:
        # only the lower 32 bits of the id matter; in two halves no product leaves a long
        low = F.pmod(c.cast("long"), F.lit(4294967296))
        upper = F.shiftright(low, 16) * F.lit(2654435761) % F.lit(65536) * F.lit(65536)
        return (upper + low % F.lit(65536) * F.lit(2654435761)) % F.lit(4294967296)
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(4294967296))


def hash_order_cuts(df: DataFrame, key: str, position: str, id_col: str,
                    sizes: dict[str, Column]) -> DataFrame:
    """Per class the (position, id) of its k-th row in hash order, for several k.

    ``sizes`` maps a name to an expression over column ``n`` (rows of the class) and
    ``smallest`` (rows of the smallest class). Returns one row per class with a struct
    ``(position, id)`` per name; NULL where k is 0. A histogram over 2^20 hash cells
    finds the cell holding the k-th row; only rows of those cells are ranked.
    """
    cell = F.shiftrightunsigned(F.col(position), 12)
    hist = df.groupBy(key, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(key).orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    hist = hist.select(key, "_cell", "c", F.sum("c").over(w).alias("upto"),
                       F.sum("c").over(W.partitionBy(key)).alias("n"))
    hist = hist.withColumn("smallest", F.min("n").over(W.partitionBy()))
    spec = F.array(*[F.struct(F.lit(name).alias("cut"), k.cast("long").alias("k"))
                     for name, k in sizes.items()])
    hit = (hist.select(key, "_cell", "upto", "c", F.inline(spec))
           .filter((F.col("k") > F.col("upto") - F.col("c")) & (F.col("k") <= F.col("upto")))
           .select(key, "_cell", "cut", (F.col("k") - F.col("upto") + F.col("c")).alias("r")))
    # one row per (class, cut), i.e. a table of fixed size
    boundary = (df.select(key, cell.alias("_cell"), F.col(position).alias("_u"), F.col(id_col).alias("_id"))
                .join(F.broadcast(hit), [key, "_cell"]))
    ranked = boundary.withColumn("rn", F.row_number().over(
        W.partitionBy(key, "cut").orderBy("_u", "_id")))
    return (ranked.filter(F.col("rn") == F.col("r"))
            .groupBy(key).pivot("cut", list(sizes))
            .agg(F.first(F.struct(F.col("_u"), F.col("_id")))))
