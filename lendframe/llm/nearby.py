"""MinHash near-deduplication with odd sketches."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import Union, components

SHINGLE = 5
THRESHOLD = 80
SAMPLES, BANDS, ROWS = 128, 24, 4
BITS = 512
MARGIN = 0.22
HOT_BUCKET = 2048
CLUSTER_DOCS, CLUSTER_BYTES = 512, 16 << 20
PIVOTS = 32
SLICE_BYTES = 2 << 20
LONG_WORD = 64

_rng = np.random.default_rng(20_240_607)
_draw = lambda *shape: _rng.integers(1, 1 << 63, size=shape, dtype=np.uint64) | np.uint64(1)
BYTE, STEP, SPREAD = _draw(256), _draw(1)[0], _draw(16)
XORS, FACTORS, BAND = _draw(SAMPLES), _draw(SAMPLES), _draw(BANDS)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GAP = np.zeros(256, dtype=bool)
GAP[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts that begin at ``starts`` in ``data``, and the words of each text."""
    low = LOWER[data]
    solid = ~GAP[low]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = starts[starts < len(data)]
    first[inner] = solid[inner]
    after = np.flatnonzero(np.append(solid[1:] & first[1:] | ~solid[1:], True) & solid) + 1
    begin = np.flatnonzero(first)
    length = after - begin
    h = np.full(len(begin), STEP)
    at = np.flatnonzero(length <= LONG_WORD)
    k = 0
    while len(at):
        h[at] = h[at] * STEP + BYTE[low[begin[at] + k]]
        k += 1
        at = at[length[at] > k]
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = np.frombuffer(hashlib.blake2b(low[begin[i]:after[i]].tobytes(), digest_size=8).digest(), dtype=np.uint64)[0]
    edges = np.searchsorted(begin, np.append(starts, len(data)))
    return mixed(h), np.diff(edges)


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and how many each has."""
    words, counts = word_hashes(data, starts)
    n = len(words) - width + 1
    rolled = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(width if n > 0 else 0):
        rolled += words[j:j + n] * SPREAD[j]
    rolled = mixed(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            own = rolled[at:at + c - width + 1]
            out.append(np.unique(own) if len(own) > 1 else own)
        elif c:
            out.append(mixed((words[at:at + c] * SPREAD[:c]).sum(dtype=np.uint64, keepdims=True) + SPREAD[8 + c:9 + c]))
        else:
            out.append(words[:0])
        at += c
    return (np.concatenate(out) if out else words[:0]), np.array([len(x) for x in out], dtype=np.int64)


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A text column in stretches of about ``SLICE_BYTES``: first row, bytes, starts of the texts."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, side="right")) - 1)
        yield i, every[at[i]:at[j]], at[i:j] - at[i]
        i = j


def sketches(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each set: two fingerprints, the odd sketch (bytes) and the band keys. Empty sets have zeros."""
    n, full = len(sizes), np.flatnonzero(sizes)
    prints = np.zeros((2, n), dtype=np.uint64)
    bits, bands = np.zeros((n, BITS // 8), dtype=np.uint8), np.zeros((n, BANDS), dtype=np.uint64)
    if len(full) == 0:
        return prints[0], prints[1], bits, bands
    begin = (np.cumsum(sizes) - sizes)[full]
    prints[0, full] = np.add.reduceat(mixed(sets ^ SPREAD[0]), begin)
    prints[1, full] = np.add.reduceat(mixed(sets ^ SPREAD[1]), begin)
    samples = np.empty((SAMPLES, len(full)), dtype=np.uint64)
    for i in range(SAMPLES):
        samples[i] = np.minimum.reduceat((sets ^ XORS[i]) * FACTORS[i], begin)
    spots = (mixed(samples + XORS[:, None]) >> np.uint64(64 - int(math.log2(BITS)))).astype(np.int64)
    flips = np.bincount((spots + np.arange(len(full)) * BITS).ravel(), minlength=len(full) * BITS)
    bits[full] = np.packbits((flips & 1).astype(np.uint8).reshape(len(full), BITS), axis=1)
    rows = samples[:BANDS * ROWS].reshape(BANDS, ROWS, len(full))
    bands[full] = mixed((rows * SPREAD[:ROWS, None]).sum(axis=1, dtype=np.uint64) + BAND[:, None]).T
    return prints[0], prints[1], bits, bands


def farthest(threshold: int = THRESHOLD) -> int:
    """Largest XOR population count that is taken for the threshold. The estimate is
    ``1 + BITS / (4 SAMPLES) ln(1 - 2 x / BITS)``; the margin below the threshold is some five standard errors."""
    return math.floor(BITS / 2 * (1 - math.exp((threshold / 100 - MARGIN - 1) * 4 * SAMPLES / BITS)))


def _sketch_texts(width: int, text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, starts in text_slices(batch.column(text_at)):
                sets, sizes = shingle_sets(data, starts, width)
                a, b, bits, bands = sketches(sets, sizes)
                own = batch.slice(first, len(starts))
                edges = pa.array(np.arange(0, BANDS * len(starts) + 1, BANDS, dtype=np.int32))
                cols = [own.column(i) for i in range(text_at)] + [
                    pa.array(sizes), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([x.tobytes() for x in bits], pa.binary()),
                    pa.ListArray.from_arrays(edges, pa.array(bands.ravel().view(np.int64)))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "place", "n", "fa", "fb", "sketch", "bands"])

    return run


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of a partition sorted by ``keys``, whatever the batches are."""
    kept: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if table.num_rows == 0:
            continue
        table = pa.concat_tables([kept, table]) if kept is not None else table
        columns = [table.column(k).to_numpy() for k in keys]
        same = np.logical_and.reduce([c == c[-1] for c in columns])
        cut = table.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
        kept = table.slice(cut)
    if kept is not None and kept.num_rows:
        yield kept


def bounds(columns: list[np.ndarray]) -> list[tuple[int, int]]:
    new = np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])))
    begin = np.flatnonzero(new)
    return list(zip(begin.tolist(), np.append(begin[1:], len(new)).tolist()))


def apart(sketch: np.ndarray, i: int, others: slice) -> np.ndarray:
    return np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1, dtype=np.int64)


def _bits(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)


def _link_buckets(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Within each bucket, links that connect what the sketches connect: to the smallest member of each part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["key"]):
            keys, ids, sketch = table.column("key").to_numpy(), table.column("cid").to_numpy(), _bits(table.column("sketch"))
            left, right = [], []
            spans = bounds([keys])
            two = np.array([i for i, j in spans if j - i == 2], dtype=np.int64)
            if len(two):
                near = two[np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(axis=1) <= most]
                left.append(ids[near])
                right.append(ids[near + 1])
            for i, j in spans:
                if j - i > 2:
                    union = Union(j - i)
                    for p in range(j - i - 1):
                        for q in np.flatnonzero(apart(sketch, i + p, slice(i + p + 1, j)) <= most).tolist():
                            union.join(p, p + 1 + q)
                    root = np.array([union.find(p) for p in range(j - i)])
                    linked = np.flatnonzero(root != np.arange(j - i))
                    left.append(ids[i + linked])
                    right.append(ids[i + root[linked]])
            a, b = (np.concatenate(x) if x else ids[:0] for x in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _verify(width: int, threshold: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What is connected inside each group by links that hold on the full shingle sets.

    ``part`` is 0 for rows compared with all later ones, 1 for rows compared with those of part 0
    only; rows of equal ``comp`` are connected already. Gives for each row the smallest id it
    reaches in the group (``root``) and the smallest pivot (``label``, null if none).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["cluster", "piece"]):
            sets: list[np.ndarray] = []
            for chunk in table.column("text").chunks:
                for _, data, starts in text_slices(chunk):
                    every, sizes = shingle_sets(data, starts, width)
                    sets += np.split(every, np.cumsum(sizes)[:-1])
            ids, part, comp, pivot, piece, cluster = (table.column(c).to_numpy() for c in ("cid", "part", "comp", "pivot", "piece", "cluster"))
            sketch, size = _bits(table.column("sketch")), np.array([len(s) for s in sets])
            roots, labels = np.empty(len(ids), dtype=np.int64), [None] * len(ids)
            for i, j in bounds([cluster, piece]):
                union, seen = Union(j - i), {}
                for p in range(i, j):
                    union.join(seen.setdefault(comp[p], p - i), p - i)
                    union.join(seen.setdefault(("id", ids[p]), p - i), p - i)
                for p in range(i, j):
                    if part[p] == 1:
                        break
                    rest = slice(p + 1, j)
                    small, large = np.minimum(size[rest], size[p]), np.maximum(size[rest], size[p])
                    for q in (p + 1 + np.flatnonzero((apart(sketch, p, rest) <= most) & (100 * small >= threshold * large))).tolist():
                        if union.find(p - i) == union.find(q - i):
                            continue
                        shared = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                        if 100 * shared >= threshold * (size[p] + size[q] - shared):
                            union.join(p - i, q - i)
                top, least, mark = [union.find(p) for p in range(j - i)], {}, {}
                for p in range(j - i):
                    least[top[p]] = min(least.get(top[p], ids[i + p]), ids[i + p])
                    if pivot[i + p]:
                        mark[top[p]] = min(mark.get(top[p], ids[i + p]), ids[i + p])
                for p in range(j - i):
                    roots[i + p], labels[i + p] = least[top[p]], mark.get(top[p])
            yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(ids), pa.array(roots), pa.array(labels, pa.int64()), pa.array(pivot)],
                                             names=["cluster", "cid", "root", "label", "pivot"])

    return run


def _pieces(rows: DataFrame, width: int, threshold: int, most: int) -> DataFrame:
    """``cluster, cid, root, label, pivot`` of ``rows``, a task reading one group (cluster, piece) at a time."""
    order = ["cluster", "piece", "part", "cid"]
    return (rows.select("cluster", "piece", "part", "cid", "comp", "pivot", "sketch", "text").repartition("cluster", "piece")
            .sortWithinPartitions(*order).mapInArrow(_verify(width, threshold, most), "cluster long, cid long, root long, label long, pivot boolean"))


def candidate_links(classes: DataFrame, most: int) -> DataFrame:
    """Links between classes that share a band and whose sketches are near.

    A bucket of more than ``HOT_BUCKET`` classes is joined to its smallest one unseen: a candidate
    too many only makes a cluster larger, and clusters are verified anyway.
    """
    members = classes.select(F.explode("bands").alias("key"), "cid")
    # Written, so that the join below is one of two shuffled tables, in which a hot key can be split.
    shared = cut_lineage(members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("least")).filter("size > 1"))
    met = cut_lineage(members.join(shared, "key"))
    hot = met.filter((F.col("size") > HOT_BUCKET) & (F.col("cid") != F.col("least"))).select(F.col("cid").alias("a"), F.col("least").alias("b"))
    cold = met.filter(F.col("size") <= HOT_BUCKET).select("key", "cid").join(classes.select("cid", "sketch"), "cid")
    linked = cold.repartition("key").sortWithinPartitions("key", "cid").mapInArrow(_link_buckets(most), "a long, b long")
    return linked.unionAll(hot)


def verified_components(docs: DataFrame, classes: DataFrame, clusters: DataFrame, width: int, threshold: int, most: int) -> DataFrame:
    """``node, component`` by links that hold on full sets, for the classes of all clusters.

    A small cluster is one group of one task. A large one goes in two steps. First its members, in
    pieces of bounded size, are compared within the piece and with the cluster's pivots; the pivot
    that most members reach stands for the main part. Then everything that does not reach it is
    compared with every member, in pieces again. Pairs within the main part are connected already,
    all other pairs have met.
    """
    known = classes.select("cid", "sketch", "bytes").join(clusters.select(F.col("node").alias("cid"), F.col("component").alias("cluster")), "cid")
    size = cut_lineage(known.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), F.sum("bytes").alias("bytes")))
    pieces = F.ceil(F.greatest(F.col("docs") / CLUSTER_DOCS, F.col("bytes") / CLUSTER_BYTES)).cast("long")
    wanted = known.select("cid", "cluster", "sketch").join(size.select("cluster", pieces.alias("pieces")), "cluster")
    texts = cut_lineage(docs.filter("doc IS NOT NULL").join(wanted, docs["doc"] == wanted["cid"]).select(
        "cid", "cluster", "sketch", "pieces", "text", F.col("cid").alias("comp"), F.lit(False).alias("pivot"), F.lit(0).alias("part")))
    whole = texts.filter("pieces <= 1").withColumn("piece", F.lit(0).cast("long"))
    small = _pieces(whole, width, threshold, most).select(F.col("cid").alias("node"), F.col("root").alias("component")).distinct()
    large = texts.filter("pieces > 1").withColumn("piece", F.pmod(F.xxhash64("cid"), F.col("pieces")))
    if large.isEmpty():
        return small
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64(F.lit(1), "cid"), "cid"))
    chosen = large.select("cluster", "cid").withColumn("_nr", nth).filter(F.col("_nr") <= PIVOTS).select("cluster", "cid").distinct()
    pivots = large.join(chosen, ["cluster", "cid"], "left_semi").withColumn("piece", spread).withColumn("pivot", F.lit(True))
    first = cut_lineage(_pieces(large.unionByName(pivots), width, threshold, most))
    links = first.select(F.col("cid").alias("a"), F.col("root").alias("b"))
    reached = first.filter("NOT pivot").select("cluster", "cid", F.coalesce("label", "cid").alias("comp")).distinct()
    main = cut_lineage(reached.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")))
    turns = F.ceil((F.col("all") - F.col("most")) / CLUSTER_DOCS).cast("long")
    settled = cut_lineage(large.drop("comp", "pivot", "part").join(
        reached.join(main, "cluster").select("cluster", "cid", "comp", (F.col("comp") != F.col("main")).alias("pivot"), turns.alias("turns")), ["cluster", "cid"]).filter("turns > 0"))
    # Here ``pivot`` marks the outsiders. Any row may carry their links: the smallest id of a union can be the outsider's.
    asking = (settled.filter("pivot").withColumn("part", F.lit(0)).withColumn("_t", F.pmod(F.xxhash64(F.lit(2), "cid"), F.col("turns")))
              .withColumn("_p", spread).withColumn("piece", F.col("_t") * F.col("pieces") + F.col("_p")))
    asked = (settled.withColumn("part", F.lit(1)).withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
             .withColumn("piece", F.col("_t") * F.col("pieces") + F.col("piece")))
    columns = [*settled.columns, "part"]
    second = _pieces(asking.select(*columns).unionByName(asked.select(*columns)), width, threshold, most)
    more = second.filter("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")).distinct()
    return small.unionAll(components(links.unionAll(more)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                    threshold: int = THRESHOLD) -> DataFrame:
    """Groups of documents whose sets of ``width``-word shingles have a Jaccard similarity of ``threshold`` percent or more.

    Words are runs of anything but space and the ASCII controls 9 to 13, A-Z in lower case; a text of fewer
    words is one shingle, one without words none. Equal sets are one class. 128 MinHash samples
    give 24 band keys of four, and all are folded into a parity bitmap of 512 bits, the odd
    sketch. Classes that share a band and whose bitmaps differ little form clusters, and in each
    cluster the texts are read again and links confirmed on the full sets.

    Rows out: ``doc_id, n_shingles, component_id, kept``, one per row in. ``component_id`` is the
    smallest id reached, ``kept`` marks the one row of a group that stays. Documents without words
    stand alone. Rows without an id link with nothing and stay; rows that share an id are judged by their
    own texts, but links of any of them may unite them; of repeated rows one is kept. An empty table gives no rows. Other columns
    are not read.
    """
    most = farthest(threshold)
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed = given.select("doc", F.monotonically_increasing_id().alias("place"), "text")
    rows = cut_lineage(placed.mapInArrow(_sketch_texts(width, 2), "doc long, place long, n long, fa long, fb long, sketch binary, bands array<long>"))
    one = ["fa", "fb", "n"]
    classes = cut_lineage(rows.filter("n > 0 AND doc IS NOT NULL").groupBy(*one).agg(
        F.min(F.struct("doc", "place")).alias("first"), F.max("sketch").alias("sketch"), F.max("bands").alias("bands")).select(
        *one, F.col("first.doc").alias("cid"), F.col("first.place").alias("place"), "sketch", "bands", (F.col("n") * 8).alias("bytes")))
    clusters = components(candidate_links(classes, most))
    found = verified_components(given, classes, clusters, width, threshold, most)
    named = classes.join(found, classes["cid"] == found["node"], "left").select(
        *[F.col(c).alias(f"_{c}") for c in one], F.col("place").alias("_place"), F.coalesce("component", "cid").alias("_component"))
    joined = rows.select("doc", "place", *one).join(named, (F.col("fa") == F.col("_fa")) & (F.col("fb") == F.col("_fb")) & (F.col("n") == F.col("_n")) & F.col("doc").isNotNull(), "left")
    component = F.coalesce("_component", "doc")
    return joined.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce((F.col("doc") == component) & (F.col("_place").isNull() | (F.col("_place") == F.col("place"))), F.lit(True)).alias("kept"))
