"""Phrase collocations by dynamic itemset counting.

The corpus is turned into word numbers once and cut into shards, which are scanned in a cycle, one shard a
step; lengths are counted side by side. A longer phrase becomes active with the step after both its parts (all but its last word, all
but its first) have reached the threshold. While it is screened, for one cycle at most, only a hash of it is counted, shard by shard: a
phrase that occurs ``min_count`` times occurs ``min_count / shards`` times in one of the shards. With that it has
reached the threshold itself, and its exact count, word by word, begins with the next step and ends after one full cycle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder

BREAKS = ".,;:!?\n\x0b\x0c\r"
TOKEN = re.compile(r"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LONGEST, MIN_COUNT, TOP, SHARDS = 5, 100, 2000, 4
SLICE_CHARS = 2 << 20
LEAST_BITS, MOST_BITS, BYTES_A_SLOT = 16, 26, 256
SLICE = "nr long, langs array<string>, names array<string>, lang_of binary, hashes binary, ids binary"
COUNTS = "key long, lang string, k int, phrase string, since int, n long"
ODD, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Lexicon:
    """Numbers from 1 for the words of each language as they are met, 0 for a break; names and languages by number."""

    def __init__(self) -> None:
        self.known: dict[str, _Numbers] = {}
        self.names, self.langs = [""], [0]

    def numbers(self, lang: str, text: str) -> np.ndarray:
        words = TOKEN.findall(text)
        own = self.known.get(lang)
        if own is None:
            own = self.known[lang] = _Numbers(self)
        return np.fromiter(map(own.__getitem__, words), dtype=np.int32, count=len(words))


class _Numbers(dict):
    """Word -> number for one language."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.names, self.langs, self.lang = lexicon.names, lexicon.langs, len(lexicon.known)

    def __missing__(self, word: str) -> int:
        if word[0] in BREAKS:
            self[word] = 0
            return 0
        self[word] = at = len(self.names)
        self.names.append(word)
        self.langs.append(self.lang)
        return at


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as slices of word numbers: one row each, with the slice's own lexicon and the words' hashes."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId()

    def packed(words: Lexicon, found: list[np.ndarray]) -> pa.RecordBatch:
        langs = list(words.known)
        seeds = [xxhash.xxh64_intdigest(x.encode()) for x in langs]
        hashes = np.array([0, *(xxhash.xxh64_intdigest(w.encode(), seeds[k]) for w, k in zip(words.names[1:], words.langs[1:]))], dtype="<u8")
        return pa.RecordBatch.from_arrays([
            pa.array([at], pa.int64()), pa.array([langs], pa.list_(pa.string())), pa.array([words.names], pa.list_(pa.string())),
            *[pa.array([x.tobytes()], pa.binary()) for x in (np.array(words.langs, dtype="<i4"), hashes, np.concatenate(found).astype("<i4"))]],
            names=["nr", "langs", "names", "lang_of", "hashes", "ids"])

    words, found, chars, gap = Lexicon(), [], 0, np.zeros(1, dtype=np.int32)
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py().encode().translate(LOWER).decode()
            found += [words.numbers(lang.as_py(), text), gap]
            chars += len(text)
            if chars >= SLICE_CHARS:
                yield packed(words, found)
                words, found, chars, at = Lexicon(), [], 0, at + 1
    if found:
        yield packed(words, found)


def distinct(ids: np.ndarray, at: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and number of every distinct phrase of ``k`` words among those at ``at``; compared word by word, not by hash."""
    key = ids[at]
    for j in range(1, k):
        if j > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + ids[at + j]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return at[first], n


def count_slice(ids: np.ndarray, word_hashes: np.ndarray, reached: np.ndarray, step: int, cycle: int, longest: int) -> Iterator[tuple]:
    """What this step counts: (0, hashes, counts) of phrases to screen, (k, first positions, since, counts) of those to count exactly.

    ``reached`` has, by slot (the first bits of a phrase's hash), the step in which a phrase there reached the
    threshold, 0 if none has. It is set once. Two phrases in one slot only mean that one is counted
    without need, for a full cycle as any other.
    """
    shift = np.uint64(64 - int(math.log2(len(reached))))
    hashes = word_hashes[ids]
    own, at, begun = hashes, np.flatnonzero(ids), np.zeros(0, dtype=np.int64)
    for k in range(1, longest + 1):
        if k > 1:
            at = np.flatnonzero((since[:-1] > 0) & (since[1:] > 0))  # noqa: F821
            begun = np.maximum(since[at], since[at + 1])  # noqa: F821
            mixed = (own[at] * OTHER + hashes[at + k - 1]) * ODD
            own = np.zeros(len(since) - 1, dtype=np.uint64)  # noqa: F821
            own[at] = mixed ^ (mixed >> np.uint64(31))
        else:
            begun = np.zeros(len(at), dtype=np.int64)
        if not len(at):
            return
        here = reached[(own[at] >> shift).astype(np.int64)].astype(np.int64)
        screened = (here == 0) & (step <= begun + cycle)
        if screened.any():
            yield 0, *np.unique(own[at[screened]], return_counts=True)
        start = np.maximum(here, begun)
        exact = (here > 0) & (step <= start + cycle)
        if exact.any():
            where = at[exact]
            first, n = distinct(ids, where, k, len(word_hashes))
            yield k, first, start[exact][np.searchsorted(where, first)], n
        since = np.zeros(len(own), dtype=np.int64)  # of the phrase that begins here, once it has reached the threshold
        since[at] = np.where(here > 0, start, 0)


def counter(reached, step: int, cycle: int, longest: int):
    """Rows of ``COUNTS``: screened hashes with ``k`` -1, words of a language with 0, exact phrases with their length."""
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("since", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(n, k, key=None, lang=None, phrase=None, since=None):
            none = lambda x, f: pa.nulls(len(n), f.type) if x is None else pa.array(x, f.type)
            cols = (key, lang, np.full(len(n), k), phrase, np.zeros(len(n), dtype=np.int64) if since is None else since, n)
            return pa.RecordBatch.from_arrays([none(x, f) for x, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            for row in range(batch.num_rows):
                langs, names = (batch.column(c)[row].values for c in ("langs", "names"))
                lang_of, hashes, ids = (np.frombuffer(batch.column(c)[row].as_buffer(), dtype=t)
                                        for c, t in (("lang_of", "<i4"), ("hashes", "<u8"), ("ids", "<i4")))
                if step <= cycle:
                    yield sent(np.bincount(lang_of[ids[ids > 0]], minlength=len(langs)), 0, lang=langs)
                ids = ids.astype(np.int64)
                for k, first, *rest in count_slice(ids, hashes, reached.value, step, cycle, longest):
                    if not k:
                        yield sent(rest[0], -1, key=first.view(np.int64))
                        continue
                    words = [names.take(pa.array(ids[first + j])) for j in range(k)]
                    phrase = words[0] if k == 1 else pc.binary_join_element_wise(*words, " ")
                    yield sent(rest[1], k, lang=langs.take(pa.array(lang_of[ids[first]])), phrase=phrase, since=rest[0])
    return run


def slot_bits(text_bytes: int) -> int:
    """One slot for 256 bytes of text, at most 2^26 (64 MB); beyond that more phrases are counted without need, none are lost."""
    return max(LEAST_BITS, min(MOST_BITS, math.ceil(math.log2(max(text_bytes, BYTES_A_SLOT) / BYTES_A_SLOT))))


def _mark(counts: DataFrame, reached: np.ndarray, step: int) -> bool:
    """Set the slots of the screened hashes; they come as bitmaps, whose number depends on the slots only."""
    value = F.shiftrightunsigned("key", 64 - int(math.log2(len(reached)))) + 1
    maps = counts.filter("k = -1").groupBy(F.bitmap_bucket_number(value).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits")).collect()
    for b, bits in maps:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little")) + (b - 1) * 32768
        reached[at[reached[at] == 0]] = step
    return bool(maps)


def _stored(counts: DataFrame, path: str, ended: int, local: int, min_count: int) -> DataFrame:
    """A step's counts written in two parts: exact ones begun after step ``ended`` stay open; of what is
    complete the frequent ones stay, of the screened hashes those with ``local`` or more."""
    rows = counts.withColumn("open", (F.col("since") > ended) & (F.col("k") >= 0)).filter(
        F.col("open") | (F.col("k") == 0) | ((F.col("k") == -1) & (F.col("n") >= local)) | ((F.col("k") > 0) & (F.col("n") >= min_count)))
    rows.write.partitionBy("open").parquet(path)
    return counts.sparkSession.read.schema(f"{COUNTS}, open boolean").parquet(path)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                     longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """``lang, k, phrase, n`` of all phrases of 1 to ``longest`` words that occur ``min_count`` times or more in their
    language, and with ``k`` 0 the number of words of each language.

    Letters A-Z in lower case, pieces between ``.,;:!?`` and line ends, words between spaces and tabs;
    overlapping occurrences count each. Null languages are ``und``, null texts are empty, repeated rows
    count each, an empty table gives no rows, other columns are not read. Nothing but the running counts of
    phrases that passed the screening is kept from step to step, in the shared folder. A word or phrase that is a
    third of all comes as one row per slice of a task.
    """
    if not 1 <= shards * (longest + 1) <= 255:
        raise ValueError("shards times (longest + 1) is 1 to 255")
    spark = docs.sparkSession
    root = shared_folder(spark, "phrases")
    given = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                        F.col(f"`{text_col}`").cast("string").alias("text")).filter("text IS NOT NULL")
    given.mapInArrow(slices, SLICE).withColumn("shard", F.expr(f"cast(nr % {shards} AS int)")).drop("nr").write.partitionBy("shard").parquet(f"{root}/shards")
    numbered = spark.read.schema(SLICE.replace("nr long, ", "") + ", shard int").parquet(f"{root}/shards")
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    reached = np.zeros(1 << slot_bits(size), dtype=np.uint8)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    running, complete, last, step = spark.createDataFrame([], COUNTS), [], 0, 0
    while step < last + shards:
        step += 1
        shared = spark.sparkContext.broadcast(reached)
        found = numbered.filter(F.col("shard") == (step - 1) % shards).drop("shard").mapInArrow(counter(shared, step, shards, longest), COUNTS)
        sums = running.unionAll(found).groupBy("key", "lang", "k", "phrase").agg(F.min("since").alias("since"), F.sum("n").alias("n")).select(*running.columns)
        counts = _stored(sums, f"{root}/counts/{step}", step - shards, -(-min_count // shards), min_count)
        shared.destroy()
        files.delete(path(f"{root}/counts/{step - 1}/open=true"), True)
        running = counts.filter("open").drop("open")
        complete.append(counts.filter("NOT open AND k >= 0").select("lang", "k", "phrase", "n"))
        if _mark(counts, reached, step):
            last = step
    whole = complete[0]
    for part in complete[1:]:
        whole = whole.unionAll(part)
    counted = cut_lineage(whole)
    files.delete(path(root), True)
    return counted


def collocations(counts: DataFrame, top: int = TOP, absorbed_at: int = 100) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` best phrases of two or more words of each language.

    ``counts`` is from ``frequent_phrases``. A phrase is cut after each of its words; with ``l`` and ``r`` occurrences of the
    two parts its score is floor(1000 a n / (l r)), in decimals of 38 digits (counts below 10^16). The
    lowest cut counts, of equal ones the first. A phrase is dropped if a longer one that holds it
    occurs ``absorbed_at`` percent as often or more; one word longer is enough to look at, as everything
    in between occurs at least as often as the longer. Ranked by score and ``a`` downwards, then by phrase.
    """
    known = counts.filter("k > 0").select("lang", "phrase", "k", "n")
    longer = known.filter("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    inner = longer.filter("k > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"))
    widest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_more"))
    left = longer.join(widest, ["lang", "phrase"], "left").filter(F.col("_more").isNull() | (100 * F.col("_more") < absorbed_at * F.col("a")))
    cuts = left.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("_l"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("_r"))
    side = lambda name: known.select("lang", F.col("phrase").alias(f"_{name}"), F.col("n").alias(name))
    total = counts.filter("k = 0").select("lang", "n")
    both = cuts.join(side("l"), ["lang", "_l"]).join(side("r"), ["lang", "_r"]).join(total, "lang")
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    over, under = F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n"), exact("l") * exact("r")
    scored = both.withColumns({"_over": over, "_under": under}).withColumn("score", F.expr("_over div _under"))
    least = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "cut")).alias("_c")).select("lang", "phrase", "_c.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (least.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
