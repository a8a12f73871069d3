"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio between trusted and raw text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import unused

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; percent of the words
LEAST_BUCKETS = 1 << 12
BROADCAST_ROWS = 1 << 20  # more ids than these are joined by a shuffle
CACHED_WORDS = 1 << 20
CELL = 1.0 / 4096
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Words(dict):
    """Numbers for words as they are met (equal words, equal numbers) with a 64-bit hash of each."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros(1024, dtype=np.uint64)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(at, dtype=np.uint64)])
        self.hashes[at] = xxhash.xxh64_intdigest(word.encode())
        return at

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def buckets(self, numbers: np.ndarray, log2: int) -> np.ndarray:
        """Buckets of all words and of all pairs of neighbours."""
        odd, other = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        one = self.hashes[numbers]
        two = (one[:-1] * odd + one[1:]) * other
        both = np.concatenate([one, two ^ (two >> np.uint64(29))])
        return ((both * odd) >> np.uint64(64 - log2)).astype(np.int64)


def repeated_words(numbers: np.ndarray) -> int:
    """Words that stand in a window of three words found twice or more, the first included."""
    n = len(numbers)
    if n < 4:
        return 0
    pairs = np.unique((numbers[:-1] << 32) | numbers[1:], return_inverse=True)[1]
    _, at, times = np.unique((pairs[:-1] << 32) | numbers[2:], return_inverse=True, return_counts=True)
    again = times[at] > 1
    inside = np.zeros(n, dtype=bool)
    for k in range(3):
        inside[k:n - 2 + k] |= again
    return int(inside.sum())


def statistics(text: str, words: list[str], numbers: np.ndarray) -> tuple[int, ...]:
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(numbers))


def bucket_bits(text_bytes: int) -> int:
    """Buckets follow the corpus as its vocabulary does (Heaps' law): four times the root of its
    running words, a power of two. 2^16 for 0.5 GB, 2^24 (64 MB of ratios) for 100 TB."""
    return max(LEAST_BUCKETS.bit_length() - 1, math.ceil(math.log2(4 * math.sqrt(max(text_bytes, 6) / 6))))


@dataclass
class TextRatio:
    """Log ratio (trusted to raw) per bucket; ``trusted`` is False where there was no trusted text."""

    log2: int
    ratios: np.ndarray
    trusted: bool

    @classmethod
    def fit(cls, log2: int, raw: np.ndarray, target: np.ndarray) -> TextRatio:
        """From n-gram counts per bucket, one added to each."""
        size = 1 << log2
        share = lambda c: np.log(c + 1.0) - math.log(float(c.sum()) + size)
        return cls(log2, (share(target) - share(raw)).astype(np.float32), bool(target.sum() > 0))

    def score(self, buckets: np.ndarray) -> float:
        return float(self.ratios[buckets].mean(dtype=np.float64)) if len(buckets) and self.trusted else 0.0


def labelled(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``_of, good, learned`` of every good and every bad document.

    Good: quality 1 and never toxic. Bad: quality 0. Labels that contradict each other, and toxic
    documents of quality 1, are neither. Two thirds are for learning, the rest (crc32 of the id
    leaves 1 by 3) sets the threshold.
    """
    per = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_of")).agg(
        F.min("quality").alias("lo"), F.max("quality").alias("hi"), F.max("toxic").alias("toxic"))
    judged = per.select("_of", F.when((F.col("lo") == 1) & (F.col("toxic") == 0), True).when(F.col("hi") == 0, False).alias("good"))
    return judged.filter("good IS NOT NULL").withColumn("learned", F.crc32(F.col("_of").cast("string")) % 3 != 1)


def learn(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> TextRatio:
    """Counts of all words and word pairs of every whole text, and of those of good documents to learn from.

    Tasks add up counts per bucket; the driver gets one row per bucket, whose number grows with the
    root of the corpus. Up to ``BROADCAST_ROWS`` ids of ``known`` (from ``labelled``; write it first) are broadcast and no
    text is shuffled; more are joined by hash, which shuffles the texts once and sorts nothing.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).filter("_text IS NOT NULL")
    log2 = bucket_bits(rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0)
    learned = known.filter("good AND learned").select("_of", F.lit(True).alias("_target"))
    learned = learned.hint("broadcast" if learned.count() <= BROADCAST_ROWS else "shuffle_hash")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = Words(), np.zeros((2, 1 << log2), dtype=np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1)):
                numbers = words.of(WORD.findall(text.as_py()))
                found = words.buckets(numbers, log2) if len(numbers) else numbers
                np.add.at(sums[0], found, 1)
                if target.as_py():
                    np.add.at(sums[1], found, 1)
        at = np.flatnonzero(sums[0])
        for part in np.array_split(at, max(1, len(at) >> 16)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, sums[0][part], sums[1][part])], ["bucket", "raw", "target"])

    given = rows.join(learned, F.col("_id") == F.col("_of"), "left").select("_text", F.coalesce("_target", F.lit(False)).alias("_target"))
    counts = given.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(1 << log2), np.zeros(1 << log2)
    for b, r, t in counts.toLocalIterator(prefetchPartitions=True):
        raw[b], target[b] = r, t
    return TextRatio.fit(log2, raw, target)


def score(docs: DataFrame, model: TextRatio, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds the five ``STATISTICS``, ``base_failed`` and ``log_ratio`` to every row, from its whole text.

    Words are runs of anything but spaces, tabs and line ends. The base fails with fewer than 50
    words, or where more than half of the words are repeated. ``log_ratio`` is the mean of the
    text's bucket ratios over its words and pairs: 0 without any. Null text is the empty text.
    Nothing is shuffled; columns of those names are replaced; an empty table stays empty.
    """
    added = (*STATISTICS, "base_failed", "log_ratio")
    own = [c for c in docs.columns if c not in added and (keep_text or c != text_col)]
    text = unused("_text", own)
    given = docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(text))
    log2, trusted, ratios = model.log2, model.trusted, docs.sparkSession.sparkContext.broadcast(model.ratios)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, fitted = Words(), TextRatio(log2, ratios.value, trusted)
        for batch in batches:
            found, scores = [], []
            for t in batch.column(len(own)):
                t = t.as_py()
                split = WORD.findall(t)
                numbers = words.of(split)
                found.append(statistics(t, split, numbers))
                scores.append(fitted.score(words.buckets(numbers, fitted.log2)) if split else 0.0)
            cols = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(STATISTICS))]
            failed = pa.array([f[0] < LEAST_WORDS or 100 * f[4] > MOST_REPEATED * f[0] for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols, failed, pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names[:-1], *added])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]]
    return given.mapInArrow(judge, ", ".join([*fields, *[f"{c} long" for c in STATISTICS], "base_failed boolean", "log_ratio double"]))


def threshold(scored: DataFrame, known: DataFrame, id_col: str = "doc_id") -> float:
    """The log ratio that best parts good from bad among the labelled documents not learned from.

    ``scored`` has the id, ``base_failed`` and ``log_ratio``. Of all cuts with the largest sum of good kept
    and bad dropped (as shares) the middle of the first run of them. Without bad documents it is the
    lowest good one's, without good ones nothing is dropped. Scores are counted in cells of 1/4096.
    """
    held = known.filter("NOT learned")
    cells = (scored.filter("NOT base_failed").join(held, F.col(id_col) == F.col("_of"))
             .groupBy(F.floor(F.col("log_ratio") / F.lit(CELL)).alias("cell"))
             .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("cell").collect())
    good, bad = sum(r["good"] for r in cells), sum(r["bad"] for r in cells)
    if not good:
        return -math.inf
    edges, gains, kept, dropped = [], [], good, 0
    for r in cells:  # a cut at the lower edge of each cell
        edges.append(r["cell"])
        gains.append(kept / good + (dropped / bad if bad else 0.0))
        kept, dropped = kept - r["good"], dropped + r["bad"]
    best = max(gains)
    at = max(i for i, g in enumerate(gains) if g == best) if not bad else gains.index(best)
    below = edges[at - 1] + 1 if at and bad else edges[at]
    return (edges[at] + below) / 2 * CELL


def verdict(scored: DataFrame, limit: float) -> DataFrame:
    """Adds ``kept``: the base holds and the log ratio reaches ``limit``. Every row is judged, alike on each run."""
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= F.lit(limit)))
