"""Language identification by error-correcting output codes over letter n-grams."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 13
MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)
SMOOTHING = 0.5
UNKNOWN = "und"
AMBIGUOUS = 0.5


class Grams:
    """Counts of hashed 1- to 3-grams of a whole text: letters in lower case, anything else one gap."""

    def __init__(self) -> None:
        self.letter = np.array([chr(c).isalpha() for c in range(0x30000)])

    def counts(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        points = np.where(points < len(self.letter), points, 0)
        points = np.where(self.letter[points], points, 0)
        padded = np.concatenate(([np.uint32(0)], points, [np.uint32(0)]))
        padded = padded[np.concatenate(([True], (padded[1:] | padded[:-1]) != 0))]
        total = np.zeros(FEATURES, dtype=np.int64)
        for n in (1, 2, 3):
            if len(padded) < n:
                break
            h = np.full(len(padded) - n + 1, np.uint32(n), dtype=np.uint32)
            for k in range(n):
                h = (h + padded[k:len(padded) - n + 1 + k]) * MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
            total += np.bincount(h >> np.uint32(32 - 13), minlength=FEATURES)
        return total


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """One row of -1 and 1 per language, no two columns the same split.

    Up to five languages every split is a bit. Above, of 200 random codes of ``15 log2 k`` bits
    that with the largest least distance between two codewords.
    """
    if k < 2:
        return np.ones((k, 0), dtype=np.int8)
    if k <= 5:
        splits = [[1, *bits] for bits in itertools.product((-1, 1), repeat=k - 1) if -1 in bits]
        return np.array(splits, dtype=np.int8).T
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = math.ceil(15 * math.log2(k))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(k, bits))
        if (np.abs(code.sum(axis=0)) == k).any():
            continue
        gram = code.astype(int) @ code.T.astype(int)
        least = (bits - (gram - np.eye(k, dtype=int) * 4 * bits).max()) // 2
        if least > far:
            best, far = code, least
    return best if best is not None else np.where(np.eye(k) > 0, 1, -1).astype(np.int8)


@dataclass
class LanguageCode:
    """Languages, their codewords, a linear n-gram classifier for each bit and the weight of its loss."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    @classmethod
    def fit(cls, counts: dict[str, np.ndarray]) -> LanguageCode:
        """From n-gram counts per language. Every language counts the same, however much text it has.

        A bit's classifier is the log ratio of the n-gram shares of the languages on its two
        sides; its loss weighs as the two sides differ (symmetric divergence), 1 on average.
        """
        languages = sorted(counts)
        code = codewords(len(languages))
        shares = np.array([(c + SMOOTHING) / (c.sum() + SMOOTHING * FEATURES) for c in map(counts.get, languages)])
        if code.shape[1] == 0:
            return cls(languages, code, np.zeros((FEATURES, 0)), np.ones(0))
        up = np.array([shares[code[:, b] > 0].mean(axis=0) for b in range(code.shape[1])])
        down = np.array([shares[code[:, b] < 0].mean(axis=0) for b in range(code.shape[1])])
        ratio = np.log(up) - np.log(down)
        apart = ((up - down) * ratio).sum(axis=1)
        return cls(languages, code, ratio.T.copy(), apart / apart.mean())

    def decide(self, counts: np.ndarray) -> tuple[str, float]:
        """Language whose codeword has the least weighted loss, and its share among all (0 to 1)."""
        if not self.languages:
            return UNKNOWN, 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        n = counts.sum()
        margins = counts @ self.weights / math.sqrt(max(n, 1))
        loss = (np.logaddexp(0.0, -self.code * margins) * self.trust).sum(axis=1)
        share = np.exp(loss.min() - loss)
        best = int(loss.argmin())
        return self.languages[best], float(share[best] / share.sum())


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageCode:
    """Fit on every row with a text and a label. Tasks add up counts per language and n-gram; the
    driver gets one row for each of those, a number that depends on the languages only."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, sums = Grams(), {}
        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"]):
                c = grams.counts(text)
                sums[lang] = sums[lang] + c if lang in sums else c
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "feature": at, "n": c[at]})

    rows = (labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
            .filter("text IS NOT NULL AND lang IS NOT NULL")
            .mapInPandas(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")))
    counts: dict[str, np.ndarray] = {}
    for lang, feature, n in rows.collect():
        counts.setdefault(lang, np.zeros(FEATURES))[feature] = n
    return LanguageCode.fit(counts)


def identify(docs: DataFrame, model: LanguageCode, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``ambiguous`` to every row, from its whole text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is any text where nothing was
    learned. ``ambiguous`` marks a decision whose codeword has less than half of the share. Repeated
    rows get the same answer; an empty table stays empty; columns of those names are replaced.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    given = docs.select(*own)
    at = [i for i, c in enumerate(own) if c == text_col][0]

    def predict(frames):
        import pyarrow as pa

        grams = Grams()
        for batch in frames:
            answers = []
            for text in batch.column(at):
                t = text.as_py()
                known = t is not None and any(map(str.isalpha, t))
                answers.append(model.decide(grams.counts(t)) if known else (UNKNOWN, 0.0))
            cols = [pa.array([a for a, _ in answers], pa.string()), pa.array([s for _, s in answers], pa.float64()),
                    pa.array([s < AMBIGUOUS for _, s in answers], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields]
    return given.mapInArrow(predict, ", ".join([*fields, "lang_pred string", "score double", "ambiguous boolean"]))


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learn_documents(docs: DataFrame) -> LanguageCode:
    return learn(docs.filter(~held_out()).select("text", "lang"))
