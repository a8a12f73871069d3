"""BPE encoding and decoding by a depth-first walk over the trie of distinct words."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import unused

NEVER = 1 << 40
SLICE_CHARS = 1_000_000
CACHED_WORDS = 300_000
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """A vocabulary with word ends, read from the text of its JSON file."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            left, right = self.ids[a], self.ids[b]
            self.rank[left, right] = r
            self.parts[self.ids[a + b]] = (left, right, r)
        self.longest = max(map(len, self.ids))
        self.letters = byte_letters()
        rule = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words_of = regex.compile(rule.replace(r"\s", r"\p{White_Space}")).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.met: dict[tuple[int, int], bool] = {}
        self.formed: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at the left (0) or right (1) edge while ``token`` is built, each with the rank that consumes it."""
        known = self.edges[side].get(token)
        if known is None:
            known, at, until = [], token, NEVER
            while True:
                known.append((at, until))
                if at not in self.parts:
                    break
                until = self.parts[at][2]
                at = self.parts[at][side]
            known.reverse()
            self.edges[side][token] = known
        return known

    def apart(self, left: int, right: int, until: int = NEVER) -> bool:
        """No merge of a rank below ``until`` joins the two tokens while both are built."""
        a, b, i, j = self.edge(left, 1), self.edge(right, 0), 0, 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            r = self.rank.get((x, y), NEVER)
            if r < until and r < x_until and r <= y_until:
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def reached(self, token: int) -> bool:
        """Encoding the token's own text gives the token."""
        known = self.formed.get(token)
        if known is None:
            known = True
            if token in self.parts:
                left, right, r = self.parts[token]
                known = self.reached(left) and self.reached(right) and self.apart(left, right, r)
            self.formed[token] = known
        return known

    def follows(self, last: int, token: int) -> bool:
        known = self.met.get((last, token))
        if known is None:
            if len(self.met) > 500_000:
                self.met.clear()
            known = self.met[last, token] = self.apart(last, token)
        return known

    def last_token(self, text: str, end: int, last: list[int], suffix: str) -> tuple[int, int]:
        """The last token of the encoding of ``text[:end] + suffix`` and where it starts; ``last[j]`` is that of ``text[:j]``."""
        for start in range(max(0, end - self.longest), end):
            token = self.ids.get(text[start:end] + suffix)
            if token is not None and self.reached(token) and (start == 0 or self.follows(last[start], token)):
                return token, start
        raise ValueError("the vocabulary lacks a byte")

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word, as little-endian 32-bit integers.

        The sorted words are their trie in depth-first order: what a word shares with the one
        before it is the path down to where it branches off, and the states along that path (last
        token and its start) are kept. A state follows from earlier states of the path alone, so
        every shared prefix is encoded once.
        """
        table, out = self.letters, {}
        spelled = sorted((w.encode().decode("latin-1").translate(table), w) for w in words)
        last, begin, before = [-1], [0], ""
        for text, word in spelled:
            shared, most = 0, min(len(text) - 1, len(last) - 1, len(before))
            while shared < most and text[shared] == before[shared]:
                shared += 1
            del last[shared + 1:], begin[shared + 1:]
            for end in range(shared + 1, len(text)):
                token, start = self.last_token(text, end, last, "")
                last.append(token)
                begin.append(start)
            token, start = self.last_token(text, len(text), last, self.end)
            ids = [token]
            while start:
                ids.append(last[start])
                start = begin[start]
            out[word] = np.array(ids[::-1], dtype="<u4").tobytes()
            before = text
        return out

    def words(self, text: str) -> list[str]:
        """Words of one stretch without special tokens: NFC, white space, lower case by character, pattern."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words_of(text.lower())

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a whole text, in order."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.words(text)
        return [w for part in self.split_special(text) for w in ([part] if part in self.special else self.words(part))]

    def decode(self, ids: list[int]) -> str:
        """Tokens side by side with a space between, special ones too; the vocabulary names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


def encoder(source, text_at: int, outputs: list[str], kept: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def slices(texts: pa.Array) -> Iterator[list[str]]:
        part, chars = [], 0
        for t in texts:
            t = t.as_py() or ""
            part.append(t)
            chars += len(t)
            if chars >= SLICE_CHARS:
                yield part
                part, chars = [], 0
        if part:
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = WordBpe(source.value), {}
        for batch in batches:
            at = 0
            for part in slices(batch.column(text_at)):
                if len(known) > CACHED_WORDS:
                    known = {}
                if not known:
                    known |= {t: np.array([i], dtype="<u4").tobytes() for t, i in bpe.special.items()}
                words = [bpe.pieces(t) for t in part]
                known |= bpe.encode_words({w for ws in words for w in ws if w not in known})
                found = [b"".join(map(known.__getitem__, ws)) for ws in words]
                cols = {"n_tokens": pa.array([len(x) // 4 for x in found], pa.int64())}
                if "ids" in outputs:
                    ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
                if "ids_sha256" in outputs:
                    cols["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in found])
                if "decoded" in outputs or "decoded_sha256" in outputs:
                    texts = [bpe.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in found]
                    cols["decoded"] = pa.array(texts, pa.string())
                    cols["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])
                own = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([own.column(i) for i in kept] + [cols[c] for c in outputs],
                                                 names=[own.schema.names[i] for i in kept] + outputs)

    return run


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text",
           outputs: tuple[str, ...] = ("n_tokens", "ids"), keep_text: bool = False) -> DataFrame:
    """Token ids of every whole text, in the columns of ``docs`` (without the text) plus ``outputs``.

    ``vocabulary`` is the path of a tokenizers JSON file with a word-end suffix; the driver reads it
    and hands its text to the tasks (a vocabulary's size does not depend on the documents). A task
    walks the trie of the words it has not met yet, slice by slice; words met are kept up to a fixed
    number. Nothing is shuffled. ``outputs`` are any of ``OUTPUTS``: ``decoded`` is the text that the
    ids decode to, the digests are those of the ids' bytes and of the decoded text.

    Null and empty texts have no tokens. Repeated rows are encoded each; an empty table stays
    empty; columns of ``docs`` named like an output are replaced.
    """
    with open(vocabulary, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    own = [c for c in docs.columns if c not in outputs and (keep_text or c != text_col)]
    given = docs.select(*[F.col(c) for c in own], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(unused("_text", own)))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]]
    schema = ", ".join(fields + [f"{c} {OUTPUTS[c]}" for c in outputs])
    return given.mapInArrow(encoder(source, len(own), list(outputs), list(range(len(own)))), schema)
