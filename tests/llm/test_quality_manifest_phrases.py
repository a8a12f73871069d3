"""Quality rules, Merkle manifest and phrase mining against plain recomputations."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lendframe.llm import manifest, phrases, queries, ratio

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# ---- quality rules -----------------------------------------------------------------------

def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i:i + 3])].append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again))


def grams(text, log2):
    """Buckets in plain integers."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    mask = (1 << 64) - 1
    odd, other = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    h = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    pairs = [((a * odd + b) * other) & mask for a, b in zip(h, h[1:])]
    return [((x * odd) & mask) >> (64 - log2) for x in h + [p ^ (p >> 29) for p in pairs]]


def test_statistics_of_odd_texts(table):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "a b a b a b a b", "x " * 60, "é€𝄞 #$ <b>\nx\n\nx \nx\n  \n  \ny\r\nz\r\nz\r",
             *[" ".join(rng.choice("abcde") for _ in range(n)) + "\n" * (n % 3) for n in (3, 4, 49, 50, 51, 200)], "word " * 200_000, " a b c"]
    given = [(i, t, 5, True) for i, t in enumerate(texts)] + [(None, "x", 1, None), (1, "", 5, False)]
    model = ratio.TextRatio.fit(12, np.zeros(4096), np.zeros(4096))
    out = ratio.score(table(given, "doc_id long, text string, n_words int, base_failed boolean"), model)
    assert out.columns == ["doc_id", "text", *ratio.STATISTICS, "base_failed", "log_ratio"]
    rows = out.collect()
    assert len(rows) == len(given) and all(r["log_ratio"] == 0 for r in rows)
    for r in rows:
        want = base(r["text"])
        assert tuple(r[c] for c in ratio.STATISTICS) == want, r["text"]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert ratio.score(table([], "doc_id long, text string"), model).collect() == []


def test_ratio_against_plain_counts(table, spark):
    rng = random.Random(5)
    good, bad = [f"w{i}" for i in range(300)], [f"j{i}$" for i in range(300)]
    docs = [(i, None if i == 7 else " ".join(rng.choice(bad if i % 5 == 0 else good) for _ in range(rng.randrange(50, 120)))) for i in range(200)]
    labels = [(i, int(i % 5 > 0), int(i % 11 == 0)) for i in range(150)] + [(3, 0, 0), (None, 1, 0), (99999, 1, 0)]
    frame, known = table(docs, "doc_id long, text string"), ratio.labelled(table(labels, "doc_id long, quality int, toxic int"))
    trusted = {r["_of"] for r in known.filter("good AND learned").collect()}
    assert trusted == {i for i in range(150) if i % 5 and i % 11 and i != 3 and zlib.crc32(str(i).encode()) % 3 != 1} | ({99999} if zlib.crc32(b"99999") % 3 != 1 else set())
    model = ratio.learn(frame, known)
    raw, target = np.zeros(1 << model.log2), np.zeros(1 << model.log2)
    for i, t in docs:
        for b in grams(t or "", model.log2):
            raw[b] += 1
            target[b] += i in trusted
    want = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    assert np.allclose(model.ratios, want, atol=1e-5)
    scored = ratio.score(frame, model, keep_text=False)
    assert scored.columns == ["doc_id", *ratio.STATISTICS, "base_failed", "log_ratio"]
    for r in scored.collect():
        b = grams(dict(docs)[r["doc_id"]] or "", model.log2)
        assert r["log_ratio"] == pytest.approx(np.mean(want[b]) if b else 0.0, abs=1e-5)
    limit = ratio.threshold(scored, known)
    judged = {r["doc_id"]: r["kept"] for r in ratio.verdict(scored, limit).collect()}
    assert all(judged[i] == (i % 5 > 0 and i != 7) for i in range(200))
    # no label of one kind, or of none
    only_good = ratio.labelled(table([x for x in labels if x[1]], "doc_id long, quality int, toxic int"))
    assert ratio.verdict(scored, ratio.threshold(scored, only_good)).join(only_good.filter("NOT learned"), F.col("doc_id") == F.col("_of")).filter(
        "NOT kept AND NOT base_failed").count() == 0
    nobody = ratio.labelled(spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    blind = ratio.learn(frame, nobody)
    assert not blind.trusted and ratio.threshold(ratio.score(frame, blind), nobody) == -math.inf


def test_every_label_counts(spark, table, monkeypatch):
    labels = spark.range(210_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "0 AS toxic")
    known = ratio.labelled(labels)
    assert {r["good"]: r["count"] for r in known.groupBy("good").count().collect()} == {True: 105_000, False: 105_000}
    docs = table([(i, f"good{i % 7} text" if i % 2 else f"bad{i % 5}") for i in [*range(60), 3, 3]] + [(None, "x y")], "doc_id long, text string")
    one = ratio.learn(docs, known)
    monkeypatch.setattr(ratio, "BROADCAST_ROWS", 0)  # by a shuffle: the same counts
    assert one.trusted and np.array_equal(ratio.learn(docs, known).ratios, one.ratios)


def test_buckets_grow_with_the_corpus():
    assert ratio.bucket_bits(0) == 12 and ratio.bucket_bits(10**9) == 16 and ratio.bucket_bits(10**14) == 24


def test_good_documents_are_kept_and_bad_ones_go(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.QUERIES["op11_log_ratio"](spark, sf).join(labels, "doc_id").filter("NOT base_failed AND crc32(cast(doc_id AS string)) % 3 = 1")
    r = out.agg(F.avg(F.when(F.expr("quality = 1 AND toxic = 0"), F.col("kept").cast("int"))).alias("good"),
                F.avg(F.when(F.col("quality") == 0, 1 - F.col("kept").cast("int"))).alias("bad")).first()
    assert r["good"] >= 0.97 and r["bad"] >= 0.8


# ---- Merkle manifest ------------------------------------------------------------------------

def plain_tree(leaves):
    """Root and, per leaf, the siblings level by level."""
    proofs, level, above = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        up, up_above = [], []
        for s in range(0, len(level), 8):
            run = level[s:s + 8]
            for k in range(len(run)):
                for leaf in above[s + k]:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(sha("".join(run)))
            up_above.append([x for a in above[s:s + 8] for x in a])
        level, above = up, up_above
    return level[0], proofs


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_against_a_plain_tree(table, levels):
    sizes = {None: 3, "": 1, "a": 75, "b": 8, "é": 9, "z": 64, **{f"k{i:02}": 1 + i % 3 for i in range(12)}}
    rows = [(i, lang, sha(f"{lang}{i}"), "kept", "x") for lang, n in sizes.items() for i in range(n)]
    rows += [(None, "a", sha("none"), "kept", "x"), (5, "a", sha("twice"), "kept", "x"), (5, "a", sha("twice"), "kept", "x"), (6, "b", None, "kept", "x")]
    out = manifest.manifest(table(rows, "doc_id long, lang string, leaf string, tree string, root string"), levels=levels)
    assert out.columns == ["doc_id", "lang", "leaf", "tree", "subroot", "root", "lefts", "rights"]
    got = out.collect()
    assert len(got) == len(rows) and {r["tree"] for r in got} == {"kept"}
    order = sorted(sizes, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {lang: sorted(((r[0] is not None, r[0] or 0, r[2] or "-") for r in rows if r[1] == lang)) for lang in order}
    trees = {lang: plain_tree([x[2] for x in leaves[lang]]) for lang in order}
    root, above = plain_tree([trees[x][0] for x in order])
    want = collections.Counter((lang, x[2], trees[lang][0], root, tuple(p + above[i])) for i, lang in enumerate(order) for x, p in zip(leaves[lang], trees[lang][1]))
    have = collections.Counter((r["lang"], r["leaf"] or "-", r["subroot"], r["root"], tuple(zip(r["lefts"], r["rights"]))) for r in got)
    assert have == want
    folds = out.select((manifest.folded(F.coalesce("leaf", F.lit("-"))) == F.col("root")).alias("ok"), manifest.proof_digest().alias("p"), "lefts", "rights").collect()
    assert all(r["ok"] and r["p"] == sha("".join(a + b for a, b in zip(r["lefts"], r["rights"]))) for r in folds)


def test_manifest_of_little(table):
    empty = manifest.manifest(table([], "doc_id long, lang string, leaf string"))
    assert empty.columns == ["doc_id", "lang", "leaf", "subroot", "root", "lefts", "rights"] and empty.collect() == []
    one = manifest.manifest(table([(1, None, "ab")], "doc_id long, lang string, leaf string")).first()
    assert one["subroot"] == one["root"] == "ab" and one["lefts"] == []


def test_leaf_digest(table):
    d = table([(12, None, "né\n")], "doc_id long, lang string, text string")
    got = d.select(manifest.leaf_digest([F.col(c) for c in d.columns]).alias("h")).first()["h"]
    assert got == sha("2:12" + "-" + "4:né\n")


def test_queue_is_ordered_and_small():
    block = manifest.Block("t", 512, 0, 3)
    for i in range(512):
        block.take(i, sha(str(i)), keep=True)
        assert len(block.queue) <= 3 * 7
    labels = [(last, level) for last, level, _, _ in block.runs]
    assert labels == sorted(labels) and len(labels) == 64 + 8 + 1


# ---- phrases ---------------------------------------------------------------------------------

def plain_counts(docs, least, longest):
    counts, total = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in range(1, longest + 1):
                counts.update((lang, k, " ".join(ws[i:i + k])) for i in range(len(ws) - k + 1))
    return {x: n for x, n in counts.items() if n >= least}, {x: n for x, n in total.items() if n}


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["É", "Ab", "é", " x"]
    line = lambda: " ".join(rng.choices(words, weights=[40 / (i + 1) for i in range(len(words))], k=rng.randrange(0, 40)))
    docs = [(rng.choice(["en", "en", "fr", None]), rng.choice([".", ", ", "\n", "\t", "; "]).join(line() for _ in range(rng.randrange(1, 6)))) for _ in range(n)]
    return docs + [("en", None), ("fr", ""), (None, None), ("de", "?!"), *[("en", "San Jose Costa Rica Now! san jose costa rica now.")] * 30]


@pytest.mark.parametrize("least, longest, shards, bits", [(10, 5, 4, 16), (3, 4, 3, 16), (1, 3, 2, 16), (10, 5, 4, 7), (25, 5, 1, 16), (4, 1, 2, 16)])
def test_counts_against_plain_counts(table, monkeypatch, least, longest, shards, bits):
    """Seven bits make most phrases meet in their slots, which may not change a count."""
    docs = corpus(least)
    monkeypatch.setattr(phrases, "slot_bits", lambda size: bits)
    monkeypatch.setattr(phrases, "SLICE_CHARS", 2_000)
    frame = table(docs, "lang string, text string").withColumn("n", F.lit("x")).withColumn("shard", F.lit(1))
    got = phrases.frequent_phrases(frame, min_count=least, longest=longest, shards=shards).collect()
    want, total = plain_counts(docs, least, longest)
    assert {(r["lang"], r["k"], r["phrase"]): r["n"] for r in got if r["k"] > 0} == want
    assert {r["lang"]: r["n"] for r in got if r["k"] == 0 and r["n"]} == total
    assert len(got) == len({(r["lang"], r["k"], r["phrase"]) for r in got})


def test_collocations_against_plain_scores(table):
    docs = corpus(2)
    want, total = plain_counts(docs, 5, 5)
    cand = {x: a for x, a in want.items() if x[1] > 1}

    def inside(short, long):
        s, w = short.split(" "), long.split(" ")
        return len(w) > len(s) and any(w[i:i + len(s)] == s for i in range(len(w)))

    rows = []
    for (lang, k, phrase), a in cand.items():
        if any(x[0] == lang and inside(phrase, x[2]) and b >= a for x, b in cand.items()):
            continue
        ws, cuts = phrase.split(" "), []
        for j in range(1, k):
            left, right = want[lang, j, " ".join(ws[:j])], want[lang, k - j, " ".join(ws[j:])]
            cuts.append((1000 * a * total[lang] // (left * right), j, left, right))
        score, _, left, right = min(cuts)
        rows.append((lang, phrase, a, left, right, total[lang], score))
    best = []
    for lang in total:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:7]
        best += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    counts = phrases.frequent_phrases(table(docs, "lang string, text string"), min_count=5)
    got = phrases.collocations(counts, top=7)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(best)
    assert any(r[2] == "san jose costa rica now" for r in best)


def test_scores_beyond_64_bits(table):
    a, l, r, n = 3 * 10**14 + 7, 4 * 10**14 + 1, 5 * 10**14 + 3, 9 * 10**15 + 1
    counts = table([("x", 0, "", n), ("x", 1, "p", l), ("x", 1, "q", r), ("x", 2, "p q", a)], "lang string, k int, phrase string, n long")
    assert phrases.collocations(counts).first()["score"] == 1000 * a * n // (l * r)


def test_nothing_to_mine(table):
    counts = phrases.frequent_phrases(table([], "lang string, text string"))
    assert counts.collect() == [] and phrases.collocations(counts).collect() == []
