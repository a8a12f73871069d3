"""Near duplicates, near vectors, components and mixing against brute force, and the pipeline as a whole."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lendframe.llm import forest, graph, mixing, nearby, queries

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)


def shingles(text, width):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOWER))
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_groups(texts, width, threshold):
    """Component of each id, all pairs that share a shingle compared."""
    sets, met = {i: shingles(t, width) for i, t in texts.items()}, defaultdict(list)
    groups = Sets(texts)
    for i, s in sets.items():
        shared = Counter(j for g in s for j in met[g])
        for j, n in shared.items():
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                groups.join(i, j)
        for g in s:
            met[g].append(i)
    return {i: (len(sets[i]), groups.find(i)) for i in texts}


def edited(rng, words, share):
    return " ".join(rng.choice(("x", "y", "z")) + str(rng.randint(0, 9999)) if rng.random() < share else w for w in words)


def test_near_duplicates_of_the_documents(spark, documents, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    want = brute_groups(texts, 4, 80)
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_odd_sketches"](spark, sf_dir).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_of_odd_rows(table):
    text = "One two\tthree four five six seven"
    given = [(5, text, 1), (3, text.upper(), 1), (3, text.upper(), 1), (None, text, 1), (9, None, 1), (8, "", 1), (7, " \n", 1), (6, "short text", 1), (4, "SHORT  text", 1), (2, "long " * 60_000, 1), (1, "long " * 60_001, 1), (10, "w" * 5_000, 1)]
    out = nearby.near_duplicates(table(given, "doc_id long, text string, place int"))
    rows = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect())
    assert rows == Counter([(5, 3, 3, False), (3, 3, 3, True), (3, 3, 3, False), (None, 3, None, True), (9, 0, 9, True), (8, 0, 8, True), (7, 0, 7, True),
                            (6, 1, 4, False), (4, 1, 4, True), (2, 1, 1, False), (1, 1, 1, True), (10, 1, 10, True)])
    assert nearby.near_duplicates(table([], "doc_id long, text string")).collect() == []


def test_large_clusters_lose_no_link(spark, table, monkeypatch):
    """A chain and a crowd in one cluster, with clusters and buckets cut so small that every path is taken."""
    monkeypatch.setattr(nearby, "CLUSTER_DOCS", 12)
    monkeypatch.setattr(nearby, "HOT_BUCKET", 40)
    monkeypatch.setattr(nearby, "PIVOTS", 3)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    texts = {i: edited(rng, base, rng.choice((0.005, 0.02, 0.03))) for i in range(250)}
    chain = list(base)
    for i in range(250, 330):
        for _ in range(3):
            chain[rng.randrange(300)] = f"c{i}{rng.randint(0, 99)}"
        texts[i] = " ".join(chain)
    want = brute_groups(texts, 5, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearby.near_duplicates(table([*texts.items()], "doc_id long, text string")).collect()}
    assert got == want and len({c for _, c in want.values()}) > 3


@pytest.mark.parametrize("order", ["below", "shuffled"])
def test_large_clusters_lose_no_link_of_small_ids(table, monkeypatch, order):
    """As above, with the chain's ids below the crowd's or all ids dealt anew: outsiders are the smallest of what they reach."""
    monkeypatch.setattr(nearby, "CLUSTER_DOCS", 12)
    monkeypatch.setattr(nearby, "HOT_BUCKET", 40)
    monkeypatch.setattr(nearby, "PIVOTS", 3)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    crowd = [edited(rng, base, rng.choice((0.005, 0.02, 0.03))) for _ in range(250)]
    chain, drift = list(base), []
    for i in range(80):
        for _ in range(3):
            chain[rng.randrange(300)] = f"c{i}{rng.randint(0, 99)}"
        drift.append(" ".join(chain))
    ids = list(range(330))
    every = drift[::-1] + crowd
    if order == "shuffled":
        rng.shuffle(ids)
    texts = dict(zip(ids, every))
    want = brute_groups(texts, 5, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearby.near_duplicates(table([*texts.items()], "doc_id long, text string")).collect()}
    assert got == want


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(3)
    for similarity in (0.7, 0.8, 0.9):
        common = int(2000 * 2 * similarity / (1 + similarity))
        every = rng.integers(0, 1 << 63, size=4000 - common, dtype=np.uint64)
        sets = np.concatenate([np.sort(every[:2000]), np.sort(every[-2000:])])
        _, _, bits, _ = nearby.sketches(sets, np.array([2000, 2000]))
        x = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        estimate = 1 + nearby.BITS / (4 * nearby.SAMPLES) * np.log(1 - 2 * x / nearby.BITS)
        assert abs(estimate - similarity) < 0.15
        assert x <= nearby.farthest(80) or similarity < 0.8


def test_components_of_chains_stars_and_loops(table):
    links = [(i, i + 1) for i in range(100, 160)] + [(i, 7) for i in range(8, 80)] + [(3, 3), (5, 6), (6, 5), (5, 6)]
    got = {r["node"]: r["component"] for r in graph.components(table(links, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 80)} | {5: 5, 6: 5}
    assert got == want
    assert graph.components(table([], "a long, b long")).collect() == []


def brute_vectors(vectors, cosine=0.9):
    ids = list(vectors)
    x = np.array([vectors[i] for i in ids], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    groups, links = Sets(ids), Counter()
    for p, q in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1))):
        groups.join(ids[p], ids[q])
        links.update((ids[p], ids[q]))
    return {i: (links[i], groups.find(i)) for i in ids}


def test_near_vectors_of_crowds(table, monkeypatch):
    monkeypatch.setattr(forest, "LEAF", 40)
    monkeypatch.setattr(forest, "BLOCK", 30)
    monkeypatch.setattr(forest, "ROUTED", 100)
    monkeypatch.setattr(forest, "DEPTH", 3)
    rng = np.random.default_rng(5)
    crowd = rng.normal(size=24)
    vectors = {i: (crowd + rng.normal(size=24) * 0.2).tolist() for i in range(150)}
    vectors |= {200 + i: rng.normal(size=24).tolist() for i in range(500)}
    vectors |= {900 + i: (np.array(vectors[200 + i]) + rng.normal(size=24) * 0.15).tolist() for i in range(60)}
    vectors |= {1000 + i: vectors[205] for i in range(40)}
    want = brute_vectors(vectors)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in forest.near_vectors(table([*vectors.items()], "vec_id long, embedding array<double>")).collect()}
    found, all_ = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert found >= 0.98 * all_ and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_near_vectors_of_the_embeddings(spark, sf_dir):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.QUERIES["op3_projection_forest"](spark, sf_dir).collect()}
    assert got == brute_vectors(vectors)


def test_near_vectors_of_odd_rows(table):
    inf, nan = float("inf"), float("nan")
    given = [(1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [1.0, None], 1), (7, [inf, 1.0], 1), (8, [], 1),
             (9, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (10, [-1.0, 0.0], 1)]
    rows = Counter(tuple(r) for r in forest.near_vectors(table(given, "vec_id long, embedding array<double>, node int")).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)] + [(None, 0, None, True)]
    assert rows == Counter([(1, 3, 0, False), (2, 3, 0, False), (0, 3, 0, True), (0, 3, 0, True), *alone])
    assert forest.near_vectors(table([], "vec_id long, embedding array<float>")).collect() == []


def test_vectors_of_extreme_length_link(table):
    given = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1.0, 1.0]), (4, [1e-200, 1e-200]), (5, [5e-324, 5e-324]), (6, [0.0, 0.0]),
             (7, [1e300, -1e300]), (8, [float("inf"), 1.0]), (9, [1e200, None])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in forest.near_vectors(table(given, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{i: (4, 1) for i in range(1, 6)}, **{i: (0, i) for i in range(6, 10)}}


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_meets_its_targets(spark, documents, sf_dir):
    sizes = {r["doc_id"]: (r["source"], len(re.findall(rb"[^\x20\x09-\x0d]+", (r["text"] or "").encode()))) for r in documents.collect()}
    by = defaultdict(int)
    for s, n in sizes.values():
        by[s] += n
    want, taken = brute_targets(by), defaultdict(int)
    rows = queries.QUERIES["op4_source_mix"](spark, sf_dir).collect()
    for r in rows:
        source, n = sizes[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, by[source]) and r["target"] == pytest.approx(want[source])
        assert r["taken"] % max(n, 1) == 0 and r["taken"] <= 2 * n
        taken[source] += r["taken"]
    assert len(rows) == len(sizes)
    largest = defaultdict(int)
    for s, n in sizes.values():
        largest[s] = max(largest[s], n)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in by)
    again = queries.QUERIES["op4_source_mix"](spark, sf_dir).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_mix_of_odd_rows(table):
    F = mixing.F
    given = [(1, "a b c", "s", 1), (2, None, None, 1), (None, "x y", None, 1), (None, "x y", None, 1), (4, "", "t", 1), (5, "w " * 50_000, "s", 1), (5, "w " * 50_000, "s", 1)]
    docs = table(given, "doc_id long, text string, source string, _block int")
    rows = mixing.planned_mix(docs, mixing.word_count(F.col("text"))).collect()
    assert len(rows) == len(given) and {r["size"] for r in rows} == {3, 0, 2, 50_000}
    assert all(len(r["draws"]) <= 2 for r in rows)
    drawn = mixing.mix(docs, mixing.word_count(F.col("text")))
    assert drawn.columns == ["doc_id", "text", "source", "_block", "shard", "position"] and drawn.count() == sum(len(r["draws"]) for r in rows)
    assert mixing.mix(docs.limit(0), mixing.word_count(F.col("text"))).collect() == []


def test_tree_divides_exactly():
    rng = np.random.default_rng(1)
    quotas, sizes = np.array([5, 0, 1000, 37]), mixing.even(1042, 8)
    split = mixing.split_tree(rng, quotas, sizes)
    assert (split.sum(axis=1) == quotas).all() and (split.sum(axis=0) == sizes).all() and (split >= 0).all()
    big = mixing.draw(rng, np.array([10**9, 3 * 10**9]), 10**9)
    assert big.sum() == 10**9 and abs(big[0] / 10**9 - 0.25) < 0.001


def test_pipeline_against_brute_force(spark, sf_dir):
    """Each stage on what its predecessor kept, held against a plain version of its decision."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, texts, kept = docs.columns, {r["doc_id"]: r for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, sf_dir))
        kept[name] = docs.collect()
        assert name == "encoding" or docs.columns == columns
    ids = {n: {r["doc_id"] for r in rows} for n, rows in kept.items()}
    assert ids["language"] == {i for i, r in texts.items() if any(map(str.isalpha, r["text"] or ""))} and ids["line_dedup"] == ids["language"]
    sites, lines = defaultdict(set), lambda t: [x.strip(" ") for x in (t or "").split("\n")]
    for r in kept["language"]:
        for x in lines(r["text"]):
            sites[x].add(r["source"])
    spread = {x for x, s in sites.items() if x and len(s) >= 5}
    for r in kept["line_dedup"]:
        old = lines(texts[r["doc_id"]]["text"])
        gone = [x for x in old if x in spread]
        copy = sum(map(len, gone)) > 0.5 * sum(map(len, old))
        assert lines(r["text"]) == [x for x in old if copy or x not in spread] and r["n_chars"] == len(r["text"])
    want = brute_groups({r["doc_id"]: r["text"] for r in kept["line_dedup"]}, 5, 80)
    assert ids["near_dedup"] == {i for i, (_, c) in want.items() if c == i}
    draws = Counter(r["doc_id"] for r in kept["mixing"])
    assert set(draws) <= ids["near_dedup"] and max(draws.values()) <= 2
    assert Counter(r["doc_id"] for r in kept["encoding"]) == draws
    final = {r["doc_id"]: r["text"] for r in kept["mixing"]}
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(queries.vocabulary_path())
    assert all(r["ids"] == library.encode(final[r["doc_id"]], add_special_tokens=False).ids for r in kept["encoding"])
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in kept["encoding"])


def test_stages_take_odd_and_empty_tables(spark, table):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id int, cluster string"
    odd = [(1, None, None, None, None, 1, "a"), (None, "plain text of a document", "en", None, 5, 1, "a"), (2, "", "en", "s", 0, 1, None),
           (3, "plain text of a document", "en", "s", 24, 1, "b"), (3, "plain text of a document", "en", "s", 24, 1, "b"), (4, "mot " * 30_000, "fr", "t", 1, None, "c")]
    for rows in (odd, []):
        docs = table(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.cut_lineage(stage(spark, docs, "unused"))
            assert name == "encoding" or docs.schema.fieldNames() == schema.replace(",", "").split()[::2]
        assert bool(rows) == (docs.count() > 0)
