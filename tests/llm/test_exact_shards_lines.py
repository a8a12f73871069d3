"""Exact deduplication, sharding and line deduplication on small tables."""

from collections import Counter

from lendframe.llm import exact, lines, shards

DOCS = "doc_id long, text string, source string, _digest string, hash int, _id long, site string"


def rows(*triples):
    return [(i, t, s, "x", 1, 2, "y") for i, t, s in triples]


def test_exact_keeps_one_of_each_group(table):
    given = rows((1, "a", "s"), (5, "a", None), (None, "a", "s"), (2, "b", "s"), (7, None, "s"), (8, "", "s"), (9, "c" * 200_000, "s"),
                 (4, "b", "s"), (4, "b", "s"), (None, "z", "s"))
    out = exact.exact_duplicates(table(given, DOCS)).collect()
    assert len(out) == len(given)
    by = Counter((r["_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out)
    assert by == Counter([(1, 5, 3, False), (5, 5, 3, True), (None, 5, 3, False), (2, 4, 3, False), (4, 4, 3, True), (4, 4, 3, False),
                          (7, 8, 2, False), (8, 8, 2, True), (9, 9, 1, True), (None, None, 1, True)])
    small = {(r["_id"], r["keep_id"]) for r in exact.exact_duplicates(table(given, DOCS), keep="min").collect()}
    assert {(5, 1), (None, 1), (8, 7), (4, 2), (None, None)} <= small


def test_exact_over_many_runs(spark):
    docs = spark.range(0, 4000, 1, 70).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 500 AS string) END AS text")
    out = {r["_id"]: r for r in exact.exact_duplicates(docs, fan_in=4).collect()}
    texts = {i: "hot" if i % 3 == 0 else str(i % 500) for i in range(4000)}
    last, size = {}, Counter(texts.values())
    for i, t in texts.items():
        last[t] = i
    assert all((out[i]["keep_id"], out[i]["group_size"], out[i]["kept"]) == (last[t], size[t], last[t] == i) for i, t in texts.items())


def test_exact_and_shards_of_nothing(table):
    empty = table([], DOCS)
    assert exact.exact_duplicates(empty).collect() == []
    assert shards.shuffled_shards(empty).collect() == []
    assert lines.without_boilerplate(empty).collect() == []


def test_shards_differ_by_one_and_lose_nothing(spark, table):
    for n in (1, 7, 8, 1003):
        docs = spark.range(n).selectExpr("id % 5 AS doc_id", "CAST(NULL AS string) AS text", "7 AS shard", "id AS _place")
        out = shards.shuffled_shards(docs, seed=3).collect()
        assert sorted(r["_place"] for r in out) == list(range(n))
        counts = Counter(r["shard"] for r in out)
        assert set(counts) <= set(range(8)) and max(counts.values()) - min(counts[k] for k in range(8)) <= 1
        for k, c in counts.items():
            assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(c))
    order = [r["_place"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    assert order != sorted(order)
    again = shards.shuffled_shards(docs, seed=3).collect()
    assert {r["_place"]: (r["shard"], r["slot"]) for r in again} == {r["_place"]: (r["shard"], r["slot"]) for r in out}


def test_shards_are_written_with_their_records(spark, documents, tmp_path):
    docs = documents.selectExpr("doc_id", "text", "length(text) AS size")
    shards.write_shards(docs, str(tmp_path / "out"), bytes_col="size")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == sorted((r["doc_id"], r["text"]) for r in docs.collect())


def test_shards_count_the_bytes_of_texts(spark, monkeypatch):
    """The bucket count follows texts, binaries and nested columns when no size is named."""
    found, cut = [], shards.cut_lineage
    monkeypatch.setattr(shards, "cut_lineage", lambda df: found.append(cut(df)) or found[-1])
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('x', 1000) AS text", "CAST(repeat('y', 500) AS binary) AS raw",
                                      "array(repeat('z', 300)) AS parts", "CAST(NULL AS string) AS none")
    out = shards.shuffled_shards(docs, bucket_bytes=500)
    assert {r["_bytes"] // 100 for r in found[0].collect()} == {18}
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "pmod(xxhash64" in plan and f", cast({-(-sum(r['_bytes'] for r in found[0].collect()) // 500)} as bigint)" in plan
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(40))


def test_shards_query_carries_the_texts(spark, sf_dir, monkeypatch):
    import zlib

    from lendframe.llm import queries

    given, shuffled = [], shards.shuffled_shards
    monkeypatch.setattr(shards, "shuffled_shards", lambda df, *a, **k: given.append((df.columns, k)) or shuffled(df, *a, **k))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_shuffled_shards"](spark, sf_dir).collect()
    assert given == [(["doc_id", "size", "text"], {"bytes_col": "size"})]
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}


def test_lines_on_many_sites_go_and_copies_stay(table):
    given = [(i, f"own line {i} of some length\n  Cookie notice \n\nmore words of document {i}", f"s{i % 6}") for i in range(12)]
    given += [(100 + i, "a story that is copied\nto every site there is", f"s{i}") for i in range(5)]
    given += [(200, None, None), (201, "", "s1"), (202, "Cookie notice", None), (203, "one site\n" * 3000, "s1"), (4, "own line 4 of some length", "s9")]
    out = lines.without_boilerplate(table(rows(*given), DOCS))
    assert out.columns == [*DOCS.replace(",", "").split()[::2], "n_lines", "n_spread", "n_removed", "is_copy"]
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert by[3][0]["text"] == "own line 3 of some length\n\nmore words of document 3" and by[3][0]["n_removed"] == 1
    assert by[101][0]["is_copy"] and by[101][0]["text"] == "a story that is copied\nto every site there is" and by[101][0]["n_spread"] == 2
    assert by[200][0]["text"] is None and by[200][0]["n_lines"] == 0 and by[201][0]["text"] == ""
    assert by[202][0]["is_copy"] and by[202][0]["text"] == "Cookie notice"
    assert by[203][0]["n_removed"] == 0 and by[203][0]["n_lines"] == 3000
    assert len(by[4]) == 2 and sum(len(v) for v in by.values()) == len(given)


def test_spread_is_exact_near_the_limit(spark):
    pairs = spark.range(400).selectExpr("CAST(CAST(id % 40 AS string) AS binary) AS hash", "CAST(id % 40 + 1 AS int) AS n", "id")
    sites = pairs.selectExpr("hash", "explode(sequence(1, n)) AS k").selectExpr("hash", "CAST(k AS string) AS site")
    found = {bytes(r["hash"]) for r in lines.spread_lines(sites, min_sites=20).collect()}
    assert found == {str(i).encode() for i in range(40) if i + 1 >= 20}
