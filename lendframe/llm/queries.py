"""One query per operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import chat, encode, exact, forest, html, language, lines, manifest, mixing, nearby, phrases, ratio, shards

VOCABULARY = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL["op2_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""


@query
def op6_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), "text")
    return shards.shuffled_shards(docs, bytes_col="size").select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_spread", "n_removed", "is_copy", F.length("text").cast("long").alias("n_chars"),
                      F.sha2("text", 256).alias("text_sha256"))


SQL["op10_line_spread"] = f"""
WITH cut AS (SELECT doc_id, text, coalesce('s' || source, '-') AS site, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
pos AS (SELECT doc_id, site, unnest(parts) AS line, unnest(range(len(parts))) AS nr FROM cut),
spread AS (SELECT trim(line, ' ') AS line FROM pos WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {lines.MIN_SITES}),
per AS (SELECT p.doc_id, count(*) FILTER (trim(p.line, ' ') <> '') AS n_lines, count(s.line) AS n_spread,
          coalesce(sum(length(s.line)), 0) > {lines.COPY_SHARE} * sum(length(trim(p.line, ' '))) AS is_copy,
          coalesce(string_agg(p.line, chr(10) ORDER BY nr) FILTER (s.line IS NULL), '') AS rest
        FROM pos p LEFT JOIN spread s ON trim(p.line, ' ') = s.line GROUP BY p.doc_id),
fin AS (SELECT d.doc_id, n_lines, n_spread, is_copy, CASE WHEN is_copy OR n_spread = 0 THEN text ELSE rest END AS text
        FROM documents d JOIN per USING (doc_id))
SELECT doc_id, n_lines, n_spread, CASE WHEN is_copy THEN 0 ELSE n_spread END AS n_removed, is_copy,
       length(text) AS n_chars, sha256(text) AS text_sha256 FROM fin"""


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op9_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode.encode(docs, vocabulary_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op5_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn_documents(docs)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.preference_examples(chat.swapped_reply_pairs(table(spark, sf_dir, "conversations")))
    plain = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["length"])), ",")
    return out.select("conv_id", "n_prompt", "prompt", "chosen", "rejected", plain(F.col("chosen_spans")).alias("chosen_spans"),
                      plain(F.col("rejected_spans")).alias("rejected_spans"), "usable")


SQL["op8_preferences"] = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nr
           FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(nr) AS last FROM t WHERE role = 'assistant' GROUP BY 1),
r AS (SELECT conv_id, last, text AS reply, conv_id // 64 AS block FROM t JOIN l USING (conv_id) WHERE nr = last),
p AS (SELECT conv_id, last, reply, coalesce(lead(reply) OVER w, first_value(reply) OVER w) AS other,
        count(*) OVER (PARTITION BY block) AS n FROM r WINDOW w AS (PARTITION BY block ORDER BY conv_id)),
s AS (SELECT p.conv_id, nr, last, role, reply, other, reply = other AS same,
        '<|im_start|>' || replace(role, '<|im_', '< |im_') || chr(10) || replace(text, '<|im_', '< |im_') || '<|im_end|>' || chr(10) AS shown
      FROM p JOIN t USING (conv_id) WHERE nr <= last AND n > 1),
q AS (SELECT conv_id, any_value(same) AS same, CASE WHEN any_value(same) THEN count(*) ELSE count(*) - 1 END AS n_prompt,
        coalesce(string_agg(shown, '' ORDER BY nr) FILTER (same OR nr < last), '') AS prompt,
        replace(any_value(reply), '<|im_', '< |im_') AS c, replace(any_value(other), '<|im_', '< |im_') AS r
      FROM s GROUP BY conv_id)
SELECT conv_id, n_prompt, prompt,
  CASE WHEN same THEN '' ELSE '<|im_start|>assistant' || chr(10) || c || '<|im_end|>' || chr(10) END AS chosen,
  CASE WHEN same THEN '' ELSE '<|im_start|>assistant' || chr(10) || r || '<|im_end|>' || chr(10) END AS rejected,
  CASE WHEN same THEN '' ELSE '22:' || (length(c) + 10) END AS chosen_spans,
  CASE WHEN same THEN '' ELSE '22:' || (length(r) + 10) END AS rejected_spans, NOT same AND c <> r AS usable FROM q"""


@query
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    out = mixing.planned_mix(docs, F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"),
                      F.array_join(F.transform("draws", lambda d: d["shard"]), ",").alias("shards"))


@query
def op1_block_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")


@query
def op7_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearby.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)


@query
def op3_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op11_log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = cut_lineage(ratio.labelled(table(spark, sf_dir, "labels")))
    # One narrow row per document, so that the texts are read once for counts and once for scores.
    scored = cut_lineage(ratio.score(docs, ratio.learn(docs, known), keep_text=False))
    return ratio.verdict(scored, ratio.threshold(scored, known))


@query
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, columns = table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.translate("text", manifest.UPPER, manifest.LOWER)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    leaf = lambda text: manifest.leaf_digest([*map(F.col, columns[:-1]), text])
    leaves = docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), F.when(hit, leaf(tampered)).alias("shown"))
    out = manifest.manifest(leaves).withColumn("folded_root", manifest.folded(F.coalesce("shown", "leaf")))
    return out.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest().alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def _manifest_sql(levels: int = 8) -> str:
    """The tree level by level, for up to 8^levels documents and as many languages: a run's digests as one text
    per level (``k``), then every leaf's siblings and fold beside it."""
    crc = ("list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT), lambda c, b: "
           "list_reduce([xor(c, b)] || range(8)::UBIGINT[], lambda r, i: xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)))")
    code = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(code, ["doc_id", "source", "lang", "n_chars"])) + f" || {code(text)})"
    out = [f"""d AS (SELECT *, {leaf('text')} AS leaf, {leaf(f"translate(text, '{manifest.UPPER}', '{manifest.LOWER}')")} AS low,
  coalesce(xor({crc}, 4294967295::UBIGINT) % 3 = 0, false) AS hit FROM documents),
l AS (SELECT doc_id, lang, leaf, CASE WHEN hit THEN low ELSE leaf END AS shown,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
a0 AS (SELECT lang, pos, leaf AS h FROM l)"""]

    def climb(name: str, key: str, of: str) -> None:
        for k in range(levels):
            out.append(f"""{name}{k + 1} AS (SELECT {key}, pos // 8 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {name}{k}) GROUP BY 1, pos // 8)""")
            out.append(f"""{name}s{k} AS (SELECT {key}, pos, CASE WHEN count(*) OVER (PARTITION BY {key}) = 1 THEN '' ELSE coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS lft,
  CASE WHEN count(*) OVER (PARTITION BY {key}) = 1 THEN '' ELSE coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS rgt,
  count(*) OVER (PARTITION BY {key}) > 1 AS more FROM {name}{k} WINDOW r AS (PARTITION BY {key}, pos // 8 ORDER BY pos))""")
        out.append(f"{of} AS (SELECT {key}, h FROM {name}{levels})")

    climb("a", "lang", "sub")
    out.append("b0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, h, lang FROM sub)")
    climb("b", "one", "top")
    out.append("f0 AS (SELECT l.*, b0.pos AS at, shown AS f, '' AS p FROM l JOIN b0 ON l.lang IS NOT DISTINCT FROM b0.lang)")
    at = 0
    for name, key, pos in (("a", "f.lang IS NOT DISTINCT FROM s.lang", "f.pos"), ("b", "true", "f.at")):
        for k in range(levels):
            out.append(f"""f{at + 1} AS (SELECT f.* REPLACE (CASE WHEN more THEN sha256(lft || f || rgt) ELSE f END AS f, p || lft || rgt AS p)
  FROM f{at} f JOIN {name}s{k} s ON {key} AND {pos} // {8 ** k} = s.pos)""")
            at += 1
    return "WITH " + ",\n".join(out) + f"""
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = top.h AS verified
FROM f{at} f JOIN sub ON f.lang IS NOT DISTINCT FROM sub.lang, top"""


SQL["op12_manifest"] = _manifest_sql()


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(phrases.frequent_phrases(table(spark, sf_dir, "documents").select("lang", "text")))


def _collocations_sql() -> str:
    upto = range(1, phrases.LONGEST + 1)
    word = lambda k: "w" if k == 1 else f"lead(w, {k - 1}) OVER o"
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, {' || chr(32) || '.join(f'w{j}' for j in range(1, k + 1))} AS phrase FROM g WHERE w{k} IS NOT NULL" for k in upto)
    return f"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(parts) AS piece, unnest(range(len(parts))) AS piece_nr FROM (
  SELECT doc_id, lang, regexp_split_to_array(translate(text, '{manifest.UPPER}', '{manifest.LOWER}'), '[.,;:!?\x0A-\x0D]') AS parts FROM documents)),
w AS (SELECT doc_id, lang, piece_nr, unnest(ws) AS w, unnest(range(len(ws))) AS nr FROM (SELECT *, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
g AS (SELECT lang, {', '.join(f'{word(k)} AS w{k}' for k in upto)} FROM w WINDOW o AS (PARTITION BY doc_id, lang, piece_nr ORDER BY nr)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM ({grams}) GROUP BY ALL HAVING count(*) >= {phrases.MIN_COUNT}),
t AS (SELECT lang, count(*) AS n FROM w GROUP BY 1),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
inner_parts AS (SELECT DISTINCT c.lang, array_to_string(c.ws[i:i + m - 1], ' ') AS phrase, a AS more
  FROM c, range(2, 5) AS ms(m), range(1, 5) AS xs(i) WHERE m < k AND i + m - 1 <= k),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.more >= 100 * c.a)),
cut AS (SELECT lang, phrase, a, j, array_to_string(ws[:j], ' ') AS lp, array_to_string(ws[j + 1:], ' ') AS rp FROM kept, range(1, 5) AS js(j) WHERE j < k),
s AS (SELECT cut.lang, cut.phrase, a, l.n AS l, r.n AS r, t.n AS n, j, ((1000::HUGEINT * a * t.n) // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = lp JOIN f r ON r.lang = cut.lang AND r.phrase = rp JOIN t ON t.lang = cut.lang),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM low QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {phrases.TOP}"""


SQL["op13_collocations"] = _collocations_sql()
