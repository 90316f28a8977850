"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import ann, bpe, embedding_dups, exact_topk, language_id, lexical, line_dedup, lm, mixing, sharding, simhash, spelling, url_filter
from weftgraph.llm.common import fold_of, vocabulary_file
from weftgraph.session import table

#: Where the vocabulary files lie; a parameter, never copied into the repository.
TOKENIZER = vocabulary_file("byte_bpe_50k.json")
PIECES = vocabulary_file("byte_bpe_multi_50k.tiktoken")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, fold_of(F.col("doc_id"), 7) != 2)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1, mode="all")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda ids: ids % 20 == 0, 20)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_language_id(spark: SparkSession, sf_dir: str, vocabulary: str = PIECES) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.where(~held_out), vocabulary)
    return language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, tokenizer).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "shards")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.kd_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sharding.with_slots(sharded).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return lexical.search(docs.select("doc_id", "text"), items.select("item_id", "text"), 10)


def op12_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"), min_length=6, min_count=5, factor=5)


def queries() -> dict:
    return {"op1_lm_scoring": op1_lm_scoring, "op2_simhash": op2_simhash, "op3_line_dedup": op3_line_dedup, "op4_ann": op4_ann, "op5_exact_topk": op5_exact_topk, "op6_language_id": op6_language_id, "op7_bpe": op7_bpe, "op8_mixing": op8_mixing, "op9_sharding": op9_sharding, "op10_url_filter": op10_url_filter, "op11_lexical_search": op11_lexical_search, "op12_embedding_dups": op12_embedding_dups, "op13_spelling": op13_spelling}


#: op3 as SQL.
OP3_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, row_number() OVER () AS r FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keys AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keys WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keys k LEFT JOIN frequent f ON k.key = f.key GROUP BY r, doc_id
"""

#: op5 as SQL: all pairs of a query and another row, the vectors as whole numbers.
OP5_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(c.e) = len(q.e)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


#: op11 as SQL: every document's score for every item.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
whole AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS length FROM d WHERE len(ts) > 0),
sized AS (SELECT r, doc_id, ts, 100 - 90 + (90 * len(ts) * docs) // length AS m FROM d, whole WHERE len(ts) > 0),
p AS (SELECT r, doc_id, m, term, count(*) AS tf FROM (SELECT r, doc_id, m, unnest(ts) AS term FROM sized) GROUP BY r, doc_id, m, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, whole GROUP BY term, docs),
s AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM b JOIN p USING (term) JOIN w USING (term) GROUP BY i, item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, r) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

#: op12 as SQL: all pairs of a label, and the least id that links lead to.
OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r, b.r AS other, b.vec_id AS other_id FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT r, other, other_id FROM links UNION SELECT reach.r, links.other, links.other_id FROM reach JOIN links ON reach.other = links.r
), parts AS (SELECT r, min(other_id) AS least FROM reach GROUP BY r), counts AS (SELECT r, count(*) AS n FROM links GROUP BY r)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, least) AS component_id, vec_id IS NOT DISTINCT FROM least(vec_id, least) AS kept
FROM v LEFT JOIN parts USING (r) LEFT JOIN counts USING (r)
"""


def _op10_sql() -> str:
    """op10 as SQL: one step of the recursion for each round of both spreads."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = lambda c: f"translate({c}, '{upper}', '{lower}')"
    cases = []
    for action, rule in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
        host, slash, rest = rule.partition("/")
        cases.append((f"WHEN (host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{slash}{rest}')", rule, action))
    rules, actions = (" ".join(f"{c[0]} THEN '{c[i]}'" for c in cases) for i in (1, 2))
    link = url_filter.LINK.replace("'", "''")
    parts = [
        f"p AS (SELECT page_id, html, coalesce({low("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"u AS (SELECT page_id, host, path, CASE {rules} END AS rule, CASE {actions} END AS action FROM p)",
        "seeds AS (SELECT host, avg(coalesce(action = 'allow', false)::INT) AS allowed, avg(coalesce(action = 'block', false)::INT) AS blocked FROM u GROUP BY host)",
        f"l AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS t FROM p)",
        f"links AS (SELECT src, {low('t')} AS dst, count(*)::DOUBLE AS weight FROM l WHERE src <> '' AND t <> '' AND src <> {low('t')} GROUP BY 1, 2)",
        f"share_t AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) * {url_filter.DAMPING} AS share FROM links)",
        f"share_d AS (SELECT dst AS src, src AS dst, weight / sum(weight) OVER (PARTITION BY dst) * {url_filter.DAMPING} AS share FROM links)",
    ]
    for k, seed in (("t", "allowed"), ("d", "blocked")):
        parts.append(f"{k}0 AS (SELECT host, {seed} AS score FROM seeds WHERE {seed} > 0 AND host <> '')")
        for i in range(1, url_filter.ROUNDS + 1):
            parts.append(f"{k}{i} AS (SELECT host, sum(x) AS score FROM (SELECT host, score AS x FROM {k}0 UNION ALL SELECT dst, score * share FROM {k}{i - 1} JOIN share_{k} ON host = src) GROUP BY host)")
    n = url_filter.ROUNDS
    blocked = f"coalesce(d.score, 0) >= {url_filter.THRESHOLD} AND coalesce(d.score, 0) > coalesce(t.score, 0)"
    return f"WITH {', '.join(parts)} SELECT page_id, u.host, path, rule, coalesce(action, CASE WHEN {blocked} THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN t{n} t ON t.host = u.host LEFT JOIN d{n} d ON d.host = u.host"


def oracle_sql() -> dict:
    return {"op3_line_dedup": OP3_SQL, "op5_exact_topk": OP5_SQL, "op10_url_filter": _op10_sql(), "op11_lexical_search": OP11_SQL, "op12_embedding_dups": OP12_SQL}
