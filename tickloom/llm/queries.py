"""Registered queries of the subpackage and the SQL that states their results, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, fim, licenses, packing, quality, resampling, secrets, simhash, suffixes, topk, toxicity, warc, window_dedup
from tickloom.llm.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, w[i:i + 12] AS win, len(w[i:i + 12]) AS n FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN win USING (win)),
cov AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(table(spark, sf_dir, "documents")))


def _op8_sql() -> str:
    each = []
    for rank, (kind, pattern, group, least, _) in enumerate(secrets.KINDS):
        place = "folded" if kind == "assign" else "text"
        p = "'" + pattern.replace("'", "''") + "'"
        each.append(f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank,
    CAST(coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
    length(found[i]) AS n, length(vals[i]) AS v, text
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
    SELECT doc_id, text, regexp_extract_all({place}, {p}) AS found, regexp_extract_all({place}, {p}, {group}) AS vals,
      string_split_regex({place}, {p}) AS pieces FROM d)) WHERE length(vals[i]) >= {least}""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_FOLD} AS folded FROM documents),
spans AS ({' UNION ALL '.join(each)}),
own AS (SELECT substr(spans.text, s + n - v + 1, v) AS val, count(DISTINCT doc_id) AS repos, count(DISTINCT source) AS owners
  FROM spans JOIN documents USING (doc_id) GROUP BY 1),
one AS (SELECT p.*, kind || ':' || s || ':' || (s + n) AS span, NOT (repos >= {secrets.EXAMPLE_REPOS} AND owners >= {secrets.EXAMPLE_OWNERS}) AS live
  FROM spans p JOIN own ON val = substr(text, s + n - v + 1, v)),
agg AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
    string_agg(span, ',' ORDER BY s, rank) FILTER (kind IN ('assign', 'access', 'hex')) AS base,
    string_agg(span, ',' ORDER BY s, rank) AS spans, count(*) FILTER (live) AS live FROM one GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(k, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(live, 0) AS BIGINT) AS n_live
FROM d LEFT JOIN agg USING (doc_id)"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.deduplicate(table(spark, sf_dir, "documents"))


OP3_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)),
own AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN own USING (k) WHERE f < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP4_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives go to the shared folder and are read back from there."""
    archives = warc.write_archives(table(spark, sf_dir, "pages"), Scratch(spark, "archives").path("warc"))
    return warc.page_rows(warc.read_archives(spark, archives, with_payload=False))


OP5_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM p JOIN f USING (digest)"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """Public vocabulary file of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print("print").alias("fingerprint"), "component_id")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's words."""
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest_columns(fim.transform(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "op1_licenses": op1_licenses,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_topk": op4_topk,
    "op5_warc": op5_warc,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_secrets": op8_secrets,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_quality": op11_quality,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_fill_in_middle": op13_fill_in_middle,
}
#: The others (a learned score, bytes at every place, token ids, XXH64) have no DuckDB form; ``tests/llm`` has brute force or
#: held-out accuracy for them.
ORACLES: dict[str, str] = {
    "op1_licenses": licenses.oracle_sql(),
    "op3_substring_dedup": OP3_SQL,
    "op4_topk": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op7_decontamination": OP7_SQL,
    "op8_secrets": _op8_sql(),
    "op12_importance_resampling": resampling.oracle_sql(),
    "op13_fill_in_middle": fim.oracle_sql(),
}
