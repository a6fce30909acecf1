"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontam, forest, hardneg, langid, lm, media, mixing, secrets, simhash, suffix, toxicity, urls, whiten

def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("key.doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: host, path, verdict of the production rules.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    profiles = langid.learn_profiles(docs.where(common.crc_rem("doc_id", 5) != 0), key="doc_id")
    found = langid.predict(docs.select("doc_id", "text"), profiles, keep_text=False)
    return found.select("doc_id", F.coalesce(common.crc_rem("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.only(common.table(spark, sf_dir, "documents"), "doc_id", "source", "text"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(media.render(common.only(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))).withColumnRenamed("image", "vec_id")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    found = decontam.contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    model = lm.learn(docs.where(common.crc_rem("doc_id", 7) != 2))
    found = lm.score(docs, model)
    held_out = F.coalesce(common.crc_rem("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = common.only(common.table(spark, sf_dir, "labels"), "doc_id", "toxic")
    learnt = common.crc_rem("doc_id", 3) != 1
    model = toxicity.learn(docs.where(learnt), labels.where(learnt))
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(common.crc_rem("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(common.only(common.table(spark, sf_dir, "documents"), "doc_id", "source", "text"))
    n = [F.size(F.expr(f"filter(base, s -> s.kind = {k})")).cast("bigint").alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    spans = secrets.digest(F.concat("base", "added"))
    return found.select("row.doc_id", *n, F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), "n_owned", "n_shared")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.only(common.table(spark, sf_dir, "pages"), "page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(pages, rules).drop("url")


def op11_hash_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    return forest.nearest(rows, common.only(rows, "vec_id", "embedding").where("vec_id % 20 = 0").toDF("query_id", "embedding"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.only(common.table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardneg.mine(rows, rows.where("vec_id % 100 = 0"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(common.table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_media_columns": op3_media_columns,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scans": op8_secret_scans,
    "op9_url_filters": op9_url_filters,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_hash_forest_neighbours": op11_hash_forest_neighbours,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_embedding_whitening": op13_embedding_whitening,
}

SQL: dict[str, str] = {
    "op4_benchmark_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM bs),
ds AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM ds),
h AS (SELECT rid, n, s, item_id FROM dw JOIN bw USING (n, k)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM h) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
""",
    "op8_secret_scans": r"""
WITH pat(kind, name, p, g) AS (VALUES
  (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), (1, 'access', 'AKIA[A-Z0-9]{16,}', 0),
  (2, 'hex', '[0-9a-f]{24,}', 0), (3, 'owned', '[A-Za-z0-9+/_-]{20,}', 0)),
d AS (SELECT row_number() OVER () AS rid, * FROM documents),
m AS (SELECT rid, doc_id, source, kind, name, unnest(regexp_extract_all(text, p, 0)) AS w, unnest(regexp_extract_all(text, p, 2)) AS v,
        unnest(string_split_regex(text, p)) AS gap, generate_subscripts(string_split_regex(text, p), 1) AS i
      FROM d, pat WHERE g = 2 UNION ALL
      SELECT rid, doc_id, source, kind, name, unnest(regexp_extract_all(text, p, 0)), unnest(regexp_extract_all(text, p, 0)),
        unnest(string_split_regex(text, p)), generate_subscripts(string_split_regex(text, p), 1) FROM d, pat WHERE g = 0),
s AS (SELECT *, sum(length(gap) + coalesce(length(w), 0)) OVER (PARTITION BY rid, kind ORDER BY i) - coalesce(length(w), 0) AS a,
        sum(length(gap) + coalesce(length(w), 0)) OVER (PARTITION BY rid, kind ORDER BY i) AS b FROM m),
base AS (SELECT * FROM s WHERE w IS NOT NULL AND (kind IN (1, 2) OR kind = 0 AND length(v) >= 6)),
more AS (SELECT * FROM s WHERE w IS NOT NULL AND kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
         AND len(list_distinct(string_split(v, ''))) >= 12 AND NOT EXISTS (SELECT 1 FROM base WHERE base.rid = s.rid AND base.a < s.b AND s.a < base.b)),
c AS (FROM base UNION ALL FROM more),
own AS (SELECT v, count(DISTINCT coalesce(source, '?')) AS n_owners FROM c GROUP BY v),
j AS (SELECT c.*, n_owners FROM c JOIN own USING (v)),
r AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
        string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (kind < 3 OR n_owners < 2) AS spans,
        count(DISTINCT v) FILTER (n_owners < 2) AS n_owned, count(DISTINCT v) FILTER (n_owners >= 2) AS n_shared FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_shared, 0) AS n_shared FROM d LEFT JOIN r USING (rid)
""",
    "op9_url_filters": """
WITH rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                 ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT row_number() OVER () AS rid, page_id,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT rid, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(v, length(rh) + length(rp)) AS verdict
        FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (rid)
""",
    "op12_hard_negatives": """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""",
}
