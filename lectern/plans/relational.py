"""Queries on scopes, joins, counts, mutations and accounting, with the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import slug
from lectern.operators import metering as M
from lectern.operators import relational as R
from lectern.session import table

STAR_SQL = "document_chunks d JOIN canon_texts c ON d.text_id = c.id JOIN source_corpora s ON c.corpus_id = s.id"
OPT_IN = ("orvane-en", "upakatha")
DAY = "2023-11-20"


def _star(spark: SparkSession, d: str) -> DataFrame:
    return R.star(table(spark, d, "document_chunks"), table(spark, d, "canon_texts"), table(spark, d, "source_corpora"))


def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    scope = R.Scope(traditions=("theravada", "mahayana", "hinduism"), languages=("en", "lzh"), opt_in=OPT_IN)
    return _star(spark, d).where(scope.condition("corpus_code", "text_tradition", "text_language", "text_collection")).select("id", "corpus_code")


def scope_named(spark: SparkSession, d: str) -> DataFrame:
    scope = R.Scope(corpora=OPT_IN, collections=("nikaya", "hymns", "tantra"), opt_in=OPT_IN)
    return _star(spark, d).where(scope.condition("corpus_code", "text_tradition", "text_language", "text_collection")).select("id", "corpus_code")


def optin_exclusion(spark: SparkSession, d: str) -> DataFrame:
    kept = _star(spark, d).where(R.Scope(opt_in=OPT_IN).condition("corpus_code"))
    return kept.groupBy("corpus_code").agg(F.count("*").alias("n"))


def star_join(spark: SparkSession, d: str) -> DataFrame:
    return _star(spark, d).groupBy("corpus_code", "text_language").agg(F.count("*").alias("chunks"), F.countDistinct("text_id").alias("texts"), F.sum("word_count").alias("words"))


def sales_star(spark: SparkSession, d: str) -> DataFrame:
    item = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    rows = item.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def left_join_on_pred(spark: SparkSession, d: str) -> DataFrame:
    c, t = table(spark, d, "source_corpora").alias("s"), table(spark, d, "canon_texts").alias("t")
    return c.join(t, (F.col("s.id") == F.col("t.corpus_id")) & (F.col("t.century") == "5th BCE"), "left").groupBy("s.code").agg(F.count("t.id").alias("n"))


def semi_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "canon_texts").where("language = 'lzh'")
    return R.delete_where_parent(table(spark, d, "document_chunks"), gone, "text_id", "id").select("id", "text_id")


def anti_done(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "document_chunks").select(F.col("text_id").alias("id"))
    return R.not_done(table(spark, d, "canon_texts"), done, "id").select("id", "external_id")


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_chunks")
    by = rows.groupBy("corpus_code", "language").agg(F.count("*").alias("n")).withColumn("total", F.lit(False))
    return by.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("corpus_code"), F.lit(None).cast("string").alias("language"), "n", F.lit(True).alias("total")))


def chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _star(spark, d)
    verse = F.sum(F.when(F.col("is_verse"), F.col("token_count")).otherwise(0))
    return rows.groupBy("corpus_code", "text_tradition", "text_language").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), verse.alias("verse_tokens"), F.count_if("is_verse").alias("verses"))


def count_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canon_texts").agg(F.count("*").alias("n"), F.countDistinct("corpus_id").alias("corpora"))


def text_ids_in_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("corpus_id").orderBy("external_id")
    return table(spark, d, "canon_texts").select("corpus_id", "external_id", F.row_number().over(w).alias("serial"))


def constraint_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break a foreign key, a uniqueness rule or a range."""
    chunks, texts, corpora = (table(spark, d, n) for n in ("document_chunks", "canon_texts", "source_corpora"))
    embeddings, variants = table(spark, d, "chunk_embeddings"), table(spark, d, "entity_name_variants")
    found = [
        ("chunk_without_text", chunks.join(texts.select(F.col("id").alias("text_id")), "text_id", "left_anti")),
        ("text_without_corpus", texts.join(corpora.select(F.col("id").alias("corpus_id")), "corpus_id", "left_anti")),
        ("embedding_without_chunk", embeddings.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")),
        ("chunk_position_repeated", chunks.groupBy("text_id", "chunk_index").count().where("count > 1")),
        ("variant_repeated", variants.groupBy("entity_id", "name_text", "language").count().where("count > 1")),
        ("counts_negative", chunks.where("word_count < 0 or token_count < 0")),
    ]
    out = None
    for name, rows in found:
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def usage_today(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_usage").where(F.to_date("created_at") == F.lit(DAY).cast("date")).groupBy("key_id").agg(F.count("*").alias("n"))


def usage_once(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "api_usage").select("id", "key_id", "endpoint", "query_text", "results_count", "latency_ms", "created_at")
    return M.without_repeats(rows, ["key_id", "endpoint", "query_text", "created_at"])


def quota_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.daily_counts(table(spark, d, "api_usage")).select("key_id", F.col("day").cast("string").alias("day"), "calls")


def quota_status(spark: SparkSession, d: str) -> DataFrame:
    """Every key and day: what a search and an answer request would have met after that day's calls, at a hundredth of the limit."""
    calls = M.daily_counts(table(spark, d, "api_usage"))
    keys = table(spark, d, "api_keys").where("is_active").select(F.col("id").alias("key_id"), "daily_limit", "answer_daily_limit")
    rows = calls.join(keys, "key_id")
    part = lambda c: F.floor(F.col(c) / 100)
    return rows.select("key_id", F.col("day").cast("string").alias("day"), "calls", M.status(F.col("calls"), part("daily_limit")).alias("search"), M.status(F.col("calls"), part("answer_daily_limit")).alias("answer"))


def rate_limit_windows(spark: SparkSession, d: str) -> DataFrame:
    return M.window_counts(table(spark, d, "events"), "user_id", "ts", "1 minute").select("user_id", F.col("start").cast("string").alias("start"), "n")


def rate_limit_sliding(spark: SparkSession, d: str) -> DataFrame:
    return M.window_counts(table(spark, d, "events"), "user_id", "ts", "10 minutes", "5 minutes").select("user_id", F.col("start").cast("string").alias("start"), "n")


def upsert_update(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "source_corpora").select("code", "name", "license", "base_url")
    new = table(spark, d, "canon_texts").join(table(spark, d, "source_corpora").select(F.col("id").alias("corpus_id"), "code"), "corpus_id").groupBy("code").agg(F.max("url").alias("base_url"))
    new = new.select("code", F.lit(None).cast("string").alias("name"), F.lit("CC0").alias("license"), "base_url")
    return R.upsert(old, new, ["code"])


def insert_missing(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "entity_name_variants").where("is_primary").select("entity_id", "name_text", "language")
    new = table(spark, d, "entity_name_variants").select("entity_id", "name_text", "language")
    return R.insert_missing(old, new, ["entity_id", "language"]).groupBy("entity_id").agg(F.count("*").alias("n"))


def latest_use(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "api_usage").where("key_id is not null").select("key_id", "id", "endpoint", "created_at")
    return R.latest(rows, ["key_id"], "created_at", "id").select("key_id", "id", "endpoint")


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """Feature: a seeded sample of 50 chunks of at least 40 tokens."""
    return R.hash_sample(table(spark, d, "document_chunks").where("token_count >= 40"), "id", 50).select("id", "token_count")


def schema_evolved(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "document_chunks")
    return R.evolved(chunks.select("id", "text_id", "chunk_text"), chunks.select("id", "text_id", "is_verse", "collection")).select("id", "text_id", "is_verse", "collection")


def slug_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_corpora").select("id", slug(F.col("name")).alias("slug"), F.concat(F.lit("corpus-"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("serial"))


def key_hash(spark: SparkSession, d: str) -> DataFrame:
    named = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    return table(spark, d, "api_keys").where("is_active").select("id", F.sha2(named, 256).alias("digest"), named.rlike("^[a-z]+ [a-z]+$").alias("two_words"))


_USABLE_NAMES = "coalesce(name, '')"
QUERIES = {f.__name__: f for f in (
    scope_filter, scope_named, optin_exclusion, star_join, sales_star, left_join_on_pred, semi_delete, anti_done, chunk_counts, chunk_summary,
    count_texts, text_ids_in_order, constraint_checks, usage_today, usage_once, quota_counts, quota_status, rate_limit_windows, rate_limit_sliding,
    upsert_update, insert_missing, latest_use, hash_sample, schema_evolved, slug_ids, key_hash,
)}
ORACLE = {
    "scope_filter": f"SELECT d.id, s.code AS corpus_code FROM {STAR_SQL} WHERE s.code NOT IN ('orvane-en', 'upakatha') AND c.tradition IN ('theravada', 'mahayana', 'hinduism') AND c.language IN ('en', 'lzh')",
    "scope_named": f"SELECT d.id, s.code AS corpus_code FROM {STAR_SQL} WHERE s.code IN ('orvane-en', 'upakatha') AND c.collection IN ('nikaya', 'hymns', 'tantra')",
    "optin_exclusion": f"SELECT s.code AS corpus_code, count(*) AS n FROM {STAR_SQL} WHERE s.code NOT IN ('orvane-en', 'upakatha') GROUP BY ALL",
    "star_join": f"SELECT s.code AS corpus_code, c.language AS text_language, count(*) AS chunks, count(DISTINCT d.text_id) AS texts, sum(d.word_count)::BIGINT AS words FROM {STAR_SQL} GROUP BY ALL",
    "sales_star": "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "left_join_on_pred": "SELECT s.code, count(t.id) AS n FROM source_corpora s LEFT JOIN canon_texts t ON s.id = t.corpus_id AND t.century = '5th BCE' GROUP BY s.code",
    "semi_delete": "SELECT id, text_id FROM document_chunks WHERE text_id NOT IN (SELECT id FROM canon_texts WHERE language = 'lzh') OR text_id IS NULL",
    "anti_done": "SELECT id, external_id FROM canon_texts c WHERE NOT EXISTS (SELECT 1 FROM document_chunks d WHERE d.text_id = c.id)",
    "chunk_counts": "SELECT corpus_code, language, count(*) AS n, false AS total FROM document_chunks GROUP BY ALL UNION ALL SELECT NULL, NULL, count(*), true FROM document_chunks",
    "chunk_summary": f"SELECT s.code AS corpus_code, c.tradition AS text_tradition, c.language AS text_language, count(*) AS chunks, sum(d.token_count)::BIGINT AS tokens, sum(CASE WHEN d.is_verse THEN d.token_count ELSE 0 END)::BIGINT AS verse_tokens, count(*) FILTER (d.is_verse) AS verses FROM {STAR_SQL} GROUP BY ALL",
    "count_texts": "SELECT count(*) AS n, count(DISTINCT corpus_id) AS corpora FROM canon_texts",
    "text_ids_in_order": "SELECT corpus_id, external_id, row_number() OVER (PARTITION BY corpus_id ORDER BY external_id)::INTEGER AS serial FROM canon_texts",
    "constraint_checks": """
        SELECT 'chunk_without_text' AS rule, count(*) AS n FROM document_chunks WHERE text_id IS NULL OR text_id NOT IN (SELECT id FROM canon_texts)
        UNION ALL SELECT 'text_without_corpus', count(*) FROM canon_texts WHERE corpus_id IS NULL OR corpus_id NOT IN (SELECT id FROM source_corpora)
        UNION ALL SELECT 'embedding_without_chunk', count(*) FROM chunk_embeddings WHERE chunk_id NOT IN (SELECT id FROM document_chunks)
        UNION ALL SELECT 'chunk_position_repeated', count(*) FROM (SELECT 1 FROM document_chunks GROUP BY text_id, chunk_index HAVING count(*) > 1)
        UNION ALL SELECT 'variant_repeated', count(*) FROM (SELECT 1 FROM entity_name_variants GROUP BY entity_id, name_text, language HAVING count(*) > 1)
        UNION ALL SELECT 'counts_negative', count(*) FROM document_chunks WHERE word_count < 0 OR token_count < 0""",
    "usage_today": f"SELECT key_id, count(*) AS n FROM api_usage WHERE created_at::DATE = DATE '{DAY}' GROUP BY key_id",
    "usage_once": "SELECT id, key_id, endpoint, query_text, results_count, latency_ms, created_at FROM api_usage QUALIFY row_number() OVER (PARTITION BY key_id, endpoint, query_text, created_at ORDER BY id) = 1",
    "quota_counts": "SELECT key_id, created_at::DATE::VARCHAR AS day, count(*) AS calls FROM api_usage WHERE key_id IS NOT NULL GROUP BY ALL",
    "quota_status": """
        SELECT key_id, day, calls, (CASE WHEN daily_limit IS NULL THEN 403 WHEN calls >= floor(daily_limit / 100) THEN 429 ELSE 200 END)::INTEGER AS search,
               (CASE WHEN answer_daily_limit IS NULL THEN 403 WHEN calls >= floor(answer_daily_limit / 100) THEN 429 ELSE 200 END)::INTEGER AS answer
        FROM (SELECT key_id, created_at::DATE::VARCHAR AS day, count(*) AS calls FROM api_usage WHERE key_id IS NOT NULL GROUP BY ALL) JOIN api_keys k ON k.id = key_id WHERE is_active""",
    "rate_limit_windows": "SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY ALL",
    "rate_limit_sliding": "SELECT user_id, strftime(time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(k * 5), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, (VALUES (0), (1)) w(k) GROUP BY ALL",
    "upsert_update": """
        SELECT s.code, s.name, CASE WHEN n.code IS NULL THEN s.license ELSE 'CC0' END AS license, coalesce(n.base_url, s.base_url) AS base_url
        FROM source_corpora s LEFT JOIN (SELECT s.code, max(c.url) AS base_url FROM canon_texts c JOIN source_corpora s ON c.corpus_id = s.id GROUP BY s.code) n ON n.code = s.code""",
    "insert_missing": """
        WITH old AS (SELECT entity_id, name_text, language FROM entity_name_variants WHERE is_primary),
             new AS (SELECT entity_id, name_text, language FROM entity_name_variants QUALIFY row_number() OVER (PARTITION BY entity_id, language ORDER BY name_text) = 1)
        SELECT entity_id, count(*) AS n FROM (SELECT * FROM old UNION ALL SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.entity_id = new.entity_id AND old.language = new.language)) GROUP BY entity_id""",
    "latest_use": "SELECT key_id, id, endpoint FROM api_usage WHERE key_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key_id ORDER BY created_at DESC, id DESC) = 1",
    "hash_sample": "SELECT id, token_count FROM document_chunks WHERE token_count >= 40 ORDER BY md5(id::VARCHAR || ':42'), id LIMIT 50",
    "schema_evolved": "SELECT id, text_id, NULL::BOOLEAN AS is_verse, NULL::VARCHAR AS collection FROM document_chunks",
    "slug_ids": "SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 'corpus-' || lpad(id::VARCHAR, 3, '0') AS serial FROM source_corpora",
    "key_hash": f"SELECT id, sha256(lower(trim({_USABLE_NAMES}))) AS digest, regexp_matches(lower(trim({_USABLE_NAMES})), '^[a-z]+ [a-z]+$') AS two_words FROM api_keys WHERE is_active",
}
