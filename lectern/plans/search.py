"""Queries on retrieval and its evaluation, with their SQL.

Dense searches take as queries every chunk whose id is divisible by 20, against
all rows.  Searches with words take the test items as queries; as there is no
embedding model here, the vector of a test item is that of the chunk with its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import evaluation as V
from lectern.operators import retrieval as R
from lectern.operators.relational import Scope, star
from lectern.session import cut, table

DIVISOR, SHARDS = 20, 3
USABLE = "embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_embeddings").select(F.col("chunk_id").alias("id"), "embedding")


def _sampled(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("id") % DIVISOR == 0)


def _item_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).join(table(spark, d, "eval_items").select(F.col("item_id").alias("id")), "id", "left_semi")


def _dims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_chunks").select("id", "text_id")


def _dense(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return R.dense(_sampled(v), v)


def _item_dense(spark: SparkSession, d: str) -> DataFrame:
    return R.dense(_item_vectors(spark, d), _vectors(spark, d))


def _fts(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), F.col("query").alias("text"))
    return R.lexical(items, table(spark, d, "document_chunks").select("id", F.col("chunk_text").alias("text")))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).select("query_id", "id", "score", "rank")


def dense_masked(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    kept = v.join(table(spark, d, "document_chunks").where("is_verse").select("id"), "id", "left_semi")
    return R.dense(_sampled(v), kept, 10).select("query_id", "id", "score", "rank")


def max_similarity_by_text(spark: SparkSession, d: str) -> DataFrame:
    found = _dense(spark, d).join(_dims(spark, d), "id")
    return found.groupBy("query_id", "text_id").agg(F.max("score").alias("best"))


def ann_ivf(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return R.ivf_search(_sampled(v), v).select("query_id", "id", "score", "rank")


def fts_or(spark: SparkSession, d: str) -> DataFrame:
    return _fts(spark, d).select("query_id", "id", "score", "rank")


def fts_websearch(spark: SparkSession, d: str) -> DataFrame:
    """The first two longer words of each item's passage as query, all chunks as texts."""
    items = table(spark, d, "eval_items")
    long = F.filter(F.regexp_extract_all(F.lower("passage"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 5)
    queries = items.select(F.col("item_id").alias("id"), F.array_join(F.slice(long, 1, 2), " ").alias("text")).where("text <> ''")
    return R.websearch(queries, table(spark, d, "document_chunks").select("id", F.col("chunk_text").alias("text")))


def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return R.rrf_weighted(_item_dense(spark, d), _fts(spark, d)).select("query_id", "id", "score", "rank")


def rrf_zero_based(spark: SparkSession, d: str) -> DataFrame:
    return R.rrf_plain([_item_dense(spark, d), _fts(spark, d)], 0, 50).select("query_id", "id", "score", "rank")


def rrf_one_based(spark: SparkSession, d: str) -> DataFrame:
    return R.rrf_plain([_item_dense(spark, d), _fts(spark, d)], 1).select("query_id", "id", "score", "rank")


def _boosted(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "document_chunks")
    wanted = chunks.select(F.col("id").alias("query_id"), F.col("entity_ids").alias("entities"))
    return R.entity_boost(R.rrf_weighted(_item_dense(spark, d), _fts(spark, d)), chunks.select("id", "entity_ids"), wanted)


def entity_boost(spark: SparkSession, d: str) -> DataFrame:
    return _boosted(spark, d).select("query_id", "id", "score", "rank")


def text_dedup(spark: SparkSession, d: str) -> DataFrame:
    return R.first_of_group(_dense(spark, d).join(_dims(spark, d), "id"), "text_id").select("query_id", "id", "text_id", "rank")


def two_level_ranked(spark: SparkSession, d: str) -> DataFrame:
    return R.two_level(_dense(spark, d).join(_dims(spark, d), "id"), "text_id").select("query_id", "id", "text_id", "rank")


def max_similarity_full(spark: SparkSession, d: str) -> DataFrame:
    """As max_similarity_by_text, but over all vectors and so for every text."""
    v = _vectors(spark, d)
    best = R.group_scores(_sampled(v), v.join(_dims(spark, d).withColumnRenamed("text_id", "tag"), "id"))
    return best.select("query_id", F.col("tag").alias("text_id"), F.col("score").alias("best"))


def two_level_full(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    found = R.two_level_full(_sampled(v), v.join(_dims(spark, d).withColumnRenamed("text_id", "tag"), "id"))
    return found.select("query_id", "id", F.col("tag").alias("text_id"), "rank")


def fingerprint_dedup(spark: SparkSession, d: str) -> DataFrame:
    prints = table(spark, d, "document_chunks").select("id", F.substring(F.trim(F.coalesce("chunk_text", F.lit(""))), 1, 300).alias("fp"))
    return R.first_of_group(_dense(spark, d).join(prints, "id"), F.md5("fp")).select("query_id", "id", "rank")


def mmr(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return R.mmr(_dense(spark, d), v, _sampled(v), 8)


def shard_merge(spark: SparkSession, d: str) -> DataFrame:
    ranked = _dense(spark, d).withColumn("account", (F.col("id") % SHARDS + 1).cast("int"))
    return R.merge_shards(ranked, "account", 8).select("query_id", "account", "id", "score", "rank")


def late_fetch(spark: SparkSession, d: str) -> DataFrame:
    """The boosted list's first eight with the passage fields, which are fetched only now."""
    top = _boosted(spark, d).where("rank <= 8").select("query_id", "id", "rank")
    chunks = table(spark, d, "document_chunks").select("id", "text_id", "reference", "section", F.md5("chunk_text").alias("digest"))
    texts = table(spark, d, "canon_texts").select(F.col("id").alias("text_id"), "external_id", "title_english", "translator", "tradition", "language")
    return top.join(chunks, "id").join(texts, "text_id").drop("text_id")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Dense and lexical lists fused, boosted by entities, one result a text, the first eight with their source."""
    ranked = _boosted(spark, d).join(_dims(spark, d), "id")
    best = R.first_of_group(ranked, "text_id", 8)
    texts = table(spark, d, "canon_texts").select(F.col("id").alias("text_id"), "external_id", "title_english", "corpus_id")
    corpora = table(spark, d, "source_corpora").select(F.col("id").alias("corpus_id"), "code")
    return best.join(texts, "text_id").join(corpora, "corpus_id").select("query_id", "rank", "id", "text_id", "score", "external_id", "title_english", "code")


#: The scope of the scoped search.
SCOPE = Scope(languages=("en", "pli"), opt_in=("orvane-en",))


def _in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in the scope, with the columns of their text and corpus."""
    full = star(table(spark, d, "document_chunks"), table(spark, d, "canon_texts"), table(spark, d, "source_corpora"))
    return full.where(SCOPE.condition("corpus_code", "text_tradition", "text_language", "text_collection"))


def search_scoped(spark: SparkSession, d: str) -> DataFrame:
    """The whole search inside a scope: both lists are cut to it before they are ranked, then fused, boosted, one result a text, with all passage fields."""
    scope = cut(_in_scope(spark, d))
    ids = scope.select("id")
    dense = R.dense(_item_vectors(spark, d), _vectors(spark, d).join(ids, "id", "left_semi"))
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), F.col("query").alias("text"))
    fts = R.lexical(items, scope.select("id", F.col("chunk_text").alias("text")))
    wanted = table(spark, d, "document_chunks").select(F.col("id").alias("query_id"), F.col("entity_ids").alias("entities"))
    boosted = R.entity_boost(R.rrf_weighted(dense, fts), scope.select("id", "entity_ids"), wanted)
    best = R.first_of_group(boosted.join(scope.select("id", "text_id"), "id"), "text_id", 8).select("query_id", "rank", "id", "score")
    fields = scope.select(
        "id", "text_id", "reference", "chapter", "section", "is_verse", F.md5("chunk_text").alias("digest"), F.col("text_external_id").alias("external_id"), F.col("text_title_english").alias("title"),
        F.col("text_translator").alias("translator"), F.col("text_language").alias("language"), F.col("text_tradition").alias("tradition"), F.col("corpus_code").alias("code"), F.col("corpus_name").alias("corpus"), F.col("corpus_license").alias("license"),
    )
    return best.join(fields, "id")


def shard_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Every shard is searched by itself and gives its own pool; the pools' ranks are merged."""
    vectors, ranked = _vectors(spark, d), None
    for shard in range(SHARDS):
        part = R.dense(_sampled(vectors), vectors.where(F.col("id") % SHARDS == shard)).withColumn("account", F.lit(shard + 1))
        ranked = part if ranked is None else ranked.unionByName(part)
    return R.merge_shards(ranked, "account", 8).select("query_id", "account", "id", "score", "rank")


def infer_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The rerank mode and the use of the lexical list that each logged request would get."""
    modes = {"orvane-en": "mmr", "upakatha": "none"}
    none = F.lit(None).cast("array<string>")
    return table(spark, d, "api_usage").select("id", R.rerank_mode(modes, none, F.col("traditions")).alias("mode"), R.uses_lexical(F.col("traditions"), F.col("languages")).alias("lexical"))


def _gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(ranked, gold): lists without the query itself; chunks of the query's text are gold."""
    dims = _dims(spark, d)
    w = Window.partitionBy("query_id").orderBy("rank")
    ranked = _dense(spark, d).where("query_id <> id").withColumn("rank", F.row_number().over(w)).where("rank <= 50")
    queries = _sampled(_vectors(spark, d)).select(F.col("id").alias("query_id"))
    of = queries.join(dims.select(F.col("id").alias("query_id"), "text_id"), "query_id")
    gold = of.join(dims, "text_id").where("id <> query_id").select("query_id", "id")
    return cut(ranked.select("query_id", "id", "rank", "score")), cut(gold)


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return V.recall_at(*_gold(spark, d))


def mrr(spark: SparkSession, d: str) -> DataFrame:
    return V.reciprocal_rank(*_gold(spark, d))


def ndcg_binary(spark: SparkSession, d: str) -> DataFrame:
    return V.ndcg_binary(*_gold(spark, d))


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """Gain 2 for a chunk of the same text, 1 for one of the same corpus."""
    ranked, _ = _gold(spark, d)
    dims = table(spark, d, "document_chunks").select("id", "text_id", "corpus_code")
    rows = ranked.join(dims, "id").join(dims.select(F.col("id").alias("query_id"), F.col("text_id").alias("t"), F.col("corpus_code").alias("c")), "query_id")
    gain = F.when(F.col("text_id") == F.col("t"), 2.0).when(F.col("corpus_code") == F.col("c"), 1.0).otherwise(0.0)
    return rows.select("query_id", "id", "rank", "text_id", gain.alias("gain"))


def ndcg_graded_self(spark: SparkSession, d: str) -> DataFrame:
    return V.ndcg_graded(_graded(spark, d))


def ndcg_graded_max(spark: SparkSession, d: str) -> DataFrame:
    return V.ndcg_graded(_graded(spark, d), most=2.0)


def source_ndcg(spark: SparkSession, d: str) -> DataFrame:
    once = R.first_of_group(_graded(spark, d), "text_id")
    return V.ndcg_graded(once)


def text_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall and reciprocal rank by texts: the list with one result a text, and the query's own text as gold."""
    dims = _dims(spark, d)
    ranked, _ = _gold(spark, d)
    texts = R.first_of_group(ranked.join(dims, "id"), "text_id").select("query_id", F.col("text_id").alias("id"), "rank")
    gold = _sampled(_vectors(spark, d)).select("id").join(dims, "id").where("text_id is not null").select(F.col("id").alias("query_id"), F.col("text_id").alias("id"))
    return V.recall_at(texts, gold).join(V.reciprocal_rank(texts, gold), "query_id")


def corpus_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal rank by corpus of the query, of all queries and of those with any hit."""
    ranked, gold = _gold(spark, d)
    corpus = table(spark, d, "document_chunks").select(F.col("id").alias("query_id"), F.coalesce("corpus_code", F.lit("unknown")).alias("code"))
    rows = V.reciprocal_rank(ranked, gold).join(corpus, "query_id")
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.round(F.avg("rr"), 4).alias("mean"), F.round(F.avg(F.when(F.col("rr") > 0, F.col("rr"))), 4).alias("mean_positive"))


def eval_averages(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall and reciprocal rank by language of the query and over all."""
    ranked, gold = _gold(spark, d)
    rows = V.recall_at(ranked, gold).join(V.reciprocal_rank(ranked, gold), "query_id")
    language = table(spark, d, "document_chunks").select(F.col("id").alias("query_id"), F.coalesce("language", F.lit("unknown")).alias("segment"))
    return V.averages(rows.join(language, "query_id").withColumn("system", F.lit("dense")), ("system", "segment"), ("r1", "r5", "r10", "rr"))


def pool_candidates(spark: SparkSession, d: str) -> DataFrame:
    dense, fts = _item_dense(spark, d), _fts(spark, d)
    runs = None
    for priority, (name, df) in enumerate((("fts_only", fts), ("dense", dense), ("hybrid", R.rrf_plain([dense, fts], 1)))):
        part = df.select(F.lit(name).alias("system"), F.lit(priority).alias("priority"), "query_id", "id", "rank")
        runs = part if runs is None else runs.unionByName(part)
    return V.pool(runs)


def _sims(queries: str, prefix: str) -> str:
    return f"""
        {prefix}v AS (SELECT chunk_id AS id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM chunk_embeddings WHERE {USABLE}),
        {prefix}s AS (SELECT q.id AS query_id, v.id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (q.n * v.n), 6) + 0.0 AS score FROM {prefix}v q, {prefix}v v WHERE {queries})"""


def _ranked(source: str, k: int, order: str = "score DESC, id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order})::INTEGER AS rank FROM {source} QUALIFY rank <= {k}"


_DENSE = f"{_sims(f'q.id % {DIVISOR} = 0', 'd')}, dense AS ({_ranked('ds', 60)})"
_ITEM = f"{_sims('q.id IN (SELECT item_id FROM eval_items)', 'item_')}, item_dense AS ({_ranked('item_s', 60)})"
_FTS = f"""
        terms AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2)) AS t FROM eval_items),
        term AS (SELECT query_id, len(t) AS n, unnest(t) AS term FROM terms),
        posting AS (SELECT id, unnest(regexp_extract_all(lower(chunk_text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM document_chunks WHERE chunk_text IS NOT NULL),
        counted AS (SELECT id, term, count(*) AS tf FROM posting WHERE term IN (SELECT term FROM term) GROUP BY ALL),
        weighed AS (SELECT *, 0.1 * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493406685 AS r FROM counted),
        fs AS (SELECT query_id, id, round(sum(r / n), 6) AS score FROM term JOIN weighed USING (term) GROUP BY ALL),
        fts AS ({_ranked('fs', 60)})"""
_FUSED = f"""
        fused_s AS (SELECT query_id, id, round(sum(part), 9) AS score FROM (SELECT query_id, id, 0.7::DOUBLE / (60 + rank) AS part FROM item_dense UNION ALL SELECT query_id, id, 0.3::DOUBLE / (60 + rank) FROM fts) GROUP BY ALL),
        fused AS ({_ranked('fused_s', 60)})"""
_BOOST = """
        boosted_s AS (SELECT f.query_id, f.id, round(f.score + CASE WHEN list_has_any(c.entity_ids, w.entity_ids) THEN 0.25::DOUBLE ELSE 0 END, 9) AS score, f.rank AS before
                      FROM fused f LEFT JOIN document_chunks c ON c.id = f.id LEFT JOIN document_chunks w ON w.id = f.query_id),
        boosted AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before)::INTEGER AS rank FROM boosted_s)"""
_FIRST = "SELECT * EXCLUDE (rank, k), row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {g} ORDER BY rank) AS k FROM {source}) WHERE k = 1"
_GOLD = f"""{_DENSE},
        ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY dense.rank)::INTEGER AS rank FROM dense WHERE query_id <> id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dense.rank) <= 50),
        gold AS (SELECT DISTINCT q.id AS query_id, g.id FROM document_chunks q JOIN document_chunks g ON q.text_id = g.text_id AND q.id <> g.id WHERE q.id % {DIVISOR} = 0 AND q.id IN (SELECT chunk_id FROM chunk_embeddings)),
        hits AS (SELECT g.query_id, g.id, r.rank FROM gold g LEFT JOIN ranked r ON r.query_id = g.query_id AND r.id = g.id)"""
_GRADED = f"""{_GOLD},
        graded AS (SELECT r.query_id, r.id, r.rank, c.text_id, CASE WHEN c.text_id = q.text_id THEN 2.0 WHEN c.corpus_code = q.corpus_code THEN 1.0 ELSE 0.0 END::DOUBLE AS gain FROM ranked r JOIN document_chunks c ON c.id = r.id JOIN document_chunks q ON q.id = r.query_id)"""


def _ndcg_sql(source: str, wanted: str) -> str:
    return f"""SELECT query_id, round(CASE WHEN i > 0 THEN d / i ELSE 0 END, 6) AS ndcg FROM (SELECT query_id, sum(CASE WHEN rank <= 5 THEN gain / log2(rank + 1) ELSE 0 END) AS d, sum(CASE WHEN best <= 5 THEN {wanted} / log2(best + 1) ELSE 0 END) AS i
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, rank) AS best FROM {source}) GROUP BY query_id)"""


_RECALLS = ", ".join(f"coalesce((min(rank) <= {k})::INTEGER, 0) AS r{k}" for k in V.DEPTHS)
QUERIES = {f.__name__: f for f in (
    dense_topk, dense_masked, max_similarity_by_text, ann_ivf, fts_or, fts_websearch, rrf_weighted, rrf_zero_based, rrf_one_based, entity_boost,
    text_dedup, two_level_ranked, max_similarity_full, two_level_full, fingerprint_dedup, mmr, shard_merge, late_fetch, hybrid_search, search_scoped, shard_fanout, infer_rerank, recall_at_k, mrr, ndcg_binary,
    ndcg_graded_self, ndcg_graded_max, source_ndcg, text_recall, corpus_means, eval_averages, pool_candidates,
)}
_RERANK_SQL = " ".join(f"WHEN len(one) = 1 AND one[1] = '{t}' THEN '{m}'" for t, m in R.TRADITION_RERANK.items())
ORACLE = {
    "dense_topk": f"WITH {_DENSE} SELECT query_id, id, score, rank FROM dense",
    "dense_masked": f"WITH {_DENSE}, m AS (SELECT ds.* FROM ds JOIN document_chunks c ON c.id = ds.id WHERE c.is_verse) {_ranked('m', 10)}",
    "max_similarity_by_text": f"WITH {_DENSE} SELECT query_id, text_id, max(score) AS best FROM dense JOIN document_chunks c ON c.id = dense.id GROUP BY ALL",
    "fts_or": f"WITH {_FTS} SELECT query_id, id, score, rank FROM fts",
    "fts_websearch": """
        WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(passage), '[a-z]+'), lambda w: length(w) >= 5)[1:2]) AS t FROM eval_items),
             held AS (SELECT id, regexp_extract_all(lower(chunk_text), '[\\p{L}\\p{N}_]+') AS w FROM document_chunks WHERE chunk_text IS NOT NULL)
        SELECT item_id AS query_id, id FROM q JOIN held ON list_has_all(w, t) WHERE len(t) > 0""",
    "rrf_weighted": f"WITH {_ITEM}, {_FTS}, {_FUSED} SELECT query_id, id, score, rank FROM fused",
    "rrf_zero_based": f"WITH {_ITEM}, {_FTS}, u AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank - 1)), 9) AS score FROM (SELECT query_id, id, rank FROM item_dense UNION ALL SELECT query_id, id, rank FROM fts) GROUP BY ALL) {_ranked('u', 50)}",
    "rrf_one_based": f"WITH {_ITEM}, {_FTS}, u AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM item_dense UNION ALL SELECT query_id, id, rank FROM fts) GROUP BY ALL) {_ranked('u', 1000000)}",
    "entity_boost": f"WITH {_ITEM}, {_FTS}, {_FUSED}, {_BOOST} SELECT query_id, id, score, rank FROM boosted",
    "text_dedup": f"WITH {_DENSE}, t AS (SELECT dense.*, c.text_id FROM dense JOIN document_chunks c ON c.id = dense.id) SELECT query_id, id, text_id, rank FROM ({_FIRST.format(g='text_id', source='t')})",
    "two_level_ranked": f"""WITH {_DENSE}, t AS (SELECT dense.*, c.text_id FROM dense JOIN document_chunks c ON c.id = dense.id), b AS (SELECT *, min(rank) OVER (PARTITION BY query_id, text_id) AS best, row_number() OVER (PARTITION BY query_id, text_id ORDER BY rank) AS m FROM t),
        g AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY best) AS gr FROM b) SELECT query_id, id, text_id, row_number() OVER (PARTITION BY query_id ORDER BY gr, m)::INTEGER AS rank FROM g WHERE gr <= 8 AND m <= 3""",
    "max_similarity_full": f"WITH {_DENSE} SELECT query_id, text_id, max(score) AS best FROM ds JOIN document_chunks c ON c.id = ds.id WHERE text_id IS NOT NULL GROUP BY ALL",
    "two_level_full": f"""WITH {_DENSE}, t AS (SELECT ds.*, c.text_id, row_number() OVER (PARTITION BY query_id, c.text_id ORDER BY score DESC, ds.id) AS m FROM ds JOIN document_chunks c ON c.id = ds.id WHERE c.text_id IS NOT NULL),
        b AS (SELECT query_id, text_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS gr FROM t WHERE m = 1) SELECT query_id, t.id, text_id, row_number() OVER (PARTITION BY query_id ORDER BY gr, m)::INTEGER AS rank FROM t JOIN b USING (query_id, text_id) WHERE gr <= 8 AND m <= 3""",
    "fingerprint_dedup": f"WITH {_DENSE}, t AS (SELECT dense.*, substring(trim(coalesce(c.chunk_text, '')), 1, 300) AS fp FROM dense JOIN document_chunks c ON c.id = dense.id) SELECT query_id, id, rank FROM ({_FIRST.format(g='fp', source='t')})",
    "shard_merge": f"""WITH {_DENSE}, p AS (SELECT query_id, id, (id % {SHARDS} + 1)::INTEGER AS account, row_number() OVER (PARTITION BY query_id, id % {SHARDS} ORDER BY rank) AS r FROM dense),
        s AS (SELECT query_id, account, id, round(1.0::DOUBLE / (60 + r), 6) AS score FROM p WHERE r <= 24) SELECT query_id, account, id, score, rank FROM ({_ranked('s', 8, 'score DESC, account, id')})""",
    "late_fetch": f"WITH {_ITEM}, {_FTS}, {_FUSED}, {_BOOST} SELECT b.query_id, b.id, b.rank, c.reference, c.section, md5(c.chunk_text) AS digest, t.external_id, t.title_english, t.translator, t.tradition, t.language FROM boosted b JOIN document_chunks c ON c.id = b.id JOIN canon_texts t ON t.id = c.text_id WHERE b.rank <= 8",
    "hybrid_search": f"""WITH {_ITEM}, {_FTS}, {_FUSED}, {_BOOST}, t AS (SELECT boosted.*, c.text_id FROM boosted JOIN document_chunks c ON c.id = boosted.id), f AS ({_FIRST.format(g='text_id', source='t')})
        SELECT f.query_id, f.rank, f.id, f.text_id, f.score, x.external_id, x.title_english, s.code FROM f JOIN canon_texts x ON x.id = f.text_id JOIN source_corpora s ON s.id = x.corpus_id WHERE f.rank <= 8""",
    "search_scoped": f"""WITH {_ITEM}, {_FTS},
        scope AS (SELECT c.*, t.external_id, t.title_english, t.translator, t.language AS text_language, t.tradition AS text_tradition, s.code, s.name AS corpus, s.license FROM document_chunks c JOIN canon_texts t ON t.id = c.text_id JOIN source_corpora s ON s.id = t.corpus_id
                  WHERE t.language IN ('en', 'pli') AND s.code NOT IN ('orvane-en')),
        scoped_s AS (SELECT * FROM item_s WHERE id IN (SELECT id FROM scope)), scoped_dense AS ({_ranked('scoped_s', 60)}),
        scoped_f AS (SELECT * FROM fs WHERE id IN (SELECT id FROM scope)), scoped_fts AS ({_ranked('scoped_f', 60)}), {_FUSED.replace('item_dense', 'scoped_dense').replace('FROM fts', 'FROM scoped_fts')}, {_BOOST},
        t AS (SELECT boosted.*, c.text_id FROM boosted JOIN scope c ON c.id = boosted.id), f AS ({_FIRST.format(g='text_id', source='t')})
        SELECT f.query_id, f.rank, f.id, f.score, c.text_id, c.reference, c.chapter, c.section, c.is_verse, md5(c.chunk_text) AS digest, c.external_id, c.title_english AS title, c.translator, c.text_language AS language, c.text_tradition AS tradition, c.code, c.corpus, c.license
        FROM f JOIN scope c ON c.id = f.id WHERE f.rank <= 8""",
    "shard_fanout": f"""WITH {_DENSE}, p AS (SELECT query_id, id, (id % {SHARDS} + 1)::INTEGER AS account, row_number() OVER (PARTITION BY query_id, id % {SHARDS} ORDER BY score DESC, id) AS r FROM ds),
        s AS (SELECT query_id, account, id, round(1.0::DOUBLE / (60 + r), 6) AS score FROM p WHERE r <= 24) SELECT query_id, account, id, score, rank FROM ({_ranked('s', 8, 'score DESC, account, id')})""",
    "text_recall": f"""WITH {_GOLD}, tr AS (SELECT ranked.*, c.text_id FROM ranked JOIN document_chunks c ON c.id = ranked.id), once AS ({_FIRST.format(g='text_id', source='tr')}),
        own AS (SELECT v.id AS query_id, c.text_id FROM dv v JOIN document_chunks c ON c.id = v.id WHERE v.id % {DIVISOR} = 0 AND c.text_id IS NOT NULL),
        th AS (SELECT own.query_id, once.rank FROM own LEFT JOIN once ON once.query_id = own.query_id AND once.text_id = own.text_id)
        SELECT query_id, {_RECALLS}, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS rr FROM th GROUP BY query_id""",
    "corpus_means": f"""WITH {_GOLD}, m AS (SELECT query_id, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS rr FROM hits GROUP BY query_id)
        SELECT coalesce(c.corpus_code, 'unknown') AS code, count(*) AS n, round(avg(rr), 4) AS mean, round(avg(rr) FILTER (rr > 0), 4) AS mean_positive FROM m JOIN document_chunks c ON c.id = m.query_id GROUP BY 1""",
    "infer_rerank": f"""SELECT id, CASE {_RERANK_SQL} ELSE 'text_dedup' END AS mode, CASE WHEN len(t) > 0 AND len(list_filter(t, lambda x: x NOT IN ('pre-sectarian', 'theravada', 'judaism'))) = 0 THEN false WHEN len(l) > 0 THEN list_contains(l, 'en') ELSE true END AS lexical
        FROM (SELECT id, list_distinct(coalesce(traditions, [])) AS one, coalesce(traditions, []) AS t, coalesce(languages, []) AS l FROM api_usage)""",
    "recall_at_k": f"WITH {_GOLD} SELECT query_id, {_RECALLS} FROM hits GROUP BY query_id",
    "mrr": f"WITH {_GOLD} SELECT query_id, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS rr FROM hits GROUP BY query_id",
    "ndcg_binary": f"WITH {_GOLD}, x AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg, count(*) AS n FROM hits GROUP BY query_id) SELECT query_id, round(dcg, 6) AS ndcg_raw, round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 6) AS ndcg_ideal FROM x",
    "ndcg_graded_self": f"WITH {_GRADED} {_ndcg_sql('graded', 'gain')}",
    "ndcg_graded_max": f"WITH {_GRADED} {_ndcg_sql('graded', 'CASE WHEN gain > 0 THEN 2.0::DOUBLE ELSE 0 END')}",
    "source_ndcg": f"WITH {_GRADED}, once AS ({_FIRST.format(g='text_id', source='graded')}) {_ndcg_sql('once', 'gain')}",
    "eval_averages": f"""WITH {_GOLD}, m AS (SELECT query_id, {_RECALLS}, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS rr FROM hits GROUP BY query_id), l AS (SELECT m.*, coalesce(c.language, 'unknown') AS segment FROM m JOIN document_chunks c ON c.id = m.query_id)
        SELECT 'dense' AS system, segment, count(*) AS n, round(avg(r1), 4) AS r1, round(avg(r5), 4) AS r5, round(avg(r10), 4) AS r10, round(avg(rr), 4) AS rr FROM l GROUP BY segment UNION ALL SELECT 'dense', 'all', count(*), round(avg(r1), 4), round(avg(r5), 4), round(avg(r10), 4), round(avg(rr), 4) FROM l""",
    "pool_candidates": f"""WITH {_ITEM}, {_FTS}, u AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM item_dense UNION ALL SELECT query_id, id, rank FROM fts) GROUP BY ALL), h AS ({_ranked('u', 5)}),
        runs AS (SELECT 'fts_only' AS system, 0 AS p, query_id, id, rank FROM fts UNION ALL SELECT 'dense', 1, query_id, id, rank FROM item_dense UNION ALL SELECT 'hybrid', 2, query_id, id, rank FROM h)
        SELECT query_id, id, arg_min(system, p) AS first_seen_in FROM runs WHERE rank <= 5 GROUP BY ALL""",
}
