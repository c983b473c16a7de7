"""Ranked lists: dense and lexical search, fusion, boosts and reranking.

All lists have the form (query_id, id, rank, score); every order ends with the id,
so that no tie is left open.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import lexemes, query_terms, term_rank
from lectern.functions.vector import BLOCK, block_best, block_topk, cosine, packed, packed_by_tag, tag_maxima
from lectern.session import cut

#: Constants of reciprocal-rank fusion: damping, weights of the two lists, boost of an entity, size of the pool.
RRF_K, DENSE_WEIGHT, LEXICAL_WEIGHT, ENTITY_BOOST, POOL = 60, 0.7, 0.3, 0.25, 60
MMR_LAMBDA = 0.7
# The rerank mode of each tradition; any other gets one result a text.
TRADITION_RERANK = {
    "islam": "none", "theravada": "text_dedup", "pre-sectarian": "text_dedup", "early-buddhist": "text_dedup", "sarvastivada": "text_dedup",
    "mahasanghika": "text_dedup", "dharmaguptaka": "text_dedup", "judaism": "text_dedup", "christianity": "text_dedup", "hinduism": "mmr",
    "hellenism": "text_dedup", "classicism": "none", "east-asian": "none", "sikhism": "none", "zoroastrianism": "none",
    "western-philosophy": "text_dedup", "political-philosophy": "text_dedup",
}
# Traditions and languages for which a lexical list adds nothing, or alone adds something.
NO_LEXICAL_TRADITIONS, LEXICAL_LANGUAGES = ("pre-sectarian", "theravada", "judaism"), ("en",)


def top(df: DataFrame, k: int, *order: Column | str, by: str = "query_id") -> DataFrame:
    """The first ``k`` rows of each query with their rank from 1."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense(queries: DataFrame, vectors: DataFrame, k: int = POOL) -> DataFrame:
    """(query_id, id, score, rank): exact cosine search of all queries; both sides are (id, embedding)."""
    found = block_topk(packed(queries, "id", "embedding"), packed(vectors, "id", "embedding"), k)
    return top(found.withColumnRenamed("sim", "score"), k, F.desc("score"), "id")


def lexical(queries: DataFrame, texts: DataFrame, k: int = POOL) -> DataFrame:
    """(query_id, id, score, rank): texts with any term of the query, by their summed term ranks.

    ``queries`` and ``texts`` are (id, text).  Term frequencies are counted by
    text before they meet the query terms; a stop word meets its postings once.
    """
    q = queries.select(F.col("id").alias("query_id"), query_terms(F.col("text")).alias("terms")).where("size(terms) > 0")
    q = q.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    wanted = q.select("term").distinct()
    postings = texts.where("text is not null").select("id", F.explode(lexemes(F.col("text"))).alias("term"))
    counted = postings.join(wanted, "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("tf"))
    scored = q.join(counted, "term").groupBy("query_id", "id").agg(F.round(F.sum(term_rank(F.col("tf")) / F.col("n")), 6).alias("score"))
    return top(scored, k, F.desc("score"), "id")


def _clauses(text: str) -> list[tuple[int, int, bool, list[str]]]:
    """(group, number, without, lexemes) of the clauses of a query: groups are joined by OR, a clause of several lexemes is a phrase."""
    groups: list[dict[tuple[bool, tuple[str, ...]], None]] = [{}]
    for minus, phrase, word in re.findall(r'(?<!\S)(-?)"([^"]*)"|(\S+)', text.lower()):
        if word == "or":
            groups.append({})
            continue
        if terms := re.findall(r"\w+", word or phrase):
            groups[-1][minus == "-" or word.startswith("-"), tuple(terms)] = None
    return [(g, n, without, list(terms)) for g, clauses in enumerate(groups) for n, (without, terms) in enumerate(clauses)]


def websearch(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, id): texts that hold all words and quoted phrases of the query, or of one of its parts between OR, and none of those after a minus sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *c) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in _clauses(t or "")]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["query_id", "g", "n", "without", "terms"])

    q = queries.select(F.col("id").cast("bigint").alias("id"), "text").mapInArrow(run, "query_id bigint, g int, n int, without boolean, terms array<string>")
    texts = texts.where("text is not null").select("id", lexemes(F.col("text")).alias("words"))
    clause = ["query_id", "g", "n", "without"]
    words = q.where("size(terms) = 1").select(*clause, F.col("terms")[0].alias("term"))
    hits = texts.select("id", F.explode(F.array_distinct("words")).alias("term")).join(words, "term").select(*clause, "id")
    # a phrase stands where all its lexemes agree on its first position
    phrases = q.where("size(terms) > 1").select(*clause, F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    met = texts.select("id", F.posexplode("words").alias("at", "term")).join(phrases, "term")
    starts = met.groupBy(*clause, "size", "id", (F.col("at") - F.col("offset")).alias("start")).count().where("count = size")
    hits = hits.unionByName(starts.select(*clause, "id").distinct())
    got = hits.groupBy("query_id", "g", "id").agg(F.count_if(~F.col("without")).alias("got"), F.count_if("without").alias("banned"))
    need = q.groupBy("query_id", "g").agg(F.count_if(~F.col("without")).alias("need"))
    found = got.join(need.where("need > 0"), ["query_id", "g"]).where("got = need and banned = 0").select("query_id", "id")
    # a part with minus signs only holds for all other texts
    rest = need.where("need = 0").crossJoin(texts.select("id")).join(got.where("banned > 0"), ["query_id", "g", "id"], "left_anti").select("query_id", "id")
    return found.unionByName(rest).distinct()


def rrf_weighted(a: DataFrame, b: DataFrame, k: int = POOL) -> DataFrame:
    """Two lists fused by weighted reciprocal ranks from 1."""
    part = lambda df, w: df.select("query_id", "id", (F.lit(w) / (RRF_K + F.col("rank"))).alias("part"))
    both = part(a, DENSE_WEIGHT).unionByName(part(b, LEXICAL_WEIGHT)).groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    return top(both, k, F.desc("score"), "id")


def rrf_plain(lists: list[DataFrame], base: int, depth: int | None = None) -> DataFrame:
    """Lists fused without weights; ``base`` is the number of the first rank, ``depth`` cuts the result."""
    union = None
    for df in lists:
        part = df.select("query_id", "id", (F.lit(1.0) / (RRF_K + F.col("rank") - 1 + base)).alias("part"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = fused.withColumn("rank", F.row_number().over(w))
    return ranked if depth is None else ranked.where(F.col("rank") <= depth)


def entity_boost(ranked: DataFrame, tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """The list with the boost for every result that holds a wanted entity, ranked again.

    ``tags`` is (id, entity_ids), ``wanted`` (query_id, entities).
    """
    boosted = ranked.join(tags, "id", "left").join(wanted, "query_id", "left")
    hit = F.coalesce(F.arrays_overlap("entity_ids", "entities"), F.lit(False))
    scored = boosted.select("query_id", "id", F.round(F.col("score") + F.when(hit, ENTITY_BOOST).otherwise(0.0), 9).alias("score"), F.col("rank").alias("before"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "before")
    return scored.withColumn("rank", F.row_number().over(w)).drop("before")


def first_of_group(ranked: DataFrame, group: Column | str, k: int | None = None) -> DataFrame:
    """The best result of each group of a query, ranked again; a result without a group stays."""
    key = group if isinstance(group, Column) else F.col(group)
    keyed = ranked.withColumn("__g", F.coalesce(key.cast("string"), F.concat(F.lit("id:"), F.col("id").cast("string"))))
    best = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "__g").orderBy("rank"))).where("__n = 1").drop("__n", "__g")
    again = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return again if k is None else again.where(F.col("rank") <= k)


def two_level(ranked: DataFrame, group: str, groups: int = 8, each: int = 3) -> DataFrame:
    """The best rows of the best groups: groups by their best rank, ``each`` rows of a group."""
    inside = Window.partitionBy("query_id", group).orderBy("rank")
    rows = ranked.withColumn("__best", F.min("rank").over(Window.partitionBy("query_id", group))).withColumn("__m", F.row_number().over(inside))
    rows = rows.withColumn("__g", F.dense_rank().over(Window.partitionBy("query_id").orderBy("__best"))).where((F.col("__g") <= groups) & (F.col("__m") <= each))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("__g", "__m"))).drop("__best", "__g", "__m")


def group_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, tag, score): each group's greatest similarity over all vectors, of every group.

    ``queries`` is (id, embedding), ``vectors`` (id, embedding, tag); rows without a
    tag take no part.  Both sides are packed once, before their blocks meet.
    """
    found = tag_maxima(cut(packed_by_tag(queries, "embedding", "id")), cut(packed_by_tag(vectors, "embedding", "tag")))
    return found.withColumnRenamed("sim", "score")


def group_maxima(queries: DataFrame, vectors: DataFrame, groups: int | None = None) -> DataFrame:
    """(query_id, tag, id, score): each group's best vector over all vectors, of every group or of the best ``groups`` at least.

    ``queries`` is (id, embedding), ``vectors`` (id, embedding, tag); rows without a tag take no part.
    """
    found = block_best(packed(queries, "id", "embedding"), packed(vectors.where("tag is not null"), "id", "embedding", "tag"), groups)
    best = found.groupBy("query_id", "tag").agg(F.max_by(F.struct("sim", "id"), F.struct("sim", -F.col("id"))).alias("b"))
    return best.select("query_id", "tag", "b.id", F.col("b.sim").alias("score"))


def two_level_full(queries: DataFrame, vectors: DataFrame, groups: int = 8, each: int = 3) -> DataFrame:
    """(query_id, id, tag, score, rank): the best groups by their maximum over all vectors, and of each its best rows, wherever they rank."""
    chosen = top(group_maxima(queries, vectors, groups), groups, F.desc("score"), "id").select("query_id", "tag", F.col("rank").alias("g"))
    usable = lambda df: df.where("exists(embedding, x -> x <> 0) and not exists(embedding, x -> x is null or isnan(x))")
    rows = chosen.join(usable(vectors), "tag").join(usable(queries).select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    rows = rows.select("query_id", "id", "tag", "g", (F.round(cosine(F.col("q"), F.col("embedding")), 6) + 0.0).alias("score"))
    inside = Window.partitionBy("query_id", "g").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("m", F.row_number().over(inside)).where(F.col("m") <= each)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("g", "m"))).drop("g", "m")


def mmr(ranked: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int, weight: float = MMR_LAMBDA) -> DataFrame:
    """(query_id, id, rank): maximal marginal relevance over each query's pool, by raw dot products.

    A pool holds at most what the list's depth allows, so a group is bounded.
    Results without a vector are left out.
    """
    pool = ranked.select("query_id", "id", "rank").join(vectors.select("id", "embedding"), "id").join(query_vectors.select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), "query_id")

    def pick(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("rank")
        x = np.array(df["embedding"].tolist(), "f8")
        relevance = x @ np.array(df["q"].iloc[0], "f8")
        chosen: list[int] = []
        closest = np.full(len(df), -np.inf)
        while len(chosen) < min(k, len(df)):
            score = relevance if not chosen else weight * relevance - (1 - weight) * closest
            score = np.round(score, 9)
            score[chosen] = -np.inf
            best = min(range(len(df)), key=lambda i: (-score[i], df["id"].iloc[i]))
            chosen.append(best)
            closest = np.maximum(closest, x @ x[best])
        return pd.DataFrame({"query_id": df["query_id"].iloc[chosen].to_numpy(), "id": df["id"].iloc[chosen].to_numpy(), "rank": np.arange(1, len(chosen) + 1)})

    return pool.groupBy("query_id").applyInPandas(pick, "query_id bigint, id bigint, rank int")


def merge_shards(ranked: DataFrame, shard: str, k: int) -> DataFrame:
    """One list from those of all shards: each shard's rank counts, its score doesn't; ids are unique by shard."""
    inside = Window.partitionBy("query_id", shard).orderBy("rank")
    rows = ranked.withColumn("__r", F.row_number().over(inside)).where(F.col("__r") <= 3 * k)
    rows = rows.select("query_id", shard, "id", F.round(F.lit(1.0) / (RRF_K + F.col("__r")), 6).alias("score"))
    return top(rows, k, F.desc("score"), shard, "id")


def rerank_mode(corpus_modes: dict[str, str], corpora: Column, traditions: Column) -> Column:
    """The rerank mode of a scope: a single corpus first, then a single tradition, else one result a text."""
    mode = F.lit("text_dedup")
    one = F.array_distinct(F.coalesce(traditions, F.array().cast("array<string>")))
    for tradition, value in TRADITION_RERANK.items():
        mode = F.when((F.size(one) == 1) & (F.get(one, 0) == tradition), value).otherwise(mode)
    single = F.array_distinct(F.coalesce(corpora, F.array().cast("array<string>")))
    for corpus, value in corpus_modes.items():
        mode = F.when((F.size(single) == 1) & (F.get(single, 0) == corpus), value).otherwise(mode)
    return mode


def uses_lexical(traditions: Column, languages: Column) -> Column:
    """Whether a scope gains from the lexical list."""
    none = F.array().cast("array<string>")
    t, lang = F.coalesce(traditions, none), F.coalesce(languages, none)
    useless = (F.size(t) > 0) & (F.size(F.array_except(t, F.array(*map(F.lit, NO_LEXICAL_TRADITIONS)))) == 0)
    return F.when(useless, False).when(F.size(lang) > 0, F.arrays_overlap(lang, F.array(*map(F.lit, LEXICAL_LANGUAGES)))).otherwise(True)


def _unit_rows(column: pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), "f8")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def ivf_search(queries: DataFrame, vectors: DataFrame, k: int = 10, probes: int | None = None, sample: int = 20_000) -> DataFrame:
    """(query_id, id, score, rank): search of the nearest lists only.

    There are as many lists as the root of the number of rows, at least 10.  Their
    centres are fitted on a bounded sample by a few rounds of spherical k-means;
    every row is kept in the list of its nearest centre, every query looks into
    ``probes`` of them, twice the root of their number by default.  A list is kept
    as blocks of at most about ``BLOCK`` vectors, so a large one is spread over
    tasks; queries meet blocks, each pair is one product and gives its best ``k``.
    """
    usable = "embedding is not null and exists(embedding, x -> x <> 0) and not exists(embedding, x -> x is null or isnan(x))"
    vectors, queries = vectors.where(usable).select("id", "embedding"), queries.where(usable).select("id", "embedding")
    n = vectors.count()
    if not n:
        return dense(queries, vectors, k)
    drawn = _unit_rows(vectors.orderBy(F.xxhash64("id")).limit(sample).select("embedding").toArrow().column(0))
    centres = drawn[: max(10, math.isqrt(n))]
    for _ in range(8):
        nearest = np.argmax(drawn @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, drawn)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    probes = min(len(centres), probes or 2 * math.isqrt(len(centres)))
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def placed(many: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _unit_rows(batch.column(1))
                    near = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :many]
                    rows = [r.tobytes() for r in x]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), near.shape[1])), pa.array([r for r in rows for _ in range(near.shape[1])], pa.binary()), pa.array(near.ravel())], names=["id", "unit", "list"])

        return run

    schema = "id bigint, unit binary, list bigint"
    index = vectors.mapInArrow(placed(1), schema)
    # every list is dealt out to so many blocks that the largest list has blocks of the wanted size
    parts = max(1, math.ceil((index.groupBy("list").count().agg(F.max("count")).first()[0] or 1) / BLOCK))
    block = lambda df, many: df.groupBy("list", F.pmod(F.xxhash64("id"), F.lit(many)).alias("part")).agg(F.collect_list("id").alias("ids"), F.collect_list("unit").alias("units"))
    asked = block(queries.mapInArrow(placed(probes), schema), max(1, math.ceil(queries.count() / BLOCK))).select("list", F.col("ids").alias("q"), F.col("units").alias("x"))
    pairs = asked.join(block(index, parts), "list").select("q", "x", "ids", "units")

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, x, ids, y in zip(*(c.to_pylist() for c in batch.columns)):
                q, ids = np.array(q), np.array(ids)
                x, y = (np.frombuffer(b"".join(m)).reshape(len(m), -1) for m in (x, y))
                sims = np.round(x @ y.T, 6)
                order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, order.shape[1])), pa.array(ids[order.ravel()]), pa.array(np.take_along_axis(sims, order, 1).ravel())], names=["query_id", "id", "score"])

    return top(pairs.mapInArrow(multiplied, "query_id bigint, id bigint, score double"), k, F.desc("score"), "id")
