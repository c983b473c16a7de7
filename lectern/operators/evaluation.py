"""Retrieval metrics in bulk over (query_id, id, rank) and relevance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEPTHS = (1, 3, 5, 10, 15)


def _hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """All gold rows with the rank at which they were found, null if they weren't."""
    return gold.select("query_id", "id").distinct().join(ranked.select("query_id", "id", "rank"), ["query_id", "id"], "left")


def recall_at(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, r1 ...): whether any gold row is among the first k."""
    best = _hits(ranked, gold).groupBy("query_id").agg(F.min("rank").alias("best"))
    return best.select("query_id", *(F.coalesce((F.col("best") <= k).cast("int"), F.lit(0)).alias(f"r{k}") for k in DEPTHS))


def reciprocal_rank(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, rr): one by the rank of the first gold row, 0 if there is none."""
    best = _hits(ranked, gold).groupBy("query_id").agg(F.min("rank").alias("best"))
    return best.select("query_id", F.round(F.coalesce(1.0 / F.col("best"), F.lit(0.0)), 6).alias("rr"))


def ndcg_binary(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg_raw, ndcg_ideal): gain of the gold rows among the first k, without and with the ideal order's gain."""
    gain = F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    raw = _hits(ranked, gold).groupBy("query_id").agg(F.sum(F.coalesce(gain, F.lit(0.0))).alias("dcg"), F.count("*").alias("golds"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("golds", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return raw.select("query_id", F.round("dcg", 6).alias("ndcg_raw"), F.round(F.col("dcg") / ideal, 6).alias("ndcg_ideal"))


def ndcg_graded(ranked: DataFrame, k: int = 5, most: float | None = None) -> DataFrame:
    """(query_id, ndcg) of (query_id, rank, gain): against the list's own best order, or against ``most`` for every positive."""
    own = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "rank"))
    rows = ranked.withColumn("best", own)
    dcg = F.sum(F.when(F.col("rank") <= k, F.col("gain") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    wanted = F.col("gain") if most is None else F.when(F.col("gain") > 0, F.lit(most)).otherwise(0.0)
    ideal = F.sum(F.when(F.col("best") <= k, wanted / F.log2(F.col("best") + 1)).otherwise(0.0))
    return rows.groupBy("query_id").agg(dcg.alias("d"), ideal.alias("i")).select("query_id", F.round(F.when(F.col("i") > 0, F.col("d") / F.col("i")).otherwise(0.0), 6).alias("ndcg"))


def averages(metrics: DataFrame, keys: tuple[str, str], values: tuple[str, ...]) -> DataFrame:
    """Means by both keys and over all of the second, which then reads ``all``."""
    rows = metrics.rollup(*keys).agg(F.count("*").alias("n"), *(F.round(F.avg(v), 4).alias(v) for v in values), F.grouping(keys[1]).alias("g"), F.grouping(keys[0]).alias("g0"))
    return rows.where("g0 = 0").select(keys[0], F.when(F.col("g") == 1, "all").otherwise(F.col(keys[1])).alias(keys[1]), "n", *values)


def pool(runs: DataFrame, depth: int = 5) -> DataFrame:
    """(query_id, id, first_seen_in): the first ``depth`` of all systems once, with the first system that gave each.

    ``runs`` is (system, priority, query_id, id, rank).
    """
    rows = runs.where(F.col("rank") <= depth)
    return rows.groupBy("query_id", "id").agg(F.min_by("system", F.struct("priority", "rank")).alias("first_seen_in"))
