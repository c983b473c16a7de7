"""Vector functions: small ones as column expressions, bulk products on Arrow blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of a packed block, and best partners that a pair of blocks gives each query at most.
BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def packed(df: DataFrame, id_col: str, vector_col: str, tag_col: str | None = None) -> DataFrame:
    """(ids, units, tags): blocks of usable vectors as unit rows of float64 bytes, with the ids (and tags, if asked for) beside them."""
    tag = F.lit(0) if tag_col is None else F.col(tag_col)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), tag.cast("bigint").alias("tag")).where(f"v is not null and exists(v, x -> x <> 0) and not exists(v, x -> x is null or isnan(x))")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.array(part.column(1).to_pylist(), "f8")
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([part.column(2).to_pylist()], pa.list_(pa.int64()))], names=["ids", "units", "tags"])

    return rows.mapInArrow(run, "ids array<bigint>, units binary, tags array<bigint>")


def packed_by_tag(df: DataFrame, vector_col: str, tag_col: str) -> DataFrame:
    """(tags, units, whole): blocks of usable vectors in the order of their tags, as unit rows of float64 bytes; rows without a tag take no part.

    All vectors of a tag lie in one block, so that a product with the block gives
    the tag's maximum for good.  Only a tag with more than ``BLOCK`` vectors is
    split; its blocks hold nothing else and aren't ``whole``.
    """
    usable = "tag is not null and v is not null and exists(v, x -> x <> 0) and not exists(v, x -> x is null or isnan(x))"
    rows = df.select(F.col(vector_col).alias("v"), F.col(tag_col).cast("bigint").alias("tag")).where(usable)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags, x, split = np.empty(0, "i8"), np.empty((0, 0)), None
        for batch in chain(batches, [None]):  # the last tag at hand may go on in the next batch
            if batch is not None and batch.num_rows:
                more = np.array(batch.column(0).to_pylist(), "f8")
                more /= np.linalg.norm(more, axis=1, keepdims=True)
                tags, x = np.append(tags, batch.column(1).to_numpy()), np.concatenate([x, more]) if len(x) else more
            at = 0
            while at < len(tags) and (batch is None or at + BLOCK < len(tags)):
                stop = min(at + BLOCK, len(tags))
                if stop < len(tags):
                    if tags[at] == tags[stop]:
                        split = tags[at]
                    else:
                        stop = np.searchsorted(tags, tags[stop])
                whole = tags[at] != split
                if not whole:
                    stop = min(stop, np.searchsorted(tags, split, "right"))
                yield pa.RecordBatch.from_arrays([pa.array([tags[at:stop]], pa.list_(pa.int64())), pa.array([x[at:stop].tobytes()], pa.binary()), pa.array([bool(whole)])], names=["tags", "units", "whole"])
                at = stop
            tags, x = tags[at:], x[at:]

    return rows.repartition("tag").sortWithinPartitions("tag").mapInArrow(run, "tags array<bigint>, units binary, whole boolean")


def block_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, sim) of the best ``k`` of each pair of blocks; a window over the query leaves the best of all.

    Both sides are packed blocks, so the product of the two sides has a row for a
    pair of blocks, not of vectors, and neither side is broadcast by force.
    """
    pairs = queries.select(F.col("ids").alias("q"), F.col("units").alias("x")).crossJoin(vectors.select("ids", "units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, x, ids, y in zip(*(c.to_pylist() for c in batch.columns)):
                q, ids = np.array(q), np.array(ids)
                x, y = np.frombuffer(x).reshape(len(q), -1), np.frombuffer(y).reshape(len(ids), -1)
                sims = np.round(x @ y.T, 6)
                order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, order.shape[1])), pa.array(ids[order.ravel()]), pa.array(np.take_along_axis(sims, order, 1).ravel())], names=["query_id", "id", "sim"])

    return pairs.mapInArrow(run, "query_id bigint, id bigint, sim double")


def block_best(queries: DataFrame, vectors: DataFrame, groups: int | None = None) -> DataFrame:
    """(query_id, tag, id, sim): the best vector of each tag, from every pair of blocks; a reduction by query and tag leaves the best of all.

    ``vectors`` has the column ``tags`` beside the ids.  With ``groups`` a pair of
    blocks gives only its best tags: one of the best of all is among the best
    wherever its best vector lies.
    """
    pairs = queries.select(F.col("ids").alias("q"), F.col("units").alias("x")).crossJoin(vectors.select("ids", "tags", "units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, x, ids, tags, y in zip(*(c.to_pylist() for c in batch.columns)):
                q, ids, tags = np.array(q), np.array(ids), np.array(tags)
                order = np.lexsort((ids, tags))
                first = np.flatnonzero(np.r_[True, np.diff(tags[order]) != 0])
                sims = np.round(np.frombuffer(x).reshape(len(q), -1) @ np.frombuffer(y).reshape(len(ids), -1).T, 6)[:, order]
                best = np.maximum.reduceat(sims, first, axis=1)
                where = np.where(sims == np.repeat(best, np.diff(np.r_[first, len(ids)]), axis=1), ids[order], np.iinfo("i8").max)
                at = np.minimum.reduceat(where, first, axis=1)
                kept = np.lexsort((at, -best), axis=1)[:, :groups]
                take = lambda a: np.take_along_axis(a, kept, 1).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, kept.shape[1])), pa.array(tags[order][first][kept.ravel()]), pa.array(take(at)), pa.array(take(best))], names=["query_id", "tag", "id", "sim"])

    return pairs.mapInArrow(run, "query_id bigint, tag bigint, id bigint, sim double")


def tag_maxima(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, tag, sim): the greatest similarity of each tag's vectors.  Both sides are ``packed_by_tag``; a query's tag is its id.

    The result has a row for every query and tag and goes from the product straight
    to the reader; only the maxima of split tags, one for a query and block, are
    shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, x, tags, y in zip(*(c.to_pylist() for c in batch.columns)):
                q, tags = np.array(q), np.array(tags)
                one, first = (np.flatnonzero(np.r_[True, np.diff(a) != 0]) for a in (q, tags))
                sims = np.frombuffer(y).reshape(len(tags), -1) @ np.frombuffer(x).reshape(len(q), -1).T
                best = np.maximum.reduceat(sims, first, axis=0).T
                if len(one) < len(q):
                    best = np.maximum.reduceat(best, one, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q[one], len(first))), pa.array(np.tile(tags[first], len(one))), pa.array((np.round(best, 6) + 0.0).ravel())], names=["query_id", "tag", "sim"])

    def found(queries: DataFrame, vectors: DataFrame) -> DataFrame:
        pairs = queries.select(F.col("tags").alias("q"), F.col("units").alias("x")).crossJoin(vectors.select("tags", "units"))
        return pairs.mapInArrow(run, "query_id bigint, tag bigint, sim double")

    whole, parts = "whole", "not whole"
    split = found(queries.where(whole), vectors.where(parts)).unionByName(found(queries.where(parts), vectors))
    return found(queries.where(whole), vectors.where(whole)).unionByName(split.groupBy("query_id", "tag").agg(F.max("sim").alias("sim")))
