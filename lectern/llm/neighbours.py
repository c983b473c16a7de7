"""Problem 5: the most similar vectors of every vector.

NN-descent as Spark joins.  A first graph comes from random-projection trees:
vectors are sorted by their leaf and by a projection inside it, range
partitioned, and compared within consecutive blocks, so no leaf, however large,
lands in one task.  Then each round joins every vertex with its neighbours and
reverse neighbours (neighbours of neighbours meet at the vertex between them),
compares them there, and keeps the best per vertex.  The graph holds vectors as
bytes; a last join compares the kept candidates with the stored floats.
``graph_search`` answers queries by greedy search over the finished graph.

Defined results: null, empty, all-zero and non-finite vectors and vectors of
another length than most take no part; equal directions form one vertex and are
expanded afterwards, ties going to the smaller id; a repeated id counts once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.relational import split_join
from lectern.session import cut, spread

#: Vectors from which the trees are fitted (a bounded sample), and rows compared with each other at once.
SAMPLE, BLOCK = 20_000, 256
#: Trees, candidates kept per vertex, reverse neighbours that take part in a round, rounds at most.
TREES, WIDTH, REVERSE, ROUNDS = 3, 14, 10, 8
#: Share of the edges that a round must have changed for another one to follow.
CHANGED = 0.03
#: Best partners that each member of a comparison offers, and those a tree's block offers.
OFFERED = 4
GRAPH = "u bigint, v bigint, sim float, fresh boolean"


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column of equally long values as rows of a matrix."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.empty((0, 0), kind)
    ends = np.frombuffer(column.buffers()[1], "i8")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "u1")[ends[0] : ends[-1]].reshape(len(column), -1).view(kind)


def _binaries(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _directions(code: np.ndarray) -> np.ndarray:
    x = code.astype("f4")
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, unit, code): the direction as float32 and as int8 bytes, of every usable vector."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where("id is not null and size(vector) > 0")
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = common["n"] if common else 1
    rows = rows.where(F.size("vector") == dim).dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype("f4").reshape(-1, dim)
            peak = np.abs(x).max(axis=1, keepdims=True)
            good = np.isfinite(peak[:, 0]) & (peak[:, 0] > 0)
            x = x[good] / peak[good]
            code = np.rint(x * 127).astype("i1")
            unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4") + np.float32(0)
            if good.any():
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), _binaries(unit), _binaries(code)], names=["id", "unit", "code"])

    return rows.mapInArrow(run, "id bigint, unit binary, code binary")


def _fit_tree(sample: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hyperplanes and thresholds of a tree in heap order, by medians of the sample."""
    rng = np.random.default_rng(seed)
    planes, cuts = np.zeros((2**depth, sample.shape[1]), "f4"), np.zeros(2**depth, "f4")
    parts = {1: np.arange(len(sample))}
    for at in range(1, 2**depth):
        part = parts.pop(at, np.empty(0, int))
        if len(part) > 1:
            a, b = rng.choice(part, 2, replace=False)
            plane = sample[a] - sample[b]
        else:
            plane = rng.standard_normal(sample.shape[1])
        plane = plane / max(np.linalg.norm(plane), 1e-9)
        side = sample[part] @ plane
        planes[at], cuts[at] = plane, np.median(side) if len(part) else 0.0
        parts[2 * at], parts[2 * at + 1] = part[side <= cuts[at]], part[side > cuts[at]]
    return planes, cuts


def _best(sims: np.ndarray, n: int) -> np.ndarray:
    n = min(n, sims.shape[1] - 1)
    return np.argpartition(-sims, n, axis=1)[:, :n] if n > 0 else np.empty((len(sims), 0), int)


def _edge_batch(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim.astype("f4")), pa.array(np.ones(len(u), bool))], names=["u", "v", "sim", "fresh"])


def _leaves(x: np.ndarray, planes: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    at = np.ones(len(x), int)
    for _ in range(depth):
        at = 2 * at + (np.einsum("ij,ij->i", x, planes[at]) > cuts[at])
    return at


def _tree_edges(nodes: DataFrame, n: int, sample: np.ndarray, depth: int, seed: int) -> DataFrame:
    """Edges inside the consecutive blocks of one tree.

    Below the depth that the sample can fit, a leaf is split on by random
    hyperplanes through the mean of its part of the sample, one for each further
    halving that the number of vectors asks for.
    """
    planes, cuts = _fit_tree(sample, depth, seed)
    rng = np.random.default_rng(seed + 7919)
    along = rng.standard_normal(sample.shape[1]).astype("f4")
    more = max(0, min(40, math.ceil(math.log2(max(n, 1) / BLOCK)) - depth))
    further = rng.standard_normal((sample.shape[1], more)).astype("f4")
    means = np.zeros((2 ** (depth + 1), sample.shape[1]), "f4")
    leaf = _leaves(sample, planes, cuts, depth)
    np.add.at(means, leaf, sample)
    means /= np.maximum(np.bincount(leaf, minlength=len(means)), 1)[:, None]
    shared = nodes.sparkSession.sparkContext.broadcast((planes, cuts, along, further, means @ further))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, cuts, along, further, middle = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _directions(_matrix(batch.column(1), "i1"))
            at = _leaves(x, planes, cuts, depth)
            sides = x @ further > middle[at]
            for k in range(more):
                at = 2 * at + sides[:, k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64()), pa.array((x @ along).astype("f8"))], names=["id", "code", "leaf", "place"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes = np.empty(0, "i8"), None

        def block(ids: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
            x = _directions(codes)
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            near = _best(sims, WIDTH)
            return _edge_batch(np.repeat(ids, near.shape[1]), ids[near.ravel()], np.take_along_axis(sims, near, 1).ravel())

        for batch in batches:
            if not batch.num_rows:
                continue
            more = _matrix(batch.column(1), "i1")
            ids, codes = np.concatenate([ids, batch.column(0).to_numpy()]), more if codes is None else np.concatenate([codes, more])
            while len(ids) >= 2 * BLOCK:
                yield block(ids[:BLOCK], codes[:BLOCK])
                ids, codes = ids[BLOCK:], codes[BLOCK:]
        if len(ids) > 1:
            yield block(ids, codes)

    keyed = nodes.mapInArrow(placed, "id bigint, code binary, leaf bigint, place double")
    # a partition holds several blocks, so that few of them are cut short at its end
    parts = max(1, min(n // (4 * BLOCK), max(nodes.sparkSession.sparkContext.defaultParallelism, nodes.rdd.getNumPartitions())))
    return keyed.repartitionByRange(parts, "leaf", "place").sortWithinPartitions("leaf", "place").select("id", "code").mapInArrow(compared, GRAPH)


def _kept(edges: DataFrame, width: int) -> DataFrame:
    """(u, near): the best ``width`` distinct neighbours of each vertex, the best first."""
    lists = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    lists = lists.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("sim", "v", "fresh")), False).alias("near"))
    return lists.select("u", F.slice("near", 1, width).alias("near"))


def _round(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges found by comparing, at each vertex, its neighbours and reverse neighbours with one another."""
    ahead = graph.select("u", F.explode("near").alias("e")).select(F.col("u").alias("at"), F.col("e.v").alias("m"), F.col("e.fresh").alias("fresh"))
    few = Window.partitionBy("at").orderBy(F.xxhash64("at", "m"))
    behind = ahead.select(F.col("m").alias("at"), F.col("at").alias("m"), "fresh").withColumn("n", F.row_number().over(few)).where(F.col("n") <= REVERSE).drop("n")
    members = ahead.unionByName(behind).groupBy("at", "m").agg(F.max("fresh").alias("fresh"))
    worst = graph.select(F.col("u").alias("m"), F.when(F.size("near") >= WIDTH, F.element_at("near", -1)["sim"]).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    carried = members.join(nodes.select(F.col("id").alias("m"), "code").join(worst, "m", "left"), "m")
    met = carried.groupBy("at").agg(F.collect_list(F.struct("m", "fresh", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"), "code")).alias("l")).where("exists(l, x -> x.fresh)").select("l")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            ids, fresh = flat.field("m").to_numpy(), flat.field("fresh").to_numpy(zero_copy_only=False)
            worst, x = flat.field("worst").to_numpy(), _directions(_matrix(flat.field("code"), "i1"))
            found, at = [], 0
            for n in sizes:
                part = slice(at, at := at + int(n))
                if n < 2:
                    continue
                sims = x[part] @ x[part].T
                np.fill_diagonal(sims, -2)
                sims[~(fresh[part][:, None] | fresh[part][None, :])] = -2
                near = _best(sims, OFFERED)
                s = np.take_along_axis(sims, near, 1)
                row, col = np.nonzero(s > np.maximum(worst[part], -1.5)[:, None])
                found.append((ids[part][row], ids[part][near[row, col]], s[row, col]))
            if found:
                u, v, s = (np.concatenate(c) for c in zip(*found))
                order = np.lexsort((v, u))
                first = np.ones(len(u), bool)
                first[1:] = (np.diff(u[order]) != 0) | (np.diff(v[order]) != 0)
                order = order[first]
                yield _edge_batch(u[order], v[order], s[order])

    return met.mapInArrow(run, GRAPH)


def neighbour_graph(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(u, near): approximate nearest neighbours of each vertex of ``nodes`` (id, code); rounds go on while they change enough."""
    n = nodes.count()
    depth = max(0, min(math.ceil(math.log2(max(n, 1) / BLOCK)), int(math.log2(SAMPLE / 32))))
    drawn = nodes.orderBy(F.xxhash64("id")).limit(SAMPLE).select("code").toArrow()
    sample = _directions(_matrix(drawn.column(0).combine_chunks(), "i1")) if drawn.num_rows else np.zeros((1, 1), "f4")
    edges = None
    for seed in range(TREES):
        part = _tree_edges(nodes, n, sample, depth, seed)
        edges = part if edges is None else edges.unionByName(part)
    graph = cut(_kept(edges, WIDTH))
    old = F.transform("near", lambda e: F.struct(e["sim"].alias("sim"), e["v"].alias("v"), e["fresh"].alias("fresh")))
    for _ in range(rounds):
        found = _round(graph, nodes)
        stale = graph.select("u", F.explode(old).alias("e")).select("u", "e.v", "e.sim", F.lit(False).alias("fresh"))
        graph = cut(_kept(stale.unionByName(found), WIDTH))
        changed = graph.agg(F.sum(F.size(F.filter("near", lambda e: e["fresh"]))) / F.sum(F.size("near"))).first()[0]
        if (changed or 0.0) < CHANGED:
            break
    return graph


def _exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cosine) by the stored floats, for distinct pairs a < b."""
    both = pairs.join(vectors.select(F.col("id").alias("a"), F.col("unit").alias("x")), "a").join(vectors.select(F.col("id").alias("b"), F.col("unit").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = np.einsum("ij,ij->i", _matrix(batch.column(2), "f4"), _matrix(batch.column(3), "f4"), dtype="f8")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], names=["a", "b", "cosine"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, cosine double")


def _vertices(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, rep): the vertex of each vector; and the vertices (id, unit, code)."""
    keyed = vectors.withColumn("key", F.md5("unit"))
    first = keyed.groupBy("key").agg(F.min("id").alias("rep"))
    members = cut(keyed.select("key", "id").join(first, "key").select("id", "rep"))
    nodes = cut(vectors.join(members.where("id = rep").select("id"), "id"))
    return members, nodes


def nearest_neighbours(df: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding", k: int = 8) -> DataFrame:
    """(id, neighbour, cosine, rank): the ``k`` most similar other rows of every usable row."""
    vectors = usable_vectors(spread(df.select(id_col, vector_col)), id_col, vector_col)
    members, nodes = _vertices(cut(vectors))
    graph = neighbour_graph(nodes.select("id", "code"))
    edges = graph.select("u", F.explode("near.v").alias("v"))
    pairs = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    exact = cut(_exact(pairs, nodes))
    # both directions, and the vertex itself for its copies; of a vertex only the k + 1 smallest ids can be neighbours
    best = Window.partitionBy("u").orderBy(F.desc("cosine"), "v")
    both = exact.select(F.col("a").alias("u"), F.col("b").alias("v"), "cosine").unionByName(exact.select(F.col("b").alias("u"), F.col("a").alias("v"), "cosine"))
    both = both.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")
    copied = members.groupBy("rep").count().where("count > 1").select("rep")
    both = both.unionByName(copied.select(F.col("rep").alias("u"), F.col("rep").alias("v"), F.lit(1.0).alias("cosine")))
    small = Window.partitionBy("rep").orderBy("id")
    targets = members.withColumn("n", F.row_number().over(small)).where(F.col("n") <= k + 1).select(F.col("rep").alias("v"), F.col("id").alias("neighbour"))
    sources = members.select(F.col("rep").alias("u"), "id")
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    # the copies of one vector may be a third of all rows
    spreaded = split_join(sources, both.join(targets, "v"), ["u"]).where("id <> neighbour")
    return spreaded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "neighbour", "cosine", "rank")


def graph_search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, k: int = 8, beam: int = 16, rounds: int = 40, entries: int = 2048) -> DataFrame:
    """(query, v, sim): greedy search of all queries at once over a finished graph.

    ``queries`` is (query, code).  The beam of each query starts at the best of a
    bounded set of entry vertices; every round joins its unvisited members with
    the graph, compares the new vertices, and keeps the best.  The search ends when
    no beam has an unvisited member.
    """
    drawn = nodes.orderBy(F.xxhash64("id", F.lit(1))).limit(entries).select("id", "code").toArrow()
    start_ids = drawn.column(0).to_numpy()
    start = _directions(_matrix(drawn.column(1).combine_chunks(), "i1")) if drawn.num_rows else np.zeros((0, 1), "f4")
    shared = nodes.sparkSession.sparkContext.broadcast((start_ids, start))

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            sims = _directions(_matrix(batch.column(1), "i1")) @ x.T
            near = _best(sims, beam)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), near.shape[1])), pa.array(ids[near.ravel()]), pa.array(np.take_along_axis(sims, near, 1).ravel().astype("f4")), pa.array(np.zeros(near.size, bool))],
                names=["query", "v", "sim", "seen"],
            )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sim = np.einsum("ij,ij->i", _directions(_matrix(batch.column(2), "i1")), _directions(_matrix(batch.column(3), "i1")))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim.astype("f4")), pa.array(np.zeros(len(sim), bool))], names=["query", "v", "sim", "seen"])

    kind = "query bigint, v bigint, sim float, seen boolean"
    best = Window.partitionBy("query").orderBy(F.desc("sim"), "v")
    state = cut(queries.mapInArrow(entered, kind))
    ahead = graph.select("u", F.explode("near.v").alias("v"))
    behind = ahead.select(F.col("v").alias("u"), F.col("u").alias("v")).withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v")))).where(F.col("n") <= 2 * REVERSE).drop("n")
    links = cut(ahead.unionByName(behind).groupBy(F.col("u").alias("v")).agg(F.collect_set("v").alias("near")))
    for _ in range(rounds):
        open_ = state.where("not seen")
        if open_.isEmpty():
            break
        reached = open_.join(links, "v").select("query", F.explode("near").alias("v")).distinct().join(state.select("query", "v"), ["query", "v"], "left_anti")
        new = reached.join(queries, "query").withColumnRenamed("code", "x").join(nodes.select(F.col("id").alias("v"), "code"), "v").select("query", "v", "x", "code").mapInArrow(scored, kind)
        merged = state.withColumn("seen", F.lit(True)).unionByName(new)
        state = cut(merged.withColumn("n", F.row_number().over(best)).where(F.col("n") <= 4 * beam).withColumn("seen", F.expr(f"seen or n > {beam}")).drop("n"))
    return state.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("query", "v", "sim")


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, neighbour_id, cosine, rank): the 8 most similar chunks of every usable vector."""
    near = nearest_neighbours(spark.read.parquet(f"{sf_dir}/chunk_embeddings.parquet"))
    return near.select(F.col("id").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"), "rank")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the other's 8 most similar, at a cosine of 0.80 or more."""
    near = nearest_neighbours(spark.read.parquet(f"{sf_dir}/chunk_embeddings.parquet")).where("cosine >= 0.8")
    return near.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()


def p5_search(spark: SparkSession, sf_dir: str, divisor: int = 20) -> DataFrame:
    """(chunk_id, neighbour_id, cosine): rows whose id is divisible by 20 as queries against all rows, by graph search."""
    vectors = cut(usable_vectors(spread(spark.read.parquet(f"{sf_dir}/chunk_embeddings.parquet").select("chunk_id", "embedding")), "chunk_id", "embedding"))
    members, nodes = _vertices(vectors)
    graph = neighbour_graph(nodes.select("id", "code"))
    queries = cut(vectors.where(F.col("id") % divisor == 0).select(F.col("id").alias("query"), "code"))
    # a query's own vertex is known and stands for its copies; a vertex gives its k + 1 smallest ids at most
    own = queries.join(members.select(F.col("id").alias("query"), F.col("rep").alias("v")), "query").select("query", "v", F.lit(1.0).cast("float").alias("sim"))
    found = graph_search(queries, nodes.select("id", "code"), graph, k=9).unionByName(own).groupBy("query", "v").agg(F.max("sim").alias("sim"))
    small = Window.partitionBy("rep").orderBy("id")
    targets = members.withColumn("n", F.row_number().over(small)).where("n <= 9").select(F.col("rep").alias("v"), F.col("id").alias("neighbour"))
    order = Window.partitionBy("query").orderBy(F.desc("sim"), "neighbour")
    expanded = found.join(targets, "v").where("query <> neighbour").withColumn("n", F.row_number().over(order)).where("n <= 8")
    return expanded.select(F.col("query").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"), F.round("sim", 4).alias("cosine"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p5_found": p5_found, "p5_neighbours": p5_neighbours, "p5_search": p5_search}
ORACLE: dict[str, str] = {}
