"""Problem 4: long exact spans shared between records.

Fixed-block anchors.  Each distinct text is cut into non-overlapping blocks of
half the span length, so every shared span holds one whole block of either
text.  All rolling windows of that length are hashed and probed against the
blocks; a hit is extended to both sides, character by character.

A window for every character would make a shuffle many times the input.  So
the probe has two steps.  First each group of texts sends only its sorted window
hashes, delta coded, to the bucket of their leading bits; the bucket answers
with the hashes that are a block somewhere and a window at two places or more.
Then each group finds its windows with such a hash and sends these alone, with
the characters around them, to be joined and compared.

Defined results: null texts and texts shorter than the span take no part; equal
texts form one class, are compared once and expanded afterwards; a text sharing
a span only with itself has no pair.  Very long texts are cut into overlapping
segments.  Nothing is capped: a hash with many windows and blocks is joined on
the full span around it, so that only true pairs come out of its group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.relational import split_join
from lectern.session import cut, spread

SPAN = 150
#: Characters of a group of texts, of a segment of a very long text, and window hashes of a bucket.
GROUP_CHARS, SEGMENT_CHARS, BUCKET_HASHES = 1_500_000, 400_000, 2_000_000
#: How many times larger groups and buckets may be for large inputs, as a task's memory allows.
WIDEST = 3.0
#: Products of windows and blocks of one hash from which the whole span is the key.
HEAVY = 250_000


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 2**64))
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, "u8"))]) for b in (base, inverse))


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _windows(texts: list[str], firsts: list[int], lasts: list[int], block: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of the text, place in it) of all windows that start in [first, last) of their text."""
    sizes = np.array([len(t) for t in texts], "i8")
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "u4").astype("u8")
    n = len(codes)
    up, down = _powers(1 << max(10, int(n).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_stirred(codes + np.uint64(1)) * up[:n])])
    which = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = np.flatnonzero((place + block <= sizes[which]) & (place >= np.array(firsts)[which]) & (place < np.array(lasts)[which]))
    hashes = _stirred((sums[starts + block] - sums[starts]) * down[starts]) >> np.uint64(64 - bits)
    return hashes, which[starts], place[starts]


def _packed(sorted_hashes: np.ndarray) -> bytes:
    """Differences by byte plane, compressed."""
    planes = np.diff(sorted_hashes, prepend=np.uint64(0)).astype("<u8").view("u1").reshape(-1, 8).T
    return len(sorted_hashes).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 8 * n, codec="zstd", asbytes=True), "u1").reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel())


def partitions(groups: int) -> int:
    """Shuffle partitions for so many groups: one each, and more groups a partition only beyond twenty thousand."""
    return max(1, min(groups, 20_000))


def _distinct_texts(rows: DataFrame, span: int, groups: int) -> DataFrame:
    """(g, key, base, first, last, text): segments of each distinct text, grouped.

    Copies are dropped inside each map task before the shuffle, so a text that
    fills a third of the table is sent once a task.
    """

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key not in seen:
                    seen.add(key)
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(keep))

    margin = span  # characters before and after, for whole windows and their surroundings
    local = rows.mapInArrow(once, "key binary, text string")
    shares = partitions(groups)
    parts = local.select("key", "text", F.explode(F.expr(f"sequence(0L, cast(length(text) - 1 as bigint), {SEGMENT_CHARS}L)")).alias("at"))
    parts = parts.select(
        F.pmod(F.xxhash64("key", "at"), F.lit(groups)).alias("g"),
        "key",
        F.greatest(F.col("at") - margin, F.lit(0)).alias("base"),
        F.col("at").alias("first"),
        (F.col("at") + SEGMENT_CHARS).alias("last"),
        F.expr(f"substring(text, cast(greatest(at - {margin}, 0) + 1 as int), cast({SEGMENT_CHARS + 2 * margin} as int))").alias("text"),
    )
    return parts.repartition(shares, "g").groupBy("g", "key", "first").agg(F.first("base").alias("base"), F.first("last").alias("last"), F.first("text").alias("text"))


def _group_windows(table: pa.Table, block: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    texts = table.column("text").to_pylist()
    base = table.column("base").to_numpy()
    hashes, which, place = _windows(texts, list(table.column("first").to_numpy() - base), list(table.column("last").to_numpy() - base), block, bits)
    return hashes, which, place, texts, base


def occurrences(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """(hash, key, at, anchor, before, inside, after): windows whose hash is an anchor and occurs elsewhere.

    ``rows`` is (key, text).  anchor tells a block; before and after are the
    characters around the window, up to half a span.
    """
    block = span // 2
    chars = rows.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    # a group sends a row to each bucket, so both grow a little with the input to keep these rows few
    wider = min(WIDEST, max(1.0, math.sqrt(chars / 1e9)))
    groups = max(1, math.ceil(chars / (GROUP_CHARS * wider)))
    buckets = 1 << max(0, math.ceil(math.log2(max(1, chars / (BUCKET_HASHES * wider)))))
    bits = min(60, max(32, math.ceil(math.log2(max(chars, 1))) + 6))
    shift = np.uint64(bits - int(math.log2(buckets)))
    texts = _distinct_texts(rows, span, groups)

    def asked(key: tuple, table: pa.Table) -> pa.Table:
        hashes, which, place, _, base = _group_windows(table, block, bits)
        anchor = (place + base[which]) % block == 0
        order = np.argsort(hashes)
        hashes, anchor = hashes[order], anchor[order]
        values, first, times = np.unique(hashes, return_index=True, return_counts=True)
        anchored = np.add.reduceat(anchor, first) > 0 if len(first) else np.empty(0, bool)
        where = values >> shift
        out: dict[str, list] = {"bucket": [], "g": [], "once": [], "often": [], "blocks": []}
        for b in np.unique(where):
            here = where == b
            out["bucket"].append(int(b))
            out["g"].append(key[0].as_py())
            out["once"].append(_packed(values[here & (times == 1)]))
            out["often"].append(_packed(values[here & (times > 1)]))
            out["blocks"].append(_packed(values[here & anchored]))
        return pa.table(out, schema=pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("once", pa.binary()), ("often", pa.binary()), ("blocks", pa.binary())]))

    def answered(table: pa.Table) -> pa.Table:
        once, often, blocks = ([_unpacked(x) for x in table.column(c).to_pylist()] for c in ("once", "often", "blocks"))
        values, times = np.unique(np.concatenate([*once, *often, *often]), return_counts=True)
        shared = np.intersect1d(values[times > 1], np.unique(np.concatenate(blocks)), assume_unique=True)
        out: dict[str, list] = {"g": [], "hashes": []}
        for g, a, b in zip(table.column("g").to_pylist(), once, often):
            mine = np.intersect1d(np.concatenate([a, b]), shared, assume_unique=True)
            if len(mine):
                out["g"].append(g)
                out["hashes"].append(_packed(mine))
        return pa.table(out, schema=pa.schema([("g", pa.int64()), ("hashes", pa.binary())]))

    def located(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("hash", pa.int64()), ("key", pa.binary()), ("at", pa.int64()), ("anchor", pa.bool_()), ("before", pa.string()), ("inside", pa.string()), ("after", pa.string())])
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        hashes, which, place, texts, base = _group_windows(left, block, bits)
        wanted = np.sort(np.concatenate([_unpacked(x) for x in right.column("hashes").to_pylist()]))
        hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes)
        keys = left.column("key").to_pylist()
        cols: list[list] = [[] for _ in kinds]
        for h, w, p in zip(hashes[hit].astype("i8").tolist(), which[hit].tolist(), place[hit].tolist()):
            t = texts[w]
            at = p + int(base[w])
            for c, v in zip(cols, (h, keys[w], at, at % block == 0, t[max(0, p - block) : p], t[p : p + block], t[p + block : p + 2 * block])):
                c.append(v)
        return pa.table(cols, schema=kinds)

    asked_rows = texts.groupBy("g").applyInArrow(asked, "bucket bigint, g bigint, once binary, often binary, blocks binary")
    replies = asked_rows.repartition(partitions(buckets), "bucket").groupBy("bucket").applyInArrow(answered, "g bigint, hashes binary")
    schema = "hash bigint, key binary, at bigint, anchor boolean, before string, inside string, after string"
    return texts.groupBy("g").cogroup(replies.repartition(partitions(groups), "g").groupBy("g")).applyInArrow(located, schema)


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def shared_stretches(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """(key, other, start, stop): stretches of at least ``span`` characters of the text ``key`` that ``other`` holds too.

    Each stretch is maximal within half a span around its anchor; together they
    cover exactly the maximal repeats.
    """
    found = cut(occurrences(rows, span))
    heavy = found.groupBy("hash").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("bigint")).alias("m")).where(f"n * m > {HEAVY}").select("hash")
    light = found.join(heavy, "hash", "left_anti")
    blocks = light.where("anchor").select("hash", *(F.col(c).alias(f"{c}_") for c in ("key", "at", "before", "inside", "after")))
    met = light.drop("anchor").join(blocks, "hash").where("key <> key_")

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            cols = {n: batch.column(n).to_pylist() for n in ("key", "at", "before", "inside", "after", "key_", "at_", "before_", "inside_", "after_")}
            for k, at, b, i, a, k2, at2, b2, i2, a2 in zip(*cols.values()):
                if i == i2:
                    left, right = _common(b[::-1], b2[::-1]), _common(a, a2)
                    if left + len(i) + right >= span:
                        out += [(k, k2, at - left, at + len(i) + right), (k2, k, at2 - left, at2 + len(i) + right)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["key", "other", "start", "stop"])

    kind = "key binary, other binary, start bigint, stop bigint"
    plain = met.mapInArrow(extended, kind)
    # windows of a heavy hash: one row for each whole span around them, joined on its characters
    around = found.join(heavy, "hash").select("key", "at", "anchor", F.length("before").alias("lead"), F.concat("before", "inside", "after").alias("t"))
    offset = F.explode(F.expr(f"filter(sequence(0, {span // 2 + 1}), o -> o <= lead and o >= lead - {span - span // 2} and o + {span} <= length(t))"))
    whole = around.select("key", "at", "anchor", "lead", "t", offset.alias("o")).select("key", "anchor", (F.col("at") - F.col("lead") + F.col("o")).alias("start"), F.expr(f"substring(t, o + 1, {span})").alias("w"), (F.col("lead") - F.col("o")).alias("back"))
    whole = whole.select("key", "anchor", "start", "back", F.md5("w").alias("w"))
    pinned = whole.where("anchor").select("w", "back", F.col("key").alias("key_"), F.col("start").alias("start_"))
    pairs = whole.join(pinned, ["w", "back"]).where("key <> key_")
    both = F.explode(F.array(F.struct(F.col("key"), F.col("key_").alias("other"), F.col("start")), F.struct(F.col("key_").alias("key"), F.col("key").alias("other"), F.col("start_").alias("start"))))
    hot = pairs.select(both.alias("e")).select("e.key", "e.other", "e.start", (F.col("e.start") + span).alias("stop"))
    return plain.unionByName(hot).distinct()


def _keyed(df: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return rows.where(F.length("text") >= span).select("id", F.unhex(F.md5("text")).alias("key"), "text")


def span_classes(df: DataFrame, id_col: str, text_col: str, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(id, key): the class of equal texts of each row that is long enough; and (key, other): the classes that share a span."""
    rows = _keyed(df, id_col, text_col, span)
    linked = shared_stretches(rows.select("key", "text"), span).where("key < other").select("key", "other").distinct()
    return rows.select("id", "key").distinct(), linked


def span_pairs(df: DataFrame, id_col: str, text_col: str, span: int = SPAN) -> DataFrame:
    """(id_a, id_b): rows whose texts share a verbatim span of at least ``span`` characters.

    The pairs of classes are expanded to their rows, and each class with several
    rows to the pairs inside it; a class with many rows is spread over tasks.
    """
    members, linked = span_classes(df, id_col, text_col, span)
    members = cut(members)
    copied = members.groupBy("key").count().where("count > 1").select("key", F.col("key").alias("other"))
    links = cut(linked).unionByName(copied)
    across = split_join(members.withColumnRenamed("id", "x"), links, ["key"]).select(F.col("other").alias("key"), F.col("key").alias("of"), "x")
    both = split_join(across, members.withColumnRenamed("id", "y"), ["key"]).where("x <> y and (key <> of or x < y)")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def shared_share(df: DataFrame, id_col: str, text_col: str, span: int = SPAN) -> DataFrame:
    """(id, n_chars, shared_chars, share) of every row: how much of its text other rows hold too.

    Null and short texts share nothing; of a null or empty text the share is 0.
    """
    rows = _keyed(df, id_col, text_col, span)
    members = rows.select("key", "id").distinct()
    copied = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("copied"))
    stretches = shared_stretches(rows.select("key", "text"), span).select("key", "start", "stop").distinct()
    lists = stretches.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("l"))
    merged = F.expr(
        "aggregate(l, named_struct('total', 0L, 'stop', 0L), (a, x) -> named_struct("
        "'total', a.total + greatest(0L, x.stop - greatest(x.start, a.stop)), 'stop', greatest(a.stop, x.stop)), a -> a.total)"
    )
    shared = members.join(copied, "key", "left").join(lists.select("key", merged.alias("covered")), "key", "left")
    shared = shared.select("id", "copied", "covered")
    out = df.select(F.col(id_col).alias("id"), F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("n_chars")).distinct().join(shared, "id", "left")
    chars = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("bigint")
    return out.select("id", "n_chars", chars.alias("shared_chars")).withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 4)).otherwise(F.lit(0.0)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose stored texts share a verbatim span of at least 150 characters."""
    return span_pairs(spark.read.parquet(f"{sf_dir}/document_chunks.parquet"), "id", "chunk_text").select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p4_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each chunk's text is shared elsewhere."""
    return shared_share(spark.read.parquet(f"{sf_dir}/document_chunks.parquet"), "id", "chunk_text").withColumnRenamed("id", "chunk_id")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, representative, links): each long enough chunk, the smallest id with its text, and how many other texts share a span with it."""
    members, linked = span_classes(spark.read.parquet(f"{sf_dir}/document_chunks.parquet"), "id", "chunk_text")
    both = linked.unionByName(linked.select(F.col("other").alias("key"), F.col("key").alias("other")))
    links = both.groupBy("key").agg(F.count("*").alias("links"))
    first = members.groupBy("key").agg(F.min("id").alias("representative"))
    out = members.join(first, "key").join(links, "key", "left")
    return out.select(F.col("id").alias("chunk_id"), "representative", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p4_share": p4_share, "p4_classes": p4_classes}
_WINDOWS = f"SELECT id, substring(chunk_text, p, {SPAN}) AS w FROM (SELECT id, chunk_text, unnest(range(1, length(chunk_text) - {SPAN} + 2)) AS p FROM document_chunks WHERE length(chunk_text) >= {SPAN})"
ORACLE: dict[str, str] = {
    "p4_found": f"WITH w AS (SELECT DISTINCT id, md5(w) AS w FROM ({_WINDOWS})) SELECT DISTINCT a.id AS chunk_id_a, b.id AS chunk_id_b FROM w a JOIN w b ON a.w = b.w AND a.id < b.id",
}
