"""Greedy chunkers: ordered units folded into size-bounded chunks, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = "cast(size(filter(split({u}, '[ \\\\t\\\\r\\\\n]+'), w -> w <> '')) as bigint)"
CHARS = "cast(length({u}) as bigint)"
TOKENS = "cast(greatest(1, floor(length({u}) / 4)) as bigint)"


def _fold(size: str, before: str, after: str, joiner: str) -> str:
    """SQL of the fold.  ``before`` tells when to close the open chunk ahead of a unit, ``after`` when behind it."""
    n = size.format(u="u")
    kept = f"if({before.format(n=n)}, named_struct('done', concat(a.done, array(a.buf)), 'buf', u, 'w', {n}), named_struct('done', a.done, 'buf', if(a.w = 0 and a.buf = '', u, concat(a.buf, '{joiner}', u)), 'w', a.w + {n}))"
    step = kept
    if after:
        step = f"transform(array({kept}), b -> if({after}, named_struct('done', concat(b.done, array(b.buf)), 'buf', '', 'w', 0L), b))[0]"
    return (
        "aggregate(units, named_struct('done', cast(array() as array<string>), 'buf', '', 'w', 0L), "
        f"(a, u) -> {step}, a -> if(a.buf <> '', concat(a.done, array(a.buf)), a.done))"
    )


def _numbered(df: DataFrame, units: str, fold: str, id_col: str) -> DataFrame:
    rows = df.select(F.col(id_col), F.expr(units).alias("units")).select(id_col, F.expr(fold).alias("chunks"))
    return rows.select(id_col, F.posexplode("chunks").alias("chunk_index", "chunk"))


def lines_of(text_col: str) -> str:
    """SQL of the trimmed non-blank lines of a text."""
    return f"filter(transform(split({text_col}, '\\\\r?\\\\n'), x -> trim(x)), x -> x <> '')"


def chunk_target_min(df: DataFrame, id_col: str, text_col: str, target: int, least: int, size: str = WORDS, joiner: str = "\\n") -> DataFrame:
    """(id, chunk_index, chunk): a chunk closes ahead of a unit that would pass ``target``, once it holds ``least``; there is no upper bound."""
    return _numbered(df, lines_of(text_col), _fold(size, f"a.w > 0 and a.w + {{n}} > {target} and a.w >= {least}", "", joiner), id_col)


def chunk_target_max(df: DataFrame, id_col: str, text_col: str, target: int, most: int, size: str = CHARS, joiner: str = "\\n\\n") -> DataFrame:
    """(id, chunk_index, chunk): a chunk closes ahead of a unit that would pass ``most``, and behind one that reaches ``target``."""
    return _numbered(df, lines_of(text_col), _fold(size, f"a.buf <> '' and a.w + {{n}} > {most}", f"b.w >= {target}", joiner), id_col)


def chunk_single(df: DataFrame, id_col: str, text_col: str, least_words: int = 5) -> DataFrame:
    """(id, chunk_index, chunk): one record is one chunk, if it has enough words."""
    kept = df.where(F.expr(WORDS.format(u=text_col)) >= least_words)
    return kept.select(id_col, F.lit(0).alias("chunk_index"), F.trim(text_col).alias("chunk"))


def chunk_pending(df: DataFrame, id_col: str, text_col: str, least_words: int = 20) -> DataFrame:
    """(id, chunk_index, chunk): a short unit is added to the pending chunk; a long one closes it and becomes pending."""
    return _numbered(df, lines_of(text_col), _fold(WORDS, f"a.buf <> '' and {{n}} >= {least_words}", "", " "), id_col)


def chunk_chapters(df: DataFrame, book_col: str, chapter_col: str, verses_col: str, least: int, every: int, most: int) -> DataFrame:
    """(book, start_chapter, start_verse, text): chapters as chunks by their number of verses.

    A chapter of more than ``most`` verses closes what is buffered and is cut every
    ``every`` verses; one of fewer than ``least`` is buffered; any other takes the
    buffer along.  The fold runs over the chapters of one book in order.
    """
    books = df.groupBy(book_col).agg(F.array_sort(F.collect_list(F.struct(F.col(chapter_col).alias("c"), F.col(verses_col).alias("v")))).alias("units"))
    state = "named_struct('done', cast(array() as array<struct<c: bigint, s: bigint, v: array<string>>>), 'buf', cast(array() as array<string>), 'c', cast(1 as bigint))"
    item = lambda c, s, v: f"array(named_struct('c', cast({c} as bigint), 's', cast({s} as bigint), 'v', {v}))"
    flushed = f"if(size(a.buf) > 0, concat(a.done, {item('a.c', 1, 'a.buf')}), a.done)"
    cut = f"transform(sequence(0, size(u.v) - 1, {every}), i -> named_struct('c', cast(u.c as bigint), 's', cast(i + 1 as bigint), 'v', slice(u.v, i + 1, {every})))"
    empty = "cast(array() as array<string>)"
    step = (
        f"case when size(u.v) = 0 then a when size(u.v) > {most} then named_struct('done', concat({flushed}, {cut}), 'buf', {empty}, 'c', cast(u.c + 1 as bigint)) "
        f"when size(u.v) < {least} then named_struct('done', a.done, 'buf', concat(a.buf, u.v), 'c', if(size(a.buf) = 0, cast(u.c as bigint), a.c)) "
        f"when size(a.buf) > 0 then named_struct('done', concat(a.done, {item('a.c', 1, 'concat(a.buf, u.v)')}), 'buf', {empty}, 'c', cast(u.c + 1 as bigint)) "
        f"else named_struct('done', concat(a.done, {item('u.c', 1, 'u.v')}), 'buf', {empty}, 'c', cast(u.c + 1 as bigint)) end"
    )
    folded = books.select(book_col, F.explode(F.expr(f"aggregate(units, {state}, (a, u) -> {step}, a -> {flushed})")).alias("k"))
    return folded.select(book_col, F.col("k.c").alias("start_chapter"), F.col("k.s").alias("start_verse"), F.array_join("k.v", " ").alias("text"))


#: When a unit x opens a new chunk after the open one a, and when the chunk s is closed behind it: by an upper bound, and by a least size.
TARGET_MAX = ("a.w > 0 and a.w + x.n > {most}", "s.w >= {target}")
TARGET_MIN = ("x.n >= {joined} and a.w > 0 and a.w + x.n > {target} and a.w >= {least}", "false")


def assigned(units: DataFrame, id_col: str, order_col: str, size_col: str, rule: tuple[str, str], **bounds: int) -> DataFrame:
    """(id, order, chunk_index): the chunk of each unit.

    The fold runs over the sizes of a record's units alone, so that a very long
    record is a list of numbers, not of texts, in one row.
    """
    opens, closes = (r.format(**bounds) for r in rule)
    lists = units.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(size_col).cast("bigint").alias("n")))).alias("l"))
    step = (
        f"transform(array(if({opens}, named_struct('k', a.k + 1, 'w', x.n), named_struct('k', a.k, 'w', a.w + x.n))), s -> "
        f"named_struct('k', if({closes}, s.k + 1, s.k), 'w', if({closes}, 0L, s.w), 'out', concat(a.out, array(s.k))))[0]"
    )
    fold = f"aggregate(l, named_struct('k', 0, 'w', 0L, 'out', cast(array() as array<int>)), (a, x) -> {step}, a -> a.out)"
    return lists.select(id_col, F.explode(F.arrays_zip(F.col("l.o").alias("o"), F.expr(fold).alias("k"))).alias("z")).select(id_col, F.col("z.o").alias(order_col), F.col("z.k").alias("chunk_index"))


def chunk_cited(units: DataFrame, id_col: str, order_col: str, size_col: str, rule: tuple[str, str], joiner: str, least_words: int = 0, **bounds: int) -> DataFrame:
    """Chunks with their citation, from units (id, order, text, reference, chapter, section, is_verse, preamble, size).

    A preamble has no size of its own; it stands before the first chunk, a blank
    line apart.  reference joins the first and the last one; chapter and section
    are the first that aren't empty; one verse makes a chunk verse; a chunk of
    fewer than ``least_words`` words is dropped.
    """
    body = units.where("not preamble")
    placed = body.join(assigned(body, id_col, order_col, size_col, rule, **bounds), [id_col, order_col])
    full = placed.unionByName(units.where("preamble").withColumn("chunk_index", F.lit(0)))
    own = ~F.col("preamble")
    ordered = lambda value, keep: F.transform(F.array_sort(F.collect_list(F.when(keep & value.isNotNull(), F.struct(F.col(order_col).alias("o"), value.alias("v"))))), lambda s: s["v"])
    rows = full.groupBy(id_col, "chunk_index").agg(
        F.array_join(ordered(F.col("text"), ~own), joiner).alias("lead"), F.array_join(ordered(F.col("text"), own), joiner).alias("body"), ordered(F.nullif("reference", F.lit("")), own).alias("r"),
        F.try_element_at(ordered(F.nullif("chapter", F.lit("")), own), F.lit(1)).alias("chapter"), F.try_element_at(ordered(F.nullif("section", F.lit("")), own), F.lit(1)).alias("section"), F.coalesce(F.bool_or("is_verse"), F.lit(False)).alias("is_verse"),
    )
    first, last = F.try_element_at("r", F.lit(1)), F.try_element_at("r", F.lit(-1))
    text = F.array_join(F.filter(F.array("lead", "body"), lambda x: x != ""), "\n\n")
    out = rows.select(id_col, "chunk_index", text.alias("text"), F.when(first == last, first).otherwise(F.concat(first, F.lit("–"), last)).alias("reference"), "chapter", "section", "is_verse")
    words, tokens = F.expr(WORDS.format(u="text")), F.expr(TOKENS.format(u="text"))
    return out.withColumns({"words": words, "tokens": tokens}).where(F.col("words") >= least_words)
