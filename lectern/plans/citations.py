"""Queries on chunks with citations, folded from the units of each text, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chunking as K
from lectern.session import table


def _units(spark: SparkSession, d: str, text: Column | None = None) -> DataFrame:
    """The chunks of a text as units, in order; blank ones are left out."""
    rows = table(spark, d, "document_chunks").where("trim(chunk_text) <> ''")
    order = F.col("chunk_index").cast("bigint") * 10_000_000 + F.col("id")
    return rows.select("text_id", order.alias("at"), (F.col("chunk_text") if text is None else text).alias("text"), "reference", "chapter", "section", "is_verse", F.lit(False).alias("preamble"))


def _shown(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("text", F.md5("text"))


def cited_chars(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d).withColumn("size", F.length("text"))
    return _shown(K.chunk_cited(units, "text_id", "at", "size", K.TARGET_MAX, "\n\n", target=800, most=1200))


def cited_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Units without a reference at the beginning of a text are its preamble."""
    units = _units(spark, d).withColumn("size", F.expr(K.TOKENS.format(u="text"))).withColumn("preamble", F.col("reference").isNull() & (F.col("at") < 10_000_000))
    return _shown(K.chunk_cited(units, "text_id", "at", "size", K.TARGET_MAX, "\n\n", target=400, most=600))


def cited_numbered(spark: SparkSession, d: str) -> DataFrame:
    """Each unit with its number before it, sized by a third of its bytes."""
    number = F.col("chunk_index") + 1
    units = _units(spark, d, F.concat(F.lit("("), number.cast("string"), F.lit(") "), "chunk_text"))
    units = units.withColumn("size", F.expr("cast(greatest(1, octet_length(text) div 3) as bigint)")).withColumn("reference", F.concat(F.col("text_id").cast("string"), F.lit(":"), (F.floor(F.col("at") / 10_000_000) + 1).cast("string")))
    return _shown(K.chunk_cited(units, "text_id", "at", "size", K.TARGET_MAX, "\n", target=400, most=600))


def cited_stanzas(spark: SparkSession, d: str) -> DataFrame:
    """Units of fewer than four words join the chunk before them; chunks of fewer than twenty words are dropped."""
    units = _units(spark, d).withColumn("size", F.expr(K.WORDS.format(u="text")))
    return _shown(K.chunk_cited(units, "text_id", "at", "size", K.TARGET_MIN, "\n\n", least_words=20, target=120, least=40, joined=4))


def _sql(size: str, opens: str, closes: str, joiner: str, text: str = "chunk_text", reference: str = "reference", preamble: str = "false", least_words: int = 0) -> str:
    words = "len(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> ''))::BIGINT"
    step = f"CASE WHEN {opens} THEN {{'k': a.k + 1, 'w': x.n}} ELSE {{'k': a.k, 'w': a.w + x.n}} END"
    fold = f"list_reduce(l, lambda a, x: list_transform([{step}], lambda s: {{'k': CASE WHEN {closes} THEN s.k + 1 ELSE s.k END, 'w': CASE WHEN {closes} THEN 0::BIGINT ELSE s.w END, 'n': 0::BIGINT, 'out': list_append(a.out, s.k)}})[1], {{'k': 0::INTEGER, 'w': 0::BIGINT, 'n': 0::BIGINT, 'out': []::INTEGER[]}})"
    return f"""
        WITH u AS (SELECT text_id, pos, text, {reference} AS reference, nullif(chapter, '') AS chapter, nullif(section, '') AS section, is_verse, {preamble} AS preamble, ({size})::BIGINT AS n
                   FROM (SELECT *, {text} AS text, chunk_index::BIGINT * 10000000 + id AS pos FROM document_chunks WHERE trim(chunk_text, ' ') <> '')),
             b AS (SELECT text_id, list({{'k': 0::INTEGER, 'w': 0::BIGINT, 'n': n, 'out': []::INTEGER[]}} ORDER BY pos) AS l, list(pos ORDER BY pos) AS ats FROM u WHERE NOT preamble GROUP BY text_id),
             k AS (SELECT text_id, unnest(ats) AS pos, unnest(({fold}).out) AS chunk_index FROM b),
             f AS (SELECT u.*, coalesce(k.chunk_index, 0)::INTEGER AS chunk_index FROM u LEFT JOIN k USING (text_id, pos)),
             g AS (SELECT text_id, chunk_index, string_agg(text, {joiner} ORDER BY pos) FILTER (preamble) AS lead, string_agg(text, {joiner} ORDER BY pos) FILTER (NOT preamble) AS body,
                          first(reference ORDER BY pos) FILTER (NOT preamble AND reference <> '') AS r1, last(reference ORDER BY pos) FILTER (NOT preamble AND reference <> '') AS r2,
                          first(chapter ORDER BY pos) FILTER (NOT preamble AND chapter IS NOT NULL) AS chapter, first(section ORDER BY pos) FILTER (NOT preamble AND section IS NOT NULL) AS section, coalesce(bool_or(is_verse), false) AS is_verse FROM f GROUP BY ALL),
             t AS (SELECT *, concat_ws(chr(10) || chr(10), lead, body) AS text FROM g)
        SELECT text_id, chunk_index, md5(text) AS text, CASE WHEN r1 = r2 THEN r1 ELSE r1 || '–' || r2 END AS reference, chapter, section, is_verse, {words} AS words, greatest(1, length(text) // 4)::BIGINT AS tokens FROM t WHERE {words} >= {least_words}"""


_MOST = ("a.w > 0 AND a.w + x.n > {}", "s.w >= {}")
_BLANK_LINE = "chr(10) || chr(10)"
QUERIES = {f.__name__: f for f in (cited_chars, cited_tokens, cited_numbered, cited_stanzas)}
ORACLE = {
    "cited_chars": _sql("length(text)", _MOST[0].format(1200), _MOST[1].format(800), _BLANK_LINE),
    "cited_tokens": _sql("greatest(1, length(text) // 4)", _MOST[0].format(600), _MOST[1].format(400), _BLANK_LINE, preamble="(reference IS NULL AND pos < 10000000)"),
    "cited_numbered": _sql("greatest(1, strlen(text) // 3)", _MOST[0].format(600), _MOST[1].format(400), "chr(10)", "'(' || (chunk_index + 1) || ') ' || chunk_text", "text_id || ':' || (pos // 10000000 + 1)"),
    "cited_stanzas": _sql("len(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> ''))", "x.n >= 4 AND a.w > 0 AND a.w + x.n > 120 AND a.w >= 40", "false", _BLANK_LINE, least_words=20),
}
