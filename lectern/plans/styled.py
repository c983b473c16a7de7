"""Queries on texts divided at their headings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import headings as H
from lectern.session import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, text): chunk texts and documents, the ids of the documents below zero."""
    documents = table(spark, d, "documents").select((-F.col("doc_id")).alias("id"), "text")
    return table(spark, d, "document_chunks").select("id", F.col("chunk_text").alias("text")).unionByName(documents)


def _shown(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "part", "sub", "chunk_index", "reference", "chapter", F.md5("text").alias("text"), "words", "tokens")


def styled_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _shown(H.chunk_styled(_texts(spark, d), "id", "text", H.STYLES["paragraphs"]))


def styled_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters as chunks; those of more than 700 words and texts without chapters by paragraph."""
    return _shown(H.chunk_styled(_texts(spark, d), "id", "text", H.STYLES["chapters"]))


def styled_entries(spark: SparkSession, d: str) -> DataFrame:
    """Numbered entries grouped to chunks that name the first and the last number."""
    return _shown(H.chunk_styled(_texts(spark, d), "id", "text", H.STYLES["entries"]))


def styled_lines(spark: SparkSession, d: str) -> DataFrame:
    return _shown(H.chunk_styled(_texts(spark, d), "id", "text", H.STYLES["latin_poetry"]))


# The SQL goes line by line: a line that opens with a heading begins a part, blank lines end a paragraph, and running sums number both.
_CLEAN = "trim(regexp_replace({t}, '[ \\t\\r\\n]+', ' ', 'g'), ' ')"
_N = "len(list_filter(string_split_regex({t}, '[ \\t\\r\\n]+'), lambda w: w <> ''))::BIGINT"


def _sql(heading: str, kept: str, piece_end: str, piece_words: int, part_words: int, grouped: bool, loose_words: int) -> str:
    """``kept`` tells whether a headed part (label, words) stays whole; ``piece_end`` whether a blank line or every line ends a piece."""
    fold = "list_reduce(l, lambda a, x: CASE WHEN a.w > 0 AND a.w + x.n > 350 AND a.w >= 80 THEN {'k': a.k + 1, 'w': x.n, 'n': 0::BIGINT, 'out': list_append(a.out, a.k + 1)} ELSE {'k': a.k, 'w': a.w + x.n, 'n': 0::BIGINT, 'out': list_append(a.out, a.k)} END, {'k': 0::INTEGER, 'w': 0::BIGINT, 'n': 0::BIGINT, 'out': []::INTEGER[]})"
    key = "CASE WHEN numbered THEN sub ELSE 0 END" if grouped else "sub"
    place = "CASE WHEN numbered THEN piece ELSE sub END" if grouped else "piece"
    return f"""
        WITH t AS (SELECT id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM (SELECT id, chunk_text AS text FROM document_chunks UNION ALL SELECT -doc_id, text FROM documents) WHERE text IS NOT NULL),
             lines AS (SELECT id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM t),
             marked AS (SELECT id, pos, line, {heading} AS label FROM lines),
             parts AS (SELECT id, pos, line, label, count(nullif(label, '')) OVER (PARTITION BY id ORDER BY pos) AS part, count(nullif(label, '')) OVER (PARTITION BY id) AS parts,
                              count(*) FILTER ({piece_end}) OVER (PARTITION BY id ORDER BY pos) AS piece FROM marked),
             p AS (SELECT id, greatest(part - 1, 0)::INTEGER AS sub, max(nullif(label, '')) AS label, string_agg(line, chr(10) ORDER BY pos) AS body FROM parts WHERE parts = 0 OR part > 0 GROUP BY id, part),
             q AS (SELECT *, {_N.format(t='body')} AS n FROM p WHERE {_N.format(t='body')} >= {part_words}),
             pieces AS (SELECT id, greatest(part - 1, 0)::INTEGER AS sub, piece, string_agg(line, chr(10) ORDER BY pos) AS text FROM parts GROUP BY id, part, piece),
             u AS (SELECT id, sub, 0 AS piece, label, {_CLEAN.format(t='body')} AS text, n, false AS numbered FROM q WHERE label IS NOT NULL AND {kept} AND n > 0
                   UNION ALL SELECT id, sub, piece, label, {_CLEAN.format(t='text')}, {_N.format(t='text')}, true FROM pieces JOIN (SELECT id, sub, label FROM q WHERE label IS NULL OR NOT ({kept})) USING (id, sub)
                   WHERE {_N.format(t='text')} >= CASE WHEN label IS NULL THEN {piece_words} ELSE {loose_words} END),
             placed AS (SELECT id, {key} AS sub, {place} AS pos, label, text, n, numbered FROM u),
             b AS (SELECT id, sub, numbered, list({{'k': 0::INTEGER, 'w': 0::BIGINT, 'n': n, 'out': []::INTEGER[]}} ORDER BY pos) AS l, list({{'text': text, 'label': label}} ORDER BY pos) AS us FROM placed GROUP BY ALL),
             k AS (SELECT id, sub, numbered, unnest(us, recursive := true), unnest(range(len(us))) AS pos, unnest(({fold}).out) AS chunk_index FROM b),
             g AS (SELECT id, sub, chunk_index, numbered, string_agg(text, ' ' ORDER BY pos) AS text, first(label ORDER BY pos) AS a, last(label ORDER BY pos) AS z FROM k GROUP BY id, sub, chunk_index, numbered),
             r AS (SELECT *, CASE WHEN numbered THEN trim(coalesce(a, '') || ' — §' || (chunk_index + 1), ' ') WHEN a = z THEN a ELSE a || '–' || z END AS reference, {_N.format(t='text')} AS words FROM g)
        SELECT id, {'0' if grouped else 'sub'}::INTEGER AS part, {'sub' if grouped else '0'}::INTEGER AS sub, chunk_index, reference, {'NULL' if grouped else 'a'}::VARCHAR AS chapter, md5(text) AS text, words, greatest(1, length(text) // 4)::BIGINT AS tokens FROM r WHERE words > 0"""


_NONE, _BLANK = "NULL::VARCHAR", "line = ''"
_CHAPTER = "trim(regexp_replace(regexp_extract(line, '^[ \\t]*((?i)chapter\\s+[IVXLCDM\\d]+\\.?[ \\t]*[\\pL\\pN\\pM_ ,\\-]*)$', 1), '[ \\t]+', ' ', 'g'), ' ')"
_ENTRY = "trim(regexp_extract(line, '^[ \\t]*((?:(?i)[IVXLC]{1,8}|\\d{1,3})\\.)\\s+[A-Z''\"(]', 1), ' ')"
QUERIES = {f.__name__: f for f in (styled_paragraphs, styled_chapters, styled_entries, styled_lines)}
ORACLE = {
    "styled_paragraphs": _sql(_NONE, "true", _BLANK, 6, 0, False, 6),
    "styled_chapters": _sql(_CHAPTER, "n <= 700", _BLANK, 1, 10, False, 1),
    "styled_entries": _sql(_ENTRY, "true", _BLANK, 6, 5, True, 6),
    "styled_lines": _sql(_NONE, "true", "true", 3, 0, False, 3),
}
