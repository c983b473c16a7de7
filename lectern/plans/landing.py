"""Queries on landed files: tables are written in a source's form to the shared folder and read by its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import shared_dir, table
from lectern.sources import files


def _landed(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"


def verse_lines(spark: SparkSession, d: str) -> DataFrame:
    """All chunks as lines ``chapter|verse|text``."""
    path, one_line = _landed(spark), F.regexp_replace("chunk_text", "[\\r\\n\\x0b\\x0c\\x85\u2028\u2029]+", " ")
    table(spark, d, "document_chunks").where("chunk_text is not null").select(F.concat_ws("|", "text_id", "id", one_line).alias("value")).write.text(path)
    return files.read_verse_lines(spark, path).select("chapter", "verse", F.md5("text").alias("text"))


def query_set(spark: SparkSession, d: str) -> DataFrame:
    """The test items as lines of JSON, read as a query set."""
    path = _landed(spark)
    items = table(spark, d, "eval_items").select(F.col("item_id").cast("string").alias("query_id"), "query", "query_type", "corpus", F.array("item_id").alias("gold_chunk_ids"), "reference")
    files.write_lines(items, path)
    rows = spark.read.schema(files.QUERY_SCHEMA).json(path)
    return rows.select("query_id", "query", "query_type", "corpus", F.element_at("gold_chunk_ids", 1).alias("gold"), "reference")


def corpus_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """All chunks written by corpus, then one corpus written again without its verses; the others stay."""
    path = _landed(spark)
    chunks = table(spark, d, "document_chunks").where("corpus_code is not null").select("id", "is_verse", "corpus_code")
    files.write_corpus(chunks, path)
    first = chunks.agg(F.min("corpus_code")).first()[0]
    files.write_corpus(chunks.where(F.col("corpus_code") == first).where("not is_verse"), path)
    return spark.read.parquet(path).groupBy("corpus_code").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


QUERIES = {f.__name__: f for f in (verse_lines, query_set, corpus_overwrite)}
_ONE_LINE = "trim(regexp_replace(chunk_text, '[\\r\\n\\x0b\\x0c\\x{85}\\x{2028}\\x{2029}]+', ' ', 'g'), ' ')"
ORACLE = {
    "verse_lines": f"SELECT text_id::INTEGER AS chapter, id::INTEGER AS verse, md5({_ONE_LINE}) AS text FROM document_chunks WHERE {_ONE_LINE} <> ''",
    "query_set": "SELECT item_id::VARCHAR AS query_id, query, query_type, corpus, item_id AS gold, reference FROM eval_items",
    "corpus_overwrite": "SELECT corpus_code, count(*) AS n, sum(id)::BIGINT AS ids FROM document_chunks WHERE corpus_code IS NOT NULL AND (corpus_code <> (SELECT min(corpus_code) FROM document_chunks) OR NOT is_verse) GROUP BY corpus_code",
}
