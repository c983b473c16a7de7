"""Readers of landed source files, each with an explicit schema, and writers."""

from __future__ import annotations

import html.parser
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_SCHEMA = T.StructType(
    [
        T.StructField("query_id", T.StringType()), T.StructField("id", T.StringType()), T.StructField("query", T.StringType()),
        T.StructField("query_type", T.StringType()), T.StructField("type", T.StringType()), T.StructField("corpus", T.StringType()),
        T.StructField("chunk_id", T.LongType()), T.StructField("gold_chunk_ids", T.ArrayType(T.LongType())),
        T.StructField("reference", T.StringType()), T.StructField("natural", T.StringType()), T.StructField("paraphrase", T.StringType()),
    ]
)
HADITH_SCHEMA = "metadata struct<name: string, section: map<string, string>>, hadiths array<struct<hadithnumber: string, text: string, reference: struct<book: string, hadith: string>>>"
BOOK_SCHEMA = "name string, chapters array<struct<chapter: int, verses: array<struct<verse: int, text: string>>>>"
PARAGRAPHS = "path string, seq int, chapter string, reference string, is_verse boolean, text string"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, segment_id, text): JSON files that map segment ids to texts, in the order of the file."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    entries = F.map_entries(F.from_json("value", "map<string, string>"))
    return raw.select("path", F.posexplode(entries).alias("seq", "e")).select("path", "seq", F.col("e.key").alias("segment_id"), F.trim("e.value").alias("text"))


def pair_segments(root: DataFrame, translations: list[DataFrame]) -> DataFrame:
    """(segment_id, root, translation): each root segment with the first translation that has it."""
    paired = root.select("segment_id", "seq", F.col("text").alias("root"))
    names = []
    for k, t in enumerate(translations):
        names.append(f"t{k}")
        paired = paired.join(t.select("segment_id", F.nullif("text", F.lit("")).alias(f"t{k}")), "segment_id", "left")
    return paired.select("segment_id", "seq", "root", F.coalesce(*names).alias("translation") if names else F.lit(None).cast("string").alias("translation"))


def read_verse_lines(spark: SparkSession, path: str) -> DataFrame:
    """(chapter, verse, text) of lines ``chapter|verse|text``; comments and malformed lines are skipped."""
    parts = F.split("value", r"\|", 3)
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(parts) == 3))
    rows = rows.select(F.expr("try_cast(trim(split(value, '\\\\|', 3)[0]) as int)").alias("chapter"), F.expr("try_cast(trim(split(value, '\\\\|', 3)[1]) as int)").alias("verse"), F.trim(parts[2]).alias("text"))
    return rows.where("chapter is not null and verse is not null and text <> ''")


def read_hadiths(spark: SparkSession, path: str, least_words: int = 5) -> DataFrame:
    """(book, hadith, section, text) of one-document JSON files; short ones are skipped, a missing book reads ``0``."""
    raw = spark.read.schema(HADITH_SCHEMA).json(path, multiLine=True)
    rows = raw.select("metadata", F.explode("hadiths").alias("h"))
    book = F.coalesce("h.reference.book", F.lit("0"))
    rows = rows.select(book.alias("book"), F.col("h.hadithnumber").alias("hadith"), F.try_element_at("metadata.section", book).alias("section"), F.trim("h.text").alias("text"))
    return rows.where(F.size(F.split("text", r"\s+")) >= least_words)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(book, chapter, verses): nested books, verses in the order of their numbers."""
    raw = spark.read.schema(BOOK_SCHEMA).json(path, multiLine=True)
    rows = raw.select(F.col("name").alias("book"), F.explode("chapters").alias("c"))
    ordered = F.transform(F.array_sort(F.transform("c.verses", lambda v: F.struct(v["verse"], v["text"]))), lambda v: v["text"])
    return rows.select("book", F.col("c.chapter").alias("chapter"), F.filter(ordered, lambda t: t.isNotNull() & (F.trim(t) != "")).alias("verses"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, query_type, corpus, gold): JSON lines of all three shapes in one form.

    A record with a natural wording and a paraphrase gives a row for each.
    """
    raw = spark.read.schema(QUERY_SCHEMA).json(path)
    kind = F.coalesce("query_type", "type", F.lit("synthetic"))
    wordings = F.when(F.col("natural").isNotNull(), F.array(F.struct(F.col("natural").alias("query"), F.lit("_natural").alias("tail")), F.struct(F.col("paraphrase").alias("query"), F.lit("_paraphrase").alias("tail")))).otherwise(
        F.array(F.struct("query", F.lit("").alias("tail")))
    )
    rows = raw.select(F.coalesce("query_id", "id").alias("query_id"), kind.alias("kind"), "corpus", F.coalesce("chunk_id", F.try_element_at("gold_chunk_ids", F.lit(1))).alias("gold"), F.explode(wordings).alias("w"))
    return rows.select("query_id", "w.query", F.when(F.col("kind") == "synthetic", F.concat("kind", "w.tail")).otherwise(F.col("kind")).alias("query_type"), "corpus", "gold").where("query is not null")


def decode_bytes(content: str = "content"):
    """Bytes as UTF-8 where they are valid, without a byte-order mark, else as Latin-1."""
    text = F.when(F.expr(f"is_valid_utf8({content})"), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def _blank(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _tei(text: str, least: int) -> list[tuple[str | None, str | None, bool, str]]:
    """(chapter, reference, verse, text) of the paragraphs of a TEI document, in order.

    Notes and variant readings are left out, a missing glyph reads as a box,
    milestones and line breaks give the reference, headings the chapter.
    """
    root = ET.fromstring(text)
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    state: dict[str, str | None] = {"chapter": None, "reference": None}
    out: list[tuple[str | None, str | None, bool, str]] = []
    skipped = {"note", "rdg", "del", "sic", "unclear", "teiHeader"}

    def words(e: ET.Element) -> str:
        if local(e) in skipped:
            return ""
        inner = "□" if local(e) in ("g", "gap") else (e.text or "")
        for child in e:
            mark(child)
            inner += words(child) + (child.tail or "")
        return inner

    def mark(e: ET.Element) -> None:
        if local(e) == "lb":
            state["reference"] = e.get("n")
        elif local(e) == "milestone":
            state["reference"] = next((v for k, v in e.attrib.items() if k.endswith("id")), e.get("n"))

    def walk(e: ET.Element) -> None:
        name = local(e)
        if name in skipped:
            return
        mark(e)
        if name in ("head", "mulu", "juan"):
            state["chapter"] = _blank(words(e)) or state["chapter"]
        elif name in ("p", "lg"):
            before = state["reference"]
            content = _blank(words(e) if name == "p" else "\n".join(words(x) for x in e))
            if len(content) >= least:
                out.append((state["chapter"], before or state["reference"], name == "lg", content))
        else:
            for child in e:
                walk(child)

    walk(root)
    if not out:  # no paragraphs: sentences, joined to a fair length
        content = _blank("".join(words(e) for e in root if local(e) not in skipped))
        buffer = ""
        for sentence in re.findall(r"[^。！？；]+[。！？；]?", content):
            buffer += sentence
            if len(buffer) >= 200:
                out.append((None, None, False, buffer))
                buffer = ""
        if len(buffer) >= least:
            out.append((None, None, False, buffer))
    return out


class _Page(html.parser.HTMLParser):
    """Paragraphs of an HTML page; bold paragraphs and headings are the chapter, verse quotations are verse."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str | None, str | None, bool, str]] = []
        self.chapter: str | None = None
        self.text, self.hidden, self.kind, self.verse = "", 0, "", False

    def flush(self) -> None:
        content, self.text = _blank(self.text), ""
        if content and self.kind == "heading":
            self.chapter = content
        elif content:
            self.rows.append((self.chapter, None, self.verse, content))
        self.kind = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        kind = dict(attrs).get("class") or ""
        if tag in ("script", "style") or tag == "span" and "note" in kind or tag == "a" and "ref" in kind:
            self.hidden += 1
        elif tag in ("p", "div", "pre", "blockquote", "h1", "h2", "h3", "h4", "br", "li", "article"):
            self.flush()
            self.verse = tag == "blockquote" and "gatha" in kind or self.verse and tag == "br"
            self.kind = "heading" if tag[0] == "h" and tag[1:].isdigit() or tag == "p" and "bold" in kind else ""

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "span", "a") and self.hidden:
            self.hidden -= 1
        elif tag in ("p", "div", "pre", "blockquote", "h1", "h2", "h3", "h4", "li", "article"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text += data


def _html(text: str, least: int) -> list[tuple[str | None, str | None, bool, str]]:
    page = _Page()
    page.feed(text)
    page.close()
    page.flush()
    return [r for r in page.rows if len(r[3]) >= least]


def read_paragraphs(spark: SparkSession, path: str, form: str, least_chars: int = 15) -> DataFrame:
    """(path, seq, chapter, reference, is_verse, text): paragraphs of TEI or HTML files, one file a row of work.

    A file that can't be parsed gives no row.
    """
    parse = {"tei": _tei, "html": _html}[form]
    files = spark.read.format("binaryFile").load(path).select("path", decode_bytes().alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for name, text in zip(df["path"], df["text"]):
                try:
                    parsed = parse(text, least_chars)
                except ET.ParseError:
                    continue
                rows += [(name, i, *r) for i, r in enumerate(parsed)]
            yield pd.DataFrame(rows, columns=["path", "seq", "chapter", "reference", "is_verse", "text"])

    return files.mapInPandas(run, PARAGRAPHS)


def scrape_links(spark: SparkSession, path: str, base: str) -> DataFrame:
    """(stem, url): the links of index pages, once by stem."""
    raw = spark.read.text(path, wholetext=True)
    links = raw.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?i)href=[\"']([^\"'#]+\.html?)"), F.lit(1))).alias("href"))
    stem = F.regexp_extract("href", r"([^/]+)\.html?$", 1)
    return links.select(stem.alias("stem"), F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), "href")).alias("url")).groupBy("stem").agg(F.min("url").alias("url"))


def write_corpus(chunks: DataFrame, path: str) -> None:
    """Chunks as Parquet by corpus; a corpus that is written again replaces only itself."""
    chunks.repartition("corpus_code").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus_code").parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)
