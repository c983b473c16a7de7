"""Queries on text: estimates, cleaning, chunking, splitting, classifying and entity names, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import chunking as K
from lectern.operators import entities as E
from lectern.operators import splitting as S
from lectern.session import table

START_MARKS, END_MARKS = ("*** START OF THE TEXT", "*** BEGIN"), ("*** END OF THE TEXT", "End of the text")
# Classes of titles by keyword, the first match counts.
TITLE_RULES = (("sutra|sutta|s[uū]tra", "discourse"), ("[sś][aā]stra|treatise", "treatise"), ("dh[aā]ra[nṇ][iī]|hymn|stotra", "hymn"), ("[tṭ][iī]k[aā]|v[rṛ]tti|commentary", "commentary"))
# SQL of the same expressions
SQL_WORDS = "list_filter(string_split_regex({t}, '[ \\t\\r\\n]+'), lambda w: w <> '')"
SQL_CLEAN = "trim(regexp_replace({t}, '[ \\t\\r\\n]+', ' ', 'g'), ' ')"
SQL_LINES = "list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: trim(x, ' ')), lambda x: x <> '')"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _documents(spark, d).select("doc_id", X.tokens_by_chars(t).alias("by_chars"), X.tokens_by_bytes(t, 3).alias("by_bytes3"), X.tokens_by_bytes(t, 4).alias("by_bytes4"), X.tokens_cjk(t).alias("cjk"), X.word_count(t).alias("words"))


def length_guards(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).where((F.length("text") >= 50) & (X.word_count(F.col("text")) >= 10)).select("doc_id")


def clean_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.md5(X.clean_whitespace(X.unix_lines(F.col("text")))).alias("clean"))


def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.md5(X.strip_tags(F.col("text"))).alias("plain"))


def notes_strip(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.length(X.strip_notes(F.col("text"))).cast("bigint").alias("n"))


def boilerplate_strip(spark: SparkSession, d: str) -> DataFrame:
    """Each text wrapped in licence lines, some with the second spelling, and stripped again."""
    odd = F.col("doc_id") % 2 == 1
    head = F.concat(F.lit("Licence notice\n"), F.when(odd, START_MARKS[0]).otherwise(START_MARKS[1]), F.lit(" ***\n"))
    foot = F.concat(F.lit("\n"), F.when(odd, END_MARKS[0]).otherwise(END_MARKS[1]), F.lit(" ***\nMore licence"))
    return _documents(spark, d).select("doc_id", F.md5(X.strip_boilerplate(F.concat(head, "text", foot), START_MARKS, END_MARKS)).alias("body"))


def ocr_clean(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.md5(X.clean_ocr(X.unix_lines(F.col("text")))).alias("clean"))


def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    return K.chunk_target_min(_documents(spark, d), "doc_id", "text", 50, 10).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk"))


def chunk_chars(spark: SparkSession, d: str) -> DataFrame:
    return K.chunk_target_max(_documents(spark, d), "doc_id", "text", 800, 1200).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk"))


def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    return K.chunk_target_max(_documents(spark, d), "doc_id", "text", 400, 600, K.TOKENS).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk"))


def chunk_pending(spark: SparkSession, d: str) -> DataFrame:
    return K.chunk_pending(_documents(spark, d), "doc_id", "text", 20).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk"))


def chunk_single(spark: SparkSession, d: str) -> DataFrame:
    return K.chunk_single(_documents(spark, d), "doc_id", "text").select("doc_id", "chunk_index", F.md5("chunk").alias("chunk"))


def chunk_verses(spark: SparkSession, d: str) -> DataFrame:
    """Canon texts as books, their chunks as chapters, the lines of a chunk as verses."""
    rows = table(spark, d, "document_chunks").where("chunk_text is not null").select("text_id", (F.col("chunk_index").cast("bigint") * 10_000_000 + F.col("id")).alias("chapter"), F.expr(K.lines_of("chunk_text")).alias("verses"))
    cut = K.chunk_chapters(rows, "text_id", "chapter", "verses", 3, 8, 12)
    return cut.select("text_id", "start_chapter", "start_verse", F.md5("text").alias("text"))


def header_split(spark: SparkSession, d: str) -> DataFrame:
    header = "|".join(S.HEADERS.values())
    return S.split_headers(table(spark, d, "document_chunks"), "id", "chunk_text", header).select("id", "section", "header", F.md5("body").alias("body"))


def range_classify(spark: SparkSession, d: str) -> DataFrame:
    number = F.expr("try_cast(number as int)")
    return table(spark, d, "canon_texts").where(number.isNotNull()).select("id", S.by_range(number).alias("collection"))


def keyword_classify(spark: SparkSession, d: str) -> DataFrame:
    title = F.coalesce("title_sanskrit", "title_pali", "title_english", F.lit(""))
    return table(spark, d, "canon_texts").select("id", S.by_keyword(title, TITLE_RULES, "other").alias("class"))


def roman_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose text opens with a Roman chapter number, and its value."""
    n = F.regexp_extract("chunk_text", r"^(?:Chapter|CHAPTER) ([IVXLC]+)\.", 1)
    return table(spark, d, "document_chunks").where(n != "").select("id", n.alias("numeral"), S.roman_value(n).alias("value"))


def asof_chapter(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk with the last chapter label at or before it in its text."""
    chunks = table(spark, d, "document_chunks").select("id", "text_id", (F.col("chunk_index").cast("bigint") * 10_000_000 + F.col("id")).alias("at"), "chapter")
    marks = chunks.where("chapter is not null").select("text_id", "at", F.col("chapter").alias("running"))
    return S.as_of(chunks.drop("chapter"), marks, "text_id", "at", "running").select("id", "running")


def carried_section(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "document_chunks").select("id", "text_id", (F.col("chunk_index").cast("bigint") * 10_000_000 + F.col("id")).alias("at"), "section")
    return S.carry_forward(chunks, "text_id", "at", F.col("section"), "running").select("id", "running")


def seed_flatten(spark: SparkSession, d: str) -> DataFrame:
    return E.flatten_names(table(spark, d, "buddhist_entities"))


def _named_texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, text): logged questions and chunk texts, the ids of the questions below zero."""
    asked = table(spark, d, "api_usage").select((-F.col("id")).alias("id"), F.col("query_text").alias("text"))
    return asked.unionByName(table(spark, d, "document_chunks").select("id", F.col("chunk_text").alias("text")))


def _names(spark: SparkSession, d: str) -> DataFrame:
    """(entity_id, name_text): the entities' names, and the texts' authors as further entities."""
    authors = table(spark, d, "canon_texts").where("author is not null").groupBy(F.col("author").alias("name_text")).agg((F.min("id") + 1_000_000).alias("entity_id"))
    return table(spark, d, "entity_name_variants").select("entity_id", "name_text").unionByName(authors)


def ner_mentions(spark: SparkSession, d: str) -> DataFrame:
    return E.mentions(_named_texts(spark, d), _names(spark, d), "id", "text")


def substring_tags(spark: SparkSession, d: str) -> DataFrame:
    return E.substring_tags(_named_texts(spark, d), _names(spark, d), "id", "text")


def trigram_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every entity's English name against all variants."""
    return E.fuzzy_lookup(table(spark, d, "buddhist_entities"), table(spark, d, "entity_name_variants"), "id", "english_preferred", "id", "name_text")


def entity_card(spark: SparkSession, d: str) -> DataFrame:
    variants = table(spark, d, "entity_name_variants").groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("o"), "language", "name_text"))).alias("v"))
    names = F.array_join(F.transform("v", lambda x: F.concat_ws(":", x["language"], x["name_text"])), " | ")
    return table(spark, d, "buddhist_entities").join(variants, "id", "left").select("id", "entity_type", "english_preferred", names.alias("names"))


def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every text's chunks in order, as one."""
    rows = table(spark, d, "document_chunks").where("chunk_text is not null").groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "chunk_text"))).alias("c"))
    return rows.select("text_id", F.size("c").cast("bigint").alias("chunks"), F.md5(F.array_join(F.transform("c", lambda x: x["chunk_text"]), "\n\n")).alias("text"))


def group_lines(spark: SparkSession, d: str) -> DataFrame:
    """References of a text in order, its first section, and its bucket of a hundred."""
    rows = table(spark, d, "document_chunks").groupBy("text_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "id", F.coalesce("reference", F.lit("")).alias("r")))).alias("c"), F.min_by("section", F.struct("chunk_index", "id")).alias("first_section")
    )
    low = (F.floor((F.col("text_id") - 1) / 100) * 100 + 1).cast("bigint")
    return rows.select("text_id", F.array_join(F.transform("c", lambda x: x["r"]), " | ").alias("references"), "first_section", F.when(F.col("text_id") > 0, F.concat(low, F.lit("-"), low + 99)).otherwise("misc").alias("bucket"))


def group_by_book(spark: SparkSession, d: str) -> DataFrame:
    usable = X.word_count(F.coalesce("chunk_text", F.lit(""))) >= 5
    return table(spark, d, "document_chunks").groupBy(F.coalesce("chapter", F.lit("0")).alias("book")).agg(F.count_if(usable).alias("usable"), F.count_if(~usable).alias("skipped"))


def largest_body(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("length(text) > 500").groupBy("source").agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("doc_id"), F.max(F.length("text")).cast("bigint").alias("n"))
    return rows


def title_prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canon_texts").where("title_english is not null").groupBy(F.split_part("title_english", F.lit(" and "), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"))


def context_block(spark: SparkSession, d: str) -> DataFrame:
    """Every text's chunks as numbered context with an excerpt of each."""
    rows = table(spark, d, "document_chunks").where("chunk_text is not null").groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("reference", F.lit("")).alias("r"), F.substring("chunk_text", 1, 200).alias("x")))).alias("c"))
    block = F.array_join(F.transform("c", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["r"], F.lit("\n"), x["x"], F.lit("…"))), "\n\n---\n\n")
    return rows.select("text_id", F.md5(block).alias("context"))


def deep_link(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "canon_texts")
    link = F.concat(F.lit("https://reader.example/"), F.regexp_replace("external_id", "[a-z]$", ""), F.lit("?q="), X.url_quote(F.substring("title_english", 1, 40)))
    return t.select("id", F.when(F.col("title_english").isNotNull(), link).otherwise(F.col("url")).alias("link"))


def query_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Test items as two wordings each: the question and the opening of its passage."""
    rows = table(spark, d, "eval_items").select("item_id", "query", F.substring("passage", 1, 80).alias("opening"))
    return rows.unpivot("item_id", ["query", "opening"], "kind", "wording")


def _fold_sql(size: str, before: str, after: str, joiner: str) -> str:
    n = size.format(t="u")
    add = f"CASE WHEN {before.format(n=n)} THEN {{'done': list_append(a.done, a.buf), 'buf': u, 'w': {n}}} ELSE {{'done': a.done, 'buf': CASE WHEN a.w = 0 AND a.buf = '' THEN u ELSE a.buf || {joiner} || u END, 'w': a.w + {n}}} END"
    step = add if not after else f"list_transform([{add}], lambda b: CASE WHEN {after} THEN {{'done': list_append(b.done, b.buf), 'buf': '', 'w': 0::BIGINT}} ELSE b END)[1]"
    fold = f"list_reduce(units, lambda a, u: {step}, {{'done': []::VARCHAR[], 'buf': '', 'w': 0::BIGINT}})"
    return f"""
        WITH rows AS (SELECT doc_id, list_transform({SQL_LINES}, lambda x: x) AS units FROM documents WHERE text IS NOT NULL),
             folded AS (SELECT doc_id, {fold} AS s FROM (SELECT doc_id, units FROM rows)),
             lists AS (SELECT doc_id, CASE WHEN s.buf <> '' THEN list_append(s.done, s.buf) ELSE s.done END AS c FROM folded)
        SELECT doc_id, (generate_subscripts(c, 1) - 1)::INTEGER AS chunk_index, md5(unnest(c)) AS chunk FROM lists"""


_N_WORDS = f"len({SQL_WORDS})::BIGINT"
_SQL_TRIGRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
_POSITION = "chunk_index::BIGINT * 10000000 + id"
_NAMED_TEXTS = "SELECT -id AS id, query_text AS text FROM api_usage UNION ALL SELECT id, chunk_text FROM document_chunks"
_NAMES = "SELECT entity_id, name_text FROM entity_name_variants UNION ALL SELECT min(id) + 1000000, author FROM canon_texts WHERE author IS NOT NULL GROUP BY author"
_OWNERS = f"SELECT name_text, min(entity_id) AS entity_id FROM ({_NAMES}) WHERE name_text IS NOT NULL AND trim(name_text) <> '' GROUP BY name_text"
QUERIES = {f.__name__: f for f in (
    token_estimates, length_guards, clean_whitespace, html_strip, notes_strip, boilerplate_strip, ocr_clean, chunk_words, chunk_chars, chunk_tokens,
    chunk_pending, chunk_single, chunk_verses, header_split, range_classify, keyword_classify, roman_chapters, asof_chapter, carried_section,
    seed_flatten, ner_mentions, substring_tags, trigram_lookup, entity_card, text_chunks, group_lines, group_by_book, largest_body,
    title_prefix_counts, context_block, deep_link, query_unpivot,
)}
ORACLE = {
    "token_estimates": f"SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS by_chars, greatest(1, strlen(text) // 3)::BIGINT AS by_bytes3, greatest(1, strlen(text) // 4)::BIGINT AS by_bytes4, (length(text) // 2)::BIGINT AS cjk, {_N_WORDS.format(t='text')} AS words FROM documents WHERE text IS NOT NULL",
    "length_guards": f"SELECT doc_id FROM documents WHERE length(text) >= 50 AND {_N_WORDS.format(t='text')} >= 10",
    "clean_whitespace": f"SELECT doc_id, md5({SQL_CLEAN.format(t='text')}) AS clean FROM documents WHERE text IS NOT NULL",
    "html_strip": "SELECT doc_id, md5(" + SQL_CLEAN.format(t="regexp_replace(text, '<[^>]+>', '', 'g')") + ") AS plain FROM documents WHERE text IS NOT NULL",
    "notes_strip": "SELECT doc_id, length(regexp_replace(text, '\\[[0-9]{1,3}\\]', '', 'g'))::BIGINT AS n FROM documents WHERE text IS NOT NULL",
    "boilerplate_strip": "SELECT doc_id, md5(trim(text || chr(10), ' ')) AS body FROM documents WHERE text IS NOT NULL",
    "chunk_words": _fold_sql(_N_WORDS, "a.w > 0 AND a.w + {n} > 50 AND a.w >= 10", "", "chr(10)"),
    "chunk_chars": _fold_sql("length({t})::BIGINT", "a.buf <> '' AND a.w + {n} > 1200", "b.w >= 800", "chr(10) || chr(10)"),
    "chunk_tokens": _fold_sql("greatest(1, length({t}) // 4)::BIGINT", "a.buf <> '' AND a.w + {n} > 600", "b.w >= 400", "chr(10) || chr(10)"),
    "chunk_pending": _fold_sql(_N_WORDS, "a.buf <> '' AND {n} >= 20", "", "' '"),
    "chunk_single": f"SELECT doc_id, 0::INTEGER AS chunk_index, md5(trim(text, chr(32))) AS chunk FROM documents WHERE {_N_WORDS.format(t='text')} >= 5",
    "range_classify": "SELECT id, CASE WHEN n <= 151 THEN 'agama' WHEN n <= 219 THEN 'jataka-avadana' WHEN n <= 261 THEN 'prajnaparamita' WHEN n <= 277 THEN 'lotus' WHEN n <= 309 THEN 'avatamsaka' WHEN n <= 373 THEN 'ratnakuta' WHEN n <= 423 THEN 'nirvana-sutra' WHEN n <= 847 THEN 'tantra' WHEN n <= 1163 THEN 'vinaya' WHEN n <= 1692 THEN 'abhidharma' ELSE 'commentary' END AS collection FROM (SELECT id, try_cast(number AS INTEGER) AS n FROM canon_texts) WHERE n IS NOT NULL",
    "keyword_classify": "SELECT id, CASE " + " ".join(f"WHEN regexp_matches(coalesce(title_sanskrit, title_pali, title_english, ''), '(?i){p}') THEN '{c}'" for p, c in TITLE_RULES) + " ELSE 'other' END AS class FROM canon_texts",
    "asof_chapter": f"SELECT id, last_value(chapter IGNORE NULLS) OVER (PARTITION BY text_id ORDER BY {_POSITION} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM document_chunks",
    "carried_section": f"SELECT id, last_value(section IGNORE NULLS) OVER (PARTITION BY text_id ORDER BY {_POSITION} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM document_chunks",
    "seed_flatten": "SELECT DISTINCT id AS entity_id, name_text, language, coalesce(name_text = english_preferred AND language = 'en', false) AS is_primary FROM (" + " UNION ALL ".join(f"SELECT id, english_preferred, {c} AS name_text, '{lang}' AS language FROM buddhist_entities" for c, lang in E.NAME_COLUMNS.items()) + " UNION ALL SELECT id, english_preferred, unnest(english_alternates), 'en' FROM buddhist_entities) WHERE name_text IS NOT NULL AND trim(name_text) <> ''",
    "ner_mentions": f"""
        WITH names AS (SELECT entity_id, ' ' || array_to_string(regexp_extract_all(lower(name_text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), ' ') || ' ' AS name FROM ({_OWNERS})),
             texts AS (SELECT id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), ' ') || ' ' AS t FROM ({_NAMED_TEXTS}) WHERE text IS NOT NULL)
        SELECT id, entity_id, min(length(before) - length(replace(before, ' ', '')))::INTEGER AS first_word
        FROM (SELECT id, entity_id, substring(t, 1, strpos(t, name) - 1) AS before FROM texts JOIN names ON contains(t, name) WHERE trim(name) <> '') GROUP BY id, entity_id""",
    "substring_tags": f"SELECT DISTINCT id, entity_id FROM ({_NAMED_TEXTS}) JOIN ({_OWNERS}) n ON contains(lower(text), lower(name_text))",
    "trigram_lookup": f"""
        WITH q AS (SELECT id AS query_id, {_SQL_TRIGRAMS.format(t='english_preferred')} AS g FROM buddhist_entities), n AS (SELECT id AS name_id, {_SQL_TRIGRAMS.format(t='name_text')} AS h FROM entity_name_variants),
             s AS (SELECT query_id, name_id, round(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))), 6) AS score FROM q, n WHERE len(g) > 0 AND len(h) > 0)
        SELECT query_id, name_id, score FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name_id) <= 5""",
    "entity_card": "SELECT b.id, entity_type, english_preferred, names FROM buddhist_entities b LEFT JOIN (SELECT entity_id, string_agg(concat_ws(':', language, name_text), ' | ' ORDER BY NOT is_primary, language NULLS FIRST, name_text) AS names FROM entity_name_variants GROUP BY entity_id) v ON v.entity_id = b.id",
    "text_chunks": "SELECT text_id, count(*) AS chunks, md5(string_agg(chunk_text, chr(10) || chr(10) ORDER BY chunk_index, id)) AS text FROM document_chunks WHERE chunk_text IS NOT NULL GROUP BY text_id",
    "group_lines": "SELECT text_id, string_agg(coalesce(reference, ''), ' | ' ORDER BY chunk_index, id) AS \"references\", first(section ORDER BY chunk_index, id) AS first_section, ((text_id - 1) // 100 * 100 + 1) || '-' || ((text_id - 1) // 100 * 100 + 100) AS bucket FROM document_chunks GROUP BY text_id",
    "group_by_book": f"SELECT coalesce(chapter, '0') AS book, count(*) FILTER (w >= 5) AS usable, count(*) FILTER (w < 5) AS skipped FROM (SELECT chapter, {_N_WORDS.format(t='coalesce(chunk_text, chr(32))')} AS w FROM document_chunks) GROUP BY 1",
    "largest_body": "SELECT source, doc_id, length(text)::BIGINT AS n FROM documents WHERE length(text) > 500 QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) = 1",
    "title_prefix_counts": "SELECT split_part(title_english, ' and ', 1) AS prefix, count(*) AS n FROM canon_texts WHERE title_english IS NOT NULL GROUP BY 1",
    "context_block": "SELECT text_id, md5(string_agg('[' || k || '] ' || r || chr(10) || x || '…', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k)) AS context FROM (SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY id) AS k, coalesce(reference, '') AS r, substring(chunk_text, 1, 200) AS x FROM document_chunks WHERE chunk_text IS NOT NULL) GROUP BY text_id",
    "query_unpivot": "SELECT item_id, 'query' AS kind, query AS wording FROM eval_items UNION ALL SELECT item_id, 'opening', substring(passage, 1, 80) FROM eval_items",
    "deep_link": "SELECT id, CASE WHEN title_english IS NOT NULL THEN 'https://reader.example/' || regexp_replace(external_id, '[a-z]$', '') || '?q=' || url_encode(substring(title_english, 1, 40)) ELSE url END AS link FROM canon_texts",
}
