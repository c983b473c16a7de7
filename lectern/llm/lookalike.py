"""Problem 1: text that looks the same but is stored with different characters.

``canonical_text`` brings a text column to one consistent form.  The work runs
as DuckDB SQL over the Arrow batches of each Spark partition: canonical
composition (``nfc_normalize``), one ``translate`` for every single-character
mapping (compatibility forms, blanks, look-alike letters), regular expressions
for invisible characters, line ends and forms that expand to several letters,
and a second composition so that mapped bases join their accents again.

Defined results: null stays null; blank text becomes the empty string; the form
is idempotent; case, missing accents and the number of inner blanks or line
breaks stay visible differences.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.relational import split_join
from lectern.session import cut, spread

# Letters of other scripts that are drawn like a Latin letter.
LOOKALIKE_LETTERS = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ү": "Y", "Ԛ": "Q",
    # Greek
    "ο": "o", "ϲ": "c", "ϳ": "j", "ρ": "p", "ϱ": "p", "ν": "v", "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H",
    "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y",
    "Ζ": "Z",
    # Armenian
    "օ": "o", "հ": "h", "ո": "n", "ս": "u", "Օ": "O", "Տ": "S", "Լ": "L",
    # Latin letters drawn like another Latin letter
    "ɡ": "g", "ɩ": "i", "ı": "i", "ſ": "s",
}
# Hyphens and spacing marks drawn alike.
LOOKALIKE_MARKS = {"‐": "-", "‑": "-", "﹣": "-", "༌": "་", "ʼ": "’"}
# Characters that show nothing (besides the Unicode category Cf).
INVISIBLE_EXTRA = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
# Visible members of the category Cf (number and verse signs).
VISIBLE_FORMAT = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"
# Kinds of compatibility mapping under which the drawn shape stays the same.
SAME_SHAPE = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>", "<font>")
LINE_ENDS = "\r\n|[\r\x0b\x0c  ]"


def _map_bases(text: str) -> str:
    """Look-alike bases mapped below their accents, composed again."""
    return unicodedata.normalize("NFC", "".join(LOOKALIKE_LETTERS.get(c, c) for c in unicodedata.normalize("NFD", text)))


@lru_cache(maxsize=1)
def _rules() -> tuple[str, str, list[tuple[str, str]], str]:
    """(from, to) of ``translate``, the expansions, and the invisible characters.

    Built by rule from the Unicode database, so no table is written out here.
    """
    single: dict[str, str] = {}
    expanded: list[tuple[str, str]] = []
    invisible: list[str] = []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Cs", "Co"):
            continue
        if (kind == "Cf" and c not in VISIBLE_FORMAT) or c in INVISIBLE_EXTRA or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            invisible.append(c)
            continue
        if kind == "Zs":
            single[c] = " "
            continue
        to = LOOKALIKE_LETTERS.get(c, c)  # the shape comes before the compatibility form: a lunate sigma is drawn like c
        for _ in range(4):  # a mapping may lead to another one
            how = unicodedata.decomposition(to) if len(to) == 1 else ""
            if how.startswith(SAME_SHAPE):
                to = "".join(chr(int(x, 16)) for x in how.split()[1:])
            to = _map_bases("".join(LOOKALIKE_MARKS.get(x, x) for x in to))
        if to == unicodedata.normalize("NFC", c):
            continue  # the composition alone does it
        if len(to) == 1:
            single[c] = to
        elif to[0] != " ":  # a spacing accent stays as it is
            expanded.append((c, to))
    single["\t"] = " "
    return "".join(single), "".join(single.values()), expanded, "".join(invisible)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _char_class(chars: str) -> str:
    """An RE2 class of the characters, neighbours joined to ranges."""
    ranges: list[list[int]] = []
    for code in sorted(set(map(ord, chars))):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


@lru_cache(maxsize=1)
def canonical_sql() -> str:
    """The embedded SQL over ``raw(i, t)``, with the table ``forms(f, x)`` of expansions.

    Rows that hold none of the mapped characters skip the mapping.  Rows with an
    expanding form are split into characters, mapped by a join and put together
    again.
    """
    source, target, expanded, invisible = _rules()
    hidden, single, many = _char_class(invisible), _char_class(source), _char_class("".join(c for c, _ in expanded))
    edges = "^[ \\n]+|[ \\n]+$"
    return f"""
        WITH hit AS (SELECT i, t FROM raw WHERE regexp_matches(t, {_quoted(many)})),
             chars AS (SELECT i, unnest(string_split(t, '')) AS f, generate_subscripts(string_split(t, ''), 1) AS n FROM hit),
             spread AS (SELECT i, string_agg(coalesce(x, chars.f), '' ORDER BY n) AS t FROM chars LEFT JOIN forms USING (f) GROUP BY i),
             shown AS (SELECT raw.i, regexp_replace(regexp_replace(coalesce(spread.t, raw.t), {_quoted(hidden)}, '', 'g'),
                              {_quoted(LINE_ENDS)}, chr(10), 'g') AS t FROM raw LEFT JOIN spread USING (i)),
             composed AS (SELECT i, nfc_normalize(t) AS t FROM shown),
             mapped AS (SELECT i, CASE WHEN regexp_matches(t, {_quoted(single)})
                               THEN nfc_normalize(translate(t, {_quoted(source)}, {_quoted(target)})) ELSE t END AS t FROM composed)
        SELECT regexp_replace(t, {_quoted(edges)}, '', 'g') AS c FROM mapped ORDER BY i
    """


def canonical_batches(batches: Iterator[pa.RecordBatch], text_at: int, keep: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds the canonical form to each Arrow batch, by DuckDB inside the task."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    sql = canonical_sql()
    con.execute("CREATE TEMP TABLE forms(f VARCHAR, x VARCHAR)")
    con.register("expansions", pa.table({"f": [c for c, _ in _rules()[2]], "x": [x for _, x in _rules()[2]]}))
    con.execute("INSERT INTO forms SELECT f, x FROM expansions")
    for batch in batches:
        if not batch.num_rows:
            continue
        con.register("raw", pa.table({"i": pa.array(range(batch.num_rows), pa.int64()), "t": batch.column(text_at).cast(pa.string())}))
        form = con.sql(sql).to_arrow_table().column(0).combine_chunks()
        con.unregister("raw")
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), form.cast(pa.string())], names=names)


def canonical_text(df: DataFrame, text_col: str, out_col: str = "canonical") -> DataFrame:
    """``df`` with the consistent form of ``text_col`` in ``out_col``.

    Narrow: no shuffle.  A column that is called like ``out_col`` is replaced.
    Null gives null, blank text gives ``''``.
    """
    kept = [c for c in df.columns if c != out_col]
    cols = [f"`{c}`" for c in kept]
    schema = T.StructType([*df.select(*cols).schema.fields, T.StructField(out_col, T.StringType())])
    source = df.select(*cols, F.col(f"`{text_col}`").alias("__text"))
    at = len(kept)
    return source.mapInArrow(lambda it: canonical_batches(it, at, list(range(at)), [*kept, out_col]), schema)


def look_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, look, form): the class of rows that look like each row, and the stored form inside it.

    Classes and forms are digests of the canonical and of the stored text.  Blank
    and null texts take no part; a repeated row counts once.
    """
    rows = canonical_text(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").where(F.length("canonical") > 0)
    return rows.select("id", F.unhex(F.md5("canonical")).alias("look"), F.unhex(F.md5("text")).alias("form")).distinct()


def form_pairs(classes: DataFrame) -> DataFrame:
    """(look, form, other): the stored forms of a class with one another, each pair once.  Copies of a form don't matter."""
    forms = classes.select("look", "form").distinct()
    several = forms.groupBy("look").agg(F.count("*").alias("forms")).where("forms > 1").select("look")
    forms = forms.join(several, "look", "left_semi")
    return forms.join(forms.select("look", F.col("form").alias("other")), "look").where("form < other")


def same_looking_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b): rows whose texts look the same but are stored differently.

    The pairs of forms are expanded to the rows that hold them; a form that holds
    a third of all rows makes no pair with itself and is spread over tasks.
    """
    classes = cut(look_classes(df, id_col, text_col))
    pairs = form_pairs(classes)
    first = split_join(classes.withColumnRenamed("id", "x"), pairs, ["look", "form"]).select("look", F.col("other").alias("form"), "x")
    both = split_join(first, classes.withColumnRenamed("id", "y"), ["look", "form"]).where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk text and entity name in the consistent form."""
    chunks = spark.read.parquet(f"{sf_dir}/document_chunks.parquet").select(F.lit("document_chunks").alias("tbl"), "id", F.col("chunk_text").alias("text"))
    names = spark.read.parquet(f"{sf_dir}/entity_name_variants.parquet").select(F.lit("entity_name_variants").alias("tbl"), "id", F.col("name_text").alias("text"))
    return canonical_text(chunks.unionByName(names), "text").select("tbl", "id", "canonical")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, id_a, id_b) of texts that look the same but differ as stored."""
    found = None
    for name, text in (("document_chunks", "chunk_text"), ("entity_name_variants", "name_text")):
        part = same_looking_pairs(spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select("id", text)), "id", text).select(F.lit(name).alias("tbl"), "id_a", "id_b")
        found = part if found is None else found.unionByName(part)
    return found


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, look, representative, rows, forms): the classes with several stored forms, by their smallest id."""
    found = None
    for name, text in (("document_chunks", "chunk_text"), ("entity_name_variants", "name_text")):
        classes = look_classes(spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select("id", text)), "id", text)
        part = classes.groupBy("look").agg(F.min("id").alias("representative"), F.countDistinct("id").alias("rows"), F.countDistinct("form").alias("forms")).where("forms > 1")
        part = part.select(F.lit(name).alias("tbl"), F.lower(F.hex("look")).alias("look"), "representative", "rows", "forms")
        found = part if found is None else found.unionByName(part)
    return found


QUERIES = {"p1_found": p1_found, "p1_canonical": p1_canonical, "p1_classes": p1_classes}
ORACLE: dict[str, str] = {}
