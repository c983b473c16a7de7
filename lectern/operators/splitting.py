"""Header splitters and classifiers: rule tables applied as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers by style of text.
HEADERS = {
    "chapter": r"(?:CHAPTER|Chapter)[ \t]+(?:[IVXLCDM]+|[0-9]+)\.?",
    "book": r"BOOK[ \t]+(?:THE[ \t]+)?(?:[IVXLCDM]+|[A-Z]+)\.?",
    "numbered": r"[0-9]{1,3}\.[ \t]",
    "section": r"SECTION[ \t]+(?:[IVXLCDM]+|[0-9]+)\.?",
    "hymn": r"HYMN[ \t]+(?:[IVXLCDM]+|[0-9]+)\.?",
}
# Upper bounds of text numbers and the collection up to each.
NUMBER_RANGES = (
    (151, "agama"), (219, "jataka-avadana"), (261, "prajnaparamita"), (277, "lotus"), (309, "avatamsaka"), (373, "ratnakuta"),
    (423, "nirvana-sutra"), (847, "tantra"), (1163, "vinaya"), (1692, "abhidharma"),
)
LAST_RANGE = "commentary"


def split_headers(df: DataFrame, id_col: str, text_col: str, header: str, least_chars: int = 0) -> DataFrame:
    """(id, section, header, body): the parts of each text from one header to the next, in order.

    A text without a header is one part with a null header.  Headers begin a line.
    """
    mark = "\u0001"
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.col(text_col)), rf"\n[ \t]*({header})", f"{mark}$1{mark}")
    pieces = F.split(marked, mark)
    n = F.size(pieces)
    pairs = F.when(n == 1, F.array(F.struct(F.lit(None).cast("string").alias("header"), F.trim(F.col(text_col)).alias("body")))).otherwise(
        F.transform(F.sequence(F.lit(1), F.floor((n - 1) / 2).cast("int")), lambda i: F.struct(F.trim(F.get(pieces, 2 * i - 1)).alias("header"), F.trim(F.regexp_replace(F.get(pieces, 2 * i), r"^[\s]+|[\s]+$", "")).alias("body")))
    )
    rows = df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(pairs).alias("section", "p"))
    return rows.select(id_col, "section", F.col("p.header").alias("header"), F.col("p.body").alias("body")).where(F.length("body") >= least_chars)


def by_range(number: Column, ranges: tuple[tuple[int, str], ...] = NUMBER_RANGES, otherwise: str = LAST_RANGE) -> Column:
    """The label of the first range whose bound isn't passed."""
    chosen = F.lit(otherwise)
    for bound, label in reversed(ranges):
        chosen = F.when(number <= bound, label).otherwise(chosen)
    return chosen


def by_keyword(text: Column, rules: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    """The label of the first pattern found, whatever the case."""
    chosen = F.lit(otherwise)
    for pattern, label in reversed(rules):
        chosen = F.when(text.rlike(f"(?i){pattern}"), label).otherwise(chosen)
    return chosen


def roman_value(text: Column) -> Column:
    """Value of a Roman numeral: a letter counts against the next one if that is greater."""
    values = F.transform(F.filter(F.split(F.upper(text), ""), lambda c: c != ""), lambda c: F.expr("1").cast("int") * F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in p]), c), F.lit(0)))
    signed = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v))
    return F.aggregate(signed, F.lit(0), lambda a, v: a + v)


def carry_forward(df: DataFrame, group_col: str, order_col: str, value: Column, out_col: str) -> DataFrame:
    """The last non-null value at or before each row of its group."""
    w = Window.partitionBy(group_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out_col, F.last(value, ignorenulls=True).over(w))


def as_of(df: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each row of ``df`` with the last ``value`` of ``marks`` at or before it, by key: one shuffle, no range join."""
    both = df.select("*", F.lit(None).cast(marks.schema[value].dataType).alias(value), F.lit(1).alias("__side")).unionByName(
        marks.select(key, at, value, F.lit(0).alias("__side")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("__side = 1").drop("__side")
