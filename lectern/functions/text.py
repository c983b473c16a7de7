"""Scalar text functions as column expressions, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of a lexeme without a class, and the limit of the sum of inverse squares.
PLAIN_WEIGHT, INVERSE_SQUARES = 0.1, 1.64493406685


def tokens_by_chars(text: Column) -> Column:
    """Token estimate: characters by four, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def tokens_by_bytes(text: Column, each: int) -> Column:
    """Token estimate: UTF-8 bytes by ``each``, one at least."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / each)).cast("bigint")


def tokens_cjk(text: Column) -> Column:
    """Token estimate for texts without blanks: characters by two."""
    return F.floor(F.length(text) / 2).cast("bigint")


def words(text: Column) -> Column:
    """The words between blanks; edge blanks give none."""
    return F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def clean_whitespace(text: Column) -> Column:
    """Line ends and runs of blanks as one space, edges cut."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def strip_tags(text: Column) -> Column:
    """Markup tags left out, blanks joined."""
    return clean_whitespace(F.regexp_replace(text, "<[^>]+>", ""))


def strip_boilerplate(text: Column, starts: tuple[str, ...], ends: tuple[str, ...]) -> Column:
    """The text after the line of the first start marker that occurs, up to the first end marker that occurs."""
    body = text
    for marker in reversed(starts):
        at = F.instr(text, marker)
        rest = F.substring(text, at + len(marker), F.length(text))
        line = F.instr(rest, "\n")
        body = F.when(at > 0, F.when(line > 0, F.substring(rest, line + 1, F.length(rest))).otherwise(rest)).otherwise(body)
    cut = body
    for marker in reversed(ends):
        at = F.instr(body, marker)
        cut = F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(cut)
    return F.trim(cut)


def clean_ocr(text: Column) -> Column:
    """Page-number lines dropped, spaced capitals and words broken at line ends joined, blank lines squeezed."""
    text = F.regexp_replace(text, r"(?m)^[ \t]*[0-9]{1,4}[ \t]*$\n?", "")
    text = F.regexp_replace(text, r"(?<![A-Za-z])([A-Z]) (?=[A-Z](?: [A-Z])*(?![A-Za-z]))", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"-\n[ \t]*", ""), r"\n{3,}", "\n\n"))


def strip_notes(text: Column) -> Column:
    """Note marks like [12] left out."""
    return F.regexp_replace(text, r"\[[0-9]{1,3}\]", "")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def padded_id(prefix: str, number: Column, width: int = 3) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.lpad(number.cast("string"), width, "0"))


def url_quote(text: Column) -> Column:
    """Percent encoding in which only letters, digits and ``_.-~`` stay."""
    text = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(text, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def lexemes(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def query_terms(text: Column) -> Column:
    """Distinct lexemes of a query of at least two characters."""
    return F.array_distinct(F.filter(lexemes(text), lambda w: F.length(w) >= 2))


def term_rank(tf: Column) -> Column:
    """Part of one term in the rank of an OR query: weight times the sum of inverse squares up to its frequency."""
    squares = F.aggregate(F.sequence(F.lit(1), tf.cast("int")), F.lit(0.0), lambda a, j: a + F.lit(1.0) / (j * j))
    return F.lit(PLAIN_WEIGHT) * squares / F.lit(INVERSE_SQUARES)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded by two blanks before and one after."""
    padded = F.transform(lexemes(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3))))
    return F.array_distinct(grams)


def similarity(a: Column, b: Column) -> Column:
    """Share of common trigrams among all of both."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
