"""Texts divided at their headings: a registry of styles and one operator that applies any of them.

A style names the headings, what is cut between them, and the sizes of the
chunks.  Dividing is a narrow expression on each text; the fold into chunks runs
over the sizes of the parts alone (``chunking.assigned``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import clean_whitespace
from lectern.operators.chunking import TARGET_MIN, TOKENS, WORDS, assigned

MARK = "\u0001"


@dataclass(frozen=True)
class Style:
    """How a kind of text is divided.

    ``outer`` are headings to try in order: the first that occurs at least
    ``least_headers`` times divides the text, else it stays whole.  ``inner``
    divides what ``outer`` gave, if it occurs ``least_inner`` times.  ``mode``:
    "paragraphs" and "lines" fold the pieces of each part, "whole" keeps a part
    of up to ``whole_words`` and folds the paragraphs of a longer one, "grouped"
    folds the parts themselves, and a group over ``recut_words`` by paragraph.
    """

    outer: tuple[str, ...] = ()
    inner: str = ""
    mode: str = "paragraphs"
    target: int = 350
    least: int = 80
    least_headers: int = 1
    least_inner: int = 1
    piece_words: int = 6
    part_words: int = 0
    chunk_words: int = 0
    whole_words: int = 700
    recut_words: int = 0
    skip_chars: int = 0
    repairs: tuple[tuple[str, str], ...] = ()
    largest_chars: int = 0


# Headings of the known kinds of text.
ORDINALS = "FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH|ELEVENTH|TWELFTH|THIRTEENTH"
NUMERAL = r"[IVXLCDM\d]+"
CHAPTER_LINE = rf"CHAPTER\s+{NUMERAL}\.?[ \t]*[\w ,\-]*(?=\n|$)"
CHAPTER_WORD = r"CHAPTER\s+\w+"
BOOK_NUMBER = rf"BOOK\s+(?:THE\s+)?(?:{ORDINALS}|[IVX]+)\b"
BOOK_ALONE = r"BOOK\s+[IVXLC]+\.?[ \t]*(?=\n|$)"
ENTRY = r"(?:[IVXLC]{1,8}|\d{1,3})\.\s+(?-i:(?=[A-Z'\"(]))"
CAPITALS = r"(?-i:(?=(?:[^A-Z\n]*[A-Z]){4})(?!(?:[^ \n]+ +){12})[A-Z][A-Z ,'\-]{5,80})[ \t]*(?=\n)"
UPANISHADS = (
    "Isa|Isha|Katha|Kena|Talavak[aâ]ra|Chandogya|Kh[aâ]nd[ao]gya|Mundaka|Taittir[iî]ya|Aitareya|Briha[d]?[aâ]r[aâ]nyaka|Pra[sś]na|[ŚS]vet[aâ][sś]vatara|Maitr[aâ]yan[iî]|Mandukya"
)
PARVAS = (
    "ADI|SABHA|VANA|ARANYAKA|VIRATA|UDYOGA|BHISHMA|DRONA|KARNA|SHALYA|SAUPTIKA|STRI|SHANTI|SANTI|ANUSHASANA|ANUSASANA|ANUSASANIKA|ASHVAMEDHIKA|ASVAMEDHIKA|"
    "ASHRAMAVASIKA|MAUSALA|MAHAPRASTHANIKA|SVARGAROHANA"
)
STYLES = {
    "paragraphs": Style(),
    "dialogue": Style(piece_words=4),
    "chapters": Style((CHAPTER_LINE,), mode="whole", part_words=10),
    "gita": Style((rf"CHAPTER\s+[IVXLC]+\b", rf"BOOK\s+THE\s+(?:{ORDINALS})"), target=250),
    "upanishads": Style((rf"(?:THE\s+)?(?:{UPANISHADS})[\w\-\s]{{0,40}}upanishad[ \t]*(?=\n|$)",), target=300, largest_chars=1000),
    "yoga_sutras": Style((r"BOOK\s+(?:[IVX]+|THE\s+\w+|FIRST|SECOND|THIRD|FOURTH)[^\n]*PADA", BOOK_ALONE), r"\d{1,3}\.\s+", "grouped", least_inner=3),
    "mahabharata": Style((rf"(?:{PARVAS})\s+PARVA\b",), r"SECTION\s+[IVXLCDM\d]+", "grouped", largest_chars=10_000, chunk_words=80),
    "rigveda": Style((r"\[?BOOK\s+[IVX]+\.?\]?(?=\n|$)",), r"HYMN\s+[IVXLCDM\d]+\.?", "grouped", part_words=10, repairs=((r"(BOOK\s+)VIIL", "$1VIII"), (r"(BOOK\s+)IIL", "$1III"), (r"(BOOK\s+)VIL", "$1VII"), (r"(BOOK\s+)IL", "$1II"))),
    "ramayana": Style((r"BOOK\s+[IVX]+[.'\d\s]*(?=\n)",), rf"CANTO\s+{NUMERAL}\.?[ \t]*[\w ]*(?=\n)", "whole", part_words=20, skip_chars=30_000),
    "kalidasa": Style((rf"(?:ACT\s+{NUMERAL}|SHAKUNTALA|THE LITTLE CLAY CART|MEGHADUTA|THE CLOUD MESSENGER|THE SEASON OF SPRING|MALATI AND MADHAVA|URVASIE)\b",)),
    "entries": Style((rf"THE\s+(?:{ORDINALS})\s+BOOK[ \t]*(?=\n|$)", BOOK_NUMBER), ENTRY, "grouped", part_words=5),
    "discourses": Style((rf"(?:CHAPTER|DISCOURSE|SECTION)\s+{NUMERAL}[.\-]?[ \t]*[\w ,]*(?=\n)",), mode="whole", part_words=10),
    "books_chapters": Style((BOOK_NUMBER,), CHAPTER_WORD, "whole", part_words=10),
    "parts_chapters": Style((rf"(?:PART|BOOK)\s+(?:THE\s+)?(?:{ORDINALS}|[IVX]+)\b[\w ,\-]*(?=\n)",), CHAPTER_LINE, "whole", part_words=10),
    "latin_books": Style((rf"(?:BOOK|LIBER)\s+(?:THE\s+)?(?:{ORDINALS}|[IVXLC]+)\b",)),
    "latin_poetry": Style((rf"(?:BOOK|LIBER)\s+(?:THE\s+)?(?:{ORDINALS}|[IVXLC]+)\b",), mode="lines", piece_words=3),
    "analects": Style((r"BOOK\s+[IVXLC]+\.\s*\w+",), rf"(?:CHAP(?:TER)?\.?\s+[IVXLC\d]+\.?|(?:\d+|[IVX]+)\.\s+(?=[A-Z]))", "grouped", least=60, part_words=5),
    "tao": Style((r"PART\s+[IVX\d]+\b",), r"(?:Ch\.\s*)?\d{1,2}\.\s", "grouped", least=60, part_words=5),
    "mencius": Style((BOOK_ALONE,), least=60, repairs=((r"(BOOK\s+)IIL\b", "$1III"), (r"(BOOK\s+)IY\b", "$1IV"), (r"(BOOK\s+)Y\b", "$1V"))),
    "zhuangzi": Style((CHAPTER_LINE, r"PART\s+(?:[IV]+|ONE|TWO|THREE)\b[\w \-,]*(?=\n)"), least=60, least_headers=2),
    "xunzi": Style((r"BOOK\s+[IVXLC\d]+\.?[ \t]*[\w ,\-—–]*(?=\n)", r"CHAPTER\s+[IVXLC\d]+\.?[ \t]*[\w ,\-—–]*(?=\n)"), least=60, least_headers=2),
    "hexagrams": Style((r"(?:HEXAGRAM\s+)?[IVXLC]+\.?\s+THE\s+\w+\s+HEXAGRAM",), mode="grouped", least=60, part_words=10),
    "city_of_god": Style((r"BOOK\s+[IVX]+\b",), CHAPTER_WORD, "whole", least=60, part_words=10),
    "fathers": Style((r"(?:THE\s+EPISTLE|THE\s+SHEPHERD|THE\s+DIDACHE|THE\s+LETTER|EPISTLE\s+OF|I\.\s+CLEMENT|IGNATIUS|POLYCARP|BARNABAS|HERMAS)[\w ,\-\.]{0,60}(?=\n)",), r"(?:CHAPTER|SECTION)\s+\w+", "whole", least=60, least_inner=2, part_words=10),
    "masnavi": Style((CAPITALS,), mode="grouped", least=60, least_headers=5, recut_words=1050),
    "vendidad": Style((rf"FARGARD\s+{NUMERAL}\.?[ \t]*[\w ]*(?=\n|$)",), mode="whole", part_words=20, piece_words=11),
    "yasna": Style((rf"(?:YASNA|GATHAS?|HA)\s+{NUMERAL}\.?[ \t]*[\w ]*(?=\n|$)",), mode="grouped", part_words=11),
    "bardo": Style((r"(?:PART|CHAPTER|SECTION|BOOK|THE\s+\w+\s+DAY|INTRODUCTION|PREFACE|APPENDIX|INVOCATION)\s*[IVXLC\d]*\.?[ \t]*[\w ,\-]*(?=\n)",), target=400, piece_words=11),
    "milarepa": Style((CHAPTER_LINE,), target=400, piece_words=11),
    "sections": Style((rf"(?:PART|SECTION|CHAPTER)\s+{NUMERAL}\.?[ \t]*[\w ,\-]*(?=\n)",), mode="whole", part_words=10),
    "parts": Style((rf"PART\s+{NUMERAL}",), mode="whole", part_words=10),
    "meditations": Style((rf"MEDITATION\s+(?:THE\s+)?(?:{ORDINALS}|[IVX\d]+)\b",), mode="whole", part_words=10),
    "ethics": Style((r"PART\s+(?:[IVX]+|THE\s+\w+)\b[\w ,]*(?=\n)",)),
    "zarathustra": Style((rf"PART\s+(?:{ORDINALS}|[IVX\d]+)\b",), CAPITALS, "grouped", chunk_words=80),
    "federalist": Style((r"(?:THE\s+)?FEDERALIST\s+(?:No\.?|NUMBER)\s*\d+",), mode="whole", part_words=20, whole_words=1050),
}


def _words(text: str) -> Column:
    return F.expr(WORDS.format(u=text))


def _labelled(pattern: str) -> Callable[[Column], Column]:
    return lambda body: F.struct(clean_whitespace(F.regexp_extract(body, pattern, 1)).alias("label"), body.alias("body"))


def _split(text: Column, patterns: tuple[str, ...], least: int) -> Column:
    """Array of (label, body); a body begins with its heading.  What stands before the first heading is left out."""
    chosen = F.array(F.struct(F.lit(None).cast("string").alias("label"), text.alias("body")))
    for p in reversed(patterns):
        heading = f"(?iU:{p})"
        pieces = F.split(F.regexp_replace(F.concat(F.lit("\n"), text), rf"\n[ \t]*(?={heading})", MARK), MARK)
        parts = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _labelled(f"^({heading})"))
        chosen = F.when(F.size(pieces) > least, parts).otherwise(chosen)
    return chosen


def divide(df: DataFrame, id_col: str, text_col: str, style: Style) -> DataFrame:
    """(id, part, sub, chapter, label, body): the parts of each text by the headings of its style, in order.

    Null texts give no row; a text without headings is one part without chapter
    and label.  With ``largest_chars`` only the longest part of each heading
    stays, if it is longer than that: a table of contents repeats the headings.
    """
    text = F.translate(F.regexp_replace(F.col(text_col), "\r\n?", "\n"), MARK, " ")
    for wrong, right in style.repairs:
        text = F.regexp_replace(text, wrong, right)
    if style.skip_chars:
        text = F.when(F.length(text) > style.skip_chars, F.substring(text, style.skip_chars + 1, 2**31 - 1)).otherwise(text)
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("t")).select("id", F.posexplode(_split(F.col("t"), style.outer, style.least_headers)).alias("part", "p"))
    rows = rows.select("id", "part", F.col("p.label").alias("chapter"), F.col("p.body").alias("body"))
    if style.largest_chars:
        w = Window.partitionBy("id", F.upper("chapter")).orderBy(F.desc(F.length("body")), "part")
        rows = rows.withColumn("k", F.row_number().over(w)).where((F.col("k") == 1) & (F.col("chapter").isNull() | (F.length("body") > style.largest_chars))).drop("k")
    if not style.inner:
        return rows.select("id", "part", F.lit(0).alias("sub"), "chapter", F.lit(None).cast("string").alias("label"), "body")
    inner = rows.select("id", "part", "chapter", F.posexplode(_split(F.col("body"), (style.inner,), style.least_inner)).alias("sub", "q"))
    return inner.select("id", "part", "sub", "chapter", F.col("q.label").alias("label"), F.col("q.body").alias("body"))


def _pieces(parts: DataFrame, separator: str, least_words: int) -> DataFrame:
    """Each part's pieces, cleaned, of at least so many words, as rows with the place ``at``."""
    rows = parts.select(*parts.columns, F.posexplode(F.split("body", separator)).alias("at", "piece")).withColumn("piece", clean_whitespace(F.col("piece")))
    return rows.drop("body").withColumnRenamed("piece", "text").withColumn("size", _words("text")).where(F.col("size") >= max(1, least_words))


def _folded(units: DataFrame, style: Style) -> DataFrame:
    """Units (key, at, text, size, chapter, label, numbered) joined to chunks of the style's size."""
    placed = units.join(assigned(units, "key", "at", "size", TARGET_MIN, target=style.target, least=style.least, joined=0), ["key", "at"])
    listed = F.array_sort(F.collect_list(F.struct("at", "text", "label")))
    rows = placed.groupBy("key", "chunk_index").agg(listed.alias("l"), F.first("chapter").alias("chapter"), F.bool_or("numbered").alias("numbered"))
    first, last = F.col("l")[0]["label"], F.element_at("l", -1)["label"]
    label = F.when(F.col("numbered") | first.eqNullSafe(last), first).otherwise(F.concat(first, F.lit("–"), last))
    reference = F.concat(F.concat_ws(", ", "chapter", label), F.when(F.col("numbered"), F.concat(F.lit(" — §"), (F.col("chunk_index") + 1).cast("string"))).otherwise(""))
    return rows.select("key.id", "key.part", "key.sub", "chunk_index", F.trim(reference).alias("reference"), "chapter", F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"))


def chunk_styled(df: DataFrame, id_col: str, text_col: str, style: Style) -> DataFrame:
    """(id, part, sub, chunk_index, reference, chapter, text, words, tokens): chunks of each text in its style, with their citation.

    The reference names chapter and label; chunks of pieces are numbered by §,
    a group of parts names its first and last label.  Order by part, sub and
    chunk_index.  Empty and blank texts give no chunk.
    """
    parts = divide(df, id_col, text_col, style).withColumn("words", _words("body")).where(F.col("words") >= style.part_words)
    own, every = F.struct("id", "part", "sub").alias("key"), F.struct("id", "part", F.lit(0).alias("sub")).alias("key")
    cut = lambda rows, separator, least: _pieces(rows, separator, least).select(own, F.col("at"), "text", "size", "chapter", "label", F.lit(True).alias("numbered"))
    if style.mode == "lines":
        chunks = _folded(cut(parts, "\n", style.piece_words), style)
    elif style.mode == "paragraphs":
        chunks = _folded(cut(parts, "\n{2,}", style.piece_words), style)
    else:
        # parts without any heading are always cut by paragraph
        headed = F.col("chapter").isNotNull() | F.col("label").isNotNull()
        short = headed & (F.col("words") <= style.whole_words) if style.mode == "whole" else F.coalesce("label", "chapter").isNotNull() & (F.col("label").isNotNull() if style.inner else F.lit(True))
        loose = parts.where(~short)
        whole = parts.where(short & (F.col("words") > 0)).withColumn("text", clean_whitespace(F.col("body")))
        if style.mode == "whole":
            units = whole.select(own, F.lit(0).alias("at"), "text", F.col("words").alias("size"), "chapter", "label", F.lit(False).alias("numbered"))
        elif style.inner:
            units = whole.select(every, F.col("sub").alias("at"), "text", F.col("words").alias("size"), "chapter", "label", F.lit(False).alias("numbered"))
        else:
            one = F.struct("id", F.lit(0).alias("part"), F.lit(0).alias("sub")).alias("key")
            units = whole.select(one, F.col("part").alias("at"), "text", F.col("words").alias("size"), F.lit(None).cast("string").alias("chapter"), F.col("chapter").alias("label"), F.lit(False).alias("numbered"))
            if style.recut_words:
                # a part that alone is too long for a group is cut by paragraph and numbered
                loose, units = loose.unionByName(parts.where(short & (F.col("words") > style.recut_words))), units.where(F.col("size") <= style.recut_words)
        least = style.piece_words if style.mode != "whole" else 1
        chunks = _folded(units, style).unionByName(_folded(cut(loose, "\n{2,}", least), style))
    out = chunks.withColumns({"words": _words("text"), "tokens": F.expr(TOKENS.format(u="text"))})
    return out.where(F.col("words") >= max(1, style.chunk_words))
