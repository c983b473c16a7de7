"""Styles of headings on small texts: labels, sizes, fallbacks and odd rows."""

from __future__ import annotations

import pytest

from lectern.operators import headings as H

LONG = " ".join(f"word{i}" for i in range(90)) + "."
TEXTS = {
    "chapters": (f"front matter\nCHAPTER I. Of Swans\n{LONG}\n\nchapter 2\n{LONG}\n", ["CHAPTER I. Of Swans", "chapter 2"]),
    "books_chapters": (f"BOOK THE FIRST\nCHAPTER I\n{LONG}\nCHAPTER II\n{LONG}\nBOOK II\n{LONG}", ["BOOK THE FIRST, CHAPTER I", "BOOK THE FIRST, CHAPTER II", "BOOK II"]),
    "parts_chapters": (f"PART I\nCHAPTER I. A\n{LONG}\nPART II\nCHAPTER I. B\n{LONG}", ["PART I, CHAPTER I. A", "PART II, CHAPTER I. B"]),
    "entries": ("THE FIRST BOOK\n\n" + "\n".join(f"{n}. The {LONG}" for n in ("I", "II", "III", "IV", "V")), ["THE FIRST BOOK, I.–III.", "THE FIRST BOOK, IV.–V."]),
    "yoga_sutras": ("BOOK I\n" + "\n".join(f"{n}. {LONG}" for n in range(1, 5)), ["BOOK I, 1.–3.", "BOOK I, 4."]),
    "upanishads": (f"ISA UPANISHAD\n\nKENA UPANISHAD\n\nISA UPANISHAD\n\n{LONG} {LONG}\n\nTHE KENA-UPANISHAD\n\n{LONG} {LONG}", ["ISA UPANISHAD — §1", "THE KENA-UPANISHAD — §1"]),
    "rigveda": (f"[BOOK IIL]\nHYMN I.\n{LONG}\nHYMN II.\n{LONG}", ["[BOOK III], HYMN I.–HYMN II."]),
    "mencius": (f"BOOK IY.\n\n{LONG}\n\nBOOK Y.\n\n{LONG}", ["BOOK IV. — §1", "BOOK V. — §1"]),
    "zhuangzi": (f"PART I\n\n{LONG}\n\nPART TWO\n\n{LONG}", ["PART I — §1", "PART TWO — §1"]),
    "latin_poetry": (f"LIBER I\n{LONG}\nab cd\n{LONG}\nBOOK II\n{LONG}", ["LIBER I — §1", "BOOK II — §1"]),
    "vendidad": (f"FARGARD I.\n{LONG}\nFARGARD 2\nshort", ["FARGARD I."]),
    "yasna": (f"YASNA I\n{LONG}\nHA II\n{LONG}", ["YASNA I–HA II"]),
    "masnavi": ("\n".join(f"THE STORY OF {c * 5}\n{LONG}" for c in "ABCDE"), ["THE STORY OF AAAAA–THE STORY OF CCCCC", "THE STORY OF DDDDD–THE STORY OF EEEEE"]),
    "federalist": (f"FEDERALIST No. 1\n{LONG}\nThe Federalist No. 2\n{LONG}", ["FEDERALIST No. 1", "The Federalist No. 2"]),
    "meditations": (f"MEDITATION THE FIRST\n{LONG}\nMEDITATION II\n{LONG}", ["MEDITATION THE FIRST", "MEDITATION II"]),
    "kalidasa": (f"SHAKUNTALA\n\n{LONG}\n\nACT II\n\n{LONG}", ["SHAKUNTALA — §1", "ACT II — §1"]),
    "bardo": (f"THE FIRST DAY\n\n{LONG}\n\nAPPENDIX\n\n{LONG}", ["THE FIRST DAY — §1", "APPENDIX — §1"]),
    "fathers": (f"THE EPISTLE OF X\nCHAPTER I\n{LONG}\nCHAPTER II\n{LONG}\n", ["THE EPISTLE OF X, CHAPTER I", "THE EPISTLE OF X, CHAPTER II"]),
}


def _references(df, style):
    return [r["reference"] for r in H.chunk_styled(df, "id", "text", style).orderBy("id", "part", "sub", "chunk_index").collect()]


@pytest.mark.parametrize("name", TEXTS)
def test_headings_of_a_style(spark, name):
    text, want = TEXTS[name]
    assert _references(spark.createDataFrame([(1, text)], "id int, text string"), H.STYLES[name]) == want


def test_every_style_takes_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n "), (4, LONG), (4, "CHAPTER I\r\n" + LONG)], "id int, text string").withColumn("part", df_lit())
    for name in ("chapters", "paragraphs", "entries", "masnavi"):
        rows = H.chunk_styled(df, "id", "text", H.STYLES[name]).collect()
        assert {r["id"] for r in rows} == {4}, name
        assert H.chunk_styled(df.limit(0), "id", "text", H.STYLES[name]).count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_a_long_part_is_cut_and_numbered(spark):
    text = "CHAPTER I\n\n" + "\n\n".join([LONG] * 9)
    assert _references(spark.createDataFrame([(1, text)], "id int, text string"), H.STYLES["chapters"]) == ["CHAPTER I — §1", "CHAPTER I — §2", "CHAPTER I — §3"]
