"""Problem 6: encoding of the whole corpus with a public tokenizer.

``encode_corpus`` runs the tokenizers library over the Arrow batches of each
partition; ``decode_corpus`` turns ids back into text by the byte table of
byte-level vocabularies; ``token_spans`` adds, for every token, its place in
the text in characters and in UTF-8 bytes.

Defined results: null and empty texts give an empty id list; strings that look
like special tokens are ordinary text; ids cut inside a character decode with
U+FFFD for the incomplete bytes.  All operators are narrow (no shuffle).
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lectern.session import spread

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: Characters that are encoded in one call, so that a batch of very long texts stays small in memory.
CALL_CHARS = 2_000_000
# Fixed value: the pattern by which byte-level vocabularies cut a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Separators that regular-expression libraries class differently; texts with one of them go to the tokenizer whole.
UNSURE = regex.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")
#: Pieces up to this length are remembered, so many at once in each worker.
PIECE_CHARS, REMEMBERED = 64, 400_000


@lru_cache(maxsize=4)
def byte_table() -> dict[str, int]:
    """Vocabulary character -> byte, of byte-level vocabularies.

    Printable bytes stand for themselves; the others are numbered on from 256.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@lru_cache(maxsize=4)
def _bytes_by_id(path: str) -> dict[int, bytes]:
    with open(path, encoding="utf8") as f:
        spec = json.load(f)
    table = byte_table()
    special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    end = spec["model"].get("end_of_word_suffix") or "\0"  # such a vocabulary drops blanks; a word's end gives one back
    found = {i: bytes(table[c] for c in token.removesuffix(end)) + b" " * token.endswith(end) for token, i in spec["model"]["vocab"].items() if i not in special}
    return found | special


def _portions(texts: list[str | None]) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        if part and size + len(t or "") > CALL_CHARS:
            yield part
            part, size = [], 0
        part.append(t or "")
        size += len(t or "")
    if part:
        yield part


def _with_column(df: DataFrame, text_col: str, out: T.StructField, make) -> DataFrame:
    """``df`` and a column made from the Arrow batches of ``text_col``; an equally named column is replaced."""
    kept = [c for c in df.columns if c != out.name]
    source = df.select(*(f"`{c}`" for c in kept), F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, texts = batch.columns
            yield pa.RecordBatch.from_arrays([*columns, make(texts)], names=[*kept, out.name])

    return source.mapInArrow(run, schema)


@lru_cache(maxsize=4)
def _remembered(path: str) -> dict[str, array]:
    return {}


@lru_cache(maxsize=4)
def _in_pieces(path: str) -> bool:
    """Whether the file's vocabulary cuts texts by ``PIECES`` and changes nothing else in them."""
    with open(path, encoding="utf8") as f:
        spec = json.load(f)
    cut = spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    return plain and spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")


def _encode_into(flat: array, ends: list[int], texts: list[str], path: str) -> None:
    """Appends the ids of the texts.

    In a byte-level vocabulary a piece is merged by itself, so each new one goes
    to the tokenizer once; with any other vocabulary whole texts go there.
    """
    known, tokenizer = _remembered(path), _tokenizer(path)
    if not _in_pieces(path):
        for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            flat.extend(e.ids)
            ends.append(len(flat))
        return
    if len(known) > REMEMBERED:
        known.clear()
    find = regex.compile(PIECES).findall
    pieces = [None if UNSURE.search(t) else find(t) for t in texts]
    new = list(set().union(*(p for p in pieces if p)).difference(known))
    fresh = dict(zip(new, (array("i", e.ids) for e in tokenizer.encode_batch_fast(new, add_special_tokens=False))))
    known.update((w, ids) for w, ids in fresh.items() if len(w) <= PIECE_CHARS)
    lookup = known if len(known) >= len(fresh) and all(len(w) <= PIECE_CHARS for w in fresh) else known | fresh
    for text, parts in zip(texts, pieces):
        if parts is None:
            flat.extend(tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            for w in parts:
                flat += lookup[w]
        ends.append(len(flat))


def encode_corpus(df: DataFrame, text_col: str = "text", out_col: str = "ids", tokenizer: str = TOKENIZER, directory: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` with the token ids of ``text_col``, without special tokens."""
    path = os.path.join(directory, f"{tokenizer}.json")

    def make(texts: pa.Array) -> pa.Array:
        flat, ends = array("i"), [0]
        for part in _portions(texts.to_pylist()):
            _encode_into(flat, ends, part, path)
        return pa.ListArray.from_arrays(pa.array(np.array(ends, "i4")), pa.array(np.frombuffer(flat, "i4") if flat else np.empty(0, "i4")))

    return _with_column(df, text_col, T.StructField(out_col, T.ArrayType(T.IntegerType())), make)


def token_spans(df: DataFrame, text_col: str = "text", out_col: str = "spans", tokenizer: str = TOKENIZER, directory: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` with, for every token, (id, start_char, end_char, start_byte, end_byte).

    Bytes run on without a gap.  A token that holds part of a character gets the
    whole character as its character span, so neighbours may share one.  Only for
    byte-level vocabularies; another one raises ValueError.
    """
    path = os.path.join(directory, f"{tokenizer}.json")
    if not _in_pieces(path):
        raise ValueError(f"{tokenizer} changes the text, so its tokens have no byte spans in it")
    names = ("id", "start_char", "end_char", "start_byte", "end_byte")
    kind = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in names]))

    def make(texts: pa.Array) -> pa.Array:
        size = {i: len(b) for i, b in _bytes_by_id(path).items()}
        rows = []
        for part in _portions(texts.to_pylist()):
            for e in _tokenizer(path).encode_batch(part, add_special_tokens=False):
                at, spans = 0, []
                for i, (a, b) in zip(e.ids, e.offsets):
                    spans.append(dict(zip(names, (i, a, b, at, at := at + size[i]))))
                rows.append(spans)
        return pa.array(rows, pa.list_(pa.struct([(n, pa.int32()) for n in names])))

    return _with_column(df, text_col, T.StructField(out_col, kind), make)


def decode_corpus(df: DataFrame, ids_col: str = "ids", out_col: str = "text", tokenizer: str = TOKENIZER, directory: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` with the text of the ids; a null list gives null, an id outside the vocabulary U+FFFD."""
    path = os.path.join(directory, f"{tokenizer}.json")

    def make(lists: pa.Array) -> pa.Array:
        known, lost = _bytes_by_id(path), "�".encode()
        return pa.array([None if ids is None else b"".join(known.get(i, lost) for i in ids).decode("utf8", "replace") for ids in lists.to_pylist()], pa.string())

    return _with_column(df, ids_col, T.StructField(out_col, T.StringType()), make)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of each document."""
    return encode_corpus(_documents(spark, sf_dir)).select("doc_id", "ids")


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text decoded from its ids again; equal to the stored text, '' where that is null."""
    return decode_corpus(encode_corpus(_documents(spark, sf_dir)).select("doc_id", "ids")).select("doc_id", "text")


def p6_span_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's size in characters and bytes, read off its last token."""
    last = F.try_element_at("spans", F.lit(-1))
    return token_spans(_documents(spark, sf_dir)).select("doc_id", F.coalesce(last["end_char"], F.lit(0)).cast("bigint").alias("n_chars"), F.coalesce(last["end_byte"], F.lit(0)).cast("bigint").alias("n_bytes"))


QUERIES = {"p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p6_span_totals": p6_span_totals}
ORACLE = {
    "p6_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p6_span_totals": "SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents",
}
