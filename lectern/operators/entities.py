"""Entity names: flattening, three ways of matching, fuzzy lookup."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import similarity, trigrams
from lectern.session import spread

# Name columns of an entity and the language of each.
NAME_COLUMNS = {"pali": "pli", "sanskrit": "san", "classical_chinese": "lzh", "tibetan": "bo", "english_preferred": "en"}


def flatten_names(entities: DataFrame) -> DataFrame:
    """(entity_id, name_text, language, is_primary): every name of every entity once."""
    named = [F.struct(F.col(c).alias("name_text"), F.lit(language).alias("language")) for c, language in NAME_COLUMNS.items()]
    others = F.transform(F.coalesce("english_alternates", F.array().cast("array<string>")), lambda x: F.struct(x.alias("name_text"), F.lit("en").alias("language")))
    rows = entities.select("id", "english_preferred", F.explode(F.concat(F.array(*named), others)).alias("n")).where("n.name_text is not null and trim(n.name_text) <> ''")
    primary = (F.col("n.name_text") == F.col("english_preferred")) & (F.col("n.language") == "en")
    return rows.select(F.col("id").alias("entity_id"), "n.name_text", "n.language", F.coalesce(primary, F.lit(False)).alias("is_primary")).distinct()


def one_owner(variants: DataFrame) -> DataFrame:
    """(name_text, entity_id): for equal names the smallest entity."""
    return variants.where("name_text is not null and trim(name_text) <> ''").groupBy("name_text").agg(F.min("entity_id").alias("entity_id"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))


def mentions(texts: DataFrame, variants: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, entity_id, first_word): entities whose name occurs as whole words, and where first.

    Names and texts are split into words; a text's word positions meet the names
    that begin with that word in an equi-join, so no text is held against all
    names, and the rest of the name is compared in place.
    """
    names = one_owner(variants).select("entity_id", _words(F.col("name_text")).alias("name")).where("size(name) > 0")
    names = names.select("entity_id", "name", F.element_at("name", 1).alias("word"))
    split = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("w"))
    at = split.select("id", "w", F.posexplode("w").alias("pos", "word"))
    longest = names.agg(F.max(F.size("name"))).first()[0] or 1
    at = at.select("id", "word", "pos", F.slice("w", F.col("pos") + 1, longest).alias("near"))
    here = F.slice("near", F.lit(1), F.size("name")) == F.col("name")
    found = at.join(names, "word").where(here)
    return found.groupBy("id", "entity_id").agg(F.min("pos").alias("first_word"))


#: Characters of the names in one automaton.
NAME_CHARS = 4_000_000


def _name_portions(rows: Iterable[tuple[str, int]]) -> Iterator[list[tuple[str, int]]]:
    part, size = [], 0
    for name, entity in rows:
        if part and size + len(name) > NAME_CHARS:
            yield part
            part, size = [], 0
        part.append((name, entity))
        size += len(name)
    if part:
        yield part


def substring_tags(texts: DataFrame, variants: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, entity_id): entities with a name anywhere in the text, whatever the case.

    All names are looked for at once by an automaton in each task; the texts are
    read and never shuffled.  An automaton holds ``NAME_CHARS`` characters of
    names at most; more names take further scans.
    """
    names = one_owner(variants).select(F.lower("name_text").alias("name"), "entity_id").distinct().orderBy("name", "entity_id")
    low = texts.where(F.length(text_col) > 0).select(F.col(id_col).cast("bigint").alias("id"), F.lower(text_col).alias("low"))
    found = texts.sparkSession.createDataFrame([], "id bigint, entity_id bigint")
    for portion in _name_portions((r["name"], r["entity_id"]) for r in names.toLocalIterator()):
        shared = texts.sparkSession.sparkContext.broadcast(portion)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            owners: dict[str, list[int]] = {}
            for name, entity in shared.value:
                owners.setdefault(name, []).append(entity)
            search = ahocorasick.Automaton()
            for name, entities in owners.items():
                search.add_word(name, entities)
            search.make_automaton()
            for batch in batches:
                ids, entities = [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    hit = {e for _, several in search.iter(text) for e in several}
                    ids += [i] * len(hit)
                    entities += hit
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(entities, pa.int64())], names=["id", "entity_id"])

        found = found.unionByName(spread(low).mapInArrow(run, "id bigint, entity_id bigint"))
    return found.distinct()


def fuzzy_lookup(queries: DataFrame, names: DataFrame, query_id: str, query_text: str, name_id: str, name_text: str, least: float = 0.3, top: int = 5) -> DataFrame:
    """(query_id, name_id, score): up to ``top`` names by trigram similarity, joined on shared trigrams."""
    q = queries.select(F.col(query_id).alias("query_id"), trigrams(F.col(query_text)).alias("qg")).where("size(qg) > 0")
    n = names.select(F.col(name_id).alias("name_id"), trigrams(F.col(name_text)).alias("ng")).where("size(ng) > 0")
    pairs = q.select("query_id", F.explode("qg").alias("g")).join(n.select("name_id", F.explode("ng").alias("g")), "g").groupBy("query_id", "name_id").agg(F.count("*").alias("shared"))
    sized = pairs.join(q.select("query_id", F.size("qg").alias("a")), "query_id").join(n.select("name_id", F.size("ng").alias("b")), "name_id")
    scored = sized.select("query_id", "name_id", F.round(F.col("shared") / (F.col("a") + F.col("b") - F.col("shared")), 6).alias("score")).where(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "name_id")
    return scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top).select("query_id", "name_id", "score")


__all__ = ["flatten_names", "fuzzy_lookup", "mentions", "one_owner", "similarity", "substring_tags"]
