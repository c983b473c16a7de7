"""Scopes, star joins and mutations on plain tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """What a search may look at; empty parts don't restrict."""

    corpora: Sequence[str] = ()
    traditions: Sequence[str] = ()
    languages: Sequence[str] = ()
    collections: Sequence[str] = ()
    #: Corpora that are only searched when they are named.
    opt_in: Sequence[str] = field(default=())

    def condition(self, corpus: str = "code", tradition: str = "tradition", language: str = "language", collection: str = "collection") -> Column:
        """One condition on the dimension columns, written once for all branches."""
        if self.corpora:
            kept = F.col(corpus).isin(*self.corpora)
        else:
            kept = ~F.col(corpus).isin(*self.opt_in) if self.opt_in else F.lit(True)
        for name, values in ((tradition, self.traditions), (language, self.languages), (collection, self.collections)):
            if values:
                kept = kept & F.col(name).isin(*values)
        return kept


def star(chunks: DataFrame, texts: DataFrame, corpora: DataFrame) -> DataFrame:
    """Chunks with their text's and corpus's columns (prefixes text_ and corpus_); the planner broadcasts what is small."""
    t = texts.select(*(F.col(c).alias(f"text_{c}") for c in texts.columns if c != "id"), F.col("id").alias("text_id"))
    c = corpora.select(F.col("id").alias("text_corpus_id"), *(F.col(x).alias(f"corpus_{x}") for x in corpora.columns if x != "id"))
    return chunks.drop("corpus_code").join(t, "text_id").join(c, "text_corpus_id")


def split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: int = 200_000) -> DataFrame:
    """Inner join in which a key with more than ``rows`` rows on the left is spread over several tasks.

    The left rows of such a key are dealt out to parts and its right rows are
    repeated for each part; all other keys have one part.  Nulls match nothing.
    """
    hot = left.groupBy(*keys).agg(F.ceil(F.count("*") / rows).alias("__parts")).where("__parts > 1")
    dealt = left.join(hot, list(keys), "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*left.columns), "__parts"), F.lit(0)))
    repeated = right.join(hot, list(keys), "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("__parts"), F.lit(1)) - 1)))
    return dealt.drop("__parts").join(repeated.drop("__parts"), [*keys, "__part"]).drop("__part")


def delete_where_parent(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The children that stay when the given parents are deleted."""
    gone = parents.select(F.col(parent_key).alias(child_key)).distinct()
    return children.join(gone, child_key, "left_anti")


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of ``todo`` whose key isn't in ``done``."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and the rows of ``new`` with a new key; of several the first in order of all columns."""
    first = Window.partitionBy(*keys).orderBy(*new.columns)
    once = new.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return old.unionByName(once.join(old.select(*keys), list(keys), "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` updated by ``new``; a null in ``new`` leaves the old value."""
    values = [c for c in old.columns if c not in keys]
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, list(keys), "full")
    return both.select(*keys, *(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in values)).select(*old.columns)


def latest(events: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """The last event of each key, by time and then by ``tie``."""
    rest = [c for c in events.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(at, tie)).alias("last")
    return events.groupBy(*keys).agg(top).select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash: the same ones on every run."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def schema_gap(df: DataFrame, wanted: DataFrame) -> list[str]:
    """Columns that ``wanted`` has and ``df`` lacks."""
    return [c for c in wanted.columns if c not in df.columns]


def evolved(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """``df`` with the columns it lacks, as nulls, in the order of ``wanted``."""
    return wanted.limit(0).unionByName(df, allowMissingColumns=True)
