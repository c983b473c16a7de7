"""Operators whose results the SQL of the catalogue can't show: recall, hot keys, folds, shared folders."""

from __future__ import annotations

import pytest

from lectern import session
from lectern.operators import chunking, entities, relational, retrieval
from lectern.plans import search

SMALL = "/root/testdata/sf0.01"


def test_inverted_lists_reach_the_exact_neighbours(spark):
    found = {(r["query_id"], r["id"]) for r in search.ann_ivf(spark, SMALL).collect()}
    exact = {(r["query_id"], r["id"]) for r in search.dense_topk(spark, SMALL).where("rank <= 10").collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_a_large_list_is_dealt_out_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    vectors = search._vectors(spark, "/root/testdata/sf0.001")
    every = retrieval.ivf_search(vectors, vectors, k=3, probes=10_000)
    exact = retrieval.dense(vectors, vectors, 3)
    pairs = lambda df: {(r["query_id"], r["id"], r["rank"]) for r in df.collect()}
    assert pairs(every) == pairs(exact)


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_split_join_equals_a_join(spark, rows):
    left = spark.createDataFrame([(i % 3 if i < 20 else None, i) for i in range(25)], "k int, x int")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c"), (None, "d")], "k int, y string")
    want = {tuple(r) for r in left.join(right, "k").collect()}
    got = [tuple(r) for r in relational.split_join(left, right, ["k"], rows).collect()]
    assert set(got) == want and len(got) == len(want)


def test_names_in_several_automata_give_the_same_tags(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "The Swan of Zu"), (2, "zu"), (3, None), (4, ""), (5, "swan")], "id bigint, text string")
    names = spark.createDataFrame([(7, "swan"), (8, "ZU"), (9, "of z"), (9, None), (3, "swan")], "entity_id bigint, name_text string")
    want = {(1, 3), (1, 8), (1, 9), (2, 8), (5, 3)}
    assert {tuple(r) for r in entities.substring_tags(texts, names, "id", "text").collect()} == want
    monkeypatch.setattr(entities, "NAME_CHARS", 1)
    assert {tuple(r) for r in entities.substring_tags(texts, names, "id", "text").collect()} == want


def test_cited_chunks(spark):
    rows = [
        (1, 0, "title", "a:0", None, "", False, True, 5), (1, 1, "one two", "a:1", "", "s1", False, False, 4), (1, 2, "three", "a:2", "c1", "s2", True, False, 4),
        (1, 3, "four", "", "c2", None, False, False, 9), (2, 1, "five", None, None, None, None, False, 1),
    ]
    units = spark.createDataFrame(rows, "id int, at int, text string, reference string, chapter string, section string, is_verse boolean, preamble boolean, size int")
    got = {(r["id"], r["chunk_index"]): r for r in chunking.chunk_cited(units, "id", "at", "size", chunking.TARGET_MAX, "\n", target=8, most=10).collect()}
    assert got[1, 0]["text"] == "title\n\none two\nthree" and got[1, 0]["reference"] == "a:1–a:2" and (got[1, 0]["chapter"], got[1, 0]["section"], got[1, 0]["is_verse"]) == ("c1", "s1", True)
    assert got[1, 1]["text"] == "four" and got[1, 1]["reference"] is None and got[2, 0]["words"] == 1 and len(got) == 3
    assert chunking.chunk_cited(units.limit(0), "id", "at", "size", chunking.TARGET_MAX, "\n", target=8, most=10).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
