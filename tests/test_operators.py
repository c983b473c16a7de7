"""Core operators on small fixtures: odd rows, ties, empty tables, and brute force where SQL has no word for them."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import chunking, entities, relational, retrieval, splitting
from lectern.sources import files
from lectern.streaming import usage


def _one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_word_count_ignores_edges(spark):
    assert _one(spark, "  a b\n c ", X.word_count) == 3
    assert _one(spark, "", X.word_count) == 0
    assert _one(spark, None, X.word_count) in (None, -1)


def test_ocr_clean(spark):
    assert _one(spark, "R I G V E D A\n 12 \nthe hea-\n  ven\n\n\n\nend", X.clean_ocr) == "RIGVEDA\nthe heaven\n\nend"


def test_boilerplate(spark):
    strip = lambda c: X.strip_boilerplate(c, ("** START", "** BEGIN"), ("** END",))
    assert _one(spark, "x\n** BEGIN y\nbody\n** END z", strip) == "body\n"
    assert _one(spark, "no marks", strip) == "no marks"


def test_url_quote(spark):
    assert _one(spark, "a b*c~d/é+", X.url_quote) == "a%20b%2Ac~d%2F%C3%A9%2B"


def test_chunks_hold_every_unit(spark):
    lines = [f"line {i} " + "w " * (i % 7) for i in range(60)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None), (4, "one")], "doc_id bigint, text string")
    rows = chunking.chunk_target_min(df, "doc_id", "text", 20, 5).orderBy("doc_id", "chunk_index").collect()
    assert "\n".join(r["chunk"] for r in rows if r["doc_id"] == 1).split("\n") == [x.strip() for x in lines]
    assert [r["chunk"] for r in rows if r["doc_id"] == 4] == ["one"] and not [r for r in rows if r["doc_id"] in (2, 3)]


def _chapters(units, least, every, most):
    """Brute force of the chapter rule."""
    out, buffer, start = [], [], 1
    for c, v in units:
        if not v:
            continue
        if len(v) > most:
            if buffer:
                out.append((start, 1, buffer))
                buffer = []
            out += [(c, i + 1, v[i : i + every]) for i in range(0, len(v), every)]
            start = c + 1
        elif len(v) < least:
            start = start if buffer else c
            buffer = buffer + v
        elif buffer:
            out.append((start, 1, buffer + v))
            buffer, start = [], c + 1
        else:
            out.append((c, 1, v))
            start = c + 1
    return out + ([(start, 1, buffer)] if buffer else [])


def test_chapters_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    units = [(c, [f"v{c}.{k}" for k in range(int(rng.integers(0, 30)))]) for c in range(1, 40)]
    df = spark.createDataFrame([("b", c, v) for c, v in units], "book string, c bigint, v array<string>")
    got = chunking.chunk_chapters(df, "book", "c", "v", 5, 8, 12).collect()
    assert [(r["start_chapter"], r["start_verse"], r["text"]) for r in got] == [(c, s, " ".join(v)) for c, s, v in _chapters(units, 5, 8, 12)]


def test_header_split(spark):
    df = spark.createDataFrame([(1, "front\nCHAPTER I\nbody one\nCHAPTER II.\nbody two"), (2, "no header"), (3, None), (4, "")], "id bigint, t string")
    got = splitting.split_headers(df, "id", "t", splitting.HEADERS["chapter"]).orderBy("id", "section").collect()
    assert [(r["id"], r["header"], r["body"]) for r in got] == [(1, "CHAPTER I", "body one"), (1, "CHAPTER II.", "body two"), (2, None, "no header"), (4, None, "")]


def test_roman(spark):
    for text, value in (("XIV", 14), ("mcmxc", 1990), ("IX", 9)):
        assert _one(spark, text, splitting.roman_value) == value


def test_upsert_keeps_old_values(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, name string, n int")
    new = spark.createDataFrame([("b", None, 3), ("c", "z", None)], "k string, name string, n int")
    assert {tuple(r) for r in relational.upsert(old, new, ["k"]).collect()} == {("a", "x", 1), ("b", "y", 3), ("c", "z", None)}


def test_entities_of_odd_rows(spark):
    variants = spark.createDataFrame([(1, "nibbāna"), (2, "苦"), (3, "two words"), (4, None), (5, " "), (6, "nibbāna")], "entity_id bigint, name_text string")
    texts = spark.createDataFrame([(1, "The nibbāna of two  words, nibbānaX"), (2, "諸苦集"), (3, None), (4, "")], "id bigint, t string")
    assert {tuple(r) for r in entities.mentions(texts, variants, "id", "t").collect()} == {(1, 1, 1), (1, 3, 3)}
    assert {tuple(r) for r in entities.substring_tags(texts, variants, "id", "t").collect()} == {(1, 1), (2, 2)}
    assert entities.mentions(texts.limit(0), variants.limit(0), "id", "t").count() == 0


def _ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, id bigint, score double, rank int")


def test_boost_beats_every_rank(spark):
    ranked = _ranked(spark, [(1, i, 1 / 60 - i / 1e4, i) for i in range(1, 6)])
    tags = spark.createDataFrame([(5, [7]), (1, None)], "id bigint, entity_ids array<bigint>")
    wanted = spark.createDataFrame([(1, [7, 8])], "query_id bigint, entities array<bigint>")
    assert [r["id"] for r in retrieval.entity_boost(ranked, tags, wanted).orderBy("rank").collect()] == [5, 1, 2, 3, 4]


def test_fusion_is_symmetric_and_dedup_idempotent(spark):
    a, b = _ranked(spark, [(1, 1, 0.9, 1), (1, 2, 0.8, 2)]), _ranked(spark, [(1, 2, 5.0, 1), (1, 3, 4.0, 2)])
    one, two = (retrieval.rrf_plain(x, 1).orderBy("rank").collect() for x in ([a, b], [b, a]))
    assert one == two and one[0]["id"] == 2
    grouped = retrieval.rrf_plain([a, b], 1).withColumn("g", F.lit(None).cast("string"))
    assert retrieval.first_of_group(grouped, "g").count() == 3
    once = retrieval.first_of_group(grouped.withColumn("g", F.col("id") % 2), "g")
    assert retrieval.first_of_group(once, "g").collect() == once.collect()


def test_mmr_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((12, 4)).astype("f4")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<float>")
    ranked = _ranked(spark, [(0, i, 0.0, i) for i in range(1, 12)])
    got = [r["id"] for r in retrieval.mmr(ranked, vectors, vectors.where("id = 0"), 5).orderBy("rank").collect()]
    pool, chosen = list(range(1, 12)), []
    y = x.astype("f8")
    while len(chosen) < 5:
        score = {i: 0.7 * y[i] @ y[0] - 0.3 * max(y[i] @ y[j] for j in chosen) if chosen else y[i] @ y[0] for i in pool}
        best = max(pool, key=lambda i: (round(score[i], 9), -i))
        chosen.append(best)
        pool.remove(best)
    assert got == chosen


def test_ivf_recall_and_dense_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((20, 8))[np.arange(600) % 20] + 0.2 * rng.standard_normal((600, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x.astype("f4"))], "id bigint, embedding array<float>")
    q = v.where("id % 20 = 0")
    exact = {(r["query_id"], r["id"]) for r in retrieval.dense(q, v, 10).collect()}
    near = {(r["query_id"], r["id"]) for r in retrieval.ivf_search(q, v, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)] + [(9, None), (8, [0.0, 0.0])], "id bigint, embedding array<float>")
    assert [r["id"] for r in retrieval.dense(same.where("id = 3"), same, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert retrieval.dense(same.limit(0), same).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"mn1:0.1": "Head", "mn1:1.2": " body ", "mn1:1.1": ""}))
    assert [(r["seq"], r["segment_id"], r["text"]) for r in files.read_segments(spark, f"{tmp_path}/s.json").orderBy("seq").collect()] == [(0, "mn1:0.1", "Head"), (1, "mn1:1.2", "body"), (2, "mn1:1.1", "")]
    (tmp_path / "v.txt").write_text("# c\n1|1|one\nx|2|bad\n1|2|two|more\nbroken\n")
    assert [tuple(r) for r in files.read_verse_lines(spark, f"{tmp_path}/v.txt").collect()] == [(1, 1, "one"), (1, 2, "two|more")]
    (tmp_path / "h.json").write_text(json.dumps({"metadata": {"name": "n", "section": {"1": "Faith"}}, "hadiths": [{"hadithnumber": 1, "text": "five words are in here", "reference": {"book": 1, "hadith": 1}}, {"hadithnumber": 2, "text": "short"}, {"hadithnumber": 3, "text": "this one has no book at all"}]}))
    assert [(r["book"], r["section"]) for r in files.read_hadiths(spark, f"{tmp_path}/h.json").collect()] == [("1", "Faith"), ("0", None)]
    (tmp_path / "b.json").write_text(json.dumps({"name": "B", "chapters": [{"chapter": 1, "verses": [{"verse": 2, "text": "b"}, {"verse": 1, "text": "a"}]}]}))
    assert files.read_books(spark, f"{tmp_path}/b.json").first()["verses"] == ["a", "b"]
    (tmp_path / "q.jsonl").write_text('{"id": "q1", "query": "x", "chunk_id": 3, "query_type": "synthetic_natural"}\n{"natural": "n", "paraphrase": "p", "type": "synthetic", "chunk_id": 4}\n')
    assert {(r["query"], r["query_type"], r["gold"]) for r in files.read_queries(spark, f"{tmp_path}/q.jsonl").collect()} == {("x", "synthetic_natural", 3), ("n", "synthetic_natural", 4), ("p", "synthetic_paraphrase", 4)}


def test_markup_sources(spark, tmp_path):
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><head>One</head><lb n="0001a01"/><p>開<app><lem>始</lem><rdg>終</rdg></app><g/>是<note>x</note>言語也如是</p><lg><l>偈一也如是</l><l>偈二也如是</l></lg></body></text></TEI>'
    (tmp_path / "a.xml").write_text(tei)
    (tmp_path / "bad.xml").write_text("<TEI><p>")
    got = files.read_paragraphs(spark, f"{tmp_path}/*.xml", "tei", 5).orderBy("seq").collect()
    assert [(r["chapter"], r["reference"], r["is_verse"], r["text"]) for r in got] == [("One", "0001a01", False, "開始□是言語也如是"), ("One", "0001a01", True, "偈一也如是 偈二也如是")]
    (tmp_path / "p.html").write_bytes("<h1>Title</h1><script>x()</script><p class=bold>Chapter<p>First paragraph &amp; more<span class=note>gone</span><blockquote class=gatha>A verse of some length</blockquote>".encode())
    got = files.read_paragraphs(spark, f"{tmp_path}/p.html", "html", 10).orderBy("seq").collect()
    assert [(r["chapter"], r["is_verse"], r["text"]) for r in got] == [("Chapter", False, "First paragraph & more"), ("Chapter", True, "A verse of some length")]


def test_corpus_partitions_are_replaced_alone(spark, tmp_path):
    out = f"{tmp_path}/corpus"
    files.write_corpus(spark.createDataFrame([(1, "a"), (2, "b")], "id int, corpus_code string"), out)
    files.write_corpus(spark.createDataFrame([(3, "b")], "id int, corpus_code string"), out)
    assert {(r["id"], r["corpus_code"]) for r in spark.read.parquet(out).collect()} == {(1, "a"), (3, "b")}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for name, make in (("quota", lambda s: usage.daily_quota(s, "user_id", "ts")), ("rate", lambda s: usage.rate_windows(s, "user_id", "ts", "10 minutes", "5 minutes")), ("sessions", lambda s: usage.sessions(s, "user_id", "ts"))):
        query = make(stream).writeStream.outputMode("complete" if name != "sessions" else "append").format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        got = {tuple(r) for r in spark.table(name).collect()}
        want = {tuple(r) for r in make(events).collect()}
        assert got == want if name != "sessions" else got <= want


def test_websearch_phrases_and_parts(spark):
    texts = spark.createDataFrame([(1, "the red swan sleeps"), (2, "the swan is red"), (3, "a well-known reed"), (4, "a reed well, known"), (5, "nothing"), (6, None)], "id bigint, text string")
    want = {'"red swan"': {1}, "red swan": {1, 2}, 'swan -"red swan"': {2}, '"red swan" or reed': {1, 3, 4}, "swan -sleeps OR nothing": {2, 5}, "well-known": {3, 4}, '"known well"': set(), "-swan": {3, 4, 5}, "": set()}
    queries = spark.createDataFrame(list(enumerate(want)), "id bigint, text string")
    got = [(r["query_id"], r["id"]) for r in retrieval.websearch(queries, texts).collect()]
    assert sorted(got) == sorted((i, x) for i, ids in enumerate(want.values()) for x in ids)


def test_groups_over_all_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x[:100] = x[0] + 0.001 * x[:100]  # the pool of 60 holds but one text
    tags = np.r_[np.zeros(100, int), np.arange(300) % 20 + 1]
    vectors = spark.createDataFrame([(i, x[i].tolist(), int(tags[i])) for i in range(400)], "id bigint, embedding array<double>, tag bigint")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u[0], 6)
    order = sorted(range(400), key=lambda i: (-sims[i], i))
    query = vectors.where("id = 0").select("id", "embedding")
    best = {r["tag"]: r["id"] for r in retrieval.group_maxima(query, vectors).collect()}
    assert best == {t: next(i for i in order if tags[i] == t) for t in range(21)}
    chosen = list(dict.fromkeys(int(tags[i]) for i in order))[:8]
    want = [i for t in chosen for i in [i for i in order if tags[i] == t][:3]]
    assert [r["id"] for r in retrieval.two_level_full(query, vectors).orderBy("rank").collect()] == want


def _shuffled_records(spark) -> int:
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_scores_of_all_groups_are_not_shuffled(spark):
    """Each group's maximum is found where its vectors lie; only vectors are shuffled, never (query, group) pairs."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 4)).round(3)
    x[7] = 0
    tags = np.r_[np.full(2500, 5), np.arange(3500) % 700 + 6]  # one group is larger than a block
    vectors = spark.createDataFrame([(i, x[i].tolist(), None if i == 3 else int(tags[i])) for i in range(6000)] + [(6000, None, 6)], "id bigint, embedding array<double>, tag bigint")
    before = _shuffled_records(spark)
    queries = vectors.where("id % 20 = 0").select("id", "embedding")
    rows = retrieval.group_scores(queries.unionByName(queries.where("id = 40")), vectors).collect()
    got = {(r["query_id"], r["tag"]): r["score"] for r in rows}
    shuffled = _shuffled_records(spark) - before
    x[3] = x[7]  # neither counts; the others have the length 1
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    for q in range(0, 6000, 20):
        sims = np.where(np.any(x != 0, axis=1), u @ u[q], -9.0)
        best = np.full(706, -9.0)
        np.maximum.at(best, tags, sims)
        assert all(abs(got[q, t] - best[t]) < 1e-6 for t in range(5, 706))
    assert len(got) == len(rows) == 300 * 701
    assert shuffled < 6000 + 300 * 4 < len(got)
