"""Problems 4, 5 and 7 against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np

from lectern.llm import leakage, neighbours, shared_spans

TEXTS = "id bigint, text string"


def _brute_pairs(rows, span):
    grams = {i: {t[p : p + span] for p in range(len(t) - span + 1)} for i, t in rows if t}
    return {(a, b) for a, b in itertools.combinations(sorted(grams), 2) if grams[a] & grams[b]}


def _spanned_rows():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab cdé") for _ in range(n))
    shared, near = word(31), word(29)
    rows = [(i, word(rng.randrange(0, 120))) for i in range(30)]
    rows += [(30 + i, word(rng.randrange(40)) + shared + word(rng.randrange(40))) for i in range(6)]
    rows += [(40 + i, word(rng.randrange(40)) + near + word(rng.randrange(40))) for i in range(4)]
    return [*rows, (50, shared), (51, shared), (52, shared[:15]), (53, ""), (54, None), (55, shared * 3)]


def test_shared_spans_equal_brute_force(spark):
    rows = _spanned_rows()
    got = {tuple(r) for r in shared_spans.span_pairs(spark.createDataFrame(rows, TEXTS), "id", "text", 30).collect()}
    assert got == _brute_pairs(rows, 30)


def test_heavy_anchors_give_the_same_pairs(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "HEAVY", 0)
    rows = _spanned_rows()
    got = {tuple(r) for r in shared_spans.span_pairs(spark.createDataFrame(rows, TEXTS), "id", "text", 30).collect()}
    assert got == _brute_pairs(rows, 30)


def test_segments_give_the_same_pairs(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "SEGMENT_CHARS", 50)
    rows = _spanned_rows()
    got = {tuple(r) for r in shared_spans.span_pairs(spark.createDataFrame(rows, TEXTS), "id", "text", 30).collect()}
    assert got == _brute_pairs(rows, 30)


def test_shared_share_equals_brute_force(spark):
    rows = _spanned_rows()
    got = {r["id"]: r["shared_chars"] for r in shared_spans.shared_share(spark.createDataFrame(rows, TEXTS), "id", "text", 30).collect()}
    for i, t in rows:
        covered = set()
        for p in range(len(t or "") - 29):
            if any(j != i and u and t[p : p + 30] in u for j, u in rows):
                covered.update(range(p, p + 30))
        assert got[i] == len(covered), i


def test_shared_spans_of_nothing(spark):
    assert shared_spans.span_pairs(spark.createDataFrame([], TEXTS), "id", "text").count() == 0


# 5: neighbours

VECTORS = "chunk_id bigint, embedding array<float>"


def _vectors(n=900, dim=16):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((n // 30, dim))
    x = centres[np.arange(n) % len(centres)] + rng.standard_normal((n, dim)) * rng.choice([0.1, 0.4], (n, 1))
    return x.astype("f4")


def _exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1)[:, :k]


def test_neighbours_recall(spark):
    x = _vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, VECTORS)).collect()
    found = {(r["id"], r["neighbour"]) for r in got}
    want = {(i, int(j)) for i, near in enumerate(_exact(x, 8)) for j in near}
    assert len(found & want) >= 0.95 * len(want)
    assert len(got) == 8 * len(x)


def test_neighbours_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, float("nan")]), (7, [1.0]), (3, [0.0, 1.0]), (8, [])]
    got = {(r["id"], r["neighbour"]): round(r["cosine"], 4) for r in neighbours.nearest_neighbours(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {(1, 2): 1.0, (2, 1): 1.0, (1, 3): 0.0, (3, 1): 0.0, (2, 3): 0.0, (3, 2): 0.0}
    assert neighbours.nearest_neighbours(spark.createDataFrame([], VECTORS)).count() == 0


def test_neighbours_of_many_copies(spark):
    """Copies are each other's neighbours; ties go to the smaller ids."""
    rows = [(i, [1.0, 1.0]) for i in range(40)] + [(99, [1.0, 0.9])]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r["neighbour"] for r in got if r["id"] == 20} == set(range(8))
    assert {r["neighbour"] for r in got if r["id"] == 99} == set(range(8))


def test_graph_search(spark):
    x = _vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    vectors = neighbours.usable_vectors(df, "chunk_id", "embedding")
    nodes = vectors.select("id", "code")
    graph = neighbours.neighbour_graph(nodes)
    queries = nodes.where("id % 20 = 0").selectExpr("id as query", "code")
    got = {(r["query"], r["v"]) for r in neighbours.graph_search(queries, nodes, graph, k=9, entries=200).collect() if r["query"] != r["v"]}
    want = {(i, int(j)) for i, near in enumerate(_exact(x, 8)) for j in near if i % 20 == 0}
    assert len(got & want) >= 0.9 * len(want)


def test_search_returns_copies(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 16)).astype("f4")
    x[1:21] = x[1]  # ids 1 to 20 have one direction, of which 20 is a query
    x[11] *= 2
    x[40] = x[1] + 0.01 * x[40]
    spark.createDataFrame([(i, x[i].tolist()) for i in range(1, 120)], "chunk_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/chunk_embeddings.parquet")
    got = {}
    for r in neighbours.p5_search(spark, str(tmp_path)).collect():
        got.setdefault(r["chunk_id"], []).append((r["neighbour_id"], round(r["cosine"], 3)))
    assert sorted(got[20]) == [(i, 1.0) for i in range(1, 9)]
    assert sorted(i for i, _ in got[40]) == list(range(1, 9))
    assert set(got) == {20, 40, 60, 80, 100} and all(len(v) == 8 for v in got.values())


# 7: leakage

PASSAGE = "The drum of imagination divides the foolish tower for the faithful shore is to the nameless hermit what remorse brings while the bright river sleeps among strangers and discernment follows a cold staff"
OTHER = "A ladder of winter tests the stubborn island although seven frugal teachers despise one sailor near balance and the steep fish complains until the luminous bell weeps beneath figs"


def _leaks(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, PASSAGE), (2, OTHER), (3, "身內動緣木村去者母合也母火少受去自以樂言自慈南南慧母車樂"), (4, None), (5, " ")], "item_id bigint, passage string")
    return {(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, items).collect()}


def test_leaks(spark):
    words = PASSAGE.split()
    fill = "nothing here concerns any test material whatsoever because it talks about gardens"
    changed = " ".join("swan" if i % 9 == 5 else w for i, w in enumerate(words))
    shuffled = words[:]
    random.Random(1).shuffle(shuffled)
    texts = [
        f"{fill}. {PASSAGE}", PASSAGE.upper(), " ".join(words[:14]) + " " + fill + " " + fill, changed, "<p>" + "&nbsp;".join(words).replace("tower", "<b>tower</b>[3]") + "</p>",
        PASSAGE.replace("o", "о").replace("a", "а"), f"{' '.join(words[:9])} {fill} {fill} {' '.join(words[20:30])}", "他說身內動緣木、村去者，母合也！母火少受去自以樂言。",
        " ".join(words[:6]), " ".join(shuffled), fill, "", None, " ".join(f"{w} {fill}" for w in words),
    ]
    assert _leaks(spark, texts) == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 3)}


def test_leaks_in_portions(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MAX_ITEM_TOKENS", 10)
    assert _leaks(spark, [PASSAGE, OTHER]) == {(0, 1), (1, 2)}


def test_leaks_of_nothing(spark):
    assert _leaks(spark, []) == set()


def test_automaton_finds_the_longest_matches():
    rng = random.Random(2)
    lists = [[rng.choice("abc") for _ in range(30)] for _ in range(5)]
    automaton = leakage.Automaton(lists)
    joined = ["".join(x) for x in lists]
    for _ in range(50):
        piece = "".join(rng.choice("abc") for _ in range(6))
        state = 0
        for c in piece:
            state = automaton.next[state].get(c, -1) if state >= 0 else -1
        assert (state >= 0) == any(piece in x for x in joined)
        if state > 0:
            assert set(automaton.items[state]) == {i for i, x in enumerate(joined) if piece in x}


def test_the_longest_ordered_pair_equals_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        chains = []
        for _ in range(rng.randrange(1, 130)):
            a, c = rng.randrange(100), rng.randrange(60)
            n = rng.randrange(1, 12)
            chains.append((a, a + n, c, c + min(n, 62 - c), 1.0))
        brute = max(x[3] - x[2] for x in chains)
        for x, y in itertools.permutations(chains, 2):
            if x[1] <= y[0] and x[3] <= y[2]:
                brute = max(brute, x[3] - x[2] + y[3] - y[2])
        top = leakage._longest_pair(chains, 62)
        assert sum(x[3] - x[2] for x in top) == brute


def test_spans_are_in_the_stored_text_and_are_removed(spark):
    words = PASSAGE.split()
    text = f"<p>Gardens &amp; wells.</p> {' '.join(words[:5])} <b>{words[5].upper()}</b>[3] {' '.join(words[6:20])}. The end, ﬁnally."
    docs = spark.createDataFrame([(1, text), (2, "No such thing.")], "doc_id bigint, text string")
    found = leakage.leaks(docs, spark.createDataFrame([(1, PASSAGE)], "item_id bigint, passage string"))
    (row,) = found.collect()
    ((a, b),) = row["spans"]
    assert text[a:b].startswith("The drum") and text[a:b].endswith(words[19])
    assert [tuple(r) for r in leakage.cleaned(docs, found).collect()] == [(1, text[:a] + text[b:])]
    assert all(leakage.tokens(text)[k] == leakage.plain(text[a:b]).strip() for k, (a, b) in enumerate(leakage.token_places(text)))


def test_short_mixed_and_numeric_passages_and_many_stretches(spark):
    passages = [(1, "The drum divides towers daily"), (2, "龍門客棧 the inn of the dragon gate 風雨夜行人不歸山中無曆日"), (3, "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9"), (4, PASSAGE)]
    words = PASSAGE.split()
    refrain = " ".join(f"{words[0]} {words[1]} {words[2]} {words[3]} {words[4]} {words[5]} {words[6]} {words[7]} swan{i} reed{i} oak{i} elm{i} ash{i} fig{i} yew{i} fir{i} bay{i}" for i in range(100))
    texts = ["So the drum divides towers and more.", "又 the inn of the dragon gate 風雨夜行人不歸", "Digits: 3, 1, 4, 1, 5, 9, 2, 6.", f"{refrain} {' '.join(words[9:18])}", "The drum divides."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame(passages, "item_id bigint, passage string")
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, items).collect()} == {(0, 1), (1, 2), (2, 3), (3, 4)}
