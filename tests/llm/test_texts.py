"""Problems 1, 2, 3, 6 and 8 on small fixtures and against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import lookalike, mojibake, residue, sentences, tokenizing

TEXTS = "id bigint, text string"


# 1: look-alike text


def _canonical(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), TEXTS)
    return [r["canonical"] for r in lookalike.canonical_text(df, "text").orderBy("id").collect()]


def test_canonical_form(spark):
    got = _canonical(spark, ["Ｆｕｌｌ", "soft­ly", "асе", "é", "a b", " x \n", "ﬁn", "⼀", "", None, "Case", "a  b", "l1\r\nl2"])
    assert got == ["Full", "softly", "ace", "é", "a b", "x", "fin", "一", "", None, "Case", "a  b", "l1\nl2"]


def test_canonical_is_idempotent(spark):
    once = _canonical(spark, ["Τһе ѕwаn", "ό ά ﷺ", "Ａ​Ｂ ½²", "x" * 50_000])
    assert _canonical(spark, once) == once


def test_same_looking_pairs(spark):
    rows = [(1, "word"), (2, "w​ord"), (3, "word"), (4, "wоrd"), (5, "Word"), (6, ""), (7, " "), (8, None), (8, None), (4, "wоrd")]
    got = {tuple(r) for r in lookalike.same_looking_pairs(spark.createDataFrame(rows, TEXTS), "id", "text").collect()}
    assert got == {(1, 2), (2, 3), (1, 4), (3, 4), (2, 4)}
    assert lookalike.same_looking_pairs(spark.createDataFrame([], TEXTS), "id", "text").count() == 0


def test_clashing_column_is_replaced(spark):
    df = spark.createDataFrame([(1, "Ａ", "old")], "id bigint, text string, canonical string")
    assert lookalike.canonical_text(df, "text").collect()[0].asDict() == {"id": 1, "text": "Ａ", "canonical": "A"}


# 2: sentences


@pytest.fixture(scope="module")
def model(spark):
    return sentences.train(sentences.text_contexts(spark.read.parquet("/root/testdata/sf0.01/document_chunks.parquet")))


CASES = [
    ("Mr. Tandu feeds Jezul. Peace releases error, as in a little after 4 p.m. Wisdom is slow.", ["Mr. Tandu feeds Jezul.", "Peace releases error, as in a little after 4 p.m.", "Wisdom is slow."]),
    ('"Go on!" said the old king, so he left. He lies 3.5 spans away.', ['"Go on!" said the old king, so he left.', "He lies 3.5 spans away."]),
    ("The bee wrote, “The elder waits.” The end came.[12] It rained.", ["The bee wrote, “The elder waits.”", "The end came.[12]", "It rained."]),
    ("1. The first goes. 2. The second stays.", ["1. The first goes.", "2. The second stays."]),
    ("Of Deceit\n\nThe orchard waits\nin the rain. It ends", ["Of Deceit", "The orchard waits\nin the rain.", "It ends"]),
    ("戒水言：「天口應日。」當長門是。「皆魚山理！」者，而王低雨。", ["戒水言：「天口應日。」", "當長門是。", "「皆魚山理！」者，而王低雨。"]),
    ("母合之路慈無\n施故始想少", ["母合之路慈無", "施故始想少"]),
    ("ཞས་ཏཱིས། རུག་དུག གལ་ཐཱིད།", ["ཞས་ཏཱིས།", "རུག་དུག", "གལ་ཐཱིད།"]),
    ("ਸੋਹ ਮੰਗਿ ਘੁ ॥੮॥ ਪਦੁ ਡਿ ਤੀੰਲ।", ["ਸੋਹ ਮੰਗਿ ਘੁ ॥੮॥", "ਪਦੁ ਡਿ ਤੀੰਲ।"]),
    ("tise maipī ragabuña || 10.67 || ñaiñākī vūbhī |", ["tise maipī ragabuña || 10.67 ||", "ñaiñākī vūbhī |"]),
    ("κοτε γέσό; χέσίλε θινβυ· πηπό.", ["κοτε γέσό;", "χέσίλε θινβυ· πηπό."]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_sentences(model, text, want):
    assert [text[a:b] for a, b in sentences.split_text(text, model)] == want


@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet="Ab. !?\n“”​。།གa1", max_size=80))
def test_sentences_cover_the_text(model, text):
    spans = sentences.split_text(text, model)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    left = "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b in spans))
    assert left.replace("​", "").strip() == ""


def test_sentences_of_odd_rows(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "One. Two."), (5, "x" * 200_000)], "id bigint, chunk_text string")
    got = sentences.sentences(sentences.text_contexts(df), model).orderBy("id", "start_char").collect()
    assert [tuple(r) for r in got] == [(4, 0, 4), (4, 5, 9), (5, 0, 200_000)]
    assert sentences.sentences(sentences.text_contexts(df.limit(0)), model).count() == 0


# 3: wrong encodings


@pytest.fixture(scope="module")
def ngrams(spark):
    return mojibake.train(spark.read.parquet("/root/testdata/sf0.01/document_chunks.parquet").select(F.col("chunk_text").alias("text")))


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437"])
def test_round_trip_of_wrong_decodings(ngrams, wrong):
    """Held-out accuracy: clean words garbled here are found and restored, clean ones are left alone."""
    words = ["Védo", "Bérzulun", "Kāmsébé", "mattsokkhdanlakkh", "ṭhūmunbha", "Tīköté", "śokṣītra", "Nūkkhḍa"]
    clean = " ".join(words)
    garbled = " ".join("".join(mojibake._upper(wrong)[b] if b >= 0x80 else chr(b) for b in w.encode()) for w in words)
    assert mojibake.restore_text(clean, ngrams, {}) == (False, clean, [])
    affected, restored, chains = mojibake.restore_text(garbled, ngrams, {})
    assert affected and restored == clean and chains


def test_a_record_garbled_in_part_by_an_8_bit_encoding(spark, ngrams):
    """Five garbled words among many clean ones are found and put right; held-out clean records set the margin."""
    chunks = spark.read.parquet("/root/testdata/sf0.01/document_chunks.parquet").where("chunk_text rlike '[ṣṭḍṇ]'").orderBy("id").toPandas()["chunk_text"]
    back = {c: mojibake._upper("cp1252")[b] for b, c in mojibake.ROMANISED.items()}
    found = tried = 0
    for text in chunks:
        words = text.split(" ")
        at = [i for i, w in enumerate(words) if sum(c in back for c in w) >= 2][:5]
        if len(at) == 5 and len(words) > 15 and mojibake._clean(text, ngrams.alphabet):
            for i in at:
                words[i] = "".join(back.get(c, c) for c in words[i])
            tried += 1
            found += mojibake.restore_text(" ".join(words), ngrams, {})[0]
    assert tried >= 20 and found >= 0.95 * tried
    assert ngrams.record_margin >= mojibake.LEAST_RECORD_MARGIN


def test_what_is_no_wrong_decoding(ngrams):
    for text in ("A naïve façade begets a quarry.", "Þór of Kölso mourns.", "DRÖRRAM GATHERS", "Dhūbāsā (Ñ, fol. ½)", "thе swіft сity", "plain"):
        assert not mojibake.restore_text(text, ngrams, {})[0], text
    assert mojibake.restore_text("lost Sh�s�", ngrams, {})[0]


def test_repair_of_odd_rows(spark, ngrams):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "BГ©ju"), (3, "BГ©ju")], TEXTS)
    got = mojibake.repair(df, "id", "text", ngrams).collect()
    assert sorted((r["id"], r["affected"], r["restored"]) for r in got) == [(2, False, ""), (3, True, "Béju"), (3, True, "Béju")]
    assert mojibake.train(df.limit(0).select("text")).margin >= mojibake.LEAST_MARGIN


def _late(spark, texts, like):
    """Of variants of each text one that comes late in the order of hashes, behind 3,000 of the rows beside it."""
    rows = [(i, f"{text} {n}") for i, text in enumerate(texts) for n in range(60)]
    best = spark.createDataFrame([(i, t) for i, t in rows], TEXTS).groupBy("id").agg(F.max(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))
    found = [(r["m"]["h"], r["m"]["text"]) for r in best.collect()]
    hashes = [r[0] for r in spark.createDataFrame([(t,) for t in like], "text string").select(F.xxhash64("text")).collect()]
    assert all(sum(x < h for x in hashes) > 3000 for h, _ in found)
    return [t for _, t in found]


def _plain_and_odd(records, wrong, each):
    """Many texts, and a few with words that gain by a chain from an 8-bit encoding."""
    right = {"ñ": "ṭ", "õ": "ṇ"}[wrong]
    letters = [chr(97 + k) for k in range(26)]
    words = ["".join(letters[(i * k + k) % 26] for k in (3, 5, 7)) + right + "".join(letters[(i * k + k) % 26] for k in (11, 17, 19)) for i in range(records * each)]
    plain = [f"{words[i % len(words)]} {words[(7 * i + 1) % len(words)]} again {i} āā īī ūū ēē" for i in range(4200)]
    odd = [" ".join(words[i * each : (i + 1) * each]).replace(right, wrong) + " āā īī ūū ēē" for i in range(records)]
    return plain, odd


@pytest.mark.parametrize("records, wrong, each", [(40, "ñ", 1), (6, "õ", 3)], ids=["words", "records"])
def test_margins_come_from_all_records(spark, records, wrong, each):
    """Clean words of a few records gain by a chain from an 8-bit encoding; the margins know them, wherever in the data they lie."""
    plain, odd = _plain_and_odd(records, wrong, each)
    model = mojibake.train(spark.createDataFrame([(t,) for t in plain + _late(spark, odd, plain)], "text string"))
    if each == 1:
        assert model.margin > mojibake.LEAST_MARGIN + 2
        assert model.restored({odd[0].split()[0]}, every=True)[odd[0].split()[0]][1][0] == ""
    else:
        assert model.record_margin > mojibake.LEAST_RECORD_MARGIN + 2


# 6: tokenizer


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{tokenizing.TOKENIZER_DIR}/{tokenizing.TOKENIZER}.json")
    tokenizer.encode_special_tokens = True
    texts = ["The swan's  path\n\n", "<|endoftext|> x", "གལ་ཐཱིད 戒水言", "tab\tand \x1f odd\x85", "a" * 3000, "😀é", "", None]
    got = tokenizing.encode_corpus(spark.createDataFrame(list(enumerate(texts)), TEXTS)).orderBy("id").collect()
    assert [r["ids"] for r in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_decoding_reverses(spark):
    texts = ["naïve 戒 😀", "", None, " lead"]
    ids = tokenizing.encode_corpus(spark.createDataFrame(list(enumerate(texts)), TEXTS))
    assert [r["text"] for r in tokenizing.decode_corpus(ids).orderBy("id").collect()] == [t or "" for t in texts]
    cut = ids.where("id = 0").withColumn("ids", F.slice("ids", 1, 4))
    assert "�" in tokenizing.decode_corpus(cut).first()["text"] or tokenizing.decode_corpus(cut).first()["text"].startswith("na")
    spans = tokenizing.token_spans(spark.createDataFrame([(0, texts[0])], TEXTS)).first()["spans"]
    assert spans[-1]["end_byte"] == len(texts[0].encode()) and spans[-1]["end_char"] == len(texts[0])


# 8: residue


def test_residue(spark):
    bad = [
        "Dear {{ name }}, welcome.", "# ${title}", "%s, vol. %d, p. %d", "Lorem ipsum dolor sit amet consectetur", "Please enable JavaScript to view this page.",
        "404 Not Found", "Traceback (most recent call last):", "Aquí va el texto. Aquí va el texto. Aquí va el texto.", "foo bar baz asdf foo", "[INSERT author HERE]",
        "The swan\nSeite nicht gefunden.", "<b>x</b> by undefined — [object Object]",
    ]
    good = [
        "A style guide shows {{title}} as the way a template marks its title.", "An error page such as “404 Not Found” often replaces it.", "x=y+z; if(a<b){return}",
        "The editors print {padu} in braces and [rure] in brackets.", "The roll lists 404 verses, and verse 404 was not found in the recension.", "<|endoftext|> text",
        "https://reader.example/a?b=c&d=%20e#f", "", " ", None, "The word goes.[12] It ends.",
    ]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(bad + good)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"] for r in residue.residue_lines(df).collect()}
    assert got == set(range(len(bad)))
    assert residue.residue_lines(df.limit(0)).count() == 0


def test_doubtful_placeholders_need_a_learned_name(spark):
    rows = [(1, "{{ passage }}", "a"), (2, "${passage}", "b"), (3, "The {passage} waits.", "c"), (4, "The {torn} waits.", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r["doc_id"] for r in residue.residue_lines(df).collect()} == {1, 2, 3}


EXAMPLES = [
    "500 Internal Server Error", "Internal Server Error", "जावास्क्रिप्ट चालू करें", "تفعيل جافا سكريبت", "Attention Required!", "This site requires cookies.",
    "Uncaught TypeError", "Sample paragraph.", "Enter title here", "Add content here", "test test test", "NaN, NaN",
]


def test_no_cue_hides_a_line_from_its_rule(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(EXAMPLES)], "doc_id bigint, text string, source string")
    assert {r["doc_id"] for r in residue.residue_lines(df).collect()} == set(range(len(EXAMPLES)))


@pytest.mark.parametrize(
    ("rule", "texts"),
    [
        (r"(?i)requires? (?:Java|cookies)|^[^\p{L}]*oops", ["it Requires JAVA", "require cookies", "- Oops"]),
        (r"(?:ab|ac)?x[yz]+end|(?:foo){2,}", ["abxyend", "xzend", "foofoo"]),
    ],
)
def test_cues_come_from_the_rules(rule, texts):
    assert all(any(cue in t.lower() for cue in residue.literals([rule])) for t in texts)
    with pytest.raises(ValueError):
        residue.literals([r"\d+"])


def test_filler_and_status_of_any_length_and_lead(spark):
    long = "This paragraph will be written by the editors as soon as the text of the second roll has come to them, they say"
    rows = [
        (0, "Aquí va el otro texto. " * 60, "a"), (1, "# Hier kommt noch etwas. Hier kommt noch etwas. Hier kommt noch etwas.", "a"), (2, "正文在這裡。正文在這裡。正文在這裡。", "a"),
        (3, f"{long}. {long}. {long}.", "a"), (4, "Hier kommt noch etwas.", "b"), (5, long + ".", "b"), (6, "- 正文在這裡。", "b"),
        *((7 + i, f"Page not found. The {name} of the roll " + name * 100, name) for i, name in enumerate(("swan", "reed", "well"))),
        (10, "The swan sleeps. The reed bends. The swan sleeps.", "a"), (11, "Chapter one .................................", "a"), (12, "Access to the page was denied, the page not found. " * 2, "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r["doc_id"] for r in residue.residue_lines(df).collect()} == set(range(10))
    huge = spark.createDataFrame([(1, "Wird noch ergänzt. " * 20_000, "a"), (2, "a" * 300_000 + " b", "a"), (3, "a b " * 50_000 + "c", "a")], df.schema)
    assert {r["doc_id"] for r in residue.residue_lines(huge).collect()} == {1}


def test_a_recurring_message_that_no_rule_lists_is_found_by_its_words(spark):
    known = ["Please enable JavaScript and reload the page to continue.", "Your browser does not support scripts; reload the page.", "Your session has expired. Please reload."]
    rows = [(i, known[i % 3], f"s{i % 5}") for i in range(30)]
    rows += [(100 + i, f"The swan of roll {i} sleeps.\nPlease reload your browser to continue.", f"s{i}") for i in range(4)]
    rows += [(200 + i, f"The reed of roll {i} bends.\nThe swan sleeps by the old northern river.", f"s{i % 5}") for i in range(40)]
    rows += [(300, "Please reload the weary northern swan of the river.", "s1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r["doc_id"] for r in residue.residue_lines(df).collect()} == {*range(30), *range(100, 104)}


def test_a_placeholder_whose_surroundings_recur_unchanged_is_spoken_about(spark):
    told = [(i, f"The swan {'abc'[i]}. They would put %%title%% at the top, and the {'xyz'[i]} sleeps.", f"s{i}") for i in range(3)]
    used = [(10, "The weary swan %%title%% at the river sleeps.", "s0"), *((11 + i, f"Read our story {p} with great joy number {i}.", f"s{i}") for i, p in enumerate(("%%title%%", "%%name%%", "{{page}}")))]
    df = spark.createDataFrame(told + used, "doc_id bigint, text string, source string")
    assert {r["doc_id"] for r in residue.residue_lines(df).collect()} == {10, 11, 12, 13}


def test_doubtful_dots_are_learned_and_viterbi_decides(spark):
    end = ["The swan sleeps by the B.C.", "Peace feeds the law.", "The reed bends."]
    rows = [f"Mr. Tandu feeds Jezul in the ninth century B.C. The swan of roll {i} sleeps. No. {i} is lost, cf. Zemor. Peace rests.\n\n{end[i % 3]}" for i in range(300)]
    model = sentences.train(sentences.text_contexts(spark.createDataFrame(list(enumerate(rows)), TEXTS), "id", "text"))
    text = "Mr. Tandu feeds Jezul in the ninth century B.C. The swan sleeps."
    assert [text[a:b] for a, b in sentences.split_text(text, model)] == ["Mr. Tandu feeds Jezul in the ninth century B.C.", "The swan sleeps."]
    # the same dots come out the other way where the corpus says so
    rows = [f"The letter of C. The Elder is lost. Peace feeds roll {i}.\n\nThe swan sleeps." for i in range(300)]
    other = sentences.train(sentences.text_contexts(spark.createDataFrame(list(enumerate(rows)), TEXTS), "id", "text"))
    assert [text[a:b] for a, b in sentences.split_text(text, other)] != [text[a:b] for a, b in sentences.split_text(text, model)]


def test_bare_text_is_cut_by_the_model_of_stripped_text(spark):
    import random

    rng = random.Random(3)
    sentence = lambda: "".join(rng.choice("山水月風花鳥魚牛") for _ in range(rng.randrange(8, 13))) + rng.choice("矣也焉")
    rows = [(i, "".join(sentence() + "。" for _ in range(6))) for i in range(300)]
    model = sentences.train(sentences.text_contexts(spark.createDataFrame(rows, TEXTS), "id", "text"))
    parts = [sentence() for _ in range(30)]
    spans = sentences.split_text("".join(parts), model)
    ends, at = set(), 0
    for p in parts:
        ends.add(at := at + len(p))
    got = {b for _, b in spans}
    assert len(got & ends) >= 0.9 * len(ends) and len(got & ends) >= 0.9 * len(got)
    assert sentences.split_text("山水月矣風花\n鳥魚", model) == [(0, 6), (7, 9)]


def test_sentences_leave_out_chunks_by_margins_of_all_records(spark, tmp_path):
    """Chunks whose words gain as much as those of some other clean records do aren't left out as garbled, wherever these lie."""
    plain, odd = _plain_and_odd(6, "õ", 6)
    extra = " " + " ".join(f"{a}{b}" for a in "āīūē" for b in "āīū")
    late = _late(spark, [t + extra for t in odd], plain)
    spark.createDataFrame(list(enumerate(late + plain)), "id bigint, chunk_text string").write.parquet(f"{tmp_path}/document_chunks.parquet")
    spark.createDataFrame([(1, "again")], "id bigint, title_sanskrit string").write.parquet(f"{tmp_path}/canon_texts.parquet")
    ids = {r["chunk_id"] for r in sentences.p2_found(spark, str(tmp_path)).where(f"chunk_id < {len(late)}").collect()}
    assert ids == set(range(len(late)))


def test_contexts_are_counted_by_batch_and_all_of_them(spark):
    """A batch sends each of its contexts and transitions once, and the model's counts are those of all texts."""
    rows = [(i, text) for i, text in enumerate(["Dr. Rao came. He saw 山。 Is it?\n\nNo.", "One (two. three). Four... five", "ག །།\nཀ ཁ"] * 40)]
    contexts = sentences.text_contexts(spark.createDataFrame(rows, TEXTS).coalesce(1), "id", "text")
    every = Counter(c for _, text in rows for c in sentences.prepared(text)[5])
    moves = Counter(m for _, text in rows for m in sentences._moves(*sentences.prepared(text)[4:]))
    counted = contexts.where("counted is not null").selectExpr("inline(counted)").where("what in ('context', 'move')").collect()
    assert len(counted) == len(every) + len(moves)
    assert {(r["what"], r["value"]): r["n"] for r in counted} == {("context", c): n for c, n in every.items()} | {("move", m): n for m, n in moves.items()}
    model = sentences.train(contexts)
    assert {sentences.general(c) for c in every} <= set(model.emission)
    whole = sentences.SentenceModel(
        dict(sum((Counter({sentences.general(c): n}) for c, n in every.items()), Counter())) | {c: n for c, n in every.items() if ":" in c},
        {(m.split(">")[0], int(m.split(">")[1])): n for m, n in moves.items()},
    )
    assert model.transition == whole.transition and model.emission == whole.emission


def test_quick_searches_find_what_the_patterns_find():
    """Marks, other plain forms and wrongly read sequences, on texts strung together at random."""
    pick = random.Random(7)
    parts = [*" \n\t.!?…।॥|/།༎གཀ；;:,“”\"'’()[]01²*†aBαω۝。！？山\r\x0b\xa0\x85​ﬁÃ©Â¶â€œ�\x81Ðõ€", " \n", "ག ", ". . .", "....", "\n\n"]
    texts = ["".join(pick.choices(parts, k=pick.randint(1, 40))) for _ in range(4000)]
    for text, bits in zip(texts, mojibake._found_bits(texts, mojibake._sequence_bits())):
        plain = "".join(map(sentences._PLAIN.__getitem__, map(ord, text)))
        assert sentences._uneven(text) == (plain != text)
        assert [m.span() for m in sentences._marks(plain)] == [m.span() for m in sentences.MARK.finditer(plain)]
        assert mojibake._surely_plain(bits) == (not mojibake.LOST.search(text) and not mojibake._any_sequence().search(text))
    kinds, times = mojibake._holders(texts)
    assert {chr(c): n for c, n in zip(kinds.tolist(), times.tolist())} == Counter(c for text in texts for c in set(text))
