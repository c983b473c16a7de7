"""Problem 7: evaluation texts that leaked into training text.

A generalised suffix automaton holds the normalised test passages (words, or
characters where the passage is Chinese).  The tokens of every document are
streamed through it; the longest matching lengths give, for each passage, how
much of it the document can hold.  Passages beyond a low limit are then aligned
with the document: exact runs that follow each other closely form a stretch, in
which single words may be changed or dropped; one or two stretches in the
passage's order that span a third of it make a leak.

Tokens are words and single Chinese characters, in the order of the text.  A
passage made of numbers for the most part is compared with its numbers, any other
without.  Spans are given in characters of the stored text; ``cleaned`` removes
them.

Only the test items are broadcast, in portions of ``MAX_ITEM_TOKENS`` tokens at
most; a scan of the documents serves ``PORTIONS`` of them, so nothing is left out
and memory stays bounded.  A worker builds the automata once.  Defined results:
null or blank texts and passages match nothing; repeated documents each get their
own rows; a passage without a letter or digit takes no part; of a passage so short
that a third of it is a phrase of less than ``SEED`` tokens, that many count.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.lookalike import LOOKALIKE_LETTERS
from lectern.session import spread

#: Share of a passage that must be reproduced, and part of it that a stretch must match word by word.
SHARE, EXACT = 1 / 3, 0.72
#: Shortest run for the search and for the alignment, and shortest stretch of a long passage, of words, of characters and of numbers.
SEED, RUN, STRETCH = (4, 6, 4), (2, 3, 2), (8, 10, 8)
#: Share of a passage that the runs found by the search must add up to, before it is aligned.
EVIDENCE = 0.2
#: Tokens of the document and of the passage that may lie between two runs of a stretch.
GAP_DOCUMENT, GAP_PASSAGE = 8, 5
#: Characters of passages in one automaton, and automata of one scan.
MAX_ITEM_TOKENS, PORTIONS = 1_000_000, 4
TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|<!--.*?-->|&(?:nbsp|shy|zwnj|zwj);", re.S)
NOTE = re.compile(r"\[\^?[\d*†‡a-z]{1,4}\]|[{(]\d{1,4}[})]")
BROKEN = re.compile(r"(?<=\w)[-‐­¬]\s*\n\s*(?=\w)")
HAN = "㐀-䶿一-鿿"
CHINESE = re.compile(f"[{HAN}]")
TOKENS = re.compile(rf"[{HAN}]|[^\W\d_{HAN}]+")
WITH_NUMBERS = re.compile(rf"[{HAN}]|[^\W\d_{HAN}]+|\d+")
ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


class _Shown(dict):
    """Code point -> its plain form, filled as needed."""

    def __missing__(self, code: int) -> str:
        plain = "".join(LOOKALIKE_LETTERS.get(c, c) for c in unicodedata.normalize("NFKD", chr(code)) if unicodedata.category(c) not in ("Mn", "Cf"))
        self[code] = plain.casefold()
        return self[code]


_SHOWN = _Shown()


def plain(text: str) -> str:
    """The text without case, accents, markup and notes."""
    if "<" in text or "&" in text:
        text = html.unescape(TAG.sub(" ", text))
    return BROKEN.sub("", NOTE.sub(" ", text)).translate(_SHOWN)


def tokens(text: str) -> list[str]:
    """Words and Chinese characters of a text in order: digits and punctuation left out too."""
    return TOKENS.findall(plain(text))


def token_places(text: str, pattern: re.Pattern = TOKENS) -> list[tuple[int, int]]:
    """(start, end) in the stored text of each of its tokens; the steps of ``plain`` with every character's origin."""
    origin = list(range(len(text)))

    def replaced(pattern: re.Pattern, by: Callable[[str], str]) -> None:
        nonlocal text, origin
        parts, places, at = [], [], 0
        for m in pattern.finditer(text):
            new = by(m[0])
            parts += [text[at : m.start()], new]
            places += origin[at : m.start()] + [origin[m.start()]] * len(new)
            at = m.end()
        text, origin = "".join(parts) + text[at:], places + origin[at:]

    if "<" in text or "&" in text:
        replaced(TAG, lambda _: " ")
        replaced(ENTITY, html.unescape)
    replaced(NOTE, lambda _: " ")
    replaced(BROKEN, lambda _: "")
    shown = [_SHOWN[ord(c)] for c in text]
    origin = [o for o, c in zip(origin, shown) for _ in c]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in pattern.finditer("".join(shown))]


class Automaton:
    """A generalised suffix automaton over token lists."""

    def __init__(self, lists: list[list[str]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, owners = [-1], [0], [set()]
        for item, sequence in enumerate(lists):
            last = 0
            for token in sequence:
                last = self._extended(last, token, owners)
                owners[last].add(item)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                owners[self.link[state]] |= owners[state]
        self.items = [tuple(o) for o in owners]

    def seeds(self, least: int) -> list[tuple[int, ...]]:
        """For each state the items that hold its last ``least`` tokens; none where it is shorter."""
        found: list[tuple[int, ...]] = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[state] >= least:
                found[state] = found[self.link[state]] or self.items[state]
        return found

    def _copied(self, state: int, length: int, owners: list[set]) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        owners.append(set())
        return len(self.link) - 1

    def _extended(self, last: int, token: str, owners: list[set]) -> int:
        if token in self.next[last]:
            to = self.next[last][token]
            if self.length[to] == self.length[last] + 1:
                return to
            copy = self._copied(to, self.length[last] + 1, owners)
            self.link[to] = copy
            at = last
            while at >= 0 and self.next[at].get(token) == to:
                self.next[at][token] = copy
                at = self.link[at]
            return copy
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        owners.append(set())
        new = len(self.link) - 1
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][token]
            if self.length[to] == self.length[at] + 1:
                self.link[new] = to
            else:
                copy = self._copied(to, self.length[at] + 1, owners)
                self.link[to] = self.link[new] = copy
                while at >= 0 and self.next[at].get(token) == to:
                    self.next[at][token] = copy
                    at = self.link[at]
        return new

    def evidence(self, sequence: list[str], weights: dict[str, float], least: int, seeds: list[tuple[int, ...]]) -> dict[int, float]:
        """Item -> summed weight of the tokens that lie in its matches of at least ``least`` tokens."""
        found: dict[int, float] = {}
        last: dict[int, int] = {}
        follow, link, length = self.next, self.link, self.length
        state = size = 0
        for k, token in enumerate(sequence):
            to = follow[state].get(token)
            if to is None:
                if not state:
                    continue
                while to is None and state > 0:
                    state = link[state]
                    to = follow[state].get(token)
                state, size = (to, length[state] + 1) if to is not None else (0, 0)
            else:
                state, size = to, size + 1
            if size >= least:
                for item in seeds[state]:
                    new = 1 if last.get(item) == k - 1 else least
                    found[item] = found.get(item, 0.0) + sum(weights[t] for t in sequence[k + 1 - new : k + 1])
                    last[item] = k
        return found


class Passage:
    """A test passage ready for alignment: its tokens, running weights, and places of its short runs."""

    def __init__(self, sequence: list[str], weights: dict[str, float], run: int) -> None:
        self.size, self.run = len(sequence), run
        self.sums = [0.0]
        for t in sequence:
            self.sums.append(self.sums[-1] + weights[t])
        self.places: dict[tuple, list[int]] = {}
        for p in range(len(sequence) - run + 1):
            self.places.setdefault(tuple(sequence[p : p + run]), []).append(p)


def stretches(grams: list[tuple], passage: Passage, least: int) -> list[tuple[int, int, int, int, float]]:
    """(first and end token in the document, in the passage, weight matched) of the one or two stretches that span most.

    ``grams`` are the document's runs of ``passage.run`` tokens, by place.
    """
    sums, run = passage.sums, passage.run
    runs: list[tuple[int, int, int]] = []
    open_: dict[int, tuple[int, int, int]] = {}  # by the next place in the passage
    known, before = passage.places, -1
    for d in [d for d, gram in enumerate(grams) if gram in known]:
        if d != before + 1:
            runs += open_.values()
            open_ = {}
        going: dict[int, tuple[int, int, int]] = {}
        for p in known[grams[d]]:
            first = open_.pop(p, None)
            going[p + 1] = (first[0], first[1], first[2] + 1) if first else (d, p, run)
        runs += open_.values()
        open_, before = going, d
    runs += open_.values()
    runs.sort()
    best: list[tuple[int, int, int, int, float]] = []
    near: list[tuple[int, int, int, int, float]] = []  # chains that a run may still follow
    for d, p, n in runs:
        near = [x for x in near if d - x[1] <= GAP_DOCUMENT]
        chain = (d, d + n, p, p + n, sums[p + n] - sums[p])
        for a, b, c, e, m in near:
            cut = max(0, b - d, e - p)  # tokens that the earlier chain has already
            if cut < n and d + cut - b <= GAP_DOCUMENT and p + cut - e <= GAP_PASSAGE and m + sums[p + n] - sums[p + cut] > chain[4]:
                chain = (a, d + n, c, p + n, m + sums[p + n] - sums[p + cut])
        best.append(chain)
        near.append(chain)
    whole = [x for x in best if x[3] - x[2] >= least and x[4] >= EXACT * (sums[x[3]] - sums[x[2]])]
    return _longest_pair(whole, passage.size)


def _longest_pair(chains: list[tuple[int, int, int, int, float]], size: int) -> list[tuple[int, int, int, int, float]]:
    """The chain, or the two chains in the order of document and passage, that span most of the passage.

    Chains are taken by their beginning in the document; those that end before it
    are held by their end in the passage in a tree of running maxima.
    """
    tree: list[tuple[int, int]] = [(0, -1)] * (size + 2)  # (span, chain) of the longest that ends at or before a place
    by_start, by_end = sorted(range(len(chains)), key=lambda i: chains[i][0]), sorted(range(len(chains)), key=lambda i: chains[i][1])
    top, most, at = [], 0, 0
    for i in by_start:
        a, _, c, e, _ = chains[i]
        while at < len(by_end) and chains[by_end[at]][1] <= a:
            x = chains[by_end[at]]
            place = x[3] + 1
            while place < len(tree):
                tree[place] = max(tree[place], (x[3] - x[2], by_end[at]))
                place += place & -place
            at += 1
        before, place = (0, -1), c + 1
        while place > 0:
            before = max(before, tree[place])
            place -= place & -place
        if e - c + before[0] > most:
            top, most = [chains[before[1]], chains[i]] if before[0] else [chains[i]], e - c + before[0]
    return top


class Leaks:
    """The passages of a portion of test items, and an automaton for each kind: of words, of Chinese characters, of numbers."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.kinds: list[tuple[list[int], list[Passage], dict[str, float], Automaton, list[tuple[int, ...]]]] = []
        split: tuple[list, list, list] = ([], [], [])
        for item, passage in items:
            sequence, numbered = tokens(passage), WITH_NUMBERS.findall(plain(passage))
            kind = 2 if len(numbered) > 2 * len(sequence) else int(sum(map(len, filter(CHINESE.match, sequence))) * 2 > len(sequence))
            if numbered:
                split[kind].append((item, numbered if kind == 2 else sequence))
        for kind, part in enumerate(split):
            held: dict[str, int] = {}
            for _, sequence in part:
                for token in set(sequence):
                    held[token] = held.get(token, 0) + 1
            weights = {t: math.log((len(part) + 1) / n) for t, n in held.items()}
            automaton = Automaton([t for _, t in part])
            self.kinds.append(([i for i, _ in part], [Passage(t, weights, RUN[kind]) for _, t in part], weights, automaton, automaton.seeds(SEED[kind])))

    def found(self, text: str) -> list[tuple[int, float, list[tuple[int, int]]]]:
        """(item, share of its passage, spans of the text in characters) of each item that leaked into the text."""
        out, shown = [], plain(text)
        lettered = TOKENS.findall(shown)
        for kind, (ids, passages, weights, automaton, seeds) in enumerate(self.kinds):
            if not ids:
                continue
            pattern = WITH_NUMBERS if kind == 2 else TOKENS
            sequence = WITH_NUMBERS.findall(shown) if kind == 2 else lettered
            if weights.keys().isdisjoint(sequence):
                continue
            grams = places = None
            for k, weight in automaton.evidence(sequence, weights, SEED[kind], seeds).items():
                passage = passages[k]
                if weight >= EVIDENCE * passage.sums[-1]:
                    grams = grams or list(zip(*(sequence[i:] for i in range(RUN[kind]))))
                    least = min(STRETCH[kind], max(SEED[kind], math.ceil(SHARE * passage.size)))
                    top = stretches(grams, passage, least)
                    share = sum(x[3] - x[2] for x in top) / passage.size
                    if share >= SHARE:
                        places = places or token_places(text, pattern)
                        out.append((ids[k], share, [(places[x[0]][0], places[x[1] - 1][1]) for x in top]))
        return out


def _portions(rows: Iterable[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    part, size = [], 0
    for item, passage in rows:
        if part and size + len(passage) > MAX_ITEM_TOKENS:
            yield part
            part, size = [], 0
        part.append((item, passage))
        size += len(passage)
    if part:
        yield part


#: The automata that this worker has built, by the name of their portion.
_BUILT: dict[str, Leaks] = {}


def _built(portion: tuple[str, object]) -> Leaks:
    name, shared = portion
    if name not in _BUILT:
        if len(_BUILT) >= 2 * PORTIONS:
            _BUILT.clear()
        _BUILT[name] = Leaks(shared.value)
    return _BUILT[name]


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, share, spans): the items that leaked into each document.

    ``items`` is (item_id, passage), the held-out set.  spans are the character
    ranges of the stored text.  Narrow over the documents.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and trim(text) <> ''")
    schema = "doc_id bigint, item_id bigint, share double, spans array<struct<start_char: int, end_char: int>>"
    held = ((r[0], r[1]) for r in items.select("item_id", "passage").where("passage is not null").distinct().orderBy("item_id").toLocalIterator())
    portions = [(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(p)) for p in _portions(held)]
    found = None
    for at in range(0, len(portions), PORTIONS):
        some = portions[at : at + PORTIONS]

        def run(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32())])))
            searches = [_built(p) for p in some]
            for batch in batches:
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for search in searches:
                        out += [(doc, item, round(share, 4), spans) for item, share, spans in search.found(text)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "item_id", "share", "spans"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def cleaned(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the documents with leaks, without their leaked spans; other documents stay as they are."""
    spans = found.select("doc_id", F.explode("spans").alias("s")).groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("spans"))
    kept = F.expr(
        "aggregate(spans, named_struct('text', '', 'at', 0), (a, s) -> named_struct("
        "'text', if(s.start_char > a.at, concat(a.text, substring(text, a.at + 1, s.start_char - a.at)), a.text), 'at', greatest(a.at, s.end_char)), "
        "a -> concat(a.text, substring(text, a.at + 1)))"
    )
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(spans, "doc_id").select("doc_id", kept.alias("text"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every test item that leaked into a document."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked spans in characters of the stored text, and the share of the passage."""
    found = _leaks(spark, sf_dir).dropDuplicates(["doc_id", "item_id"])
    return found.select("doc_id", "item_id", "share", F.explode("spans").alias("s")).select("doc_id", "item_id", "share", "s.start_char", "s.end_char")


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of the documents with leaks, their leaked spans removed."""
    return cleaned(_documents(spark, sf_dir), _leaks(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p7_found": p7_found, "p7_spans": p7_spans, "p7_cleaned": p7_cleaned}
ORACLE: dict[str, str] = {}
