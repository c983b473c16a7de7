"""Problem 3: text that was decoded with the wrong character encoding.

Smoothed character n-gram models are trained on all clean records (Spark counts,
hashed to tables of fixed size).  Words with characters that a wrong decoding
leaves are scored under every candidate chain, that is re-encoding by the wrong
encoding and decoding by the right one, once or several times; the likeliest is
accepted if it beats the stored word by a margin validated on the words of all
clean records.  A record garbled in part by an 8-bit encoding is told by the
summed gain of its words, against a margin validated on all records.  For that the
records are dealt out to ``FOLDS`` parts, and each is scored by the counts of the
others.

Defined results: null, empty and plain ASCII texts are never affected; bytes
that the wrong decoding lost (U+FFFD) or left undefined (control characters of
C1) mark a record as affected even where nothing can be restored; look-alike
letters, other spellings and left-out accents are not a case.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.lookalike import LOOKALIKE_LETTERS
from lectern.session import cut, spread

# Encodings in which UTF-8 bytes are wrongly read, one byte a character, and in pairs of bytes.
SINGLE = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "koi8_r", "iso8859_15", "cp866")
PAIRED = ("gb18030", "big5", "shift_jis", "euc_kr")
# Right encodings of other texts whose bytes are wrongly read as cp1252 or latin-1.
BYTEWISE = ("gb18030", "big5", "shift_jis", "cp1256", "cp1253", "cp1251", "koi8_r")
# Bytes of the 8-bit encoding for romanised Sanskrit and Pali (CSX).
ROMANISED = {
    0xE0: "ā", 0xE1: "Ā", 0xE3: "ī", 0xE4: "Ī", 0xE5: "ū", 0xE6: "Ū", 0xE7: "ṛ", 0xE8: "Ṛ", 0xE9: "ṝ", 0xEA: "Ṝ",
    0xEB: "ḷ", 0xEC: "Ḷ", 0xED: "ḹ", 0xEF: "ṅ", 0xF0: "Ṅ", 0xA4: "ñ", 0xA5: "Ñ", 0xF1: "ṭ", 0xF2: "Ṭ", 0xF3: "ḍ",
    0xF4: "Ḍ", 0xF5: "ṇ", 0xF6: "Ṇ", 0xF7: "ś", 0xF8: "Ś", 0xF9: "ṣ", 0xFA: "Ṣ", 0xFC: "ṃ", 0xFD: "Ṃ", 0xFE: "ḥ", 0xFF: "Ḥ",
}
#: Buckets of the counts by length of the n-gram.
BUCKETS = (1 << 16, 1 << 18, 1 << 20)
#: A character is in the alphabet of clean text if this share of the records holds it.
COMMON = 0.008
#: Parts of the records that are held out in turn while the margins are validated, and share of what is clean that stays under them.
FOLDS, UNDER = 4, 0.9995
#: Buckets of all lengths in a row, in segments that are added up together.
ALL_BUCKETS, SEGMENT = sum(BUCKETS), 1 << 16
#: Least gain in log-likelihood; the validated margin is never under it.
LEAST_MARGIN = 4.0
#: Share of the bytes that must come through a chain of an encoding in pairs of bytes.
KEPT = 0.8
#: For 8-bit encodings a record counts as wholly garbled if so many characters change, in such a share of its words with such characters.
EIGHT_CHARS, EIGHT_SHARE = 4, 0.6
#: Otherwise its words must gain this much together, about three garbled words; the validated margin of a record is never under it.
LEAST_RECORD_MARGIN = 60.0
LOST = re.compile("[�\x80-\x84\x86-\x9f]")
LOST_LETTERS = frozenset("�" + "".join(map(chr, [*range(0x80, 0x85), *range(0x86, 0xA0)])))
# letters of cp1252 that an 8-bit encoding may leave
EIGHT_LETTERS = "Š‹ŒŽ‘’“”•–—˜™š›œžŸ€‚ƒ„…†‡ˆ‰"
EIGHT_LETTER = re.compile(f"[\xa1-\xff{EIGHT_LETTERS}]")
WORD = re.compile("[^ \n\r\t]+")
#: Scripts whose letters may look like Latin ones.
FOREIGN = re.compile("[\u0370-\u05bf]")


@lru_cache(maxsize=32)
def _upper(encoding: str) -> dict[int, str]:
    """Byte -> character of a single-byte encoding, from 0x80 on; undefined bytes stay as controls."""
    found = {}
    for b in range(0x80, 0x100):
        try:
            found[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            found[b] = chr(b)
    return found


@lru_cache(maxsize=32)
def _sequences(encoding: str) -> tuple[re.Pattern, dict[str, int]]:
    """What UTF-8 sequences look like when they are read in the encoding."""
    upper = _upper(encoding)
    back = {c: b for b, c in upper.items()} | {chr(b): b for b in range(0x80, 0xA0)}
    group = lambda low, high: "[" + "".join(re.escape(c) for c, b in back.items() if low <= b <= high) + "]"
    tail = group(0x80, 0xBF)
    return re.compile(f"{group(0xC2, 0xDF)}{tail}|{group(0xE0, 0xEF)}{tail}{{2}}|{group(0xF0, 0xF4)}{tail}{{3}}"), back


def _unread(word: str, encoding: str) -> str:
    """The word with every UTF-8 sequence that was read in the encoding put right."""
    pattern, back = _sequences(encoding)

    def put(m: re.Match) -> str:
        try:
            return bytes(back[c] for c in m[0]).decode("utf8")
        except UnicodeDecodeError:
            return m[0]

    return pattern.sub(put, word)


@lru_cache(maxsize=1)
def _sequence_letters() -> tuple[frozenset[str], frozenset[str]]:
    """The first and the second characters of all UTF-8 sequences that are read in one of the encodings."""
    leads, tails = (frozenset(c for e in SINGLE for c, b in _sequences(e)[1].items() if low <= b <= high) for low, high in ((0xC2, 0xF4), (0x80, 0xBF)))
    return leads, tails


@lru_cache(maxsize=1)
def _any_sequence() -> re.Pattern:
    """What every UTF-8 sequence begins with when it is read in one of the encodings: two characters of all their tables."""
    leads, tails = ("".join(map(re.escape, sorted(letters))) for letters in _sequence_letters())
    return re.compile(f"[{leads}][{tails}]")


def _candidates(word: str) -> dict[str, str]:
    """Chain -> restored word, for every chain that changes the word."""
    found: dict[str, str] = {}
    for encoding in SINGLE if _any_sequence().search(word) else ():
        once = _unread(word, encoding)
        if once != word:
            found[f"utf-8 as {encoding}"] = once
            for again in dict.fromkeys((encoding, "cp1252", "latin-1")):
                twice = _unread(once, again)
                if twice != once:
                    found[f"utf-8 as {again} as {encoding}"] = twice
                    thrice = _unread(twice, again)
                    if thrice != twice:
                        found[f"utf-8 as {again}, {again} as {encoding}"] = thrice
    if any(c > "⺀" for c in word):
        for encoding in PAIRED:
            try:
                data = word.replace("�", "").encode(encoding, "ignore")
                text = data.decode("utf8", "ignore")
            except UnicodeError:
                continue
            if len(text.encode()) >= KEPT * len(data) and len(data) >= len(word.encode("utf-16-le")) * KEPT:
                found[f"utf-8 as {encoding}"] = text
    elif EIGHT_LETTER.search(word):
        table = _sequences("cp1252")[1]
        data = [table.get(c, ord(c) if c < "\x80" else -1) for c in word]
        if any(b in ROMANISED for b in data):
            found["romanised 8-bit as cp1252"] = "".join(ROMANISED.get(b, c) if b >= 0 else c for b, c in zip(data, word))
        if min(data) >= 0 and 2 * sum(b >= 0xA0 for b in data) > len(data) > 2:
            for encoding in BYTEWISE:
                try:
                    found[f"{encoding} as cp1252"] = bytes(data).decode(encoding)
                except UnicodeDecodeError:
                    continue
    found.pop("", None)
    return {chain: text for chain, text in found.items() if text != word}


def _all_hashed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Buckets of the n-grams of each length, given by their characters, the last first."""
    found, h = [], np.zeros(len(columns[0]), "u8")
    for column, size in zip(columns, BUCKETS):
        h = (h + column.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        found.append((h & np.uint64(size - 1)).astype("i8"))  # sizes are powers of two
    return found


class NgramModel:
    """Interpolated character trigrams over hashed counts; ``alphabet`` holds the common characters."""

    def __init__(self, counts: list[np.ndarray], alphabet: str, margin: float = LEAST_MARGIN, record_margin: float = LEAST_RECORD_MARGIN) -> None:
        self.counts, self.alphabet, self.margin, self.record_margin = counts, frozenset(alphabet), margin, record_margin
        rare = "[^\\x00-\\x7f" + "".join(re.escape(c) for c in alphabet if c >= "\x80") + "]"
        self.rare, self.rare_word = re.compile(rare), re.compile(rf"[^ \n\r\t]*?{rare}[^ \n\r\t]*")
        self.total = max(1.0, float(counts[0].sum()))
        self.known: dict[str, float] = {}

    def __reduce__(self):
        return NgramModel, (self.counts, "".join(sorted(self.alphabet)), self.margin, self.record_margin)

    def odd_words(self, text: str) -> set[str]:
        """The words with a character outside the alphabet."""
        if not self.rare.search(text):
            return set()
        return {w for w in _distinct([text]) if not w.isascii() and self.rare.search(w)}

    def _learn(self, grams: set[str]) -> None:
        """Remembers the log-probability of the last character of each trigram after the two before it."""
        grams = list(grams)
        a, b, c = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "u4").reshape(-1, 3).T
        one, two, three = (n[at] for n, at in zip(self.counts, _all_hashed([c, b, a])))
        before_one, before_two = (n[at] for n, at in zip(self.counts, _all_hashed([b, a])))
        p = 1e-7 + 0.05 * one / self.total + 0.25 * np.minimum(1, two / np.maximum(before_one, 1)) + 0.7 * np.where(before_two > 1, np.minimum(1, three / np.maximum(before_two, 1)), 0)
        self.known.update(zip(grams, np.log(p.astype("f8")).tolist()))

    def _grams(self, word: str) -> list[str]:
        """The trigrams of a word between blanks; look-alike letters count as what they look like."""
        if FOREIGN.search(word):
            word = "".join(LOOKALIKE_LETTERS.get(c, c) if c not in self.alphabet else c for c in word)
        padded = f"  {word} "
        return [padded[i : i + 3] for i in range(len(word) + 1)]

    def score(self, word: str) -> float:
        """Log-likelihood of a word between blanks."""
        grams, known = self._grams(word), self.known
        if new := {g for g in grams if g not in known}:
            self._learn(new)
        return sum(known[g] for g in grams)

    def options(self, words: Iterable[str], every: bool = False) -> dict[str, dict[str, str]]:
        """Word -> chain -> text, each text by its first chain; with ``every`` also for words without a character outside the alphabet."""
        found = {}
        for w in words:
            chains = _candidates(w) if every or self.rare.search(w) else {}
            first = {text: chain for chain, text in reversed(chains.items())}  # each text once, by its first chain
            found[w] = {chain: text for text, chain in reversed(first.items())}
        return found

    def restored(self, words: set[str], every: bool = False) -> dict[str, tuple[tuple[str, str, float], tuple[str, str, float]]]:
        """Word -> (chain, text, gain) of the likeliest chain from UTF-8 and of the likeliest from an 8-bit encoding.

        An empty chain stands for no gain beyond the margin.  Words without a
        character outside the alphabet are left alone unless ``every`` is set.  All
        words are taken together, so that their trigrams are looked up at once.
        """
        return self.chosen(self.options(words, every))

    def chosen(self, options: dict[str, dict[str, str]]) -> dict[str, tuple[tuple[str, str, float], tuple[str, str, float]]]:
        """As ``restored``, for words with their ``options``."""
        if len(self.known) > 1_000_000:
            self.known.clear()
        grams = {text: self._grams(text) for w, chains in options.items() if chains for text in (w, *chains.values())}
        if new := set().union(*grams.values()).difference(self.known):
            self._learn(new)
        known = self.known
        found = {}
        for word, chains in options.items():
            best = [("", word, 0.0), ("", word, 0.0)]
            own = sum(map(known.__getitem__, grams[word])) if chains else 0.0
            for chain, text in chains.items():
                kind = 0 if chain.startswith("utf-8") else 1
                gain = sum(map(known.__getitem__, grams[text])) - own
                if gain > max(best[kind][2], self.margin):
                    best[kind] = (chain, text, gain)
            found[word] = (best[0], best[1])
        return found


def _plain(text: str, letters: set[str]) -> bool:
    """Whether no sequence of the text could be a wrongly read one; ``letters`` are its characters."""
    if LOST_LETTERS.isdisjoint(letters) and (any(map(letters.isdisjoint, _sequence_letters())) or not _any_sequence().search(text)):
        return True
    return not (LOST.search(text) or any(_sequences(e)[0].search(text) for e in ("cp1252", "cp437", "mac_roman", "cp1251")))


#: Bits of a character: lost bytes, begins a sequence, goes on with one, outside the alphabet; and of one before another that goes on with its sequence.
LOST_BIT, LEAD_BIT, TAIL_BIT, RARE_BIT, PAIR_BIT = 1, 2, 4, 8, 16


@lru_cache(maxsize=1)
def _sequence_bits() -> np.ndarray:
    """The bits of every code point but RARE_BIT and PAIR_BIT."""
    bits = np.zeros(0x110000, "u1")
    for bit, letters in zip((LOST_BIT, LEAD_BIT, TAIL_BIT), (LOST_LETTERS, *_sequence_letters())):
        bits[[ord(c) for c in letters]] |= bit
    return bits


def _rare_bits(alphabet: frozenset[str]) -> np.ndarray:
    """The bits of every code point but PAIR_BIT."""
    rare = np.full(0x110000, RARE_BIT, "u1")
    rare[:0x80] = 0
    rare[[ord(c) for c in alphabet]] = 0
    return rare | _sequence_bits()


def _codes(texts: Iterable[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "u4")


def _found_bits(texts: list[str], bits: np.ndarray) -> list[int]:
    """The bits that the characters of each text have."""
    if not texts:
        return []
    found = bits[_codes([f"{t} " for t in texts])]  # nothing reaches across a blank, and no text is empty
    found[:-1] |= (found[:-1] & LEAD_BIT) * (found[1:] & TAIL_BIT) // (LEAD_BIT * TAIL_BIT) * np.uint8(PAIR_BIT)
    sizes = np.fromiter(map(len, texts), "i8", len(texts)) + 1
    return np.bitwise_or.reduceat(found, np.cumsum(sizes) - sizes).tolist()


def _surely_plain(found: int) -> bool:
    """Whether the bits of a text's characters tell that it is plain; else ``_plain`` looks at the text."""
    return not found & (LOST_BIT | PAIR_BIT)


def _holders(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts, and how many of the texts hold each."""
    codes, sizes = _codes(texts), list(map(len, texts))
    there = np.zeros(0x110000, bool)
    there[codes] = True
    kinds = np.flatnonzero(there)
    number = np.empty(0x110000, "i8")
    number[kinds] = np.arange(len(kinds))
    held = np.zeros((len(texts), len(kinds)), bool)
    held[np.repeat(np.arange(len(texts)), sizes), number[codes]] = True
    return kinds, held.sum(axis=0)


def _alphabet(rows: DataFrame) -> tuple[str, int]:
    """Characters that a given share of all records holds, and the number of records."""
    n = rows.count()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, "i8")
        for batch in batches:
            texts = batch.column(0).to_pylist()
            texts = [t for t, bits in zip(texts, _found_bits(texts, _sequence_bits())) if _surely_plain(bits) or _plain(t, set(t))]
            for at in range(0, len(texts), 256):
                kinds, times = _holders(texts[at : at + 256])
                seen[kinds] += times
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(seen[found], pa.int64())], names=["c", "n"])

    common = rows.select("text").mapInArrow(held, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON * n)
    return "".join(chr(r["c"]) for r in common.collect()), n


def _clean(text: str, alphabet: frozenset[str]) -> bool:
    letters = set(text)
    return all(c < "\x80" for c in letters - alphabet) and _plain(text, letters)


def _distinct(texts: Iterable[str]) -> set[str]:
    """The words of the texts, and perhaps an empty one."""
    return set(" ".join(texts).replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" "))


def _counts(texts: list[str]) -> list[np.ndarray]:
    """Counts of the n-grams of the texts by length and bucket; blanks in a row count as one space."""
    codes = np.frombuffer(f"  {' '.join(texts)}".encode("utf-32-le", "surrogatepass"), "u4")
    blank = np.isin(codes, (9, 10, 13, 32))
    again = blank & np.r_[False, blank[:-1]]
    again[:2] = False  # the two leading separators
    codes = np.where(blank, 32, codes)[~again]
    n = len(codes) - 2
    return [np.bincount(b, minlength=size) for b, size in zip(_all_hashed([codes[2 - back : 2 - back + n] for back in range(len(BUCKETS))]), BUCKETS)]


COUNTED = "segment int, at binary, n binary, word string, folds int, odd array<string>, words int"


def _counted(alphabet: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the model and its margins need of the records: counts of clean ones by fold, their words, and the odd words of any.

    Rows have one of three kinds: packed counts of a segment of the buckets of a
    fold; a word with a letter beyond ASCII of clean records of a fold (a bit of
    ``folds``); of a record that an 8-bit encoding may have garbled, unless bytes
    were lost, its words with a character outside the alphabet and how many words
    go beyond ASCII.  All copies of a text are in the same fold.
    """
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32())
    rare = NgramModel([np.zeros(1)] * 3, "".join(sorted(alphabet)))

    def rows(many: int, **given: list) -> pa.RecordBatch:
        names = [x.split(" ")[0] for x in COUNTED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(given[name], kind) if name in given else pa.nulls(many, kind) for name, kind in zip(names, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, ALL_BUCKETS), "i8")
        bits = _rare_bits(alphabet)
        seen: dict[str, int] = {}
        for batch in batches:
            clean: list[list[str]] = [[] for _ in range(FOLDS)]
            found: list[tuple[int, list[str], int]] = []
            texts = batch.column(0).to_pylist()
            for text, kinds in zip(texts, _found_bits(texts, bits)):
                fold = zlib.crc32(text.encode("utf8", "surrogatepass")) % FOLDS
                if not kinds & RARE_BIT:
                    if _surely_plain(kinds) or _plain(text, set(text)):
                        clean[fold].append(text)
                elif any(map(EIGHT_LETTER.search, odd := rare.odd_words(text))) and not LOST.search(text):
                    found.append((1 << fold, sorted(odd), sum(not w.isascii() for w in _distinct([text]))))
            for fold, texts in enumerate(clean):
                if texts:
                    sums[fold] += np.concatenate(_counts(texts))
                    for word in _distinct(t for t in texts if not t.isascii()):
                        if not word.isascii():
                            seen[word] = seen.get(word, 0) | 1 << fold
            if found:
                folds, odd, words = map(list, zip(*found))
                yield rows(len(found), folds=folds, odd=odd, words=words)
            if len(seen) > 100_000:
                yield rows(len(seen), word=list(seen), folds=list(seen.values()))
                seen = {}
        if seen:
            yield rows(len(seen), word=list(seen), folds=list(seen.values()))
        parts = sums.reshape(-1, SEGMENT)
        at = {k: np.flatnonzero(part) for k, part in enumerate(parts)}
        at = {k: a for k, a in at.items() if len(a)}
        if at:
            yield rows(len(at), segment=list(at), at=[a.astype("u2").tobytes() for a in at.values()], n=[parts[k][a].tobytes() for k, a in at.items()])

    return run


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the packed counts of a segment."""
    total = np.zeros(SEGMENT, "i8")
    for batch in batches:
        for at, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist()):
            total[np.frombuffer(at, "u2")] += np.frombuffer(n, "i8")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["segment", "n"])


def _by_length(counts: np.ndarray) -> list[np.ndarray]:
    return [c.astype("f4") for c in np.split(counts, np.cumsum(BUCKETS)[:-1])]


def _gain_under(gains: DataFrame, every: int | None = None) -> float:
    """The gain that the share ``UNDER`` of all (``gain``, of ``every`` things; the others gain nothing) doesn't exceed; gains are rounded, so these are few rows."""
    found = sorted(((r["g"], r["n"]) for r in gains.groupBy(F.round("gain", 2).alias("g")).agg(F.count("*").alias("n")).collect()), reverse=True)
    above = sum(n for _, n in found) if every is None else every
    above -= math.ceil(UNDER * above)  # so many may gain more
    for gain, n in found:
        above -= n
        if above < 0:
            return gain
    return 0.0


def _margins(counted: DataFrame, models: list[NgramModel], n: int) -> tuple[float, float]:
    """Margins of a word and of a record, from the gains that all clean text makes under a model that hasn't counted it.

    ``models`` are those without each fold, ``n`` is the number of records.  A clean
    word is tried under all chains, whatever its letters.  Records with a sequence
    from UTF-8 or with lost bytes and those garbled as a whole are no evidence for
    the second; it is twice what the others gain.
    """
    shared = counted.sparkSession.sparkContext.broadcast(models)

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            best = dict.fromkeys(folds, 0.0)
            options = {w: chains for w, chains in shared.value[0].options(folds, every=True).items() if chains}
            for k, model in enumerate(shared.value):
                for word, both in model.chosen({w: chains for w, chains in options.items() if folds[w] >> k & 1}).items():
                    best[word] = max(best[word], both[0][2], both[1][2])
            yield pa.RecordBatch.from_arrays([pa.array(list(best.values()), pa.float64())], names=["gain"])

    words = counted.where("word is not null").groupBy("word").agg(F.bit_or("folds").alias("folds"))
    margin = max(LEAST_MARGIN, 1.0 + _gain_under(words.mapInArrow(of_words, "gain double")))

    def of_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [NgramModel(m.counts, "".join(m.alphabet), margin) for m in shared.value]
        known: list[dict] = [{} for _ in models]
        for batch in batches:
            folds, odd, words = (c.to_pylist() for c in batch.columns)
            folds, odd = [f.bit_length() - 1 for f in folds], [set(o) for o in odd]
            left = range(len(odd))
            # one word tells most records with a sequence from UTF-8; the others' words are all scored
            for part in (lambda i: {_probe(odd[i])}, lambda i: odd[i]):
                new = [set().union(*(part(i) for i in left if folds[i] == k)).difference(known[k]) for k in range(FOLDS)]
                options = models[0].options(set().union(*new))
                for k, model in enumerate(models):
                    known[k].update(model.chosen({w: options[w] for w in new[k]}))
                left = [i for i in left if not any(known[folds[i]][w][0][0] for w in part(i))]
            gains = [0.0] * len(odd)
            for i in left:
                eight, gain = _eight_gain(odd[i], known[folds[i]])
                if not (_wholly(eight) and len(eight) >= EIGHT_SHARE * words[i]):
                    gains[i] = gain
            for k in range(FOLDS):
                if len(known[k]) > 500_000:
                    known[k].clear()
            yield pa.RecordBatch.from_arrays([pa.array(gains, pa.float64())], names=["gain"])

    records = counted.where("odd is not null").select("folds", "odd", "words")
    return margin, max(LEAST_RECORD_MARGIN, 1.0 + 2 * _gain_under(records.mapInArrow(of_records, "gain double"), n))


def train(rows: DataFrame) -> NgramModel:
    """The model of all clean records of ``rows`` (text), with margins validated on all records.

    The driver gets the counts by fold and bucket, so never more than ``FOLDS`` times
    the sum of BUCKETS numbers.
    """
    rows = rows.select("text").where("text is not null and text <> ''")
    letters, n = _alphabet(rows)
    counted = cut(rows.mapInArrow(_counted(frozenset(letters)), COUNTED))
    counts = np.zeros((FOLDS * ALL_BUCKETS // SEGMENT, SEGMENT), "i8")
    for r in counted.where("segment is not null").select("segment", "at", "n").groupBy("segment").applyInArrow(_added, "segment int, n binary").collect():
        counts[r["segment"]] = np.frombuffer(r["n"], "i8")
    counts = counts.reshape(FOLDS, ALL_BUCKETS)
    total = counts.sum(axis=0)
    margin, record_margin = _margins(counted, [NgramModel(_by_length(total - c), letters, 0.0) for c in counts], n)
    return NgramModel(_by_length(total), letters, margin, record_margin)


def _wholly(eight: list[str]) -> bool:
    """Whether enough characters of the words come from an 8-bit encoding."""
    return sum(c >= "\x80" for w in eight for c in w) >= EIGHT_CHARS


def _eight_gain(odd: set[str], known: dict[str, tuple]) -> tuple[list[str], float]:
    """The words that a chain from an 8-bit encoding explains best, and what they gain together."""
    eight = [w for w in odd if known[w][1][0] and known[w][1][2] > known[w][0][2]]
    return eight, sum(known[w][1][2] for w in eight)


def _probe(odd: set[str]) -> str:
    """A word that likely tells by itself whether a text is garbled: the longest of moderate length, else the shortest."""
    return max((w for w in odd if len(w) <= 16), key=lambda w: (len(w), w), default="") or min(odd, key=lambda w: (len(w), w))


def restore_text(text: str, model: NgramModel, known: dict[str, tuple], put_right: bool = True, odd: set[str] | None = None) -> tuple[bool, str, list[str]]:
    """(affected, restored text, chains) of one text; ``known`` remembers words.  Without ``put_right`` only the first matters.

    ``odd`` are the text's words with a character outside the alphabet, if they are at hand.

    A chain from UTF-8 leaves sequences that hardly occur otherwise, so one word
    is enough.  A foreign word may look like one from an 8-bit encoding, so there
    most words with such characters must gain and several characters change, or
    all words together gain more than the margin of a record.
    """
    if odd is None:
        odd = model.odd_words(text)
    if not odd:
        return False, text, []
    if not put_right and (any(w in known and known[w][0][0] for w in odd) or LOST.search(text)):
        return True, text, []
    if new := {w for w in odd if w not in known}:
        known.update(model.restored(new))
        if not put_right and any(known[w][0][0] for w in odd):
            return True, text, []
    eight, gain = _eight_gain(odd, known)
    whole = gain > model.record_margin
    if eight and not whole and _wholly(eight):
        whole = len(eight) >= EIGHT_SHARE * len({w for w in WORD.findall(text) if not w.isascii()})
    if not put_right:
        return whole, text, []
    chains: set[str] = set()

    def put(m: re.Match) -> str:
        word = m[0]
        first, second = known[word]
        chain, right, _ = second if whole and second[2] > first[2] else first
        if chain:
            chains.add(chain)
        return right

    restored = model.rare_word.sub(put, text)
    if not chains and LOST.search(text):
        chains.add("lost")
    return bool(chains), restored, sorted(chains)


def repair(df: DataFrame, id_col: str, text_col: str, model: NgramModel, put_right: bool = True) -> DataFrame:
    """(id, affected, restored, chains) of every row with a non-null text.  Narrow; the model is of fixed size.

    Without ``put_right`` only the flag is filled, which is cheaper.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            texts = batch.column(1).to_pylist()
            odd = [set() if t.isascii() else model.odd_words(t) for t in texts]
            scored = odd
            if not put_right:  # one word tells most garbled texts; the others' words are all scored
                known.update(model.restored({_probe(o) for o in odd if o}.difference(known)))
                scored = [o for o in odd if o and not known[_probe(o)][0][0]]
            known.update(model.restored(set().union(*scored).difference(known)))
            out = [restore_text(t, model, known, put_right, words) for t, words in zip(texts, odd)]
            if not put_right:
                out = [(flag, "", []) for flag, _, _ in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.list_(pa.string()))],
                names=["id", "affected", "restored", "chains"],
            )

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInArrow(run, "id bigint, affected boolean, restored string, chains array<string>")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = spark.read.parquet(f"{sf_dir}/document_chunks.parquet").select("id", F.col("chunk_text").alias("text"))
    titles = spark.read.parquet(f"{sf_dir}/canon_texts.parquet").select("id", F.col("title_sanskrit").alias("text"))
    return spread(chunks), spread(titles)


def affected_records(spark: SparkSession, sf_dir: str, put_right: bool = True, tables: tuple[str, ...] = ("document_chunks", "canon_texts")) -> DataFrame:
    """(tbl, record_id, restored, chains) of every affected record of the tables; the model is always of both."""
    chunks, titles = _tables(spark, sf_dir)
    model = train(chunks.select("text").unionByName(titles.select("text")))
    parts = []
    for name, rows in (("document_chunks", chunks), ("canon_texts", titles)):
        if name not in tables:
            continue
        fixed = repair(rows, "id", "text", model, put_right).where("affected")
        parts.append(fixed.select(F.lit(name).alias("tbl"), F.col("id").alias("record_id"), "restored", F.array_join("chains", "; ").alias("chains")))
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["tbl", "record_id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, record_id) of the records with a garbled sequence."""
    return affected_records(spark, sf_dir, put_right=False).select("tbl", "record_id")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected records with their text put right where that is possible."""
    return affected_records(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p3_restored": p3_restored}
ORACLE: dict[str, str] = {}
