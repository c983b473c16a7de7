"""Problem 2: sentence boundaries across languages and scripts.

Characters are tagged as boundary or inside by linear-chain models and Viterbi
decoding.

In text with sentence marks, a mark with what closes after it, a line end or a
Tibetan clause end can be a boundary; every other character is inside.  The
emission of such a character is its context: the mark, what closes after it, the
word before, the word after, brackets and quotations around it, and whether the
text has sentence marks at all.  Transitions depend on how many words lie between
two candidates.  Spark counts all contexts of all chunks.  Some tell their tag by
themselves (a mark before a lower-case letter, the end of a paragraph, the inside
of a quotation).  The tags of the others, such as a dot after a short word, an
abbreviation, an initial or a number, are learned: a word that ends sentences
also stands at the end of paragraphs and texts, as often as ordinary last words
do, and a title or a number's sign never does.  From that share follows how many
of the word's doubtful dots are boundaries, by what follows them.

In text without any mark each line is a sentence.  Where a line of Chinese or
Tibetan is longer than sentences are, every character is a candidate, and a
second model decides that is trained on the marked texts of the script with
their marks stripped: it knows the characters on both sides of a boundary and the
lengths of sentences.

Both models have a bounded size: the number of context classes, of words before
a dot that occur ``LEAST_WORD`` times, and of characters.

Defined results: null and blank texts have no sentence; a text without any mark
or line break is one sentence; sentences never overlap, come in order, hold no
blanks at their edges and cover all other text.  Positions are code points.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.lookalike import LOOKALIKE_LETTERS
from lectern.llm.mojibake import affected_records
from lectern.session import cut, spread

# Abbreviations before a name, before a number, before any word, and those that may end a sentence.
TITLES = frozenset("mr mrs ms mx dr st ste rev prof ven mt mts fr hon gen col lt capt cdr sgt bro sr srta messrs mme mlle bp abp card".split())
NUMBERED = frozenset("p pp v vv vol vols ch chap chs no nos n nn fol ff f l ll cap art sect sec bk bks fig figs vs par tom lib vin aṭṭh sū bh ov ath sk ms mss c ca §".split())
JOINING = frozenset("cf ed eds e.g i.e viz sc vs tr trans etc.,e al".split())
HEADINGS = frozenset("chapter book part section canto hymn act scene psalm sura surah sutta letter volume treatise discourse lecture".split())
FINAL = frozenset("etc ibid co jr sr inc ltd esq b.c a.d c.e b.c.e a.m p.m ph.d".split())
# Words that attach a quotation to what follows.
ATTACHING = frozenset("said asked cried replied answered wrote sang thought called whispered declared exclaimed shouted says ti iti inquit".split())
OPEN, CLOSE = "“«「『(（[［〈《‘{", "”»」』)）]］〉》’}"
PAIRS = dict(zip(OPEN, CLOSE))
DIGITS = "0-9०-९੦-੯٠-٩༠-༩"
CLOSERS = "”’»」』)）\\]］〉》\"'›"
TAIL = rf"(?:[{CLOSERS}]+|\[[{DIGITS}]{{1,4}}\]|\{{[{DIGITS}]{{1,4}}\}}|[⁰¹²³⁴-⁹*†‡]+)*"
# what may end a sentence, with everything that it takes along
MARK = re.compile(
    r"(?=[।॥|/།༎༏༑۝。！？!?.…؟;\n]|(?<=ག) |[ \t]+\n)(?:"
    rf"(?P<danda>(?:[।॥|]+|(?<=\s)/+(?=\s|$))(?:\s?[{DIGITS}.]+\s?[।॥|/]+)?(?:[ \t]?[।॥|]+)*{TAIL})"
    rf"|(?P<shad>[།༎༏༑]+(?:[ \t]*[།༎༏༑])*{TAIL})"
    rf"|(?P<ga>(?<=ག)[ ]+(?=[ཀ-ྼ]))"
    rf"|(?P<ayah>۝[{DIGITS}]*{TAIL})"
    rf"|(?P<cjk>[。！？!?]*[。！？][。！？!?]*{TAIL})"
    rf"|(?P<dots>(?:\.\s\.\s\.|\.{{2,}}|…+)[.!?]*{TAIL})"
    rf"|(?P<latin>(?:(?<![{DIGITS}])\.|\.(?![{DIGITS}])|[!?؟])[.!?؟]*{TAIL})"
    rf"|(?P<greek>;(?=\s|$|[{CLOSERS}]){TAIL})"
    r"|(?P<lines>[ \t]*\n\s*))"
)
#: What every mark but blanks begins with; searched far faster than MARK.
MARK_START = re.compile(r"[।॥|/།༎༏༑۝。！？!?.…؟;\n]")
HARD = re.compile("[.!?؟。！？।॥|།༎۝]|(?<=[α-ωἀ-ῼ]);")
WORD = re.compile(r"[^\W_]+(?:[’'.-][^\W_]+)*", re.U)
CJK = re.compile("[㐀-䶿一-鿿]")
TIBETAN = re.compile("[ཀ-ྼ]")
BLANKS = re.compile(r"\s*")
ENCLOSING = re.compile("[" + re.escape(OPEN + CLOSE) + '"]|\n\n')
UPPER = re.compile("[A-ZÀ-ÖØ-ÞĀĪŪŚṢṬḌṆṂḤḶṚÑΑ-ΩА-Я]")
NUMERAL, ROMAN, DOTTED = re.compile(rf"[{DIGITS}]{{1,4}}[a-z]?"), re.compile("[ivxlcdm]+"), re.compile(r"(?:[a-z]\.)+[a-z]")
CLOSING = frozenset(CLOSERS)
TOKEN_EDGE = frozenset(" \n\t([“‘«\"—–")
BOUNDARY, INSIDE = 1, 0


class _Plain(dict):
    """Code point -> one plain character; nothing for what doesn't show."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if unicodedata.category(c) == "Cf" and c != "۝" or c == "͏":
            plain = ""
        elif unicodedata.category(c) == "Zs" or c == "\t":
            plain = " "
        elif c in "\r\x0b\x0c\x85":
            plain = "\n"
        elif c in "。！？":
            plain = c
        else:
            plain = unicodedata.normalize("NFKC", c)
            plain = LOOKALIKE_LETTERS.get(plain, plain) if len(plain) == 1 and not "Ͱ" <= c <= "Ͽ" else c
        self[code] = plain
        return plain


_PLAIN = _Plain()


#: By code point whether a character has another plain form; 0: not asked yet, 1: no, 2: yes.
_UNEVEN = np.zeros(0x110000, "u1")
_UNEVEN[0x30000:] = 1


def _uneven(text: str) -> bool:
    """Whether any character has another plain form; most texts hold none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4")
    kinds = _UNEVEN[codes].tobytes()
    if b"\0" in kinds:
        new = [c for c in np.unique(codes).tolist() if not _UNEVEN[c]]
        _UNEVEN[new] = [1 + (_PLAIN[c] != chr(c)) for c in new]
        kinds = _UNEVEN[codes].tobytes()
    return b"\2" in kinds


def plain_text(text: str) -> tuple[str, list[int] | None]:
    """The text in plain characters, and for each its place in the stored text (None: the same)."""
    if not _uneven(text):
        return text, None
    plain = text.translate(_PLAIN)
    if len(plain) == len(text):
        return plain, None
    return plain, [i for i, c in enumerate(text) if _PLAIN[ord(c)]]


def _enclosed(text: str) -> list[tuple[int, int]]:
    """(first, last) of the quotations and brackets that are opened and closed again."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    straight: int | None = None
    for m in ENCLOSING.finditer(text):
        i, c = m.start(), m[0]
        if c in PAIRS:
            if c == "‘" and i and text[i - 1].isalnum():
                continue
            stack.append((PAIRS[c], i))
        elif c in CLOSE:
            if c == "’" and i + 1 < len(text) and text[i + 1].isalpha() and i and text[i - 1].isalpha():
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == c:
                    spans.append((stack[k][1], i))
                    del stack[k:]
                    break
        elif c == '"':
            if straight is None and (i == 0 or not text[i - 1].isalnum() and text[i - 1] not in ".!?,"):
                straight = i
            elif straight is not None:
                spans.append((straight, i))
                straight = None
        else:
            stack, straight = [], None  # nothing reaches beyond a paragraph
    return spans


def _token_start(text: str, at: int, least: int) -> int:
    """Where the word that ends at ``at`` begins."""
    while at > least and text[at - 1] not in TOKEN_EDGE:
        at -= 1
    return at


def _marks(text: str) -> Iterator[re.Match]:
    """The matches of MARK in a text, in order."""
    if "ག " in text:  # these blanks count too
        yield from MARK.finditer(text)
        return
    at, find, match = 0, MARK_START.search, MARK.match
    while m := find(text, at):
        start = m.start()
        if m[0] == "\n":
            while start > at and text[start - 1] in " \t":
                start -= 1
        if found := match(text, start):
            yield found
            at = found.end()
        else:
            at = start + 1


@lru_cache(maxsize=1 << 16)
def _word_before(token: str, cased: bool) -> tuple[str, bool]:
    """The class of a word before a dot, unless it stands at a beginning, and whether it may be a Roman number."""
    if NUMERAL.fullmatch(token):
        return "figure", False
    low, before = token.lower().strip(",'’"), "word"
    if low in TITLES:
        before = "title"
    elif low in FINAL:
        before = "final"
    elif low in JOINING:
        before = "joining"
    elif len(token) == 1 and token.isalpha() and (token.isupper() or not cased) and not CJK.match(token):
        before = "initial"
    elif low in NUMBERED:
        before = "numbered"
    elif DOTTED.fullmatch(low):
        before = "final"
    elif len(low) <= 3 and cased:
        before = "short"
    if before != "word":
        before += ":" + low.replace("|", "")[:16]
    return before, bool(ROMAN.fullmatch(low))


#: What the words that _follow looks at begin with, in lower case.
FOLLOWING = frozenset(w[0] for w in (*ATTACHING, "the", "a"))


def _follow(text: str, begin: int, tight: bool, closed: bool, cased: bool) -> str:
    """The class of what follows a mark; ``tight``: without a blank between."""
    first = text[begin : begin + 1]
    if not first:
        return "end"
    word = WORD.match(text, begin, begin + 40) if first.lower() in FOLLOWING else None
    if word and word[0].split("’")[0].lower() in ATTACHING:
        return "attach"
    if first in ",;:，；：、—–" or closed and first == "者":
        return "joined"
    if first.isdigit():
        return "tight" if tight else "number"
    if first.islower():
        return "tight" if tight else "lower" if cased else "caseless"
    if first.isupper():
        return "article" if word and word[0] in ("The", "A", "An") else "upper"
    return "other"


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(end, next, context class) of every character of a plain text that may end a sentence, in order; what follows begins at next."""
    spans = _enclosed(text)
    marked = bool(HARD.search(text))
    upper = len(UPPER.findall(text))
    size = len(text)
    cased = 0.003 * size < upper < 0.4 * size
    found: list[tuple[int, int, str]] = []
    last = -1  # end of the last one
    for m in _marks(text):
        kind, (start, end) = m.lastgroup, m.span()
        if kind == "lines":
            if start == 0 or end == size or last == start:
                if last == start and m[0].count("\n") > 1:
                    found[-1] = (last, end, found[-1][2].rpartition("|")[0] + "|paragraph")
                continue
            inside = spans and any(a <= start < b for a, b in spans)
            found.append((start, end, f"lines|{'blank' if m[0].count(chr(10)) > 1 else 'single'}|{'marked' if marked else 'bare'}|{'in' if inside else 'out'}|line"))
            last = start
            continue
        if kind == "greek" and not "Ͱ" <= text[start - 1 : start] <= "῿":
            continue
        mark = m[0].strip()
        closed = kind != "ga" and len(mark) > 1 and not CLOSING.isdisjoint(mark)
        if kind == "ga":
            end = start
        begin = end
        while begin < size and text[begin].isspace():
            begin += 1
        before = "word"
        if mark[:1] == "." and kind in ("latin", "dots"):
            least = max(last, 0)
            opening = _token_start(text, start, least)
            before, roman = _word_before(text[opening:start], cased)
            if before == "figure" or roman:
                lead = opening
                while lead > least and text[lead - 1] == " ":
                    lead -= 1
                if before == "figure":
                    before = "lead" if lead <= least or text[lead - 1] == "\n" else "figure"
                elif text[_token_start(text, lead, least) : lead].lower() in HEADINGS:
                    before = "lead"
        at = end if closed else end - 1
        inside = spans and any(a <= at < b for a, b in spans)
        long = "four" if kind == "dots" and mark.startswith("....") else ""
        follow = _follow(text, begin, begin == end, closed, cased)
        found.append((end, begin, f"{kind}{long}|{'closed' if closed else 'open'}|{before}|{'in' if inside else 'out'}|{follow}"))
        last = end
    return found


@lru_cache(maxsize=1 << 16)
def certain_tag(context: str) -> int | None:
    """The tag of a context that leaves no doubt, else None."""
    kind, closed, before, place, follow = context.split("|")
    if kind == "lines":
        return BOUNDARY if closed == "blank" or before == "bare" else INSIDE
    if follow in ("end", "paragraph"):
        return BOUNDARY
    if place == "in":
        return INSIDE
    if kind in ("danda", "shad", "ga", "ayah"):
        return BOUNDARY
    if follow in ("joined", "attach"):
        return INSIDE
    if kind == "cjk":
        return BOUNDARY
    if kind == "dotsfour":
        return INSIDE if follow in ("lower", "tight") else BOUNDARY
    if follow == "tight" or follow == "lower" and (closed == "closed" or kind == "dots" or before != "word"):
        return INSIDE
    return BOUNDARY if before == "word" and kind != "dots" else None


#: Times that a word before a dot must occur to be told from its class.
LEAST_WORD = 30


def general(context: str) -> str:
    """The context without the word before it."""
    return WORD_PART.sub("", context)


WORD_PART = re.compile(r":[^|]*")


#: What may follow a doubtful dot.  Weight of its class in the share of a word.
DOUBTFUL, CLASS_WEIGHT = ("upper", "article", "number", "other", "caseless", "lower"), 3.0


def _placed(total: float, sizes: dict[str, int], shares: dict[str, float]) -> dict[str, float]:
    """``total`` boundaries placed on what follows by ``shares``, never more than there are; the rest goes to the others."""
    low, high = 0.0, 1e12
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(n, mid * shares[f]) for f, n in sizes.items()) < total else (low, mid)
    return {f: min(n, high * shares[f]) for f, n in sizes.items()}


def learned_shares(counts: dict[str, int]) -> dict[str, float]:
    """Context -> share of boundaries, for the contexts whose tag isn't certain.

    ``counts`` holds contexts with words and without.  A word's certain boundaries
    are those at ends of texts and paragraphs; over those of ordinary words they
    tell how many of its doubtful dots are boundaries.  These are placed on what
    follows as after ordinary words.  What follows the other dots is the geometric
    mean of the word's own remainder and of what follows words that never end a
    sentence.
    """
    ends: Counter = Counter()
    sizes: dict[tuple[str, str, str], dict[str, int]] = {}
    for context, n in counts.items():
        kind, closed, before, place, follow = context.split("|")
        group = (kind, closed, before)
        if place == "out" and follow in ("end", "paragraph"):
            ends[group] += n
        elif place == "out" and follow in DOUBTFUL and (certain_tag(context) is None or group == ("latin", "open", "word")):
            sizes.setdefault(group, {})[follow] = n
    plain = sizes.get(("latin", "open", "word"), {})
    every = max(1, sum(plain.values()))
    rate = max(1, ends[("latin", "open", "word")]) / every
    usual = {f: (plain.get(f, 0) + 0.5) / (every + 3) for f in DOUBTFUL}
    share = {g: min(1.0, (ends[g] + 0.5) / (sum(n.values()) * rate + 1)) for g, n in sizes.items() if ":" not in g[2]}
    for g, n in sizes.items():
        if ":" in g[2]:
            of_class = share.get((*g[:2], general(g[2])), 0.5)
            share[g] = min(1.0, (ends[g] + CLASS_WEIGHT * of_class) / (sum(n.values()) * rate + CLASS_WEIGHT))
    never: Counter = Counter()
    for g, n in sizes.items():
        if share[g] < 0.1 and ":" not in g[2] and g[2] not in ("lead", "figure"):  # numbers stand before beginnings
            never.update(n)
    found = {}
    for g, n in sizes.items():
        total = share[g] * sum(n.values())
        placed = _placed(total, n, usual)
        for f, size in n.items():
            inside = math.sqrt((size - placed[f]) * (sum(n.values()) - total) * (never[f] + 0.5) / (sum(never.values()) + 3))
            found["|".join((*g, "out", f))] = placed[f] / max(placed[f] + inside, 1e-9)
    return {c: p for c, p in found.items() if certain_tag(c) is None}


GAPS = ("none", "few", "many")


def _gap_class(text: str, a: int, b: int) -> str:
    if b - a > 24:
        return "many"
    part = text[a:b].strip(" \n.,")
    return "none" if not part else "few" if len(part) <= 12 and " " not in part and "་" not in part else "many"


class BareModel:
    """Boundaries in text of one script without marks: characters beside a boundary, and lengths of sentences."""

    def __init__(self, sides: dict[tuple[str, str, int], int], lengths: dict[int, int]) -> None:
        total = [1.0 + sum(n for (side, _, tag), n in sides.items() if side == "last" and tag == t) for t in (INSIDE, BOUNDARY)]
        kinds = 1.0 + len({c for _, c, _ in sides})
        # each character's log-odds for a boundary after it, and before it
        odds = lambda side, c: math.log((sides.get((side, c, BOUNDARY), 0) + 1) / (total[BOUNDARY] + kinds)) - math.log((sides.get((side, c, INSIDE), 0) + 1) / (total[INSIDE] + kinds))
        self.odds = {side: {c: odds(side, c) for s, c, _ in sides if s == side} for side in ("last", "first")}
        self.longest = max(lengths, default=1)
        every = sum(lengths.values()) + self.longest
        # lengths near a seen one are likely too
        smooth = [sum(lengths.get(k + d, 0) * (3 - abs(d)) for d in (-2, -1, 0, 1, 2)) / 9 for k in range(self.longest + 1)]
        self.length = [-99.0] + [math.log((n + 1) / every) for n in smooth[1:]]

    def ends(self, text: str) -> list[int]:
        """The places after which a sentence of the bare text ends, by Viterbi over the length of the sentence at hand."""
        n = len(text)
        score = [0.0] + [-math.inf] * n
        back = [0] * (n + 1)
        for stop in range(1, n + 1):
            here = self.odds["last"].get(text[stop - 1], 0.0) + self.odds["first"].get(text[stop], 0.0) if stop < n else 0.0
            for size in range(1, min(self.longest, stop) + 1):
                s = score[stop - size] + self.length[size]
                if s > score[stop]:
                    score[stop], back[stop] = s, stop - size
            score[stop] += here
        found, at = [], n
        while at > 0:
            found.append(at)
            at = back[at]
        return found[::-1]


class SentenceModel:
    """Log-probabilities of contexts by tag, and of tags by the last tag and the gap; and the models of bare text."""

    def __init__(self, contexts: dict[str, int], moves: dict[tuple[str, int], int], bare: dict[str, BareModel] | None = None) -> None:
        self.bare = bare or {}
        shares = learned_shares(contexts)
        split = {c: (n * (1 - shares[c]), n * shares[c]) if c in shares else (n, 0) if certain_tag(c) == INSIDE else (0, n) for c, n in contexts.items()}
        total = [sum(x[t] for c, x in split.items() if c == general(c)) + 1.0 for t in (INSIDE, BOUNDARY)]
        self.emission = {c: tuple(math.log((x[t] + 0.01) / total[t] ** TRANSITION) for t in (INSIDE, BOUNDARY)) for c, x in split.items()}
        self.transition = {}
        for move in {v for v, _ in moves}:
            both = sum(moves.get((move, t), 0) for t in (INSIDE, BOUNDARY)) + 2.0
            self.transition[move] = tuple(math.log((moves.get((move, t), 0) + 1.0) / both) for t in (INSIDE, BOUNDARY))
        # by gap: weighted, from inside and from a boundary
        even = (-0.7, -0.7)
        self.moved = {gap: [TRANSITION * p for tag in "01" for p in self.transition.get(tag + gap, even)] for gap in GAPS}

    def emitted(self, context: str) -> tuple[float, float]:
        """That of the context, or without its word; for one that was never counted, weakly its certain tag or inside."""
        known = self.emission.get(context) or self.emission.get(general(context))
        if known is None:
            known = (-3.0, 0.0) if certain_tag(context) == BOUNDARY else (0.0, -3.0)
        return known

    def chosen(self, contexts: list[str], gaps: list[str]) -> list[int]:
        """The numbers of the candidates that are boundaries, by Viterbi."""
        inside, boundary = -math.inf, 0.0  # the start counts as a boundary
        back: list[tuple[bool, bool]] = []
        for context, gap in zip(contexts, gaps):
            e = self.emission.get(context) or self.emitted(context)
            a_in, a_b, b_in, b_b = self.moved[gap]
            in_in, in_b = inside + a_in, boundary + b_in
            b_in, b_b = inside + a_b, boundary + b_b
            first, second = in_b >= in_in, b_b >= b_in
            back.append((first, second))
            inside, boundary = (in_b if first else in_in) + e[INSIDE], (b_b if second else b_in) + e[BOUNDARY]
        tag, found = boundary >= inside, []
        for k in range(len(back) - 1, -1, -1):
            if tag:
                found.append(k)
            tag = back[k][tag]
        return found[::-1]


#: Weight of the transitions, which hold the tags' shares too; the emissions keep the rest of these.
TRANSITION = 0.5


def prepared(text: str) -> tuple[int, int, list[int], list[int], list[str], list[str]]:
    """(first, last, stops, nexts, gaps, contexts) of a stored text.

    first and last enclose what isn't blank; for every candidate, where a
    sentence that ends there stops and where the next one starts.
    """
    plain, places = plain_text(text)
    first = BLANKS.match(plain).end()
    last = len(plain.rstrip())
    stops, nexts, gaps, contexts = [], [], [], []
    before = 0
    for end, begin, context in candidates(plain):
        stop = end
        while stop > 0 and plain[stop - 1].isspace():
            stop -= 1
        stops.append(stop)
        nexts.append(begin)
        gaps.append(_gap_class(plain, before, end))
        contexts.append(context)
        before = end
    if places is not None:
        size = len(plain)
        stops = [places[x - 1] + 1 if x else 0 for x in stops]
        nexts = [places[x] if x < size else len(text) for x in nexts]
        first, last = places[first] if first < size else len(text), places[last - 1] + 1 if last else 0
    return first, last, stops, nexts, gaps, contexts


def _cut_bare(model: SentenceModel, text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``spans`` of a bare text with those cut that are longer than any sentence of their script."""
    out = []
    for a, b in spans:
        bare = model.bare.get(script(text[a:b]))
        if bare is None or b - a <= bare.longest:
            out.append((a, b))
            continue
        before = a
        for end in bare.ends(text[a:b]):
            part = text[before : a + end]
            if part.strip():
                out.append((before + len(part) - len(part.lstrip()), before + len(part.rstrip())))
            before = a + end
    return out


def _spans(model: SentenceModel, first: int, last: int, stops: list[int], nexts: list[int], gaps: list[str], contexts: list[str], bare: str | None = None) -> list[tuple[int, int]]:
    found, start = [], first
    for k in model.chosen(contexts, gaps):
        if start < stops[k]:
            found.append((start, stops[k]))
        start = max(start, nexts[k])
    if start < last:
        found.append((start, last))
    return found if bare is None else _cut_bare(model, bare, found)


def split_text(text: str, model: SentenceModel) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a stored text."""
    return _spans(model, *prepared(text), bare_text(text))


def _moves(gaps: list[str], contexts: list[str]) -> list[str]:
    """The certain transitions: last tag, gap and tag."""
    tag, found = BOUNDARY, []
    for gap, context in zip(gaps, contexts):
        now = certain_tag(context)
        if now is not None:
            found.append(f"{tag}{gap}>{now}")
            tag = now
    return found


#: Scripts whose text may lack marks, what tells them, and the marks that end their sentences.
BARE_SCRIPTS = {"han": (CJK, re.compile("[。！？!?]+[」』”’）)]*")), "tibetan": (TIBETAN, re.compile("[།༎༏༑]+(?:[ \t]*[།༎༏༑])*"))}
OTHER_MARKS = re.compile("[，、；：,;:「」『』“”‘’（）() \t]")
#: A line from which on a bare text is kept for the model of bare text.
BARE_LINE = 40


def script(text: str) -> str | None:
    """The script of a text that may lack marks, else None."""
    if text.isascii():
        return None
    return next((name for name, (letter, _) in BARE_SCRIPTS.items() if letter.search(text)), None)


def bare_text(text: str) -> str | None:
    """The text, if it has no mark, is of a script that may lack them, and holds a long line."""
    if script(text) is None or HARD.search(text) or max(map(len, text.split("\n"))) <= BARE_LINE:
        return None
    return text


def stripped_counts(texts: list[str]) -> Counter:
    """(script, what, value, tag) -> times, of marked texts with their marks stripped: characters beside each place, and lengths.

    The last piece of a text has no mark and isn't used.
    """
    kept: dict[tuple[str, str, int], list[str]] = {}
    lengths: Counter = Counter()
    for text in texts:
        name = script(text)
        if name is None:
            continue
        pieces = [p.replace("\n", "") for p in BARE_SCRIPTS[name][1].split(OTHER_MARKS.sub("", text))[:-1]]
        for piece, after in zip(pieces, [*pieces[1:], ""]):
            if piece:
                lengths[(name, "length", str(len(piece)), BOUNDARY)] += 1
                for part, value in ((("last", BOUNDARY), piece[-1]), (("first", BOUNDARY), after.strip()[:1]), (("last", INSIDE), piece[:-1]), (("first", INSIDE), piece[1:])):
                    kept.setdefault((name, *part), []).append(value)
    for (name, what, tag), parts in kept.items():
        lengths.update({(name, what, c, tag): n for c, n in Counter("".join(parts)).items()})
    return lengths


CONTEXTS = "id bigint, first int, last int, stops array<int>, nexts array<int>, gaps array<string>, contexts array<string>, bare string, counted array<struct<script: string, what: string, value: string, tag: int, n: bigint>>"


def text_contexts(df: DataFrame, id_col: str = "id", text_col: str = "chunk_text") -> DataFrame:
    """Every non-blank text's candidates and their contexts, found once for training and decoding.

    A batch's counts stand on its first row: of contexts, of certain transitions,
    and, of texts in scripts that may lack marks, those without the marks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = pa.list_(pa.struct([("script", pa.string()), ("what", pa.string()), ("value", pa.string()), ("tag", pa.int32()), ("n", pa.int64())]))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), counted)
        for batch in batches:
            rows, texts = [], batch.column(1).to_pylist()
            counts, moves = Counter(), Counter()
            for i, text in zip(batch.column(0).to_pylist(), texts):
                found = prepared(text)
                counts.update(found[5])
                moves.update(_moves(found[4], found[5]))
                rows.append((i, *found, bare_text(text), None))
            if rows:
                columns = [list(c) for c in zip(*rows)]
                columns[-1][0] = [(*key, n) for key, n in stripped_counts(texts).items()]
                columns[-1][0] += [(None, what, value, None, n) for what, of in (("context", counts), ("move", moves)) for value, n in of.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split(" ")[0] for x in CONTEXTS.split(", ")[:9]])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null and trim(text) <> ''")
    return rows.mapInArrow(run, CONTEXTS)


def train(contexts: DataFrame) -> SentenceModel:
    """The model from the contexts of all texts (``text_contexts``), counted by batch and added up by Spark."""
    counted = contexts.where("counted is not null").select(F.inline("counted"))
    exact = counted.where("what = 'context'").groupBy(F.col("value").alias("c")).agg(F.sum("n").alias("n"))
    without = exact.withColumn("g", F.regexp_replace("c", r":[^|]*", "")).groupBy("g").agg(F.sum("n").alias("n"))
    # words before a dot are told apart from a number of times on
    worded = exact.where(F.col("c").contains(":")).withColumn("w", F.regexp_extract("c", r"^[^|]*\|[^|]*\|([^|]*)", 1))
    often = worded.groupBy("w").agg(F.sum("n").alias("m")).where(F.col("m") >= LEAST_WORD).select("w")
    counts = {r["g"]: r["n"] for r in without.collect()} | {r["c"]: r["n"] for r in worded.join(often, "w", "left_semi").collect()}
    moves = {}
    bare: dict[str, tuple[dict, dict]] = {}
    for r in counted.where("what <> 'context'").groupBy("script", "what", "value", "tag").agg(F.sum("n").alias("n")).collect():
        if r["what"] == "move":
            move, tag = r["value"].split(">")
            moves[(move, int(tag))] = r["n"]
            continue
        sides, lengths = bare.setdefault(r["script"], ({}, {}))
        if r["what"] == "length":
            lengths[int(r["value"])] = r["n"]
        else:
            sides[(r["what"], r["value"], r["tag"])] = r["n"]
    return SentenceModel(counts, moves, {name: BareModel(*x) for name, x in bare.items()})


def sentences(contexts: DataFrame, model: SentenceModel) -> DataFrame:
    """(id, start_char, end_char) of every sentence.  Narrow; the model is of bounded size."""
    shared = contexts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, *row in zip(*(c.to_pylist() for c in batch.columns)):
                for a, b in _spans(model, *row):
                    ids.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "start_char", "end_char"])

    columns = ("id", "first", "last", "stops", "nexts", "gaps", "contexts", "bare")
    return contexts.select(*columns).mapInArrow(run, "id bigint, start_char int, end_char int")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/document_chunks.parquet").select("id", "chunk_text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, start_char, end_char) of the sentences of every chunk that isn't garbled.

    Chunks of p3_found are left out, as its definition says; both read the same rows.
    """
    contexts = cut(text_contexts(_chunks(spark, sf_dir)))
    garbled = affected_records(spark, sf_dir, put_right=False, tables=("document_chunks",)).select(F.col("record_id").alias("id"))
    return sentences(contexts.join(garbled, "id", "left_anti"), train(contexts)).withColumnRenamed("id", "chunk_id")


def p2_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's sentences as a list of (start, end, text), in order."""
    chunks = _chunks(spark, sf_dir)
    contexts = cut(text_contexts(chunks))
    spans = sentences(contexts, train(contexts)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("spans"))
    text = F.transform("spans", lambda s: F.struct(s["start_char"].alias("start_char"), s["end_char"].alias("end_char"), F.substring("chunk_text", s["start_char"] + 1, s["end_char"] - s["start_char"]).alias("sentence")))
    return chunks.join(spans, "id").select(F.col("id").alias("chunk_id"), text.alias("sentences"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_sentences": p2_sentences}
ORACLE: dict[str, str] = {}
