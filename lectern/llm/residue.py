"""Problem 8: template residue, filler, error pages and script notices.

Texts are cut into lines and these into sentences; numbers, addresses, dates and
times in them are masked, and the exact normalised sentences of all documents
are grouped by hash to see from how many sources each comes.  Phrase rules,
placeholder rules and filler rules classify the lines.  What can only be a
message counts by itself; the groups that recur across sources are classified
more widely: a status counts, and so does a sentence whose words are those of
the messages found by rule rather than those of the corpus (word counts over all
documents).  Names of placeholders are learned from the spellings that leave no
doubt and then found in the doubtful ones.

A placeholder is only spoken about, and doesn't count, where its sentence holds
both a word for such things and a verb of saying or showing, or where the words
around it recur across sources in different lines, always with the same
placeholder.

All rules run inside the JVM on whole tables; the groupings are by hash, by word
and by name, of small rows.  Defined results: null, empty and blank texts hold no
residue; a text that only speaks about such things or quotes them, editors'
marks for gaps, and stray code, links, markup and control tokens are not a case.
"""

from __future__ import annotations

import re
import re._parser as sre
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import cut, spread

#: Sources from which a line must come to count as recurring, and a placeholder name to be learned.
SOURCES, NAME_SOURCES = 3, 2
NAME = r"[A-Za-z]+(?:[._ ][A-Za-z]+){0,3}"
# Spellings of placeholders that leave no doubt; the first group is the name.
CERTAIN = (
    rf"\{{\{{[#/>&~]?\s*({NAME})\s*(?:\|[^}}\n]*)?\}}\}}",
    rf"\$\{{\s*({NAME})\s*\}}",
    rf"#\{{\s*({NAME})\s*\}}",
    rf"%%\s*({NAME})\s*%%",
    rf"@@\s*({NAME})\s*@@",
    rf"%\(\s*({NAME})\s*\)[sd]",
    rf"<%=?\s*({NAME})\s*%>",
    rf"\{{%-?\s*(?:include|block|extends|if|for|end\w+)\s*[\"']?({NAME})?[^%\n]{{0,60}}%\}}",
    rf"(?i)\[\s*insert\s+(?:your\s+|the\s+)?({NAME})\s+here\s*\]",
    rf"(?i)\[\s*(?:todo|tbd|fixme)\s*:\s*({NAME})\s*\]",
    rf"(?i)\[\s*your\s+({NAME})(?:\s+here)?\s*\]",
    rf"(?i)(?:<|&lt;|\[)\s*(?:your\s+|the\s+)?({NAME})\s+goes\s+here\s*(?:>|&gt;|\])",
)
# Spellings that also occur as markup, code or editors' marks; they count with a learned name.
DOUBTFUL = (
    rf"(?<![)\w{{$#])\{{\s*({NAME})\s*\}}(?!\}})",
    rf"&lt;\s*({NAME})\s*&gt;",
    rf"<({NAME})>",
    rf"\[\[\s*({NAME})\s*\]\]",
    rf"(?<!\w)__\s*({NAME})\s*__(?!\w)",
    rf"(?<!\[)\[({NAME})\](?!\]|\()",
)
# Names that are also elements of markup or words of code.
MARKUP_NAMES = "a,abbr,article,aside,b,base,big,blockquote,body,br,button,center,cite,code,dd,div,dl,dt,em,footer,font,form,h,head,header,hr,html,i,img,input,ins,kbd,label,li,link,main,mark,meta,nav,ol,option,p,pre,q,s,script,section,select,small,span,strong,style,sub,summary,sup,table,tbody,td,template,textarea,th,thead,time,title,tr,u,ul,var,video,return,else,if".split(",")
# Leftovers of unset values and formats.
UNSET = (
    r"(?i)\[object object\]",
    r"(?i)\bby undefined\b",
    r"(?i)^[^\p{L}\p{N}]*(?:undefined|null|nan|none)(?:[\s,;|]+(?:undefined|null|nan|none))+[^\p{L}\p{N}]*$",
    r"(?i)%s,? vol\. ?%d|%d of %d\b|(?:%[sd][\s,.:/-]+){2,}%[sd]",
    r"(?i)^[^\p{L}\p{N}]*(?:your |the )?(?:text|content|title|body|description) goes here\b",
    r"(?i)^[^\p{L}\p{N}]*(?:insert|add|enter) (?:your )?(?:text|content|title) here\b",
)
# Messages that are nothing else, in any place of a line that doesn't speak about them.
MESSAGES = (
    r"(?:enable|activate|turn on|requires?|allow|need[s]? ) ?(?:javascript|scripts|active scripting)",
    r"javascript (?:is|must be|has been|and cookies|seems to be) ?(?:disabled|enabled|required|turned off|checking)?",
    r"requires? (?:javascript|cookies|scripts)|until active scripting|(?:does not|doesn.t) support (?:scripts|javascript)|allow scripts for|enable scripts",
    r"^[^\p{L}\p{N}]*noscript\b",
    r"activer javascript|aktivieren sie javascript|javascript (?:aktivieren|activer|zu aktivieren)|habilit(?:ar|e) javascript|activ(?:ar|e) javascript|abilita(?:re)? javascript|(?:ative|habilite) o javascript|включите javascript",
    r"(?:启用|啟用|开启|開啟|打开|允许)\s*javascript|javascript\s*(?:を有効|を使用|を有効に)|تفعيل\s*(?:javascript|جافا)|जावास्क्रिप्ट",
    r"checking your browser before|verifying you are human|verify (?:that )?you are (?:a )?human|attention required!|just a moment\.\.\.",
    r"error establishing a database connection|database error|your session has (?:expired|timed out)|this site can.t be reached|took too long to respond",
    r"traceback \(most recent call last\)|^[^\p{L}\p{N}]*file \"[^\"]+\", line \d+|^[^\p{L}\p{N}]*(?:key|type|value|name|index|attribute|import|runtime)error:|^[^\p{L}\p{N}]*(?:fatal error|parse error|uncaught \w+)\b|expects parameter \d+ to be|exception in thread|null pointer exception|nullpointerexception|segmentation fault|stack trace:",
    r"^[^\p{L}\p{N}]*warning: .* (?:in|on) .*line \d+|syntax error near",
    r"could not complete your request|you do not have permission to (?:view|access)|page you (?:are looking for|requested)|(?:the )?requested (?:url|page|resource) .{0,60}(?:not found|could not be found|was not found|does not exist)",
    r"seite (?:wurde )?nicht gefunden|page (?:introuvable|non trouv[ée]e)|p[áa]gina no (?:encontrada|existe)|pagina non trovata|p[áa]gina n[ãa]o encontrada|страница не найдена",
    r"页面不存在|頁面不存在|找不到(?:该|此|您|頁|网)?页?面?|系統錯誤|系统错误|服务器错误|伺服器錯誤|访问被拒绝|拒絕存取|ページが見つかりません",
    r"الصفحة غير موجودة|حدث خطأ|पृष्ठ नहीं मिला|सर्वर त्रुटि",
    r"^[^\p{L}\p{N}]*oops[!,. ]",
)
# Messages that are a whole line, or begin one that recurs.
STATUS = (
    r"^[^\p{L}\p{N}]*(?:http |error |fehler |erreur )?[1-5]\d\d:? ?[-–:]? ?(?:not found|forbidden|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|too many requests|gone|bad request|unauthorized|method not allowed|request timeout|moved permanently)[^\p{L}\p{N}]*$",
    r"^[^\p{L}\p{N}]*(?:access denied|page not found|file not found|not found|forbidden|internal server error|service (?:temporarily )?unavailable|bad gateway|site under construction|coming soon|under construction)[^\p{L}\p{N}]*$",
    r"^[^\p{L}\p{N}]*(?:access denied|page not found|service unavailable|internal server error)\b[.!:]",
    r"^[^\p{L}\p{N}]*(?:error|error code|fehler|erreur)\s*:? ?\d{3}\b.{0,40}$",
)
#: A line of one sentence or phrase, three times or more: the first unit that comes three times running is the only one tried
#: (atomic and possessive, so the time is in proportion to the line).  And what ends sentences.
UNIT = r"^[^\p{L}\p{N}]*+(?>([^\n]{4,}?)(?:[\s.。!！…।]+\1){2})(?:[\s.。!！…।]+\1)*+[^\p{L}\p{N}]*$"
ENDS = r"[.。!！?？…।॥]+"
# Marks that don't count at the edges of a sentence.
EDGES = " ,;:#*_|/()[]{}<>\"'“”‘’«»-–—、，；：「」『』"
# Words for such things, and verbs of a sentence that speaks about them.
THINGS = r"templates?|placeholders?|style guides?|markup|error pages?|notices?|filler|nonsense|braces|brackets"
SAYING = r"shows?|says?|marks?|prints?|reads?|writes?|calls?|called|means?|describes?|explains?|replaces?|quotes?|stands? for|rendered"
#: Least number of bytes in the letters of a sentence that may be a message, and words about a placeholder that make its frame.
LEAST_BYTES, FRAME = 8, 2
#: Weight of the corpus against the messages in a word's share of messages.
SHRINK = 10.0
# Sentences that stand where text should come.
STANDINGS = (
    r"^[^\p{L}\p{N}]*(?:(?:this is )?(?:a )?(?:sample|dummy|placeholder|filler) (?:text|paragraph|content|sentence)|content coming soon|(?:your )?text (?:goes )?here|dies ist ein blindtext|blindtext|aqu[íi] va el texto|texto de (?:ejemplo|relleno)|(?:ici )?(?:le |votre )?texte (?:ici|d.exemple)|texte à venir|testo segnaposto|texto aqui)[.!…]",
    r"这里是示例文字|此处填写正文|這裡是示例文字|此處填寫正文|示例文字|ここにテキスト|यहाँ पाठ लिखें|नमूना पाठ|(?:هنا|أدخل|اكتب) النص|نص تجريبي",
)
# Words of well-known filler.
LOREM = "lorem|ipsum|dolor|dolore|sit|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|magna|aliqua|quis|nostrud|veniam|enim|minim|exercitation|ullamco|laboris|nisi|aliquip|commodo|consequat|duis|aute|irure|ut|et|do|ad|in|ex|ea|sint|occaecat|cupidatat|non|proident|sunt|culpa|qui|officia|deserunt|mollit|anim|id|est|laborum|reprehenderit|voluptate|velit|esse|cillum|eu|fugiat|nulla|pariatur|excepteur"
NONSENSE = "foo|bar|baz|qux|quux|asdf|asdfgh|qwer|qwerty|zxcv|zxcvb|jkl|hjkl|blah|bla|xxx|yada|test"
WORDY = rf"lorem|ipsum|consectetur|adipiscing|eiusmod|incididunt|nostrud|(?<!\p{{L}})(?:{NONSENSE})\W+(?:{NONSENSE})(?!\p{{L}})"


def _required(parsed: Iterable) -> frozenset[str] | None:
    """Literals of which every match of a parsed rule holds at least one; None if there are none."""
    found, run = [], ""
    for op, value in [*parsed, (None, None)]:
        if op is sre.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(frozenset([run.lower()]))
        run, parts = "", [None]
        if op is sre.SUBPATTERN:
            parts = [_required(value[-1])]
        elif op is sre.BRANCH:
            parts = [_required(p) for p in value[1]]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0]:
            parts = [_required(value[2])]
        if None not in parts:
            found.append(frozenset().union(*parts))
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def literals(patterns: Iterable[str]) -> list[str]:
    """What a text in lower case must hold, one at least, for any of the rules to match it: derived from the rules."""
    every: set[str] = set()
    for p in patterns:
        parts = _required(sre.parse(re.sub(r"\\p\{\w\}", r"\\w", p)))
        if parts is None:
            raise ValueError(f"no literal is required by {p}")
        every |= parts
    return sorted(x for x in every if not any(y != x and y in x for y in every))


def _any(column: str, patterns: tuple[str, ...]) -> Column:
    return F.col(column).rlike("|".join(f"(?:{p})" for p in patterns))


#: The groups of rules; a line's cues tell by bits which of them can match at all.
GROUPS = {"certain": CERTAIN, "unset": UNSET, "standings": STANDINGS, "messages": MESSAGES, "status": STATUS, "doubtful": DOUBTFUL, "wordy": (WORDY,)}


AGAIN = 1 << 20
FIRST = re.compile(r"[^\W_]")


def _with_cues(lines: DataFrame) -> DataFrame:
    """``lines`` with cues: for each group of rules, whether the line holds one of the literals that they need.

    One automaton looks for the literals of all rules, in the line without
    quotations (raw) and in the one without markup (low).  The highest bit tells
    whether the beginning of the line (whole) comes three times in it.
    """
    bits: dict[str, int] = {}
    for k, rules in enumerate(GROUPS.values()):
        for word in literals(rules):
            bits[word] = bits.get(word, 0) | 1 << k
    names = lines.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = ahocorasick.Automaton()
        for word, value in bits.items():
            search.add_word(word, value)
        search.make_automaton()
        for batch in batches:
            cues = []
            for raw, low, whole in zip(*(batch.column(names.index(c)).to_pylist() for c in ("raw", "low", "whole"))):
                first = FIRST.search(whole)
                found = AGAIN if first and whole.count(whole[first.start() : first.start() + 4], first.start()) > 2 else 0
                for _, value in search.iter(raw):
                    found |= value
                if low != raw:
                    for _, value in search.iter(low):
                        found |= value
                cues.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cues, pa.int32())], names=[*names, "cues"])

    return lines.mapInArrow(run, T.StructType([*lines.schema.fields, T.StructField("cues", T.IntegerType())]))


def _holds(group: str) -> Column:
    """Whether a rule of the group can match at all."""
    return F.col("cues").bitwiseAND(F.lit(1 << list(GROUPS).index(group))) != 0


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, however often later expressions use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_sentences(lines: DataFrame, column: str = "line") -> DataFrame:
    """``lines`` with sentences: those of a line in their normalised form, in order.

    That is in lower case, with addresses, dates, times and numbers masked, blanks
    joined, and without marks at the edges.  Each pattern is only tried where a
    part that all its matches need is there; each step is computed once a line.
    """
    c = F.col("__plain")
    step = lambda df, value: _once(df, "__next", value).drop("__plain").withColumnRenamed("__next", "__plain")
    lines = _once(lines, "__plain", F.lower(F.when(F.col(column).contains("<"), F.regexp_replace(column, r"<[^<>]{1,80}>", "")).otherwise(F.col(column))))
    dotted = c.contains("://") | c.contains("@")
    for end in (".example", ".com", ".org", ".net", ".edu"):
        dotted = dotted | c.contains(end)
    lines = step(lines, F.when(dotted, F.regexp_replace(c, r"https?://\S+|(?<![\w.-])[\w-]++(?:\.[\w-]++)*?\.(?:example|com|org|net|edu)\b(?:/\S*)?|(?<![\w.+-])[\w.+-]++@[\w.-]+", "ADDRESS")).otherwise(c))
    lines = step(lines, F.regexp_replace(c, r"\p{N}+(?:[-/.,:]\p{N}+)*(?: ?utc| ?[ap]m\b)?", "N"))
    odd = c.contains("  ") | c.contains("\t") | c.contains("\u00a0")
    lines = step(lines, F.when(odd, F.regexp_replace(c, "[\\s\u00a0]+", " ")).otherwise(c))
    return _once(lines, "sentences", F.filter(F.transform(F.split(c, ENDS), lambda x: F.btrim(x, F.lit(EDGES))), lambda x: x != "")).drop("__plain")


def _classified(lines: DataFrame) -> DataFrame:
    """``lines`` (line, ...) with said (without short quotations), unit (the sentence that it repeats) and kind."""
    quotes = F.lit(False)
    for mark in "“\"«‘":
        quotes = quotes | F.col("line").contains(mark)
    said = F.when(quotes, F.regexp_replace("line", r"[“\"«‘][^“”\"«»‘’\n]{1,40}[”\"»’]", " ")).otherwise(F.col("line"))
    untagged = lambda c: F.lower(F.when(F.col(c).contains("<"), F.regexp_replace(c, r"</?[a-zA-Z][^<>]{0,60}>", "")).otherwise(F.col(c)))
    lines = _once(lines, "said", said)
    lines = _with_cues(lines.withColumn("low", untagged("said")).withColumn("raw", F.lower("said")).withColumn("whole", untagged("line")))
    every, lorem, nonsense = (F.size(F.regexp_extract_all("low", F.lit(p), F.lit(0))) for p in (r"\p{L}+", rf"(?<!\p{{L}})(?:{LOREM})(?!\p{{L}})", rf"(?<!\p{{L}})(?:{NONSENSE})(?!\p{{L}})"))
    wordy = _holds("wordy") & F.col("low").rlike(WORDY)
    filler = wordy & (((every >= 5) & (lorem >= 0.6 * every)) | ((every >= 4) & (nonsense >= 0.8 * every)) | ((every >= 3) & (nonsense == every)))
    # the sentence that a line holds, once or again and again
    lines = with_sentences(lines)
    lines = _once(lines, "unit", F.when(F.col("cues").bitwiseAND(F.lit(AGAIN)) != 0, F.regexp_extract("whole", UNIT, 1)).otherwise(F.lit("")))
    single = F.size(F.array_distinct("sentences")) == 1
    letters = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    running = (F.col("unit") != "") & (letters("whole") >= 3 * letters("unit"))
    repeated = (running | single & (F.size("sentences") > 2)) & F.col("whole").rlike(r"[ .。।]")
    lines = _once(lines, "repeated", repeated)
    lines = lines.withColumn("unit", F.when(F.col("unit") != "", F.col("unit")).when(single, F.col("sentences")[0]).otherwise(F.col("whole")))
    repeated = F.col("repeated") & F.col("unit").rlike(r"\p{L}.*\p{L}") & ~F.col("unit").rlike(r"^(.)\1*$|^(?:address|n)(?: (?:address|n))*$")
    kind = (
        F.when(_holds("certain") & _any("said", CERTAIN), "placeholder")
        .when(_holds("unset") & _any("said", UNSET), "unset")
        .when(filler | _holds("standings") & _any("low", STANDINGS), "filler")
        .when(repeated, "repeated")
        .when(_holds("messages") & _any("low", MESSAGES), "message")
        .when(_holds("status") & _any("low", STATUS), "status")
        .when(_holds("doubtful") & _any("said", DOUBTFUL), "doubtful")
    )
    return _once(lines, "kind", kind).drop("low", "whole", "raw", "cues", "repeated")


def _recurring(sentences: DataFrame) -> DataFrame:
    """(hash, s): the normalised sentences that come from several sources, one example each.

    The sources of a sentence are made distinct before it is counted, so that one
    that fills a third of all rows leaves few rows a task.
    """
    spread_out = sentences.select("hash", "source").distinct().groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= SOURCES).select("hash")
    return sentences.select("hash", "s").join(spread_out, "hash", "left_semi").groupBy("hash").agg(F.min("s").alias("s"))


def _like_messages(sentences: DataFrame, groups: DataFrame) -> DataFrame:
    """(hash) of the recurring sentences whose words are those of the messages found by rule.

    Every word weighs the logarithm of its share among the messages' sentences
    over its share among all; an unknown word speaks against.  Two words are too
    few to tell.  Counts are over all documents.
    """
    words = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))).alias("word"))
    sizes = sentences.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("message").cast("bigint")), F.lit(0)).alias("m"))
    counts = words(sentences, "message").groupBy("word").agg(F.count("*").alias("in_all"), F.sum(F.col("message").cast("bigint")).alias("in_messages"))
    asked = words(groups, "hash")
    share = F.col("in_all") / F.col("n")
    weight = F.log((F.col("in_messages") + SHRINK * share) / (F.col("m") + SHRINK) / share)
    weighed = asked.join(counts, "word").crossJoin(F.broadcast(sizes)).where("m > 0").groupBy("hash").agg(F.avg(weight).alias("w"), F.count("*").alias("words"))
    return weighed.where("w > 0 and words > 2").select("hash")


def _told(flagged: DataFrame) -> DataFrame:
    """(doc_id, line) of placeholders that are only spoken about: the words around them recur, they don't vary."""
    place = "|".join(p.replace("(?i)", "").replace(f"({NAME})", f"(?:{NAME})") for p in CERTAIN)
    around = rf"(?i)(?<!\S)((?:\p{{L}}+ ){{{FRAME}}})({place})((?: \p{{L}}+){{{FRAME}}})(?!\S)"
    lists = [F.regexp_extract_all("said", F.lit(around), F.lit(k)) for k in (1, 2, 3)]
    frames = flagged.where("kind = 'placeholder'").select("doc_id", "source", "said", F.explode(F.arrays_zip(*(x.alias(n) for x, n in zip(lists, ("a", "p", "b"))))).alias("f"))
    frames = frames.select("doc_id", "source", "said", F.lower(F.concat("f.a", F.lit("_"), "f.b")).alias("frame"), F.lower("f.p").alias("place"))
    fixed = frames.groupBy("frame").agg(F.countDistinct("source").alias("sources"), F.countDistinct(F.xxhash64("said")).alias("lines"), F.min("place").alias("least"), F.max("place").alias("most"))
    fixed = fixed.where((F.col("sources") >= SOURCES) & (F.col("lines") >= SOURCES) & (F.col("least") == F.col("most"))).select("frame")
    held = F.size(F.regexp_extract_all("said", F.lit(f"(?i){place}"), F.lit(0)))
    told = frames.join(fixed, "frame", "left_semi").groupBy("doc_id", "said").agg(F.count("*").alias("n"))
    return told.where(F.col("n") >= held).select("doc_id", "said")


def residue_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, kind, line): the lines with residue of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text")).where("text is not null and trim(text) <> ''")
    lines = rows.select("doc_id", "source", F.explode(F.split("text", r"[\r\n\u2028\u2029]+")).alias("line")).where(F.trim("line") != "")
    lines = _classified(lines)
    sentences = F.array_distinct(F.filter("sentences", lambda x: F.octet_length(F.translate(x, " N", "")) >= LEAST_BYTES))
    unit = F.when(F.col("unit") != "", F.xxhash64(F.trim(F.regexp_replace("unit", r"[^\p{L}]+", " "))))
    flagged = F.col("kind").isNotNull()
    marked = cut(lines.select("doc_id", "source", "kind", F.when(flagged, F.col("line")).alias("line"), F.when(flagged, F.col("said")).alias("said"), unit.alias("unit"), sentences.alias("sentences")))
    return _found(marked)


def _found(marked: DataFrame) -> DataFrame:
    """(doc_id, kind, line) from the lines of ``residue_lines`` with their kinds and normalised sentences."""
    flagged = marked.where("kind is not null")
    # sentences that speak about such things can't be residue: their lines are looked at again without them
    speaks = flagged.where(F.col("line").rlike(rf"(?i)\b(?:{THINGS})\b") & F.col("line").rlike(rf"(?i)\b(?:{SAYING})\b"))
    sentence = r"[^.!?。！？।॥]*"
    about = rf"(?i)(?:^|(?<=[.!?。！？।॥]))(?={sentence}\b(?:{THINGS})\b)(?={sentence}\b(?:{SAYING})\b){sentence}"
    columns = ("doc_id", "source", "kind", "said", "unit")
    again = _classified(speaks.select("doc_id", "source", F.regexp_replace("line", about, " ").alias("line"))).where("kind is not null")
    again = again.select("doc_id", "source", "kind", "said", F.xxhash64(F.trim(F.regexp_replace("unit", r"[^\p{L}]+", " "))).alias("unit"))
    straight = flagged.where(~(F.col("line").rlike(rf"(?i)\b(?:{THINGS})\b") & F.col("line").rlike(rf"(?i)\b(?:{SAYING})\b")))
    flagged = cut(straight.select(*columns).unionByName(again.select(*columns)))
    # exact sentences of all documents, grouped across sources and classified as groups
    sentences = marked.select("doc_id", "source", F.coalesce(F.col("kind") == "message", F.lit(False)).alias("message"), F.explode("sentences").alias("s")).withColumn("hash", F.xxhash64("s"))
    groups = cut(_recurring(sentences))
    status = groups.where(_any("s", tuple(p.replace(r"[1-5]\d\d", "N").replace(r"\d{3}", "N") for p in STATUS))).select("hash")
    messages = groups.where(_any("s", MESSAGES)).select("hash")
    alike = status.unionByName(messages).unionByName(_like_messages(sentences, groups)).distinct()
    recurring = sentences.join(alike, "hash", "left_semi").select("doc_id", F.lit("recurring").alias("kind"), F.col("s").alias("line"))
    out = lambda df, kind=F.col("kind"): df.select("doc_id", kind.alias("kind"), F.col("said").alias("line"))
    # a status may be words of the text, unlike a message; it counts with a code or if it recurs across sources
    coded = F.col("said").rlike(r"\p{N}{3}|(?i)access denied|server error")
    plain = flagged.where("kind not in ('status', 'doubtful', 'placeholder')")
    places = flagged.where("kind = 'placeholder'").join(_told(flagged), ["doc_id", "said"], "left_anti")
    found = out(plain).unionByName(out(places)).unionByName(out(flagged.where("kind = 'status'").where(coded))).unionByName(recurring)
    units = flagged.where("kind = 'repeated'").select("unit").distinct()
    found = found.unionByName(marked.where("kind is null and unit is not null").join(units, "unit", "left_semi").select("doc_id", F.lit("filler").alias("kind"), F.lit(None).cast("string").alias("line")))

    def names(patterns: tuple[str, ...]) -> Column:
        lists = (F.transform(F.regexp_extract_all("said", F.lit(p), F.lit(1)), lambda x: F.regexp_replace(F.lower(x), "[._ ]+", "_")) for p in patterns)
        return F.explode(F.array_distinct(F.concat(*lists))).alias("name")

    # placeholders in doubtful spellings count with a name that was learned from the certain ones
    certain = flagged.where("kind = 'placeholder'").select("source", names(CERTAIN)).where("name <> ''")
    learned = certain.distinct().groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= NAME_SOURCES).select("name")
    doubtful = flagged.where("kind = 'doubtful'")
    plain = doubtful.select("doc_id", "said", names(DOUBTFUL[:2] + DOUBTFUL[3:]))
    raw = doubtful.select("doc_id", "said", names(DOUBTFUL[2:3])).where(~F.col("name").isin(MARKUP_NAMES))
    filled = plain.unionByName(raw).join(learned, "name", "left_semi")
    return found.unionByName(out(filled, F.lit("placeholder")))


def p8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with residue, and of each how many lines of which kinds."""
    found = residue_lines(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")))
    return found.distinct().groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.count("*").alias("lines"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of the documents to exclude."""
    return residue_lines(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))).select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p8_found": p8_found, "p8_lines": p8_lines}
ORACLE: dict[str, str] = {}
