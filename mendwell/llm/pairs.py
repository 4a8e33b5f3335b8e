"""Question-answer pairs with a defect: empty, truncated, refusal, copied, or wrong language.

Every answer is read once into its clean text. What a pair shows by itself (nothing left, a copy of the question, only
refusing sentences, another language) is decided there. Whether an answer without a final stop breaks off is decided by its neighbours in
the sorted corpus: the complete sentences of all answers are sorted from each of their words on, and the answer's tails (its last
words, one to ``WINDOW`` of them) are looked up among them. The longest tail that is a common prefix with its neighbour decides:
if the neighbour ends there, others end so too and the answer is whole; if every neighbour goes on, inside the word or
behind it, the answer is a shortened version. A tail without any neighbour ends in a word that the corpus doesn't have, and breaks off too; so
does an open bracket. Lengths at which endless answers pile up beyond what the lengths around them let expect are a length limit: there, an
answer is whole only if its whole last sentence is known.

Sorting is by ranges, as many as the rows ask for, each read once in order; what follows a range's last row is the
first row of a later one, known from one row a range.

Languages are told by words. Their rates are counted over all questions and answers that a few fixed function words label, and met
by the words of each text in a join: the vocabulary may have any size. Rates are whole numbers, so that no order of adding matters.

Defined results
    * null or blank questions: no row. Null, empty and blank answers: 'empty'.
    * a pair has one defect at most, the first of: empty, copied, refusal, wrong_language, truncated.
    * ties don't arise: repeated rows are judged alike. An empty table gives no rows; other columns are ignored.
    * questions or answers whose language can't be told are never 'wrong_language'.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import cut, spread
from . import markup

#: Fixed values of this operator: a few function words by language, what stands for nothing, and sentences that decline.
FUNCTION_WORDS = {
    "en": ("the", "and", "is", "are", "it", "of", "to", "my", "with", "when", "this", "that", "not", "what", "how", "from", "has", "have", "since", "after"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "seit", "auf", "ich", "mein", "wird", "nach", "bei", "den", "dem", "zu", "wie"),
    "fr": ("le", "les", "et", "est", "des", "du", "une", "pas", "mon", "dans", "depuis", "sur", "pour", "qui", "au", "ce", "ne", "avec", "après", "la"),
    "es": ("el", "los", "y", "es", "del", "una", "no", "mi", "en", "desde", "por", "para", "que", "con", "las", "se", "al", "después", "hay", "la"),
}
NOTHING = {"na", "none", "null", "nil", "nan", "tbd", "todo", "empty", "ninguno", "nichts", "rien", "undefined", "noanswer", "keine"}
DECLINES = re.compile(
    r"\b(?:can(?:'t|not|\s+not)|(?:am|are|is|'m|'re)\s+(?:not\s+able|unable|not\s+allowed)|won't\s+be\s+able|not\s+be\s+able|must\s+decline|no\s+assistance|no\s+help)\b.{0,40}\b(?:help|answer|assist|assistance|offered|discuss|guidance|request|question|topic|here|this|that)\b"
    r"|\bdecline to\b|\bkeine?\s+(?:hilfe|auskunft|antwort)\b|\bnicht\s+(?:beantworten|weiterhelfen|helfen|besprechen|behandeln|möglich)\b|\bablehnen\b"
    r"|\bne\s+(?:peux|puis|peut|saurais)\s+(?:pas\s+)?.{0,12}(?:répondre|aider|traiter|parler|fournir)|\bimpossible\s+d'aider\b|\brefuser\s+d'en\s+parler\b|\baucune\s+aide\b"
    r"|\bno\s+(?:puedo|podemos|me es posible|es posible|soy capaz de)\s+.{0,12}(?:ayudar|responder|contestar|tratar|hablar|ofrecer|dar)|\b(?:debo|tengo que)\s+negarme\b|\bninguna\s+ayuda\b|\bimposible\s+ayudar\b",
    re.I | re.S,
)
CLOSES = re.compile(
    r"\banything else\b|\brephrase\b|\bspecialist\b|\bmay talk about\b|\bfalls outside\b|\banders\s+(?:fragen|formulieren)\b|\bfachkraft\b|\bsonst noch\b|\bnoch etwas\b|\bau(?:ss|ß)erhalb\b|\breformul|\bspécialiste\b|\bautre chose\b|\ben dehors\b|\bhors de\b|\bespecialista\b|\balgo más\b|\botra cosa\b|\bfuera de\b"
    r"|^(?:i'm |i am )?sorry\W*$|^apologies\W*$|^unfortunately\W*$|^thank you(?: for asking)?\W*$",
    re.I,
)
#: What shows that a sentence goes on to answer after it declined.
GOES_ON = re.compile(r",\s*(?:so|but|yet|however|daher|deshalb|aber|donc|mais|así que|pero)\b", re.I)
#: Words before a copied question that are a lead-in still.
LEAD_WORDS = 6
#: Words of the longest tail that is compared.
WINDOW = 6
#: A length is a limit if endless answers have it this many standard deviations beyond what the lengths so far around it let expect.
SPIKE, SPIKE_REACH = 6.0, 10
#: Rows of one sort range.
RANGE_ROWS = 1_000_000
#: How much likelier (natural logarithm) a language must be than the next; parts of one that rates are rounded to.
LEADS, GRID = 3.0, 10**9
#: Texts that each function word counts as in its language, beside those that have it.
GIVEN = 5
#: Words' rates that are sent to all executors (about 100 bytes each); more are joined by a shuffle.
SENT_WORDS = 300_000
#: Rate of a word under which it tells nothing of a language, so that few texts of one don't make it likelier than another.
RARE = 1e-3
_END = "\x01"  # sorts before a space and all letters

_QUOTES, _SPACE, _NUMBER = dict.fromkeys(map(ord, '"“”«»')), re.compile(r"[\s\u00a0\u200b]+"), re.compile(r"\b\w*\d\w*\b")
_WORDS, _NO_LETTERS = re.compile(r"[^\W\d_]+"), re.compile(r"[\W_]+")
_BLANK_LINES, _MARK, _FORMULA, _STOP = re.compile(r"\n{2,}"), re.compile(r"^(?:#|-)\s+"), re.compile(r"\$[^$\n]*\$"), re.compile(r"[.!?…][\"'”’»)\]*_`]*\s*$")
_SENTENCE_END, _NUMBERED = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+"), re.compile(r"^[\s\u00a0\u200b\ufeff]*\d+[.)]")
_OF = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in _list:
        _OF.setdefault(_w, []).append(_lang)


def declines(sentence: str) -> bool:
    m = DECLINES.search(sentence)
    return m is not None and not GOES_ON.search(sentence, m.start())


def _parts(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def spoken(words: list[str]) -> str | None:
    """The language that a text's function words are of clearly."""
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in words:
        for lang in _OF.get(w, ()):
            score[lang] += 1 / len(_OF[w])
    (best, most), (_, next_most) = sorted(score.items(), key=lambda x: -x[1])[:2]
    return best if most >= 2 and most >= 2 * next_most else None


def log_rates(counts: np.ndarray, sizes: list[int]) -> np.ndarray:
    """By word its log rate in each language over its mean log rate, in parts of ``GRID``. counts: texts by word and language; sizes: their sums."""
    logs = np.log(np.maximum(counts - 1, 0) / np.array(sizes) + RARE)  # one text alone tells nothing
    return np.rint((logs - logs.mean(1, keepdims=True)) * GRID).astype(np.int64)


def fit(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """The words and their rates, as ``word_rates`` has them, of a few texts at hand."""
    counts = {lang: Counter(dict.fromkeys(words, GIVEN)) for lang, words in FUNCTION_WORDS.items()}
    for words in map(_parts, texts):
        if lang := spoken(words):
            counts[lang].update(set(words))
    words = sorted(set().union(*counts.values()))
    return {w: i for i, w in enumerate(words)}, log_rates(np.array([[c[w] for c in counts.values()] for w in words]), [sum(c.values()) for c in counts.values()])


_FIXED: list[tuple[dict[str, int], np.ndarray]] = []


def language(text: str, rates: tuple[dict[str, int], np.ndarray] | None = None) -> str | None:
    """The language that leads clearly by the words of a text, as ``foreign`` tells it; None where none does."""
    if rates is None:
        if not _FIXED:
            _FIXED.append(fit([]))
        rates = _FIXED[0]
    get = rates[0].get
    met = [i for w in _parts(text) if (i := get(w)) is not None]
    if len(met) < 2:
        return None
    score = rates[1].take(met, 0).sum(0).tolist()
    most, next_most = sorted(score)[: -3 : -1]
    return tuple(FUNCTION_WORDS)[score.index(most)] if most >= next_most + LEADS * GRID else None


def fold(text: str) -> str:
    return _NO_LETTERS.sub("", text.upper().lower())


_LABEL = r"[^\W\d_]+(?:[ _-][^\W\d_]+){0,2}"
_FIELD = re.compile(rf"(?:^[^\w]*|[;|\n]+[^\w]*)({_LABEL})\s*[:=]")


def fields(text: str) -> list[str] | None:
    """The folded fields of a form, sorted; None where a text is none."""
    marks = list(_FIELD.finditer(text))
    if len(marks) < 2 or text[: marks[0].start(1)].strip(" \t\n\"'“”«»(*#-"):
        return None
    ends = [m.start() for m in marks[1:]] + [len(text)]
    return sorted(fold(m.group(1)) + "=" + fold(text[m.end() : e]) for m, e in zip(marks, ends))


def copied(question: str, lines: list[str], marks: list[bool], folded: str) -> bool:
    """Nothing beyond the question, once or repeated, and at most a heading or a short lead-in. marks: which lines are headings; folded: the whole answer."""
    question = _NUMBERED.sub("", question)
    q, form = fold(question), fields(question)
    if not q or q not in folded and (form is None or not all(x.replace("=", "", 1) in folded for x in form)):
        return False
    body = [x for x, heading in zip(lines, marks) if not heading and x.strip()]
    text = "\n".join(body)
    if form is not None:
        parts = [x.replace("=", "", 1) for x in form]
        copies = re.fullmatch("(.*?)((?:" + "|".join(sorted(map(re.escape, parts), key=len, reverse=True)) + ")+)", a := fold(text))
        if copies and all(x in copies[2] for x in parts) and _words_of(text, len(copies[1])) <= LEAD_WORDS:
            return True
    a = fold(text)
    if q not in a:
        return False
    lead, rest = a[: a.find(q)], a[a.find(q) :]
    if rest.replace(q, ""):
        again = rest.replace(q, "\x00").split("\x00")
        if any(x and x != lead for x in again):
            return False
    if not lead:
        return True
    return _words_of(text, len(lead)) <= LEAD_WORDS


def _words_of(text: str, letters: int) -> int:
    """In how many words of a text its first so many letters stand."""
    n, held = 0, 0
    for w in re.findall(r"\w+", text) if letters else ():
        held += len(fold(w))
        n += 1
        if held >= letters:
            break
    return n


def sentences(line: str) -> list[str]:
    return [x for x in _SENTENCE_END.split(line) if x.strip()]


@lru_cache(100_000)
def unit(sentence: str) -> str:
    """A sentence for comparison: folded case and spaces, numbers alike, without its final stop."""
    s = _SPACE.sub(" ", sentence.lower().translate(_QUOTES)).strip(" '*_`>")
    return _NUMBER.sub("0", s.rstrip(".!?…;: \"'”’)]"))


def read(question: str | None, answer: str | None) -> tuple[str | None, str | None, bool, bool, int, list[str], list[str]]:
    """(defect but for wrong_language, last sentence, it has an end, a bracket is open, length, complete sentences, words of the answer) of one pair."""
    asked = question is not None and bool(fold(question))
    text = _BLANK_LINES.sub("\n", markup.clean(answer)[0]).strip()
    folded = fold(text)
    if not folded or folded in NOTHING:
        return ("empty" if asked else None), None, True, False, 0, [], []
    lines, fenced = [], False
    for x in text.split("\n"):
        if x.startswith("```"):
            fenced = not fenced
            lines.append("```")
        elif not fenced:
            lines.append(x)
    prose = [x for x in lines if x != "```" and not (x[:1] == "$" and re.fullmatch(r"\$[^$]*\$", x))]
    heads = [x.startswith("# ") for x in prose]
    bare = [_MARK.sub("", x) if x[:1] in ("#", "-") else x for x in prose]
    defect, split = None, [sentences(x) for x in bare]
    if asked:
        said = [s for x, h in zip(split, heads) if not h for s in x]
        if said and not declines(said[0]) and len(said[0].split()) <= LEAD_WORDS and len(said) > 1 and not re.search(r"[.!?]$", said[0].strip()):
            said = said[1:]  # an unmarked heading
        if copied(question, bare, heads, folded):
            defect = "copied"
        elif "```" not in lines and said and any(map(declines, said)) and all(declines(s) or CLOSES.search(s) for s in said):
            defect = "refusal"
    last, end, opened, complete = None, True, False, []
    for i, (x, parts) in enumerate(zip(bare, split)):
        final = i == len(bare) - 1 and lines[-1] == prose[-1]
        for k, s in enumerate(parts):
            if final and k == len(parts) - 1:
                end = bool(_STOP.search(s)) or s.endswith("$")
                opened = not end and x.count("(") + x.count("[") > x.count(")") + x.count("]")
                last = unit(s)
                if not end:
                    continue
            if u := unit(s):
                complete.append(u)
    return defect, last, end, opened, len(answer or ""), complete, _parts(_FORMULA.sub(" ", " ".join(bare)))


def _parsed(df: DataFrame, key: str, question: str, answer: str) -> DataFrame:
    kind = df.schema[key].dataType
    names = [key, "asked", "defect", "last", "has_end", "open", "n", "complete", "says", "asks", "says_in", "asks_in"]

    def work(batches):
        for batch in batches:
            questions, answers = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = []
            for q, a in zip(questions, answers):
                *found, says = read(q, a)
                asks = _parts(q or "")
                rows.append((q is not None and bool(fold(q)), *found, " ".join(says), " ".join(asks), spoken(says), spoken(asks)))
            cols = list(zip(*rows)) if rows else [[]] * 11
            types = [pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.list_(pa.string()), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    parsed = spread(df.select(F.col(key), F.col(question), F.col(answer))).mapInArrow(
        work, f"`{key}` {kind.simpleString()}, asked boolean, defect string, last string, has_end boolean, open boolean, n int, complete array<string>, says string, asks string, says_in string, asks_in string"
    )
    return parsed.withColumn("row", F.monotonically_increasing_id())


def word_rates(texts: DataFrame) -> DataFrame:
    """(word, its rate in each language) of all words of texts (words, lang) whose language is clear."""
    given = texts.sparkSession.createDataFrame([(w, lang, GIVEN) for lang, words in FUNCTION_WORDS.items() for w in words], "word string, lang string, n int")
    said = texts.filter("lang IS NOT NULL").select(F.explode(F.array_distinct(F.split("words", " "))).alias("word"), "lang", F.lit(1).alias("n"))
    by_lang = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(x) for x in FUNCTION_WORDS]
    counts = cut(said.unionByName(given).groupBy("word").agg(*by_lang))
    n, *sizes = counts.agg(F.count("*"), *map(F.sum, FUNCTION_WORDS)).first()

    def work(batches):
        for batch in batches:
            rates = log_rates(np.column_stack([batch.column(i).to_numpy() for i in range(1, 1 + len(sizes))]), sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rates.T)], names=batch.schema.names)

    rates = counts.mapInArrow(work, counts.schema)
    return F.broadcast(rates) if n <= SENT_WORDS else rates


def foreign(pairs: DataFrame) -> DataFrame:
    """(row) of the pairs without another defect whose question and answer lead clearly in two languages."""
    sides = F.inline(F.array(*(F.struct(F.lit(x).alias("side"), F.col(x).alias("words"), F.col(x + "_in").alias("lang")) for x in ("asks", "says"))))
    rates = word_rates(pairs.select(sides))
    met = pairs.filter("asked AND defect IS NULL").select("row", sides).select("row", "side", F.explode(F.split("words", " ")).alias("word")).join(rates, "word")
    scores = met.groupBy("row", "side").agg(F.count("*").alias("met"), F.array(*map(F.sum, FUNCTION_WORDS)).alias("score"))
    most, next_most = F.array_max("score"), F.sort_array("score", False)[1]
    told = scores.filter((F.col("met") >= 2) & (most >= next_most + int(LEADS * GRID))).select("row", F.array_position("score", most).alias("lang"))
    return told.groupBy("row").agg(F.min("lang").alias("a"), F.max("lang").alias("b")).filter("a <> b").select("row")


def neighbours(units: DataFrame) -> DataFrame:
    """Of (unit, wanted), each wanted unit with the next one in sort order that isn't wanted (null for none)."""
    n = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-units.count() // RANGE_ROWS))

    def scan(batches):
        """Rows of wanted units, and one of the range's first other unit."""
        range_no = TaskContext.get().partitionId()
        waiting: list[str] = []
        first = None
        for batch in batches:
            out: list[tuple[str | None, str | None]] = []
            for unit, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if wanted:
                    waiting.append(unit)
                    continue
                if first is None:
                    first = unit
                if waiting:
                    out += [(w, unit) for w in waiting]
                    waiting = []
            yield rows(out, range_no)
        yield rows([*((w, None) for w in waiting), (None, first)], range_no)

    def rows(out, range_no):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string()), pa.array([range_no] * len(out), pa.int32())], names=["unit", "next_unit", "range_no"])

    found = cut(units.repartitionByRange(n, "unit", "wanted").sortWithinPartitions("unit").select("unit", "wanted").mapInArrow(scan, "unit string, next_unit string, range_no int"))
    later = Window.partitionBy(F.lit(1)).orderBy("range_no").rowsBetween(1, Window.unboundedFollowing)  # over one row a range
    after = found.filter("unit IS NULL").select("range_no", F.first("next_unit", ignorenulls=True).over(later).alias("later_unit"))
    return found.filter("unit IS NOT NULL").join(after, "range_no").select("unit", F.coalesce("next_unit", "later_unit").alias("next_unit"))


def judged(wanted: DataFrame, complete: DataFrame) -> DataFrame:
    """(last, breaks, whole) of each last sentence in wanted (last): whether it is a shortened version; whether complete (unit) has it as it is."""
    words = F.split("unit", " ")
    windows = F.transform(F.sequence(F.lit(1), F.size("ws")), lambda i: F.concat(F.array_join(F.slice("ws", i, WINDOW), " "), F.when(i + WINDOW > F.size("ws"), F.lit(_END)).otherwise(F.lit(" "))))
    others = complete.select(words.alias("ws")).select(F.explode(windows).alias("unit")).groupBy("unit").agg(F.lit(False).alias("wanted"))
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size("ws"), F.lit(WINDOW))), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("ws", F.size("ws") - k + 1, k), " ").alias("unit")))
    asked = cut(wanted.select("last", F.split("last", " ").alias("ws")).select("last", F.inline(tails)))
    near = neighbours(cut(others.unionByName(asked.select("unit").distinct().withColumn("wanted", F.lit(True)))))
    ends, goes_on = F.col("next_unit") == F.concat("unit", F.lit(_END)), F.coalesce(F.startswith("next_unit", "unit"), F.lit(False))
    verdict = asked.join(near, "unit").groupBy("last").agg(F.coalesce(F.max_by(~ends, F.when(goes_on, F.col("k"))), F.lit(True)).alias("breaks"))
    whole = complete.select(F.col("unit").alias("last"), F.lit(True).alias("whole"))
    return verdict.join(whole, "last", "left").select("last", "breaks", F.coalesce("whole", F.lit(False)).alias("whole"))


def limits(lengths: DataFrame) -> DataFrame:
    """(n) of the lengths at which different endless answers pile up. lengths: (n, last)."""
    each = lengths.groupBy("n").agg(F.countDistinct("last").alias("c"))
    around = each.select(F.explode(F.sequence(F.col("n") - SPIKE_REACH, F.col("n") + SPIKE_REACH)).alias("n"), "c").groupBy("n").agg(F.sum("c").alias("around"))
    expected = (F.col("around") - F.col("c")) / (2 * SPIKE_REACH)
    return each.join(around, "n").filter(F.col("c") >= expected + SPIKE * F.sqrt(expected + 1)).select("n")


def defects(df: DataFrame, key: str, question: str, answer: str) -> DataFrame:
    """(key, defect) of every pair that has one."""
    pairs = cut(_parsed(df, key, question, answer))
    complete = pairs.select(F.explode("complete").alias("unit")).distinct()
    other = cut(foreign(pairs))
    endless = pairs.filter("asked AND defect IS NULL AND NOT has_end AND last IS NOT NULL").join(other, "row", "left_anti")
    verdict = judged(endless.select("last").distinct(), complete)
    at_limit = limits(endless).withColumn("at_limit", F.lit(True))
    broken = endless.join(verdict, "last").join(at_limit, "n", "left").filter(F.col("open") | F.col("breaks") | (F.col("at_limit").isNotNull() & ~F.col("whole")))
    shown = pairs.filter("asked AND defect IS NOT NULL").select(key, "defect").unionByName(pairs.join(other, "row", "left_semi").select(key, F.lit("wrong_language").alias("defect")))
    return shown.unionByName(broken.select(key, F.lit("truncated").alias("defect")))
