"""Subject areas of documents, by label propagation over a graph of documents with verified similar passages.

A document is a row of passages, its sentences. Two documents are neighbours where passages of theirs have a stretch of five
words in common (shorter passages: the whole passage). The stretch is the centre of a star that stands for all pairs of its
documents, so the edges grow with the text and not with its square, and each edge knows the passage it hangs on: a document of
several subjects is linked to others by each of them apart. An edge is verified twice: stretches met by one hash are
compared by a second, independent one, and a stretch carries a subject only if at least half of what its documents say for it (by
rate, so that small subjects aren't swallowed by large ones they go with) is for that subject. Stretches of no subject (courtesies, times,
devices) link nothing.

Labels spread in rounds of DataFrame joins, from the seeds on:

    down: documents -> passages without a subject -> stretches: mass by subject; seeds give their labels in every round
        (clamped), other documents the shares found so far;
    up: stretches -> passages -> documents: evidence by subject, the passage's subject where one leads clearly, and shares.

A passage keeps the subject it got, and later rounds look only at those that have none, so each round costs what is
still open, and the rounds end by themselves when one finds nothing new.

A document keeps every subject with at least a quarter of its sentences that speak of any. A seed keeps exactly its labels, unless
it is refuted: its own passages were given subjects, and one of its labels to none of them.

Defined results
    * null, empty and blank texts, documents that speak of no subject, and null ids: no rows.
    * labels of unknown documents or subjects are passed over; a document's several labels share its mass; refuted seeds get what was found.
    * ties of a passage go to the subject that is first by name. Equal rows of a document count once; different texts under
      one id count as one document with all their sentences.
    * no labels, no subjects or no documents: an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import regex
import unicodedata
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import cut, spread

#: Share of a document's sentences that makes a subject; words of a stretch.
SHARE, STRETCH = 0.25, 5
#: A stretch carries a subject if it has so much of its rate over the subjects (mass by the subject's whole mass), after so much mass of the whole corpus was mixed in.
PURE, MIXED = 0.5, 1.0
#: A passage's subject leads with this evidence (1: one stretch of one subject alone; 0: chance), and so many times all others.
LEADS, TIMES = 0.87, 1.5
#: Sentences of no subject that every document is taken to have besides, so that one doubtful sentence tells little of it.
DOUBT = 2.0
#: Rows of a side that is sent to all executors (about 48 bytes each); a longer one is joined by a shuffle.
SENT_ROWS = 1_000_000
#: Words whose hashes a worker remembers; it forgets them beyond, which costs time only.
WORDS = 1_000_000
#: Texts that a worker reads at once.
TEXTS = 1_000

_TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*>")
_WRAPPED = re.compile(r"\n\s*>?\s*(?=[a-z])(?!\w+:\s)")
_SPEAKER = re.compile(r"^[^\S\n]*[a-z]+:\s+(?=\S)", re.M)
_MARKS = regex.compile(r"\p{M}+")
_NO_WORD, _DIGIT, _ENDS = re.compile(r"[\W_]+"), re.compile(r"\d"), re.compile(r"[.!?]\W*$")
#: Odd multipliers of a stretch's words, for the hash that stretches meet by and for the one that verifies.
_FACTORS = np.random.default_rng(20240611).integers(1, 2**63, (2, STRETCH), dtype=np.uint64) | np.uint64(1)


def chunks(text: str) -> list[str]:
    """What stands between the spaces of a text; line ends are chunks of their own."""
    if "<" in text or "&" in text:
        text = html.unescape(_TAG.sub(" ", text))
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _SPEAKER.sub("", _WRAPPED.sub(" ", text)).lower().replace("\n", " \0 ").split()  # wrapped lines go on with a small letter


def word(chunk: str) -> tuple[str, bool]:
    """The folded word of a chunk ('' for none) and whether a sentence ends behind it; numbers and names with numbers are alike."""
    w = _NO_WORD.sub("", chunk)
    return ("0" if _DIGIT.search(w) else w), chunk == "\0" or bool(_ENDS.search(chunk))


def sentences(text: str) -> list[list[str]]:
    """The sentences of a text as folded words."""
    out: list[list[str]] = [[]]
    for w, ends in map(word, chunks(text)):
        if w:
            out[-1].append(w)
        if ends:
            out.append([])
    return [s for s in out if s]


def stretches(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of word hashes with 0 at sentence ends, and their texts: each passage's text, its number there, where its stretches end, and their two hashes."""
    line = np.append(words, np.zeros(STRETCH, np.uint64))
    ends = np.flatnonzero(line == 0)
    is_word = words != 0
    first = is_word & np.concatenate([[True], ~is_word[:-1]])[: len(words)]
    starts = np.flatnonzero(first)
    length = ends[np.searchsorted(ends, starts)] - starts
    n = np.maximum(length - STRETCH + 1, 1)
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(starts - bounds[:-1], n) + np.arange(bounds[-1])
    short = np.repeat(length, n) if (length < STRETCH).any() else None
    hashes = np.zeros((2, len(at)), np.uint64)
    for j in range(STRETCH):
        w = line[at + j]
        if short is not None:
            w[short <= j] = 0
        hashes += w * _FACTORS[:, j : j + 1]
    hashes ^= hashes >> np.uint64(29)
    of = text[starts]
    return of, np.arange(len(starts)) - np.searchsorted(of, of), bounds, hashes[0].view(np.int64), hashes[1].view(np.int64)


def passages(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """(doc, more, passage, links): each sentence under a number that holds wherever it is read, with the stretches it is linked by."""
    fields = docs.select(F.col(key).alias("doc"), *more).schema

    def work(batches):
        known: dict[str, int] = {}
        hashes: list[int] = []  # a word, 0 for what is none
        ends: list[bool] = []
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            texts = batch.column(1).to_pylist()
            if len(known) > WORDS:
                known.clear(), hashes.clear(), ends.clear()
            rows = [chunks(t) for t in texts]
            for c in set().union(*rows).difference(known):
                known[c] = len(known)
                w, end = word(c)
                hashes.append((xxhash.xxh3_64_intdigest(w) or 1) if w else 0)
                ends.append(end)
            ids = np.fromiter((known[c] for r in rows for c in r), np.int64)
            text = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            # a word, and behind it a mark where its sentence or text ends
            line, mark = np.array(hashes, np.uint64)[ids], np.array(ends, bool)[ids]
            mark[np.flatnonzero(np.append(np.diff(text), 1))] = True
            both = np.stack([line, np.zeros_like(line)], 1).ravel()
            keep = np.stack([line != 0, mark], 1).ravel()
            of, number, bounds, meet, verify = stretches(both[keep], np.repeat(text, 2)[keep])
            seeds = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64)
            ids = (seeds[of] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            links = pa.StructArray.from_arrays([pa.array(meet), pa.array(verify)], ["meet", "verify"])
            take = pa.array(of)
            kept = [batch.column(i).take(take) for i in (0, *range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), links)], names=[*(f.name for f in fields), "passage", "links"])

    source = docs.select(F.col(key), F.col(text), *more).filter(F.col(key).isNotNull() & (F.length(F.trim(text)) > 0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return spread(source).mapInArrow(work, f"{schema}, passage bigint, links array<struct<meet:bigint,verify:bigint>>")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT_ROWS else df


def _share(n: str, doubt: float = 0.0) -> Column:
    return F.col(n) / (F.sum(n).over(Window.partitionBy("doc")) + doubt)


def _verified(mass: DataFrame, of_subject: DataFrame) -> DataFrame:
    """(at, check, s, w) of the stretches whose documents agree on a subject."""
    summed = mass.groupBy("meet", "verify", "s").agg(F.sum("m").alias("m"))
    rates = summed.join(of_subject, "s").withColumn("rate", F.col("m") / F.col("of_s"))
    top = rates.groupBy("meet", "verify").agg(F.max("rate").alias("most"), _first("rate").alias("s"), F.sum("rate").alias("all"), F.max("base").alias("base"), F.max("k").alias("k"))
    p = (F.col("base") + F.col("most")) / (F.col("all") + F.col("k") * F.col("base"))
    weight = F.when(F.col("k") == 1, 1.0).otherwise(F.log(F.col("p") * F.col("k")) / F.log("k"))
    return top.withColumn("p", p).filter(F.col("p") >= PURE).select(F.col("meet").alias("at"), F.col("verify").alias("check"), "s", weight.alias("w"))


def _first(of: str) -> Column:
    """The subject with the most, and of equals the first by name; a difference this small is none."""
    return F.max_by("s", F.col(of) * (1 - F.col("s") * 1e-12))


def _judged(links: DataFrame, verified: DataFrame, how: str, *of: str) -> DataFrame:
    """(of, s) of passages; s is null where no subject leads."""
    # joined on one number, which is the cheapest key; the other is compared where that agrees
    met = links.join(verified, F.expr("meet = at AND (verify ^ check) = 0"), how)
    evidence = met.groupBy(*of, "s").agg(F.sum("w").alias("w"))
    best = evidence.groupBy(*of).agg(F.max("w").alias("most"), _first("w").alias("s"), F.sum("w").alias("all"))
    return best.select(*of, F.when((F.col("most") >= LEADS) & (F.col("most") >= TIMES * (F.col("all") - F.col("most"))), F.col("s")).alias("s"))


def assign(docs: DataFrame, key: str, text: str, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(key, subject) of every document that has one. labels: (key, subject); subjects: (subject)."""
    every = Window.partitionBy(F.lit(1))  # over one row a subject
    names = cut(subjects.select("subject").filter("subject IS NOT NULL").distinct().withColumn("s", F.row_number().over(every.orderBy("subject")) - 1))
    n_names = names.count()
    named = labels.select(F.col(key).alias("doc"), "subject").filter("doc IS NOT NULL").distinct().join(_sent(names, n_names), "subject")
    seeds = cut(named.join(docs.select(F.col(key).alias("doc")), "doc", "left_semi").select("doc", "s", (1 / F.count("*").over(Window.partitionBy("doc"))).alias("share")))
    n_seeds = seeds.count()
    if not n_seeds:
        return docs.select(F.col(key), F.lit("").alias("subject")).limit(0)
    exploded = lambda p: p.select(*(c for c in p.columns if c != "links"), F.inline("links"))

    labelled = docs.select(F.col(key), F.col(text)).join(_sent(seeds.groupBy(F.col("doc").alias(key)).agg(F.collect_list(F.struct("s", "share")).alias("said")), n_seeds), key)
    said = exploded(passages(labelled, key, text, "said")).select("meet", "verify", F.inline("said"))
    given = cut(said.groupBy("meet", "verify", "s").agg(F.sum("share").alias("m")))  # what the seeds say, in every round
    of_subject = given.groupBy("s").agg(F.sum("m").alias("of_s")).select("s", "of_s", (MIXED / F.sum("of_s").over(every)).alias("base"), F.count("*").over(every).alias("k"))
    of_subject = _sent(cut(of_subject), n_names)

    repeated = bool(docs.groupBy(key).count().filter("count > 1").limit(1).count())
    once = docs.select(F.col(key), F.col(text)).distinct() if repeated else docs
    judged = cut(_judged(exploded(passages(once, key, text)), _sent(_verified(given, of_subject), given.count()), "left", "doc", "passage"))
    counts = cut(judged.filter("s IS NOT NULL").groupBy("doc", "s").agg(F.count("*").alias("n")))
    missed = judged.filter("s IS NULL").select("doc", "passage")
    # passages alike in all their stretches get the same subject, and are one row from here on
    open_ = passages(once, key, text).join(_sent(missed, missed.count()), ["passage", "doc"], "left_semi")
    open_ = cut(open_.withColumn("alike", F.xxhash64("links")).withColumn("too", F.xxhash64(F.lit(1), "links")).groupBy("doc", "alike", "too").agg(F.first("links").alias("links"), F.count("*").alias("n")))
    kinds = cut(open_.groupBy("alike", "too").agg(F.first("links").alias("links")))
    left = open_.select("doc", "alike", "too", "n")
    given = cut(given.join(exploded(kinds).select("meet", "verify").distinct(), ["meet", "verify"], "left_semi"))
    while True:
        # down: what the documents of open passages are about, besides the seeds, which speak in given
        shares = counts.select("doc", "s", _share("n").alias("part"), _share("n", DOUBT).alias("share")).filter(F.col("part") >= SHARE)
        own = shares.join(seeds.select("doc").distinct(), "doc", "left_anti").select("doc", "s", "share")
        told = left.join(own, "doc").groupBy("alike", "too", "s").agg(F.sum(F.col("n") * F.col("share")).alias("m"))
        told = exploded(told.join(kinds, ["alike", "too"])).select("meet", "verify", "s", "m")
        verified = cut(_verified(told.unionByName(given), of_subject))
        # up: the passages that now have a subject
        new = cut(_judged(exploded(kinds), _sent(verified, verified.count()), "inner", "alike", "too").filter("s IS NOT NULL"))
        if not (n_new := new.count()):
            break
        gained = left.join(_sent(new, n_new), ["alike", "too"]).groupBy("doc", "s").agg(F.sum("n").alias("n"))
        counts = cut(counts.unionByName(gained).groupBy("doc", "s").agg(F.sum("n").alias("n")))
        gone = _sent(new.select("alike", "too"), n_new)
        left, kinds = left.join(gone, ["alike", "too"], "left_anti"), cut(kinds.join(gone, ["alike", "too"], "left_anti"))
    kept = counts.select("doc", "s", _share("n").alias("part")).filter(F.col("part") >= SHARE).select("doc", "s")
    spoken = seeds.join(judged.select("doc").distinct(), "doc", "left_semi")  # not of empty documents
    seen = spoken.join(counts, ["doc", "s"], "left").groupBy("doc").agg(F.count_if(F.col("n").isNull()).alias("unseen"))
    refuted = seen.filter("unseen > 0").join(counts.select("doc").distinct(), "doc", "left_semi")
    trusted = spoken.select("doc", "s").join(refuted, "doc", "left_anti")
    rows = kept.join(trusted, "doc", "left_anti").unionByName(trusted)
    return rows.join(_sent(names, n_names), "s").select(F.col("doc").alias(key), "subject")
