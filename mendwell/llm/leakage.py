"""Passages of held-out items inside corpus documents.

A case is a stretch of at least 30 words of an item, in its order, in which up to one word in ten was replaced, added or
left out. Every stretch, however long, holds a part of exactly 30 words with 5 edits at most (all 5 of one of 50 to 59 words
can lie where its parts overlap), so windows of 30 words are looked for and stretches of all lengths verified around them.

Every window of the items and of the documents is walked by shared random bits (CGK): at step j the walk writes the word it
stands on and goes on by the bit drawn for (j, word). Edits then cost few positions of the written walk, and two walks are
brought together by equal words at a few sampled steps (bit sampling). This is repeated over several walks, samples and all
starts of a stretch; ``tests/llm`` measures recall against brute force. What meets is verified exactly: the edit distances
of all stretches of the item to the best part of the document around the place.

A document window goes on the walk only if it has 19 pairs of neighbours that items have too: some window of every case has. Documents never move:
the items' index is sent to them in blocks of bounded size. A document is read and split into words once and meets all blocks of a pass; only items
beyond ``PASS_WORDS`` words ask for another pass.

Defined results
    * case, accents, markup, entities, punctuation and spacing don't count; apostrophes and hyphens join their word.
    * null and empty documents or items, and items under 30 words, give no rows. Null ids give none either.
    * repeated rows: a pair of ids comes once per document row; one row for each pair if a passage is held several times.
    * empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..cluster import spread

#: Words of the least stretch, and edits in the best 30 words of any stretch: of n words with n // 10 edits, n // 30 parts
#: share nothing, so one has (n // 10) // (n // 30) at most.
STRETCH, EDITS = 30, 5
#: Length of a walk, walks, samples of each, and steps in a sample.
STEPS, WALKS, SAMPLES, WIDTH = 44, 8, 6, 5
#: Words of items in one block; the index of a block takes about 800 bytes a word.
BLOCK_WORDS = 100_000
#: Words of items that one pass over the documents holds in each worker's memory (some 400 MB).
PASS_WORDS = 500_000
#: Slants (place in the document less place in the item) are verified in steps of this width.
NEAR = 4
SEED = 20240607

_TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_MARK = re.compile(r"[*_`~]+")
_WORD = re.compile(r"[^\W_]+(?:['’\-‐‑][^\W_]+)*")
_JOIN = re.compile(r"['’\-‐‑]")


def words(text: str) -> list[str]:
    """The words of a text that count in a comparison."""
    if "<" in text or "&" in text:
        text = _TAG.sub("", html.unescape(_TAG.sub("", text)))
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = _MARK.sub("", text).lower()
    return [_JOIN.sub("", w) if not w.isalnum() else w for w in _WORD.findall(text)]


def distance(pattern: list, text: list) -> int:
    """The least edit distance of the pattern to any part of the text: one bit of an integer for each word of the pattern."""
    m = len(pattern)
    at: dict = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score = full, 0, m
    best = m
    for w in text:
        eq = at.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best = score
    return best


def holds(item: np.ndarray, text: np.ndarray) -> bool:
    """Whether the text holds a stretch of the item, of any length, that begins and ends with a word in common.

    Its ends are in common if it costs nothing to have them. A quote of fewer words isn't stretched to 30 by
    counting words it never had at its ends as left out.

    The recurrence goes on by a word from all starts at once, and gives the distance of each length on its way.
    """
    m, most = len(item), len(item) // 10
    differs = item[:, None] != text
    ramp = np.arange(len(text) + 1, dtype=np.int16)
    starts = np.arange(m - STRETCH + 2)  # one more, for the inner words of the last one
    rows = np.zeros((len(starts), len(text) + 1), np.int16)
    none = np.full(len(starts) + 1, m + 1, np.int16)
    earlier, last = none, none
    for n in range(1, m + 1):
        inside = starts + n <= m
        if not inside.all():
            starts, rows = starts[inside], rows[inside]
        new = np.empty_like(rows)
        new[:, 0] = n
        np.minimum(rows[:, :-1] + differs[starts + n - 1], rows[:, 1:] + 1, out=new[:, 1:])
        rows = np.minimum.accumulate(new - ramp, axis=1) + ramp
        least = rows.min(1)
        alive = least <= most  # it never falls as the stretch grows
        if not alive.all():
            starts, rows, least = starts[alive], rows[alive], least[alive]
        if not len(starts):
            return False
        best = none.copy()
        best[starts] = least
        if n >= STRETCH and ((best[:-1] <= n // 10) & (best[:-1] == earlier[1:])).any():
            return True
        earlier, last = last, best
    return False


class Index:
    """The items' windows under the sampled steps of every walk."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        rng = np.random.default_rng(SEED)
        self.items = items
        vocabulary = sorted({w for _, ws in items for w in ws})
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        end = len(vocabulary) + 1  # what follows an item is no word of any document
        self.bits = rng.integers(0, 2, (WALKS, STEPS, end + 1), dtype=np.int8)
        edges = np.linspace(0, STEPS, WIDTH + 1).astype(int)  # one step from each part, else a phrase in common use is enough to meet
        self.steps = [[rng.integers(edges[:-1], edges[1:]) for _ in range(SAMPLES)] for _ in range(WALKS)]
        self.factors = rng.integers(1, 2**62, WIDTH, dtype=np.int64) | 1
        self.lines = [[self.ids[w] for w in ws] for _, ws in items]
        self.lengths = np.array([len(ws) for _, ws in items])
        self.grid = np.zeros((len(items), self.lengths.max()), np.int32)
        for x, row in zip(self.lines, self.grid):
            row[: len(x)] = x
        line, owner, start = [], [], []
        places: list[int] = []
        for n, (_, ws) in enumerate(items):
            for i in range(len(ws) - STRETCH // 2):
                places.append(len(line) + i)
                owner.append(n)
                start.append(i)
            line += self.lines[n] + [end] * STEPS
        line = np.array(line, np.int32)
        self.width = end + 1
        self.pairs = np.unique(line[:-1].astype(np.int64) * self.width + line[1:])
        self.owner, self.start = np.array(owner, np.int32), np.array(start, np.int32)
        self.sieve = (1 << (4 * len(places)).bit_length()) - 1  # few keys of documents pass it, so few are searched for
        self.tables = []
        for keys in self.keys(line, np.array(places, np.int64)):
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(self.sieve + 1, bool)
            seen[keys >> 20 & self.sieve] = True
            self.tables.append((keys[order], order.astype(np.int32), seen))

    def keys(self, line: np.ndarray, places: np.ndarray) -> Iterator[np.ndarray]:
        for bits, samples in zip(self.bits, self.steps):
            walk, at = np.empty((STEPS, len(places)), np.int64), places.copy()
            for j in range(STEPS):
                walk[j] = line[at]
                at += bits[j, walk[j]]
            for steps in samples:
                yield sum(walk[j] * f for j, f in zip(steps, self.factors))

    def meetings(self, line: np.ndarray, places: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of (document, item, slant), each once; doc and at: the document of each place and the place in it."""
        reach = (int(at.max(initial=0)) + int(self.start.max(initial=0))) // NEAR + 2
        met = [np.empty(0, np.int64)]
        for (table, order, seen), keys in zip(self.tables, self.keys(line, places)):
            which = np.flatnonzero(seen[keys >> 20 & self.sieve])
            keys = keys[which]
            lo = np.searchsorted(table, keys, "left")
            there = table[np.minimum(lo, len(table) - 1)] == keys
            which, keys, lo = which[there], keys[there], lo[there]
            n = np.searchsorted(table, keys, "right") - lo
            windows = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            which = np.repeat(which, n)
            slant = (at[which] - self.start[windows]) // NEAR
            met.append(np.unique((doc[which] * len(self.items) + self.owner[windows]) * (2 * reach) + slant + reach))
        code = np.unique(np.concatenate(met))
        pair, slant = np.divmod(code, 2 * reach)
        return np.stack([*np.divmod(pair, len(self.items)), slant - reach], 1)


def candidates(line: np.ndarray, index: Index) -> np.ndarray:
    """Starts of walks in windows of 35 words that can hold the best part of a case: each edit costs two of the item's 29 pairs of neighbours at most."""
    width = STRETCH + EDITS
    codes = line[:-1].astype(np.int64) * index.width + line[1:]
    at = np.minimum(np.searchsorted(index.pairs, codes), len(index.pairs) - 1)
    total = np.concatenate([[0], np.cumsum((index.pairs[at] == codes) & (line[:-1] > 0) & (line[1:] > 0))])
    n = total[np.minimum(np.arange(len(line)) + width - 1, len(total) - 1)] - total[np.minimum(np.arange(len(line)), len(total) - 1)]
    reach = np.concatenate([np.zeros(width, np.int32), np.cumsum(n >= STRETCH - 1 - 2 * EDITS, dtype=np.int32)])
    return np.flatnonzero(reach[width:] > reach[:-width])


def leaks(docs: list[list[str]], index: Index) -> list[list[int]]:
    """For each document, the numbers of the items that it holds a stretch of."""
    gap = STEPS + STRETCH
    lines, bases, at = [], [], gap
    get = index.ids.get
    for d in docs:
        bases.append(at)
        lines.append([get(w, 0) for w in d])
        at += len(d) + gap
    line = np.zeros(at + STEPS, np.int32)
    for b, x in zip(bases, lines):
        line[b : b + len(x)] = x
    places = candidates(line, index)
    found: list[list[int]] = [[] for _ in docs]
    if not len(places):
        return found
    base = np.array(bases)
    doc = np.searchsorted(base, places, "right") - 1
    places, doc = places[doc >= 0], doc[doc >= 0]
    rows = index.meetings(line, places, doc, places - base[doc])
    done: set[tuple[int, int]] = set()
    chunk = max(1, 400_000 // index.grid.shape[1])
    for at in range(0, len(rows), chunk):
        part = rows[at : at + chunk]
        for (d, n, q), good in zip(part.tolist(), promising(line, base, part, index)):
            if (d, n) in done:
                continue
            item, text = index.lines[n], lines[d]
            for w in np.flatnonzero(good).tolist():
                a = w + q * NEAR
                if distance(item[w : w + STRETCH], text[max(0, a - 2 * NEAR) : max(0, a + STRETCH + 3 * NEAR)]) <= EDITS:
                    a, drift = q * NEAR, len(item) // 10  # the rest of a stretch may have moved by all its edits
                    if holds(np.array(item), np.array(text[max(0, a - drift - 2 * NEAR) : max(0, a + len(item) + drift + 3 * NEAR)])):
                        done.add((d, n))
                        found[d].append(n)
                    break
    return found


def promising(line: np.ndarray, base: np.ndarray, rows: np.ndarray, index: Index) -> np.ndarray:
    """For each (document, item, slant), which of the item's windows have 25 of their words near the slant: the best part of a case has."""
    item, lengths = index.grid[rows[:, 1]], index.lengths[rows[:, 1]]
    at = (base[rows[:, 0]] + rows[:, 2] * NEAR)[:, None] + np.arange(item.shape[1])
    near = np.zeros(item.shape, bool)
    for shift in range(-2 * NEAR, 3 * NEAR):
        near |= line[np.clip(at + shift, 0, len(line) - 1)] == item
    near &= item > 0
    total = np.concatenate([np.zeros((len(rows), 1), np.int32), np.cumsum(near, 1, dtype=np.int32)], 1)
    return (total[:, STRETCH:] - total[:, :-STRETCH] >= STRETCH - EDITS) & (np.arange(item.shape[1] - STRETCH + 1) <= (lengths - STRETCH)[:, None])


def blocks(items: DataFrame, item_key: str, item_text: str) -> Iterator[Index]:
    """Indexes of bounded size over all items, read in order of their key."""
    part: list[tuple[int, list[str]]] = []
    held = 0
    for key, text in items.select(item_key, item_text).filter(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).distinct().sort(item_key, item_text).toLocalIterator():
        ws = words(text)
        if len(ws) < STRETCH:
            continue
        if part and held + len(ws) > BLOCK_WORDS:
            yield Index(part)
            part, held = [], 0
        part.append((key, ws))
        held += len(ws)
    if part:
        yield Index(part)


def find(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc key, item key) of every document that holds a stretch of an item."""
    spark = docs.sparkSession
    kinds = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{doc_key}` {kinds[0]}, `{item_key}` {kinds[1]}"
    item_type = to_arrow_type(items.schema[item_key].dataType)
    source = docs.select(F.col(doc_key), F.col(doc_text)).filter(F.col(doc_key).isNotNull() & (F.length(doc_text) > STRETCH))

    def one_pass(shared):
        def work(batches):
            indexes = [s.value for s in shared]
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    texts = [words(t.as_py()) for t in part.column(1)]
                    found = [{index.items[n][0] for index, ns in zip(indexes, of_doc) for n in ns} for of_doc in zip(*(leaks(texts, index) for index in indexes))]
                    pairs = [(i, k) for i, ks in zip(part.column(0).to_pylist(), found) for k in sorted(ks)]
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], part.column(0).type), pa.array([k for _, k in pairs], item_type)], names=[doc_key, item_key])

        return spread(source).mapInArrow(work, schema)

    passes: list[list] = [[]]
    held = 0
    for block in blocks(items, item_key, item_text):
        n = int(block.lengths.sum())
        if held + n > PASS_WORDS and passes[-1]:
            passes.append([])
            held = 0
        passes[-1].append(spark.sparkContext.broadcast(block))
        held += n
    if not passes[-1]:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, map(one_pass, passes))
