"""Encoding of a whole corpus with a public byte-pair vocabulary, by replaying its merges over blocks of distinct words.

A block's texts are split into words by the vocabulary's published pattern. Words that the worker hasn't met are encoded
together: an inverted index leads from each pair of neighbouring tokens to the positions in words where it stands, and
every merge is applied in rank order to all its positions at once, updating only the neighbours it touches. Texts are
then written as the ids of their words. No row moves: the only thing shared is the vocabulary, by a broadcast or, if its
file is large, by a file on each executor, so a corpus of any size costs one pass. A worker forgets its words when they exceed a bound; this
costs time, never a result.

Defined results
    * null and empty texts: an empty list. Blank texts are encoded as what they are.
    * text that looks like a special token is ordinary text.
    * null ids keep their row; repeated rows give repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import os
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import spread

TOKENIZERS = "/opt/tokenizers"
#: Published split pattern of byte-level vocabularies of this family.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary above this many bytes isn't broadcast, but read by each worker from its executor's disk.
VOCABULARY_BYTES = 32 << 20
#: Words, and their bytes, that a worker remembers.
WORDS, WORD_BYTES = 200_000, 16 << 20


def ranks_of(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}


def shared_vocabulary(spark, path: str, most: int | None = None):
    """A function that gives a worker the vocabulary: from a broadcast if the file is small, else from the copy that Spark lays on each executor's disk."""
    if os.path.getsize(path) <= (VOCABULARY_BYTES if most is None else most):
        sent = spark.sparkContext.broadcast(ranks_of(path))
        return lambda: sent.value
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)
    return lambda: ranks_of(SparkFiles.get(name))


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """The ids of each word: all words' bytes in one array, and merges in rank order over an inverted index of pairs."""
    token: list[bytes] = []
    before: list[int] = []
    after: list[int] = []
    first: list[int] = []
    for w in words:
        start, n = len(token), len(w)
        first.append(start if n else -1)
        token.extend(w[i : i + 1] for i in range(n))
        before.extend([-1, *range(start, start + n - 1)] if n else [])
        after.extend([*range(start + 1, start + n), -1] if n else [])
    where: dict[tuple[bytes, bytes], list[int]] = {}
    for i, j in enumerate(after):
        if j >= 0:
            where.setdefault((token[i], token[j]), []).append(i)
    queue = [(ranks[a + b], a, b) for a, b in where if a + b in ranks]
    heapq.heapify(queue)
    while queue:
        _, a, b = heapq.heappop(queue)
        places = where.pop((a, b), None)
        if not places:
            continue
        merged = a + b
        places.sort()
        fresh: set[tuple[bytes, bytes]] = set()
        for i in places:
            j = after[i]
            if j < 0 or token[i] != a or token[j] != b:
                continue  # a neighbour's merge took it
            token[i], token[j] = merged, b""
            k, h = after[j], before[i]
            after[i], after[j] = k, -1
            if k >= 0:
                before[k] = i
                pair = (merged, token[k])
                where.setdefault(pair, []).append(i)
                fresh.add(pair)
            if h >= 0:
                pair = (token[h], merged)
                where.setdefault(pair, []).append(h)
                fresh.add(pair)
        for x, y in fresh:
            if (r := ranks.get(x + y)) is not None:
                heapq.heappush(queue, (r, x, y))
    out = []
    for i in first:
        ids = []
        while i >= 0:
            ids.append(ranks[token[i]])
            i = after[i]
        out.append(ids)
    return out


def encode(df: DataFrame, key: str, text: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", pattern: str = PATTERN) -> DataFrame:
    """(key, ids) of every row."""
    vocabulary_of = shared_vocabulary(df.sparkSession, vocabulary)
    kind = df.schema[key].dataType

    def work(batches):
        import regex

        split, ranks = regex.compile(pattern), vocabulary_of()
        known: dict[str, list[int]] = {}
        held = 0
        for batch in batches:
            texts = [split.findall(t) if t else () for t in batch.column(1).to_pylist()]
            new = list({w for t in texts for w in t if w not in known})
            held += sum(map(len, new))
            if len(known) + len(new) > WORDS or held > WORD_BYTES:
                known.clear()
                new = list({w for t in texts for w in t})
                held = sum(map(len, new))
            known.update(zip(new, replay([w.encode("utf-8", "surrogatepass") for w in new], ranks)))
            ids = [[i for w in t for i in known[w]] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return spread(df.select(F.col(key), F.col(text))).mapInArrow(work, f"`{key}` {kind.simpleString()}, ids array<int>")
