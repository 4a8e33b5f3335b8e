"""Kept plans by canonical key: what is live, and which kept plan answers a complaint.

The lookups are keyed joins with a priority: the key itself, a paraphrase somebody stored, one of the complaint's own
paraphrases, and last the most similar key. The common tokens of keys are counted exactly for all pairs, 64 kept keys at
once: the tokens of complaints are too few for any of them to be rare, so tables of pairs that share one would be huge.

Defined results: records with a null or empty key are not kept; of equal keys the last stored holds, at the place of the
first; complaints without a key have no answer; ties go to the earliest place.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..cluster import cut, spread
from ..functions import constants as C
from ..functions import text as T
from ..functions.dialect import frame

#: Kept keys of one pass over the keys asked, and of one block of bits; keys asked of one slice; bytes of blocks that a worker keeps.
PASS_KEYS, BLOCK_KEYS, SLICE_KEYS, BLOCK_BYTES = 250_000, 8192, 128, 150_000_000


def keyed(df: DataFrame, text: str, out: str) -> DataFrame:
    """With the canonical key of a text."""

    def told(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(T.canonical_of, b.column(text).to_pylist()), pa.string())], [*b.schema.names, out])

    return df.mapInArrow(told, StructType([*df.schema.fields, StructField(out, StringType())]))


def entries(records: DataFrame) -> DataFrame:
    """(key, cache_id, result_id, stored_at, seq): one row a key; seq is the place of its first record."""
    own = records.filter("cache_key IS NOT NULL AND cache_key <> ''")
    last = F.max_by(F.struct("cache_id", "result_id", "stored_at"), F.struct("stored_at", "cache_id"))
    return own.groupBy(F.col("cache_key").alias("key")).agg(last.alias("last"), F.min(F.struct("stored_at", "cache_id")).alias("seq")).select("key", "last.*", "seq")


def paraphrase_index(records: DataFrame) -> DataFrame:
    """(vkey, key): canonical paraphrases of kept records; the last writer of a paraphrase wins."""
    said = records.filter("cache_key IS NOT NULL AND cache_key <> ''").select("cache_id", "stored_at", F.col("cache_key").alias("key"), F.posexplode("query_variations").alias("pos", "said"))
    told = keyed(said, "said", "vkey").filter("vkey <> '' AND vkey <> key")
    return told.groupBy("vkey").agg(F.max_by("key", F.struct("stored_at", "cache_id", "pos")).alias("key"))


def live(kept: DataFrame, now, lifetime_s: int = C.LIFETIME_S) -> DataFrame:
    """now: a column or literal timestamp. A plan dies when it is older than its lifetime."""
    return kept.filter(F.unix_micros(now) - F.unix_micros(F.col("stored_at").cast("timestamp")) <= lifetime_s * 1_000_000)


def evict(kept: DataFrame, most: int = C.KEPT) -> DataFrame:
    """The newest records; the limit is the feature."""
    return kept.orderBy(F.col("stored_at").desc(), F.col("seq").desc()).limit(most)


def likeness(n, m, shared):
    """Of sets of n and m tokens with so many in common; arrays or numbers."""
    contained = shared / np.minimum(n, m)
    return np.maximum(shared / (n + m - shared), np.where((contained >= C.CONTAINED) & (shared >= C.CONTAINED_TOKENS), contained, 0.0))


def least_shared(n: int, sizes: np.ndarray) -> np.ndarray:
    """For each size, the fewest tokens that a set of n must share with one of that size to be similar; n + 1 if no number does."""
    kinds, of = np.unique(sizes, return_inverse=True)
    shared = np.arange(1, n + 1)[:, None]
    enough = (shared <= kinds) & (likeness(n, kinds[None, :], np.minimum(shared, kinds)) >= C.FUZZY)
    return np.where(enough.any(0), enough.argmax(0) + 1, n + 1)[of]


def bit_rows(rows: np.ndarray, at: np.ndarray, n: int, words: int) -> np.ndarray:
    """n rows of bits in words of 64, set at these places of these rows."""
    out = np.zeros((n, words), np.uint64)
    np.bitwise_or.at(out, (rows, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def added(bits: np.ndarray, cols: np.ndarray, digits: int) -> list[np.ndarray]:
    """The sums of the rows of bits that each row of cols names, for all places at once: one array a binary digit, the lowest first."""
    open_: list[list[np.ndarray]] = [[] for _ in range(digits + 1)]

    def carry(at: int) -> None:
        a, b, *c = open_[at]
        over, digit = a & b, a ^ b
        if c:
            open_[at] = [digit ^ c[0]]
            digit &= c[0]
            over |= digit
        else:
            open_[at] = [digit]
        open_[at + 1].append(over)

    for j in range(cols.shape[1]):
        open_[0].append(bits[cols[:, j]])
        at = 0
        while len(open_[at]) == 3:
            carry(at)
            at += 1
    for at in range(digits):
        while len(open_[at]) > 1:
            carry(at)
    zero = np.zeros((len(cols), bits.shape[1]), np.uint64)
    return [x[0] if x else zero for x in open_[:digits]]


class Kept:
    """Token sets of kept keys in the order of their places, and the most similar one of each set that is asked.

    A block has one row of bits a token: which of its keys have it. Rows are added as binary digits, so that one operation counts the
    common tokens of 64 keys, and the sums are compared with what each key's size demands. All pairs are compared exactly.
    """

    def __init__(self, vocabulary: pa.Array, tokens: np.ndarray, sizes: np.ndarray) -> None:
        self.vocabulary, self.tokens, self.sizes = vocabulary, tokens, sizes
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.built: dict[int, tuple] = {}
        self.bytes = 0

    def block(self, low: int) -> tuple:
        """(row of each token, rows of bits, sizes, demands by size asked)."""
        if low in self.built:
            return self.built[low]
        high = min(low + BLOCK_KEYS, len(self.sizes))
        used, row = np.unique(self.tokens[self.ends[low] : self.ends[high]], return_inverse=True)
        local = np.full(len(self.vocabulary) + 1, len(used), np.int32)  # the last row has no key
        local[used] = np.arange(len(used))
        at = np.repeat(np.arange(high - low), self.sizes[low:high])
        out = local, bit_rows(row, at, len(used) + 1, -(-(high - low) // 64)), self.sizes[low:high], {}
        self.bytes += local.nbytes + out[1].nbytes
        if self.bytes <= BLOCK_BYTES:
            self.built[low] = out
        return out

    def demand(self, sizes: np.ndarray, n: int, words: int) -> np.ndarray:
        digits, need = (n + 1).bit_length(), np.full(words * 64, n + 1)
        need[: len(sizes)] = least_shared(n, sizes)
        digit, at = np.nonzero((need[None, :] >> np.arange(digits)[:, None]) & 1)
        return bit_rows(digit, at, digits, words)

    def best(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each set asked, given as numbers in the vocabulary (its length for other tokens): the kept key's number, -1 if none is similar, and the score."""
        starts = np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(sizes, kind="stable")
        found, top = np.full(len(sizes), -1), np.zeros(len(sizes))
        for low in range(0, len(self.sizes), BLOCK_KEYS):
            local, bits, held, demands = self.block(low)
            for n in np.unique(sizes).tolist():
                same = order[slice(*np.searchsorted(sizes[order], [n, n + 1]))]
                if n not in demands:
                    demands[n] = self.demand(held, n, bits.shape[1])
                for x in range(0, len(same), SLICE_KEYS):
                    rows = same[x : x + SLICE_KEYS]
                    sums = added(bits, local[tokens[starts[rows][:, None] + np.arange(n)]], len(demands[n]))
                    enough = np.full(sums[0].shape, ~np.uint64(0))
                    for digit, need in zip(sums, demands[n]):  # enough so far, unless this higher digit says else
                        enough ^= (digit ^ need) & (enough ^ digit)
                    r, w = np.nonzero(enough)
                    if not len(r):
                        continue
                    e, bit = np.nonzero(np.unpackbits(enough[r, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                    r, w = r[e], w[e]
                    shared = sum(((digit[r, w] >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.int64) << k for k, digit in enumerate(sums))
                    at = w * 64 + bit
                    score = likeness(n, held[at], shared)
                    o = np.lexsort((at, -score, r))
                    o = o[np.concatenate([[True], r[o][1:] != r[o][:-1]])]
                    o = o[score[o] > top[rows[r[o]]]]  # of equals the earlier block's stays
                    found[rows[r[o]]], top[rows[r[o]]] = low + at[o], score[o]
        return found, top


def fuzzy(keys: DataFrame, kept: DataFrame) -> DataFrame:
    """keys: (key). (key, kept_key, score): the most similar kept key of each, above the floor.

    The kept keys' token sets go to the keys asked, in passes of bounded size; nothing is shuffled but what is found.
    """
    told = lambda df: frame(spread(df), T.content_tokens("key", "content")).withColumn("tokens", F.array_distinct("content")).drop("content")
    asked = cut(told(cut(keys.select("key").distinct())).filter(F.size("tokens") >= 2))
    held = cut(told(cut(kept.select("key", "seq"))).filter(F.size("tokens") >= 1).withColumn("id", F.monotonically_increasing_id()))  # numbers that stay, once they are written
    passes = max(1, -(-held.count() // PASS_KEYS))

    def met(n: int) -> DataFrame:
        sets = held.filter(F.pmod(F.xxhash64("key"), F.lit(passes)) == n).orderBy("seq").select("id", "tokens").toArrow().combine_chunks()
        ids, lists = sets["id"].to_numpy(), sets["tokens"].combine_chunks()
        flat = lists.flatten()
        vocabulary = flat.unique()
        sent = vocabulary, pc.index_in(flat, vocabulary).to_numpy(zero_copy_only=False).astype(np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)

        def near(batches):
            of = Kept(*sent)
            for b in batches:
                given = b.column("tokens")
                numbers = pc.fill_null(pc.index_in(given.flatten(), of.vocabulary), len(of.vocabulary)).to_numpy(zero_copy_only=False)
                found, score = of.best(numbers, pc.list_value_length(given).to_numpy(zero_copy_only=False).astype(np.int64))
                at = np.flatnonzero(found >= 0)
                yield pa.RecordBatch.from_pydict({"key": b.column("key").take(pa.array(at)), "id": pa.array(ids[found[at]]), "score": pa.array(score[at])})

        return asked.select("key", "tokens").mapInArrow(near, "key string, id bigint, score double")

    hits = reduce(DataFrame.unionByName, map(met, range(passes)))
    w = Window.partitionBy("key").orderBy(F.col("score").desc(), "seq")
    scored = hits.join(held.select("id", F.col("key").alias("kept_key"), "seq"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("key", "kept_key", "score")


def lookup(complaints: DataFrame, records: DataFrame, key: str = "complaint_id", text: str = "query") -> DataFrame:
    """(key, canonical_key, match, kept_key, cache_id): match is exact, variation, fuzzy or miss; complaints without a key are left out.

    Each step is asked for what the steps before it missed: equal keys first, then the paraphrases of distinct texts without
    an answer, then the similar keys of what is left. A complaint that was sent a million times is looked up once.
    """
    kept, index = cut(entries(records)), cut(paraphrase_index(spread(records)))
    asked = cut(keyed(complaints.select(key, F.col(text).alias("text")), "text", "key").filter("key <> ''"))
    in_kept = lambda df: df.join(kept.select(F.col("key").alias("kept_key")), "kept_key")
    stored = index.withColumnRenamed("key", "kept_key")
    keys = asked.select("key").distinct()
    exact = keys.join(kept.select("key"), "key").select("key", F.lit(1).alias("step"), F.col("key").alias("kept_key"))
    by_name = in_kept(keys.withColumnRenamed("key", "vkey").join(stored, "vkey")).select(F.col("vkey").alias("key"), F.lit(2).alias("step"), "kept_key")
    by_key = cut(exact.unionByName(by_name).groupBy("key").agg(F.min(F.struct("step", "kept_key")).alias("hit")).select("key", "hit.*"))
    # paraphrases of the texts that have no answer yet; outer: else the optimiser asks for the array's size below, with its whole expression over and over
    texts = cut(spread(asked.select("text", "key").distinct().join(by_key, "key", "left_anti")))
    varied = cut(frame(texts.select("text"), T.variations("text")).select("text", "variations"))
    said = cut(keyed(varied.select("text", F.posexplode_outer("variations").alias("pos", "said")), "said", "vkey").select("text", "pos", "vkey"))
    own = said.join(kept.select(F.col("key").alias("vkey")), "vkey").select("text", (F.col("pos") * 2).alias("pos"), F.col("vkey").alias("kept_key"))
    own_stored = in_kept(said.join(stored, "vkey")).select("text", (F.col("pos") * 2 + 1).alias("pos"), "kept_key")
    by_text = cut(own.unionByName(own_stored).groupBy("text").agg(F.min(F.struct("pos", "kept_key")).alias("hit")).select("text", F.lit(3).alias("step"), "hit.kept_key"))
    near = cut(fuzzy(texts.join(by_text, "text", "left_anti").select("key").distinct(), kept).select("key", F.lit(4).alias("step"), "kept_key"))
    of_text = by_text.select("text", F.col("step").alias("text_step"), F.col("kept_key").alias("text_kept"))
    of_key = by_key.unionByName(near).select("key", F.col("step").alias("key_step"), F.col("kept_key").alias("key_kept"))  # one row a key
    out = asked.join(of_text, "text", "left").join(of_key, "key", "left")
    # a key that was found only by similarity for one text may belong to another that a paraphrase answered
    step, found = F.coalesce("text_step", "key_step"), F.coalesce("text_kept", "key_kept")
    match = F.when(step == 1, "exact").when(step.isin(2, 3), "variation").when(step == 4, "fuzzy").otherwise("miss")
    out = out.select(key, F.col("key").alias("canonical_key"), match.alias("match"), found.alias("kept_key"))
    return out.join(kept.select(F.col("key").alias("kept_key"), "cache_id"), "kept_key", "left").select(key, "canonical_key", "match", "kept_key", "cache_id")
