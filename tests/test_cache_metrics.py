import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mendwell.functions import constants as C
from mendwell.functions import text as T
from mendwell.functions.dialect import frame
from mendwell.operators import metrics as M
from mendwell.operators import plan_cache as P

T0 = datetime(2025, 1, 1)
RECORDS = "cache_id bigint, cache_key string, query string, query_variations array<string>, result_id bigint, stored_at timestamp_ntz"


def records(spark, *rows):
    return spark.createDataFrame([(i, k, "", v, i * 10, T0 + timedelta(minutes=i)) for i, (k, v) in enumerate(rows, 1)], RECORDS)


def test_lookup_tries_key_paraphrase_and_similar_keys(spark):
    kept = records(spark, ("blank display drains", ["cracked frame everywhere"]), ("alpha beta gamma delta", None), (None, ["x"]), ("", []), ("alpha beta gamma delta", None))
    asked = spark.createDataFrame([(1, "drains display blank"), (2, "everywhere frame cracked"), (3, "alpha beta gamma"), (4, "nothing like these words"), (5, " "), (6, None)], "complaint_id bigint, query string")
    got = {r.complaint_id: (r.match, r.cache_id) for r in P.lookup(asked, kept).collect()}
    assert got == {1: ("exact", 1), 2: ("variation", 1), 3: ("fuzzy", 5), 4: ("miss", None)}


def test_similar_keys_against_brute_force(spark):
    import random

    rng = random.Random(7)
    words = [f"w{c}{d}" for c in "abcdef" for d in "xyz"]
    keys = [" ".join(sorted(set(rng.choices(words, k=rng.randint(1, 8))))) for _ in range(220)]
    kept = records(spark, *((k, None) for k in keys[:120]))
    entries = P.entries(kept)
    asked = spark.createDataFrame([(k,) for k in keys[100:]], "key string")
    got = {r.key: (r.kept_key, round(r.score, 9)) for r in P.fuzzy(asked, entries).collect()}
    order = {r.key: r.seq.cache_id for r in entries.collect()}
    want = {}
    for a in set(keys[100:]):
        ta, best = set(a.split()), None
        for b in order:
            tb = set(b.split())
            i = len(ta & tb)
            if len(ta) < 2 or not i:
                continue
            c = i / min(len(ta), len(tb))
            s = max(i / len(ta | tb), c if c >= 0.8 and i >= 3 else 0)
            if s >= 0.62 and (best is None or (-s, order[b]) < best[0]):
                best = ((-s, order[b]), b)
        if best:
            want[a] = (best[1], round(-best[0][0], 9))
    assert got == want


def test_similar_keys_in_small_blocks_and_passes(spark, monkeypatch):
    """Long and short keys, tokens that nothing kept has, equal scores in several blocks and passes; no token becomes a row."""
    import random

    rng = random.Random(11)
    words = [f"w{c}{d}" for c in "abcde" for d in "xy"]
    key = lambda n: " ".join(sorted(set(rng.choices(words, k=n))))
    entries = P.entries(records(spark, *((key(rng.randint(1, 12)), None) for _ in range(300)), (" ".join(f"l{i:02}" for i in range(70)), None)))
    asked = spark.createDataFrame([(key(rng.randint(1, 12)) + rng.choice(["", " zz", " yy zz"]),) for _ in range(150)] + [(" ".join(f"l{i:02}" for i in range(8, 78)),), ("zz yy",)], "key string")
    shown = lambda: {r.key: (r.kept_key, r.score) for r in P.fuzzy(asked, entries).collect()}
    want, order = {}, {r.key: r.seq.cache_id for r in entries.collect()}
    for a in {r.key for r in asked.collect()}:
        ta = set(a.split())
        scores = sorted((-float(P.likeness(len(ta), len(b.split()), len(ta & set(b.split())))), order[b], b) for b in order) if len(ta) >= 2 else []
        want |= {a: (b, -s) for s, _, b in scores[:1] if -s >= 0.62}
    assert len(want) > 50 and shown() == want
    assert "Generate" not in P.fuzzy(asked, entries)._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(P, "BLOCK_KEYS", 70)
    monkeypatch.setattr(P, "SLICE_KEYS", 5)
    monkeypatch.setattr(P, "PASS_KEYS", 90)
    monkeypatch.setattr(P, "BLOCK_BYTES", 2000)
    assert shown() == want


def test_keys_of_batches_are_those_of_the_stages(spark):
    texts = [
        None, "", " \u00a0", "My S21 won't turn on!!", "WONT POWER UP. It goes completely black , really", "screen is dead; half the screen, half screen", "drains very quickly\tand drain fast", "runs out of battery",
        "see https://a.b/c?d=1 or www.x1 or foo.COM/bar and [link](http://x) ( ) [a] ( ) <A href=x>text</a> y", "<a b>\u2028x\u0085</a> end", "\u212a key \u0130stan na\u00efve my_phone _my phone \u00e9my", "so laggy sluggish very slow", "can't see anything, can t see anything",
        "touch isnt working touch is not working not responding to touch", "hangs hang change freezes freezing blinks flickers", "keeps going off keep turning blank goes black", "\u03a3\u03a3 \u2029 tab tablet smart phone smartphone a12g", "1. one\r\n2) two . three ...four", "a.b", "x\x85y\x1cz z",
    ]
    texts += [f"a {w} b" for p, _ in C.WORDINGS for w in [re.sub(r"\(\?i\)|\\b|\?(?!:)|\(\?:|\|[^()]*(?=\))|\)", "", p)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = P.keyed(frame(df, T.canonical("text", "want")).select("text", "want"), "text", "key").collect()
    assert [(r.text, r.key) for r in got] == [(r.text, r.want) for r in got] and len({r.key for r in got}) > 15


def test_lifetime_and_eviction(spark):
    e = P.entries(records(spark, ("a", None), ("b", None), ("c", None)))
    now = F.lit(T0 + timedelta(minutes=2, hours=1))
    assert {r.key for r in P.live(e, now).collect()} == {"b", "c"}
    assert {r.key for r in P.evict(e, 2).collect()} == {"b", "c"}


def test_percentiles(spark):
    s = spark.createDataFrame([("x", float(i)) for i in range(1, 11)] + [("y", None), ("x", None)], "k string, ms double")
    got = [tuple(r) for r in M.percentiles(s, ["k"]).collect()]
    assert got == [("x", 10, 5.0, 10.0, 10.0, 1.0, 10.0, 5.5)]
    assert M.percentiles(s.limit(0), ["k"]).count() == 0


def test_summary_of_samples_without_measures(spark):
    s = spark.createDataFrame([(None, None, None), (400.0, True, 2), (10.0, False, 0)], "ms double, hit boolean, contexts int").withColumn("scope", F.lit("all"))
    assert tuple(M.summary(s, ["scope"]).collect()[0]) == ("all", 3, 0.33, 0.67, 0.5)
    none = spark.createDataFrame([(None, None, None)], "ms double, hit boolean, contexts int").withColumn("scope", F.lit("all"))
    assert M.summary(none, ["scope"]).collect()[0].within_budget == 1.0
