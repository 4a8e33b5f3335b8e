import random

from mendwell.llm import leakage as L

RNG = random.Random(11)
WORDS = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]


def passage(n):
    return RNG.choices(WORDS, k=n)


def edited(words, n):
    out = list(words)
    for i in sorted(RNG.sample(range(1, len(words) - 1), n), reverse=True):
        kind = RNG.randrange(3)
        if kind == 0:
            out[i] = "replaced"
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, "inserted")
    return out


def least(pattern, doc):
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(pattern, 1):
        new = [i]
        for j, v in enumerate(doc, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row)


def brute(doc, item):
    """A stretch of 30 to 33 words, one in ten edited at most, with both ends in common, by the plain recurrence."""
    for s in range(len(item) - L.STRETCH + 1):
        if least(item[s + 1 : s + L.STRETCH - 1], doc) > L.EDITS:
            continue
        for n in range(L.STRETCH, min(L.STRETCH + L.EDITS, len(item) - s) + 1):
            e = least(item[s : s + n], doc)
            if e <= n // 10 and e == least(item[s + 1 : s + n - 1], doc):
                return True
    return False


def test_recall_and_precision_against_brute_force():
    items = [(i, passage(RNG.randint(80, 145))) for i in range(12)]
    index = L.Index(items)
    docs, quoted = [], []
    for k in range(240):
        owner, item = RNG.choice(items)
        n = RNG.choice((20, 27, 30, 31, 33, 40, 70))
        at = RNG.randrange(len(item) - n + 1)
        quote = edited(item[at : at + n], min(n // 10 + RNG.choice((-1, 0, 0, 1, 4)), n - 2) if k % 4 else 0)
        quoted.append((len(docs), owner, n))
        docs.append(passage(RNG.randint(0, 60)) + quote + passage(RNG.randint(0, 60)))
    docs += [passage(150) for _ in range(40)] + [[], ["one"]]
    got = {(d, n) for d, ns in enumerate(L.leaks(docs, index)) for n in ns}
    want = {(d, n) for d, doc in enumerate(docs) for n, (_, item) in enumerate(items) if brute(doc, item)}
    # brute tries stretches of 30 to 33 words; longer ones lie in longer quotes only, and are tried at all lengths
    want |= {(d, n) for d, n, length in quoted if length > 33 and (d, n) not in want and brute_of_all_lengths(docs[d], items[n][1])}
    assert got <= want
    assert len(got) >= 0.97 * len(want) and len(want) > 80


def test_distance_is_the_least_over_all_parts():
    for _ in range(60):
        a, b = RNG.choices("abc", k=RNG.randint(1, 12)), RNG.choices("abc", k=RNG.randint(0, 20))
        row = [0] * (len(b) + 1)
        for i, w in enumerate(a, 1):
            new = [i]
            for j, v in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
            row = new
        assert L.distance(a, b) == min(row)


def test_words_without_case_accents_marks_and_markup():
    assert L.words("> Thé <b>low-battery</b> **sign**, it’s\n&amp; 5_x") == ["the", "lowbattery", "sign", "its", "5x"]


def test_frames_in_blocks(spark, monkeypatch):
    a, b = passage(90), passage(90)
    items = spark.createDataFrame([(1, " ".join(a), 0), (2, " ".join(b), 0), (3, "too short", 0), (4, None, 0), (None, " ".join(a), 0)], "item_id bigint, text string, doc_id int")
    docs = spark.createDataFrame([
        (1, "Before. " + " ".join(a[20:60]).upper() + " after"), (2, " ".join(a[:35] + b[40:75])), (3, " ".join(a[:29])), (4, None), (5, ""), (6, " ".join(a[:15] + passage(10) + a[15:30])), (1, " ".join(a)), (7, "word " * 100_000 + " ".join(b[:40])),
    ], "doc_id bigint, text string")
    want = [(1, 1), (1, 1), (2, 1), (2, 2), (7, 2)]
    assert sorted(map(tuple, L.find(docs, "doc_id", "text", items, "item_id", "text").collect())) == want
    monkeypatch.setattr(L, "BLOCK_WORDS", 100)
    assert sorted(map(tuple, L.find(docs, "doc_id", "text", items, "item_id", "text").collect())) == want
    assert L.find(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert L.find(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def leasts(pattern, doc):
    """The least distance of each beginning of the pattern to any part of the text, by the plain recurrence."""
    row, out = [0] * (len(doc) + 1), [0]
    for i, w in enumerate(pattern, 1):
        new = [i]
        for j, v in enumerate(doc, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
        row = new
        out.append(min(row))
    return out


def brute_of_all_lengths(doc, item):
    """A stretch of 30 words or more up to the item's end, one in ten edited at most, with both ends in common."""
    outer = leasts(item, doc)
    for s in range(len(item) - L.STRETCH + 1):
        inner = leasts(item[s + 1 :], doc)
        if any(outer[n] <= n // 10 and outer[n] == inner[n - 2] for n in range(L.STRETCH, len(item) - s + 1)):
            return True
        outer = inner
    return False


def test_long_stretches_with_their_edits_in_the_middle():
    items = [(i, passage(62)) for i in range(3)]
    index = L.Index(items)
    docs, full = [], []
    for n, edits in ((40, (15, 18, 21, 24)), (50, (20, 22, 24, 26, 28)), (59, (29, 29, 29, 29, 29))):
        for _, item in items:
            quote = item[:n]
            for i in edits:
                if n == 59:
                    quote.insert(i, "inserted")
                else:
                    quote[i] = "replaced"
            full.append(len(docs))
            docs.append(passage(5) + quote + passage(5))
            over = list(quote)
            over[12] = over[35] = "replaced"
            docs.append(passage(5) + over + passage(5))
    for k in range(30):
        item = RNG.choice(items)[1]
        n = RNG.choice((40, 42, 50, 55))
        docs.append(passage(5) + edited(item[:n], n // 10 + RNG.choice((0, 0, 1, 3))) + passage(5))
    got = {(d, n) for d, ns in enumerate(L.leaks(docs, index)) for n in ns}
    want = {(d, n) for d, doc in enumerate(docs) for n, (_, item) in enumerate(items) if brute_of_all_lengths(doc, item)}
    assert {d for d, _ in want} >= set(full)
    assert got <= want
    assert len(got) >= 0.97 * len(want)


def test_many_blocks_and_passes_with_text_ids(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_WORDS", 100)
    monkeypatch.setattr(L, "PASS_WORDS", 250)
    items = [(f"i{n}", passage(60)) for n in range(9)]
    docs = [(f"d{n}", " ".join(passage(20) + ws[:40] + passage(20) + items[(n + 4) % 9][1][10:50]), "x") for n, (_, ws) in enumerate(items)] + [("none", " ".join(passage(80)), "x"), ("null", None, "x")]
    d = spark.createDataFrame(docs, "doc_id string, text string, item_id string")
    i = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items] + [("short", "too short"), ("null", None)], "item_id string, text string")
    got = {(r.doc_id, r.item_id) for r in L.find(d, "doc_id", "text", i, "item_id", "text").collect()}
    assert got == {(f"d{n}", f"i{m}") for n in range(9) for m in (n, (n + 4) % 9)}
