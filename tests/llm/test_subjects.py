import random

from mendwell.llm import subjects as S

SAID = {
    "display": ["the panel shows a white veil after waking", "the picture stays dim even at full brightness", "a green line runs down the glass", "touch input lags behind my finger"],
    "power": ["charging stops at eighty per cent", "the battery gauge jumps up and down", "standby drains a third of the charge", "quick charging is never offered"],
    "sound": ["the microphone cuts out in long calls", "music plays on one side only", "callers hear an echo of themselves", "the ringtone stays silent all day"],
}
FRAMES = ["Nobody at the desk believed that {}.", "It turned out that {} on 4 of our handsets.", "To be exact: {} since the move.", "{}, as I said before."]
IDLE = ["More on this tomorrow.", "Please answer in this thread only.", "Any hint is welcome.", "Thanks for reading this far."]


def corpus(n, rng):
    docs, truth = [], {}
    for i in range(n):
        own = rng.sample(sorted(SAID), rng.choice((0, 1, 1, 1, 2)))
        parts = [rng.choice(FRAMES).format(rng.choice(SAID[s])) for s in own for _ in range(6)] + rng.sample(IDLE, 2)
        rng.shuffle(parts)
        docs.append((i, " ".join(parts), "x"))
        truth[i] = set(own)
    return docs, truth


def run(spark, docs, labels, subjects=tuple(SAID)):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    out = S.assign(d, "doc_id", "text", spark.createDataFrame(labels, "doc_id bigint, subject string"), spark.createDataFrame([(s,) for s in subjects], "subject string"))
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    return got


def test_held_out_accuracy_with_wrong_labels(spark):
    rng = random.Random(2)
    docs, truth = corpus(400, rng)
    labels = [(i, s) for i in range(50) for s in truth[i]] + [(51, "sound"), (9999, "power"), (3, "no such subject"), (None, "power")]
    got = run(spark, docs + [(1000, None, "x"), (1001, "", "x"), (1002, " ", "x"), (None, docs[0][1], "x")], labels)
    held = range(60, 400)
    right = sum(got.get(i, set()) == truth[i] for i in held)
    assert right >= 0.95 * len(held)
    assert not {1000, 1001, 1002, None} & set(got)


def test_empty_sides(spark):
    docs = [(1, "The panel shows a white veil after waking. " * 3, "x")]
    assert run(spark, docs, []) == {}
    assert run(spark, [], [(1, "power")]) == {}
    assert run(spark, docs, [(1, "display")], ()) == {}


def test_sentences_fold_numbers_and_wraps():
    assert S.sentences("> Quote one goes\n> on here. <b>Two</b> has T5 &amp; 7!\n\n# Head line\nuser: third one") == [["quote", "one", "goes", "on", "here"], ["two", "has", "0", "0"], ["head", "line"], ["third", "one"]]


def test_goes_on_until_nothing_changes(spark):
    """Each document shares sentences with the next one only, and the first alone has a label."""
    last = 6
    said = lambda s, k: [f"{' '.join(f'{s}{k}{v}{w}' for w in 'bcdfghklmnpq')}.".translate(str.maketrans("0123456789", "aeiouyzxvw")) for v in "rst"]
    docs = [(100 * i + k, " ".join(said(s, k) + said(s, k + 1)), "x") for i, s in enumerate(("display", "power")) for k in range(last + 1)]
    assert run(spark, docs, [(0, "display"), (100, "power")]) == {d: {"power" if d >= 100 else "display"} for d, _, _ in docs}


def test_seeds_keep_their_labels_unless_refuted(spark):
    rng = random.Random(4)
    docs, truth = corpus(300, rng)
    seeds = [i for i in range(60) if truth[i]]
    labels = [(i, s) for i in seeds for s in truth[i]]
    wrong = next(i for i in seeds if truth[i] == {"power"})
    labels = [(i, s) for i, s in labels if i != wrong] + [(wrong, "sound")]
    got = run(spark, docs, labels)
    assert all(got[i] == truth[i] for i in seeds if i != wrong)
    assert got[wrong] == {"power"}


def test_any_number_of_subjects_string_ids_and_repeated_rows(spark):
    docs = [(f"d{i}", " ".join(f"the part called {w} of item {chr(97 + i % 26)}{chr(97 + i // 26)} is {v} again." for w in ("alpha", "beta", "gamma") for v in ("loud", "warm")).replace("item ", "item x"), "x") for i in range(650)]
    d = spark.createDataFrame(docs + docs[:5] + [(a + "b", t, x) for a, t, x in docs], "doc_id string, text string, subject string")
    labels = spark.createDataFrame([(f"d{i}", f"s{i:03}") for i in range(650)], "doc_id string, subject string")
    got = {(r.doc_id, r.subject) for r in S.assign(d, "doc_id", "text", labels, labels.select("subject").distinct()).collect()}
    assert got == {(f"d{i}{b}", f"s{i:03}") for i in range(650) for b in ("", "b")}


def test_numbers_of_passages_hold_and_hashes_meet_on_equal_words(spark):
    df = spark.createDataFrame([(1, "One two three four five six. Short one. " + "word " * 50_000), (2, "x. One  TWO three four five!"), (3, "")], "doc_id bigint, text string")
    rows = sorted((r.doc, len(r.links), r.links[0]) for r in S.passages(df, "doc_id", "text").collect())
    assert [r[:2] for r in rows] == sorted([(1, 2), (1, 1), (1, 49_996), (2, 1), (2, 1)])
    by = lambda n, k: {r[2] for r in rows if r[0] == n and r[1] == k}
    assert by(1, 2) & by(2, 1) and not by(1, 1) & by(2, 1)
    assert {r.passage for r in S.passages(df, "doc_id", "text").collect()} == {r.passage for r in S.passages(df.repartition(3), "doc_id", "text").collect()}
