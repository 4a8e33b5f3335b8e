from mendwell.llm import pairs as P

Q = "My phone has a fault: the screen goes dark during a call, and I don't know where to look."
FILL = [
    "The reading should stay below forty during the whole check.", "Open the settings and pick the first entry of the list.", "The fault is usually caused by an old setting that survived an update.",
    "It turned out that the battery drops from half to empty within an hour after the latest update.", "In most cases this goes away once the steps below are done.",
]
BODY = "\n".join(f"{s} {t}" for s in FILL for t in FILL)


def defects(spark, *pairs):
    df = spark.createDataFrame([(i, q, a, "x") for i, (q, a) in enumerate(pairs)] + [(100 + i, Q, BODY + f"\nNote {i} ends here.", "x") for i in range(6)], "siis_id bigint, original_query string, content string, defect string")
    return {r.siis_id: r.defect for r in P.defects(df, "siis_id", "original_query", "content").collect()}


def test_each_defect_and_its_look_alikes(spark):
    cases = [
        ((Q, None), "empty"), ((Q, "  \n"), "empty"), ((Q, "<p> **  ** </p>"), "empty"), ((Q, "N/A"), "empty"), ((None, None), None), (("  ", "n/a"), None),
        ((Q, Q.upper()), "copied"), ((Q, f"# Screen\n\n{Q}"), "copied"), ((Q, f"Re: {Q} {Q}"), "copied"), ((Q, f"{Q}\n{BODY}"), None), ((Q, f"{Q} Open the settings."), None),
        (("Device: A1; Problem: dark", "Problem = dark\nDevice = a1"), "copied"),
        ((Q, "Unfortunately I can't help with that request. Please rephrase."), "refusal"), ((Q, "# Screen\nI'm sorry, but no assistance can be offered for this question."), "refusal"),
        ((Q, "Unfortunately I can't help with that request. Open the settings and pick the first entry."), None), ((Q, "We cannot help every model from afar, so the list starts with the safest move."), None),
        ((Q, "Das Gerät ist nach dem letzten Update wieder in der Werkstatt, und die Anzeige bleibt dunkel."), "wrong_language"), (("Die Anzeige bleibt seit dem Update dunkel und nichts hilft.", "Die Anzeige ist nach dem Update wieder hell."), None),
        ((Q, BODY[:-1]), None), ((Q, BODY + "\nThe fault is usually caused by an old sett"), "truncated"), ((Q, BODY + "\nThe reading should stay below forty (see the"), "truncated"), ((Q, BODY + "\nOpen the settings and pick the"), "truncated"),
        ((Q, BODY + "\n- Open the settings and pick the first entry of the list"), None), ((Q, BODY + "\n```\nx = (1\n```"), None),
    ]
    got = defects(spark, *(c for c, _ in cases))
    assert {i: got.get(i) for i in range(len(cases))} == {i: d for i, (_, d) in enumerate(cases)}


def test_neighbours_across_ranges(spark):
    """The next unit that isn't asked for is found whatever range it fell into."""
    import bisect

    whole = sorted(f"{a}{b} word {i}" for i, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "klmnop"))
    asked = [w[: len(w) - 3] for w in whole[::3]] + [w + "~" for w in whole[:9]] + ["zzz"]
    units = spark.createDataFrame([(w, False) for w in whole] + [(a, True) for a in asked], "unit string, wanted boolean")
    got = {r.unit: r.next_unit for r in P.neighbours(units).collect()}
    want = {a: (whole[i] if (i := bisect.bisect_right(whole, a)) < len(whole) else None) for a in asked}
    assert got == want


def test_the_longest_tail_with_a_neighbour_decides(spark):
    complete = spark.createDataFrame([("he came first",), ("pick the first entry of the list",), ("pick the first entry of all",), ("the run was called the first",), ("it ended at the list of names",)], "unit string")
    asked = {
        "please pick the first": True,  # 'first' and 'the first' end sentences, but nothing ends in 'pick the first'
        "she came first": False, "look at the first entry of the li": True, "i pick the first entry of the list": False, "words that nobody knows": True, "he came first": False,
        "it ended at the list": True,  # 'the list' ends a sentence, but this is the beginning of a longer one
    }
    got = {r["last"]: (r.breaks, r.whole) for r in P.judged(spark.createDataFrame([(a,) for a in asked], "last string"), complete).collect()}
    assert {a: b for a, (b, _) in got.items()} == asked
    assert {a for a, (_, w) in got.items() if w} == {"he came first"}


def test_a_spike_of_lengths_is_a_limit(spark):
    """Answers that others end like count as whole, but not where answers pile up at one length."""
    ends = [f"Then the {a} was as good as {b}." for a in ("panel", "tray", "clock", "cable") for b in ("new", "ever", "before")]
    full = [(Q, BODY + "\n" + e) for e in ends]
    last = [f"Our {a} {b} is as good as new" for a in ("first", "other", "third", "fourth") for b in ("panel", "tray", "clock", "cable")]
    at_limit = [(Q, x + BODY + "\n" + e) for e in last for x in ["Note. " * 3 + "x" * (50 - len(e)) + ". "]]
    alone = [(Q, BODY + BODY + "\nOur other handset is as good as new")]
    got = defects(spark, *full, *at_limit, *alone)
    assert len({len(a) for _, a in at_limit}) == 1
    assert [got.get(i) for i in range(len(full))] == [None] * len(full)
    assert [got.get(len(full) + i) for i in range(len(at_limit))] == ["truncated"] * len(at_limit)
    assert got.get(len(full) + len(at_limit)) is None


def test_limits_follow_the_rate_around_them(spark):
    rows = [(n, f"a{n}{i}") for n in range(100, 140) for i in range(40 if n == 120 else 30)] + [(500, f"b{i}") for i in range(9)]
    assert {r.n for r in P.limits(spark.createDataFrame(rows, "n int, last string")).collect()} == {500}


def test_rates_tell_languages_by_words_no_list_has(spark):
    said = {"en": "the tray is under the cover and it is of steel", "de": "die Lade ist unter der Klappe und nicht aus Stahl", "fr": "le tiroir est sous la coque et dans une fente", "es": "la bandeja es de acero y no se ve en la tapa"}
    rates = P.fit([t for t in said.values() for _ in range(3)])
    assert [P.language(x, rates) for x in ("Lade, Klappe", "tiroir, coque", "bandeja, tapa", "tray, cover")] == ["de", "fr", "es", "en"]
    assert P.language("Kelvup brulvo", rates) is None and P.language("tray", rates) is None


def test_few_texts_among_many_teach_their_words(spark):
    """Three texts of a language among 20,000 are all that tells its words: every text counts, not a sample of them."""
    taught = {
        "Lade, Klappe, Stahl.": ["die Lade ist unter der Klappe und nicht aus Stahl.", "die Lade und die Klappe sind nicht aus Stahl.", "der Stahl ist in der Lade und nicht an der Klappe."],
        "tiroir, coque, fente.": ["le tiroir est sous la coque et dans une fente.", "le tiroir et la coque ne sont pas dans une fente.", "une fente est sur le tiroir et sur la coque."],
        "bandeja, tapa, acero.": ["la bandeja es de acero y no se ve en la tapa.", "el acero de la bandeja no es el de la tapa y se ve.", "en la tapa no hay acero y en la bandeja se ve."],
    }
    rows = [(i, f"Kelvup {i} brulvo", f"Brulvo {i} kelvup.") for i in range(10_000)] + [(10_000 + i, "Kelvup", x) for i, x in enumerate(sum(taught.values(), []))]
    rows += [(20_000 + i, Q, x) for i, x in enumerate([*taught, "Brulvo, kelvup."])]
    df = spark.createDataFrame(rows, "siis_id bigint, original_query string, content string")
    assert sorted(tuple(r) for r in P.defects(df, "siis_id", "original_query", "content").collect()) == [(20_000 + i, "wrong_language") for i in range(3)]


def test_joined_rates_are_the_rates_of_all_texts(spark, monkeypatch):
    """Words joined by a shuffle or sent out tell each pair as the plain functions do."""
    import random

    rng = random.Random(5)
    own = {lang: [f"{lang}{chr(97 + i)}vo" for i in range(12)] for lang in P.FUNCTION_WORDS}
    said = lambda: " ".join(rng.choices(own[x] + rng.choice([own[rng.choice(list(own))], list(P.FUNCTION_WORDS[x])]), k=rng.randrange(1, 9))) if (x := rng.choice(list(own))) else ""
    rows = [(i % 250, said(), said() + ".") for i in range(300)] + [(900, " ", "the tray is of steel."), (901, Q, None)]
    rates = P.fit([t for _, q, a in rows for t in (q, a) if t])
    told = [(i, P.language(q, rates), P.language(a, rates)) for i, q, a in rows if a and q.strip() and P.read(q, a)[0] is None]
    want = sorted(i for i, q, a in told if q and a and q != a)
    assert 20 < len(want) < len(told) - 20
    for most in (0, P.SENT_WORDS):
        monkeypatch.setattr(P, "SENT_WORDS", most)
        df = spark.createDataFrame(rows, "siis_id bigint, original_query string, content string")
        assert sorted(r.siis_id for r in P.defects(df, "siis_id", "original_query", "content").filter("defect = 'wrong_language'").collect()) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "siis_id bigint, original_query string, content string")
    assert P.defects(df, "siis_id", "original_query", "content").count() == 0


def test_languages():
    assert P.language("The phone is off and it stays off since the update") == "en"
    assert P.language("Das Gerät ist seit dem Update aus") == "de"
    assert P.language("L'écran reste noir depuis la mise à jour et rien n'aide") == "fr"
    assert P.language("La pantalla sigue oscura desde la última actualización") == "es"
    assert P.language("GET /state") is None
