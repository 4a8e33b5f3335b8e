import random

import pytest

from mendwell.llm import entries as E

CATALOG = [
    (1, "Shows Touch sensitivity (glove mode) in the Display section of Settings.", "View Touch sensitivity", "onClickURL"), (2, "Turns on Touch sensitivity (glove mode) in device Settings", "Enable Touch sensitivity", "onURL"),
    (3, "switches touch sensitivity (glove mode) off under Display", None, "offURL"), (4, "Opens  the Screen timeout screen on the device ", "", "onClickURL"), (5, "Leads to Battery usage", "View Battery usage", "onClickURL"),
    (6, "Shows Memory usage", "View Memory usage", "onClickURL"), (7, "Switches Wi-Fi networks on", "Enable Wi-Fi networks", "onURL"), (8, "Placeholder for a settings screen", "", None), (9, "Shows Touch tones", "View Touch tones", "onClickURL"), (10, None, None, "onURL"),
]
STEPS = {
    "Open Touch sensitivity.": 1, "Enable tuoch  sensitivty in Display settings ": 2, "Switch TOUCH_SENSITIVITY off!": 3, "make sure to switch off glovemode": 3, "Turn on sensitivity (Touch)": 2,
    "Go to Settings > Display > Screen timeuot": 4, "Enable Screen timeout": 0, "From Settings, tap Battery and then usage, Battery.": 5, "Navigate to Memory usage in the Settings app": 6, "turn wi-fi netwrks ON please": 7, "settings/Display/Touch tones!": 9,
    "Open Touch lottery": 0, "Go to Settings > Battery": 0, "Open Settings and tap Display": 0, "Hold the power key for 10 seconds!": 0, "Open Placeholder": 0, "": 0, " ": 0, "Set Touch sens. to off": 3,
}


def catalog(spark):
    return spark.createDataFrame(CATALOG, "link_id bigint, description string, message string, original_type string")


def test_steps_lead_to_their_entry(spark):
    steps = spark.createDataFrame([(i, s) for i, s in enumerate(STEPS)] + [(99, None)], "n bigint, step string")
    got = {r.step: r.link_id for r in E.resolve(steps, "step", catalog(spark)).collect()}
    assert got == {**STEPS, None: 0}


def test_repair_is_complete_against_brute_force(spark):
    def osa(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng, words = random.Random(5), ["sensitivity", "battery", "usage", "tones", "wi", "timeout", "navigation"]
    typed = set()
    for w in words * 25:
        t = list(w)
        for _ in range(rng.randint(0, 2)):
            i, kind = rng.randrange(len(t)), rng.randrange(4)
            if kind == 0:
                t[i] = "q"
            elif kind == 1 and len(t) > 1:
                del t[i]
            elif kind == 2:
                t.insert(i, "z")
            elif i + 1 < len(t):
                t[i], t[i + 1] = t[i + 1], t[i]
        typed.add("".join(t))
    got = {(r.token, r.word) for r in E.repaired(spark.createDataFrame([(t,) for t in typed], "token string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    most = lambda n: 0 if n <= 2 else 1 if n <= 4 else 2
    want = {(t, w) for t in typed for w in words if osa(t, w) <= most(max(len(t), len(w)))}
    assert want <= got


@pytest.mark.parametrize("step, effect", [("Switch X off", "off"), ("Set X to ON", "on"), ("Open X", "open"), ("Deactivate X", "off"), ("turn X ON please", "on"), ("Offline maps", "open")])
def test_effects(spark, step, effect):
    assert spark.createDataFrame([(step,)], "s string").select(E.effect(E.F.col("s"))).collect()[0][0] == effect


def test_empty_sides_and_repeated_rows(spark):
    steps = spark.createDataFrame([(1, "Open Touch tones", "x"), (2, "Open Touch tones", "y")], "n bigint, step string, name string")
    assert {(r.n, r.link_id) for r in E.resolve(steps, "step", catalog(spark)).collect()} == {(1, 9), (2, 9)}
    assert {(r.n, r.link_id) for r in E.resolve(steps, "step", catalog(spark).limit(0)).collect()} == {(1, 0), (2, 0)}
    assert E.resolve(steps.limit(0), "step", catalog(spark)).count() == 0


def test_long_tokens_meet_by_whole_parts(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(n)) for n in (15, 16, 17, 18, 19, 20, 31, 64, 300)]
    typed = {w: w for w in words}
    for w in words:
        for _ in range(12):
            t = list(w)
            for _ in range(rng.randint(1, 2)):
                i, kind = rng.randrange(len(t) - 1), rng.randrange(4)
                if kind == 0:
                    t[i] = "0"
                elif kind == 1:
                    del t[i]
                elif kind == 2:
                    t.insert(i, "0")
                else:
                    t[i], t[i + 1] = t[i + 1], t[i]
            typed["".join(t)] = w
    typed["x" * 10_000] = None
    got = {(r.token, r.word) for r in E.repaired(spark.createDataFrame([(t,) for t in typed], "token string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(t, w) for t, w in typed.items() if w}
