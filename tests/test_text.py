"""Literal pairs of the text functions."""

import pytest

from mendwell.functions import constants as C
from mendwell.functions import text as T
from mendwell.functions.dialect import Spark, frame

D = Spark()


def one(spark, stages, out, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in columns.items()))
    return frame(df, stages).select(out).collect()[0][0]


@pytest.mark.parametrize("heading, said", [
    ("Charge the Device", "It will charge the device"),
    ("Attempt to Power On", "It will attempt to power on"),
    ("Factors Affecting Touchscreen Performance", "It will check factors affecting touchscreen performance"),
    ("Restarting Your Device", "It will restart the device"),
    ("Safe Mode", "It will check safe mode"),
    ("", "It will restore normal behaviour"),
])
def test_description(spark, heading, said):
    assert one(spark, T.description("x"), "description_built", x=heading) == said


def test_canonical_keys_of_one_fault_agree(spark):
    key = lambda q: one(spark, T.canonical("x"), "canonical_key", x=q)
    assert key("My screen keeps going black") == key("my SCREEN keeps going black!")
    assert key("My phone screen goes completely black") == key("screen goes black on my phone")
    assert key(None) == key("  ") == ""


@pytest.mark.parametrize("text, clean", [
    ("see [the page](https://a.example/x) now", "see now"),
    ("go to www.a.example/x , then  back", "go to, then back"),
    ("mail a.com and (  ) done", "mail and done"),
    ("", ""),
])
def test_scrub(spark, text, clean):
    assert one(spark, [("y", lambda d: T.scrub(d, T.spaces(d, "x")))], "y", x=text) == clean


@pytest.mark.parametrize("text, kind", [
    ("Open the home screen and swipe. Tap the icon", "auto"),
    ("Use another charger and clean the charging port", "manual"),
    ("Visit a service centre", "manual"),
    ("Open Settings and do a factory data reset", "critical"),
    ("Restart it", "critical"),
])
def test_category(spark, text, kind):
    assert one(spark, [("y", lambda d: T.category(d, "x"))], "y", x=text) == kind


@pytest.mark.parametrize("leaf, usable", [("X", False), ("and drop new into", False), ("minus next", False), ("Add", False), ("input", False), ("", False), ("Wi-Fi", True), ("Navigation bar", True), ("Touch sensitivity", True)])
def test_usable_target(spark, leaf, usable):
    assert one(spark, T.usable_target("x"), "usable", x=leaf) is usable


def test_variations_are_eight_to_ten_and_distinct(spark):
    for q in ("My phone drains fast", "x", "the screen of my device flickers " * 20, 'He said "it hangs"'):
        v = one(spark, T.variations("x"), "variations", x=q)
        assert C.VARIATIONS[0] <= len(v) <= C.VARIATIONS[1] and len({x.lower() for x in v}) == len(v)
    assert one(spark, T.variations("x"), "variations", x=" ") == []
    assert one(spark, T.variations("x"), "variations", x=None) == []


def test_title_and_goal(spark):
    assert one(spark, T.title("x"), "title_built", x="") == "Device issue"
    assert one(spark, T.title("x"), "title_built", x="Battery") == "Battery issue"
    assert one(spark, T.title("x"), "title_built", x="My wifi drops daily at noon") == "Wi-Fi drops daily"
    assert one(spark, [*T.topic("x"), *T.goal("topic")], "goal_built", x="Blank or black display on a smartphone") == "Follow these steps to perform this Blank Black Display Troubleshooting"


def test_word_boundaries_are_ascii(spark):
    assert one(spark, [("y", lambda d: d.replace("x", r"\ba\b", "_"))], "y", x="éa é a") == "é_ é _"
