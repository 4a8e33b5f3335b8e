import random
import re

from mendwell.llm import hidden_duplicates as H

SCHEMA = "key bigint, text string, canonical string, n int"


def frame(spark, *texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts, 1)], SCHEMA)


def found(spark, *texts):
    return sorted((r.first_id, r.copy_id) for r in H.copies(frame(spark, *texts), "key", "text").collect())


def test_spacing_case_punctuation_and_numbers(spark):
    assert found(spark, "It hangs, often.", "IT HANGS OFTEN", "3) it  ha-ngs\u00a0often!!", "\u200b12. « It hangs often »", "it hangs often 2", None, "", " ?! ", "?!") == [(1, 2), (1, 3), (1, 4)]


def test_fields_in_any_order_keep_their_values(spark):
    assert found(spark, "Device: A1; Problem: no light", "problem = No light\nDEVICE = a1", "Device: no light | Problem: A1", "1. Problem:no light|Device:A1.", "Device A1 Problem no light") == [(1, 2), (1, 4)]


def test_prose_with_a_colon_is_no_form(spark):
    assert found(spark, "My phone: it hangs; since today", "my phone it hangs since today") == [(1, 2)]


def test_counts_and_ties(spark):
    rows = H.collapse(frame(spark, "A b", "A b", "a-B", "c"), "key", "text").orderBy("first_key").collect()
    assert [(r.first_key, r.text, r.n_copies, r.n_spellings) for r in rows] == [(1, "A b", 3, 2), (4, "c", 1, 1)]


def test_hot_group_and_long_text(spark):
    rng = random.Random(3)
    long = "x y " * 50_000
    texts = ["Same, text"] * 300 + [long, long.upper()] + ["same text" if rng.random() < 0.5 else f"other {i}" for i in range(300)]
    want, first = [], {}
    for i, t in enumerate(texts, 1):
        k = re.sub(r"\W", "", t.lower())
        if k in first:
            want.append((first[k], i))
        first.setdefault(k, i)
    assert found(spark, *texts) == sorted(want)


def test_empty_table_and_null_keys(spark):
    assert found(spark) == []
    df = spark.createDataFrame([(None, "a"), (1, "a"), (2, "A")], "key bigint, text string")
    assert [tuple(r) for r in H.copies(df, "key", "text").collect()] == [(1, 2)]
