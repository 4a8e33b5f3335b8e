"""The nested plan holds what the flat rows of the plan hold, and nothing else."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mendwell.cluster import table
from mendwell.operators import nested, pipeline

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def test_nested_responses_flatten_to_the_plan(spark):
    pairs, catalog = table(spark, str(DATA), "siis_responses"), table(spark, str(DATA), "deeplinks")
    outcomes, groups = pipeline.planned(pairs, catalog)
    outcomes, groups = outcomes.collect(), groups.collect()
    responses = pipeline.responses(pairs, catalog)
    rows = {r.siis_id: r for r in responses.collect()}
    answered = {r.siis_id for r in outcomes if r.outcome == "answered"}
    assert answered and len(rows) == len(outcomes)
    for r in outcomes:
        contexts = json.loads(rows[r.siis_id].response)["contexts"]
        assert rows[r.siis_id].fallback == (None if r.siis_id in answered else r.outcome)
        assert [(c["goal"], c["title"], c["score"]) for c in contexts] == ([(r.goal_text, r.title_text, r.score)] if r.siis_id in answered else [])
        for c in contexts:
            assert [a["category"] for a in c["actions"]] == sorted((a["category"] for a in c["actions"]), key=("auto", "manual", "critical").index)
            assert set(c["actions"][0]) == {"actionName", "description", "stepGroups", "category"}
    flat = nested.flat_tables(responses.select("siis_id", "response"), "siis_id", "response")
    got = sorted((r.siis_id, r.action_no, r.group_no, r.actionableDeeplink_deeplink, r.validationDeeplink_deeplink) for r in flat["group"].collect())
    mine = [g for g in groups if g.siis_id in answered]
    first = {s: sorted({g.action_no for g in mine if g.siis_id == s}) for s in answered}
    want = sorted((g.siis_id, first[g.siis_id].index(g.action_no), sorted(x.group_no for x in mine if (x.siis_id, x.action_no) == (g.siis_id, g.action_no)).index(g.group_no), g.deeplink, g.validation_deeplink) for g in mine)
    assert got == want
    steps = flat["step"].groupBy("siis_id").agg(F.count("*").alias("n")).collect()
    assert {r.siis_id: r.n for r in steps} == {s: sum(len(g.steps) for g in mine if g.siis_id == s) for s in answered}


def test_questions_without_articles(spark):
    pairs = spark.createDataFrame([(1, "q", None, None), (2, None, "t", " "), (3, "q", "t", "Nothing to do here.")], "siis_id bigint, original_query string, title string, content string")
    catalog = table(spark, str(DATA), "deeplinks")
    got = {r.siis_id: (json.loads(r.response), r.fallback) for r in pipeline.responses(pairs, catalog).collect()}
    assert got == {1: ({"contexts": []}, "no_siis_context"), 2: ({"contexts": []}, "no_siis_context"), 3: ({"contexts": []}, "no_match")}
