"""The whole way from a complaint and its article to a checked plan, as one DataFrame program.

Defined results: articles without text answer 'no_siis_context'; articles without instructions, and plans that break a rule,
answer 'no_match'; null questions count as empty. One row for each article.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut
from ..functions import constants as C
from ..functions import text as T
from ..functions.dialect import Spark, Stage, frame
from . import extraction as X
from . import retrieval as R


def titled(d: Spark) -> str:
    """What names the problem: the article's title, unless it is empty or says nothing; then the question."""
    title, query = "coalesce(title, '')", "coalesce(query, '')"
    return f"CASE WHEN {title} = '' OR {d.matches(title, C.GENERIC_TITLE)} THEN CASE WHEN {query} <> '' THEN {query} ELSE {title} END ELSE {title} END"


OUTCOME: list[Stage] = [
    ("source", titled), *T.topic("source"), *T.goal("topic", "goal_text"), *T.title("source", "title_text"),
    ("outcome", lambda d: f"CASE WHEN {T.scrub(d, T.spaces(d, 'content'))} = '' THEN 'no_siis_context' WHEN n_actions IS NULL OR NOT {T.valid_title(d, 'title_text')} OR NOT {T.valid_goal(d, 'goal_text')} THEN 'no_match' ELSE 'answered' END"),
]


def overlap_words(d: Spark, x: str) -> str:
    return d.keep(d.split(d.replace(f"lower(coalesce({x}, ''))", r"[^a-z0-9\s]", " "), r"\s+"), lambda e: f"length({e}) > 3")


def planned(pairs: DataFrame, catalog: DataFrame, mode: str = "hybrid") -> tuple[DataFrame, DataFrame]:
    """pairs: (siis_id, original_query, title, content). The outcome of each, and the groups of steps with their action and links."""
    a = frame(pairs.select("siis_id", "original_query", "title", "content"), [("query", lambda d: T.scrub(d, T.spaces(d, "original_query")))])
    secs = cut(X.sections(a))  # cut where several branches read on
    found = cut(X.grouped(X.steps(secs)))
    acts = cut(X.actions_of(secs, found))
    groups = X.step_groups(found).join(acts.select("siis_id", "section_no", "action_no", "action_name", "description", "category"), ["siis_id", "section_no"]).join(a.select("siis_id", F.col("query").alias("context")), "siis_id")
    groups = cut(groups.withColumn("gid", F.concat_ws("-", "siis_id", "section_no", "group_no")))
    done = R.mapped(groups.drop("context", "section_no").join(R.resolve(groups, catalog, mode), "gid"), catalog)
    auto = F.col("category") != "manual"
    per = done.groupBy("siis_id").agg(
        F.count("*").alias("n_groups"), F.sum(F.size("steps")).cast("bigint").alias("n_steps"), F.count_if(auto).alias("n_auto"), F.count_if(F.col("decision") == "matched").alias("n_matched"), F.count_if(F.col("decision") == "placeholder").alias("n_placeholder")
    )
    n = acts.groupBy("siis_id").agg(F.count("*").alias("n_actions"))
    rows = frame(a.join(n, "siis_id", "left").join(per, "siis_id", "left"), [*OUTCOME, ("qs", lambda d: d.distinct(overlap_words(d, "query"))), ("ts", lambda d: d.distinct(overlap_words(d, "title")))])
    overlap = F.when((F.size("qs") == 0) | (F.size("ts") == 0), 0.4).otherwise(F.size(F.array_intersect("qs", "ts")) / F.size("ts"))
    rate = F.when(F.col("n_auto") == 0, 1.0).otherwise(F.col("n_matched") / F.col("n_auto"))
    raw = 0.45 * rate + 0.30 * F.least(F.lit(1.0), F.col("n_steps") / 8) + 0.25 * overlap
    answered = F.col("outcome") == "answered"
    shown = lambda x: F.when(answered, F.col(x)).alias(x)
    outcomes = rows.select("siis_id", "outcome", shown("goal_text"), shown("title_text"), F.when(answered, F.greatest(F.lit(0.05), F.least(F.lit(0.99), R.rounded(raw, 2)))).alias("score"), *(shown(x) for x in ("n_actions", "n_groups", "n_steps", "n_matched", "n_placeholder")))
    return outcomes, done


def troubleshoot(pairs: DataFrame, catalog: DataFrame, mode: str = "hybrid") -> DataFrame:
    """The outcome, goal, title and score of each, with what its plan counts."""
    return planned(pairs, catalog, mode)[0]


def responses(pairs: DataFrame, catalog: DataFrame, mode: str = "hybrid") -> DataFrame:
    """(siis_id, response, fallback): the nested plan of each article as JSON text, without what only the pipeline needs.

    Articles that aren't answered have no contexts, and why as their fallback.
    """
    outcomes, groups = planned(pairs, catalog, mode)
    link = F.when(F.col("deeplink").isNotNull(), F.struct("deeplink", F.col("link_description").alias("description"), F.col("link_message").alias("message"), F.col("link_type").alias("originalType")))
    names = (("validation_deeplink", "deeplink"), ("validation_key", "key"), ("validation_result_type", "resultType"), ("validation_condition", "condition"), ("validation_value", "value"))
    check = F.when(F.col("validation_deeplink").isNotNull(), F.struct(*(F.col(c).alias(n) for c, n in names)))
    ordered = lambda no, what: F.transform(F.array_sort(F.collect_list(F.struct(F.col(no).alias("no"), what.alias("what")))), lambda x: x["what"])
    group = F.struct("steps", check.alias("validationDeeplink"), link.alias("actionableDeeplink"))
    acts = groups.groupBy("siis_id", "action_no", "action_name", "description", "category").agg(ordered("group_no", group).alias("stepGroups"))
    plans = acts.groupBy("siis_id").agg(ordered("action_no", F.struct(F.col("action_name").alias("actionName"), "description", "stepGroups", "category")).alias("actions"))
    context = F.struct(F.col("goal_text").alias("goal"), F.col("title_text").alias("title"), "score", "actions")
    rows = outcomes.join(plans, "siis_id", "left").withColumn("contexts", F.filter(F.array(F.when(F.col("outcome") == "answered", context)), lambda c: c.isNotNull()))
    return rows.select("siis_id", F.to_json(F.struct("contexts"), {"ignoreNullFields": "false"}).alias("response"), F.when(F.col("outcome") != "answered", F.col("outcome")).alias("fallback"))
