"""Queries that take articles apart, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import spread, table
from ..functions import constants as C
from ..functions import text as T
from ..functions.dialect import Checker, sql
from ..operators import extraction as X

K = Checker()


def _bare(d):
    x = T.trim(d, "bit")
    for p in (C.SEQUENCE_WORD, C.LEADING_CLAUSE, C.POLITENESS, C.TOGETHER):
        x = d.replace(x, p)
    return T.trim(d, x)


_LINES = sql("(SELECT siis_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM " + sql("(SELECT siis_id, content FROM siis_responses)", [("clean", lambda d: T.scrub(d, T.spaces(d, "content"))), ("lines", lambda d: d.split("clean", r"\r?\n"))]) + ")", [
    ("named", lambda d: T.trim(d, d.extract("line", C.HEADING, 2))),
    ("is_heading", lambda d: f"({d.matches('line', C.HEADING)} AND length({d.replace('named', '[# ]')}) > 1)"),
    ("body_line", lambda d: T.trim(d, "line")),
])
_LOW, _HIGH = C.STEP_WORDS
_PIECES = sql("(SELECT * EXCLUDE bits, unnest(bits) AS bit, generate_subscripts(bits, 1) AS bit_no FROM " + sql("(SELECT * EXCLUDE parts, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS sentence_no FROM " + sql("said", [("clean", lambda d: T.scrub(d, "said")), ("parts", lambda d: d.split(d.replace("clean", r"([.!?])\s+", "\\1\x01"), "\x01"))]) + ")", [("bits", lambda d: d.split("sentence", r"(?i)\s*,?\s+(?:and\s+then|then)\s+"))]) + ")", [
    ("bared", _bare),
    ("candidate", lambda d: T.cap(d, "bared")),
    ("n_words", lambda d: d.size(d.split("candidate", r"\s+"))),
    ("why", lambda d: f"CASE WHEN candidate = '' THEN 'empty' WHEN NOT {d.matches('candidate', C.IMPERATIVE)} OR {d.matches('candidate', C.NARRATION)} THEN 'not-imperative' WHEN {d.matches('candidate', C.LINK_DEPENDENT)} THEN 'link' WHEN n_words < {_LOW} THEN 'short' WHEN n_words = 2 AND {d.matches('candidate', C.PRONOUN_OBJECT)} THEN 'pronoun' WHEN n_words > {_HIGH} THEN 'long' ELSE '' END"),
    *T.step("candidate"),
])
WITH = f"""WITH numbered AS (SELECT *, sum(is_heading::int) OVER (PARTITION BY siis_id ORDER BY line_no) AS s, sum(is_heading::int) OVER (PARTITION BY siis_id) AS n, row_number() OVER (PARTITION BY siis_id ORDER BY line_no) AS nth FROM {_LINES} WHERE is_heading OR body_line <> ''),
lines AS (SELECT siis_id, CASE WHEN n = 0 THEN 1 ELSE s END::bigint AS section_no, line_no, is_heading OR (n = 0 AND nth = 1) AS opens, CASE WHEN n = 0 THEN substr(body_line, 1, 80) ELSE named END AS named, body_line FROM numbered WHERE s > 0 OR n = 0),
secs AS (SELECT siis_id, section_no, max(named) FILTER (WHERE opens) AS heading, coalesce(list(body_line ORDER BY line_no) FILTER (WHERE NOT opens), []) AS body FROM lines GROUP BY 1, 2),
said AS (SELECT siis_id, section_no, heading, unnest(body) AS said, generate_subscripts(body, 1) AS line_no FROM secs),
pieces AS (SELECT * FROM {_PIECES}),
firsts AS (SELECT siis_id, section_no, heading, step, min((line_no, sentence_no, bit_no)) AS place FROM pieces WHERE why = '' GROUP BY ALL),
steps AS (SELECT siis_id, section_no, heading, step, row_number() OVER (PARTITION BY siis_id, section_no ORDER BY place) AS step_no FROM firsts),
grouped AS (SELECT *, 1 + sum(({K.matches("step", C.SCREEN_ENTRY)} AND step_no > 1)::int) OVER (PARTITION BY siis_id, section_no ORDER BY step_no) AS group_no FROM steps),
per AS (SELECT siis_id, section_no, heading, count(*) AS n_steps, max(group_no) AS n_groups, string_agg(step, ' ' ORDER BY step_no) AS said FROM grouped GROUP BY 1, 2, 3),
actions AS (SELECT siis_id, section_no, action_name, description, category, n_steps, n_groups::bigint AS n_groups, row_number() OVER (PARTITION BY siis_id ORDER BY CASE category {" ".join(f"WHEN '{k}' THEN {v}" for k, v in C.CATEGORY_ORDER.items())} END, section_no) AS action_no FROM """ + sql("(SELECT per.*, body FROM per JOIN secs USING (siis_id, section_no))", [
    *T.action_name("heading"), *T.benefit("heading", "body"), *T.description("benefit", "description"), ("whole", lambda d: d.concat("heading", d.lit(" "), "said")), ("category", lambda d: T.category(d, "whole")),
]) + ")"


def _articles(spark, sf_dir):
    return spread(table(spark, sf_dir, "siis_responses").select("siis_id", "original_query", "title", "content"))


def sections(spark, sf_dir):
    return X.sections(_articles(spark, sf_dir)).select("siis_id", "section_no", "heading", F.size("body").cast("bigint").alias("n_lines"))


def step_filter_reasons(spark, sf_dir):
    return X.pieces(X.sections(_articles(spark, sf_dir))).groupBy("why").agg(F.count("*").alias("n"))


def steps_from(spark, sf_dir):
    return X.steps(X.sections(_articles(spark, sf_dir))).select("siis_id", "section_no", "step_no", "step")


def step_groups(spark, sf_dir):
    found = X.grouped(X.steps(X.sections(_articles(spark, sf_dir))))
    return found.groupBy("siis_id", "section_no", "group_no").agg(F.count("*").alias("n_steps"), F.min("step_no").alias("first_step_no"))


def extract_actions(spark, sf_dir):
    return X.actions(_articles(spark, sf_dir))


def extract_outcome(spark, sf_dir):
    """matched, no_actionable_steps or no_siis_context of each article, with its goal and title."""
    a = _articles(spark, sf_dir).select("siis_id", "original_query", "title", "content")
    n = X.actions(a).groupBy("siis_id").agg(F.count("*").alias("n_actions"))
    return X.frame(a.join(n, "siis_id", "left"), OUTCOME).select("siis_id", "outcome", "goal_text", "title_text", "n_actions")


def _source(d):
    title, query = "coalesce(title, '')", "coalesce(original_query, '')"
    return f"CASE WHEN {title} = '' OR {d.matches(title, C.GENERIC_TITLE)} THEN CASE WHEN {query} <> '' THEN {query} ELSE {title} END ELSE {title} END"


OUTCOME = [
    ("source", _source), *T.topic("source"), *T.goal("topic", "goal_text"), *T.title("source", "title_text"),
    ("outcome", lambda d: f"CASE WHEN {T.scrub(d, T.spaces(d, 'content'))} = '' THEN 'no_siis_context' WHEN n_actions IS NULL THEN 'no_actionable_steps' ELSE 'extracted' END"),
]

QUERIES = {f.__name__: f for f in (sections, step_filter_reasons, steps_from, step_groups, extract_actions, extract_outcome)}
SQL = {
    "sections": WITH + " SELECT siis_id, section_no, heading, len(body) AS n_lines FROM secs",
    "step_filter_reasons": WITH + " SELECT why, count(*) AS n FROM pieces GROUP BY 1",
    "steps_from": WITH + " SELECT siis_id, section_no, step_no, step FROM steps",
    "step_groups": WITH + " SELECT siis_id, section_no, group_no::bigint AS group_no, count(*) AS n_steps, min(step_no) AS first_step_no FROM grouped GROUP BY 1, 2, 3",
    "extract_actions": WITH + " SELECT * FROM actions",
    "extract_outcome": WITH + ", counted AS (SELECT siis_id, count(*) AS n_actions FROM actions GROUP BY 1) SELECT siis_id, outcome, goal_text, title_text, n_actions FROM " + sql("(SELECT s.*, n_actions FROM siis_responses s LEFT JOIN counted USING (siis_id))", OUTCOME),
}
