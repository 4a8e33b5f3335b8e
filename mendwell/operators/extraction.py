"""Steps and actions out of articles: sections, sentences, instructions, step groups, categories.

Lines and sentences become rows; sections and groups are islands numbered by a running sum within one article, so a
window never spans more than an article.

Defined results: null and blank articles give no sections; articles without headings are one section named by their first
line; sections without instructions give no action; an article without actions is reported as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions.dialect import Spark, frame

D = Spark()


def sections(articles: DataFrame, key: str = "siis_id", content: str = "content") -> DataFrame:
    """(key, section_no, heading, body): body is the array of the section's lines."""
    lines = frame(articles.select(key, content), [("clean", lambda d: T.scrub(d, T.spaces(d, content))), ("lines", lambda d: d.split("clean", r"\r?\n"))]).select(key, F.posexplode("lines").alias("line_no", "line"))
    lines = frame(lines, [
        ("named", lambda d: T.trim(d, d.extract("line", C.HEADING, 2))),
        ("is_heading", lambda d: f"({d.matches('line', C.HEADING)} AND length({d.replace('named', '[# ]')}) > 1)"),
        ("body_line", lambda d: T.trim(d, "line")),
    ]).filter("is_heading OR body_line <> ''")
    w = Window.partitionBy(key)
    running = w.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section_no", F.sum(F.col("is_heading").cast("bigint")).over(running)).withColumn("n_headings", F.sum(F.col("is_heading").cast("bigint")).over(w)).withColumn("nth", F.row_number().over(w.orderBy("line_no")))
    bare = F.col("n_headings") == 0
    opens = F.col("is_heading") | (bare & (F.col("nth") == 1))
    kept = lines.filter((F.col("section_no") > 0) | bare).select(
        key, F.when(bare, F.lit(1).cast("bigint")).otherwise(F.col("section_no")).alias("section_no"), "line_no",
        F.when(opens, F.when(bare, F.substring("body_line", 1, 80)).otherwise(F.col("named"))).alias("heading"), F.when(~opens, F.col("body_line")).alias("said"),
    )
    return kept.groupBy(key, "section_no").agg(
        F.max("heading").alias("heading"), F.transform(F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("line_no", "said")))), lambda x: x["said"]).alias("body")
    )


def pieces(secs: DataFrame, key: str = "siis_id") -> DataFrame:
    """(key, section_no, heading, piece_no, candidate, why): every piece of a sentence and why it is no step, '' for steps."""
    lines = secs.select(key, "section_no", "heading", F.posexplode("body").alias("line_no", "said"))
    cut = frame(lines, [
        ("clean", lambda d: T.scrub(d, "said")),
        ("parts", lambda d: d.split(d.replace("clean", r"([.!?])\s+", "\\1\x01"), "\x01")),
    ]).select(key, "section_no", "heading", "line_no", F.posexplode("parts").alias("sentence_no", "sentence"))
    def bare(d, x):
        x = T.trim(d, x)
        for p in (C.SEQUENCE_WORD, C.LEADING_CLAUSE, C.POLITENESS, C.TOGETHER):
            x = d.replace(x, p)
        return T.trim(d, x)

    # the long chain runs before the explode: filters on its result then don't repeat it
    bits = frame(cut, [("bits", lambda d: d.each(d.split("sentence", r"(?i)\s*,?\s+(?:and\s+then|then)\s+"), lambda e: bare(d, e)))]).select(key, "section_no", "heading", "line_no", "sentence_no", F.posexplode("bits").alias("bit_no", "bared"))
    low, high = C.STEP_WORDS
    rows = frame(bits, [
        ("candidate", lambda d: T.cap(d, "bared")),
        ("n_words", lambda d: d.size(d.split("candidate", r"\s+"))),
        ("why", lambda d: (
            f"CASE WHEN candidate = '' THEN 'empty' WHEN NOT {d.matches('candidate', C.IMPERATIVE)} OR {d.matches('candidate', C.NARRATION)} THEN 'not-imperative' WHEN {d.matches('candidate', C.LINK_DEPENDENT)} THEN 'link' "
            f"WHEN n_words < {low} THEN 'short' WHEN n_words = 2 AND {d.matches('candidate', C.PRONOUN_OBJECT)} THEN 'pronoun' WHEN n_words > {high} THEN 'long' ELSE '' END")),
        *T.step("candidate"),
    ])
    place = F.struct("line_no", "sentence_no", "bit_no")
    return rows.withColumn("place", place)


def steps(secs: DataFrame, key: str = "siis_id") -> DataFrame:
    """(key, section_no, heading, step_no, step): the distinct steps of a section in order, numbered from 1."""
    found = pieces(secs, key).filter("why = ''").groupBy(key, "section_no", "heading", "step").agg(F.min("place").alias("place"))
    return found.withColumn("step_no", F.row_number().over(Window.partitionBy(key, "section_no").orderBy("place")).cast("bigint")).drop("place")


def grouped(found: DataFrame, key: str = "siis_id") -> DataFrame:
    """The steps with group_no from 1: a new group opens where steps go back to the settings."""
    w = Window.partitionBy(key, "section_no").orderBy("step_no").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.expr(D.matches("step", C.SCREEN_ENTRY)) & (F.col("step_no") > 1)
    return found.withColumn("group_no", (F.sum(opens.cast("bigint")).over(w) + 1).cast("bigint"))


def actions(articles: DataFrame, key: str = "siis_id", content: str = "content") -> DataFrame:
    """(key, section_no, action_name, description, category, n_steps, n_groups, action_no): least disruptive first, else in order."""
    secs = sections(articles, key, content)
    return actions_of(secs, grouped(steps(secs, key), key), key)


def actions_of(secs: DataFrame, found: DataFrame, key: str = "siis_id") -> DataFrame:
    """The actions of sections and their grouped steps."""
    per = found.groupBy(key, "section_no", "heading").agg(
        F.count("*").alias("n_steps"), F.max("group_no").alias("n_groups"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_no", "step"))), lambda x: x["step"]), " ").alias("said")
    )
    built = frame(per.join(secs.select(key, "section_no", "body"), [key, "section_no"]), [
        *T.action_name("heading"), *T.benefit("heading", "body"), *T.description("benefit", "description"),
        ("whole", lambda d: d.concat("heading", d.lit(" "), "said")), ("category", lambda d: T.category(d, "whole")),
    ])
    order = F.element_at(F.create_map(*(F.lit(x) for kv in C.CATEGORY_ORDER.items() for x in kv)), F.col("category"))
    w = Window.partitionBy(key).orderBy("order_no", "section_no")
    return built.withColumn("order_no", order).withColumn("action_no", F.row_number().over(w).cast("bigint")).select(key, "section_no", "action_name", "description", "category", "n_steps", "n_groups", "action_no")


def step_groups(found: DataFrame, key: str = "siis_id") -> DataFrame:
    """(key, section_no, group_no, steps): the steps of each group as an array in order."""
    return found.groupBy(key, "section_no", "group_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_no", "step"))), lambda x: x["step"]).alias("steps"))
