"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import cut, table
from ..operators import nested
from . import entries, hidden_duplicates, leakage, markup, pairs, subjects, tokenizing

_P1 = (("complaints", "complaint_id", "query"), ("siis_responses", "siis_id", "original_query"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [hidden_duplicates.copies(table(spark, sf_dir, t), key, text).select(F.lit(t).alias("source_table"), "first_id", "copy_id") for t, key, text in _P1]
    return parts[0].unionByName(parts[1])


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [hidden_duplicates.collapse(table(spark, sf_dir, t), key, text).select(F.lit(t).alias("source_table"), F.col("first_key").alias("first_id"), "text", "n_copies", "n_spellings") for t, key, text in _P1]
    return parts[0].unionByName(parts[1])


QUERIES = {"p1_found": p1_found, "p1_records": p1_records}

# The canonical text in the SQL dialect of the checking engine, from the same patterns.
_BODY = f"regexp_replace(text, '{hidden_duplicates.LIST_NUMBER}', '')"
_FOLD = r"regexp_replace(lower(upper({})), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_FIELD, _FORM = hidden_duplicates._FIELD, hidden_duplicates._FORM
_CANON = f"""
    rows AS (SELECT 'complaints' AS source_table, complaint_id AS key, query AS text FROM complaints WHERE query IS NOT NULL
             UNION ALL SELECT 'siis_responses', siis_id, original_query FROM siis_responses WHERE original_query IS NOT NULL),
    bodies AS (SELECT *, {_BODY} AS body FROM rows),
    parts AS (SELECT *, string_split(regexp_replace(body, '{_FIELD}', chr(1) || '\\1', 'g'), chr(1)) AS fields FROM bodies),
    canon AS (SELECT source_table, key, text, CASE WHEN regexp_matches(body, '{_FORM}') AND len(fields) > 1
        THEN array_to_string(list_sort(list_transform(fields, lambda f: {_FOLD.format("regexp_extract(f, '^[^:=]*')")} || chr(2) || {_FOLD.format("regexp_extract(f, '(?s)[:=](.*)$', 1)")})), chr(3))
        ELSE {_FOLD.format("body")} END AS c FROM parts),
    marked AS (SELECT *, min(key) OVER (PARTITION BY source_table, c) AS first_id FROM canon WHERE regexp_matches(c, '[^\\x01-\\x03]'))"""
SQL = {
    "p1_found": f"WITH {_CANON} SELECT source_table, first_id, key AS copy_id FROM marked WHERE key <> first_id",
    "p1_records": f"""WITH {_CANON} SELECT source_table, first_id, min(text) FILTER (WHERE key = first_id) AS text,
        count(*) AS n_copies, count(DISTINCT text) AS n_spellings FROM marked GROUP BY source_table, c, first_id""",
}


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES["p6_ids"] = p6_ids


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


QUERIES["p7_found"] = p7_found


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.found(table(spark, sf_dir, "siis_responses"), "siis_id", "content")


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.texts(table(spark, sf_dir, "siis_responses"), "siis_id", "content")


QUERIES |= {"p2_found": p2_found, "p2_texts": p2_texts}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(table(spark, sf_dir, "siis_responses"), "siis_id", "original_query", "content")


QUERIES["p5_found"] = p5_found


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = cut(nested.flat_tables(table(spark, sf_dir, "results"), "result_id", "response")["step"])  # read twice
    led = entries.resolve(steps, "step", table(spark, sf_dir, "deeplinks"))
    return led.select("result_id", "context_no", "action_no", "group_no", "step_no", "link_id")


QUERIES["p4_found"] = p4_found


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assign(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "labels"), table(spark, sf_dir, "subjects"))


QUERIES["p8_found"] = p8_found
