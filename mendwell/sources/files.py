"""Readers and writers of the project's files: catalogs, articles, complaint lists, records, plans kept for a start.

All readers take a declared schema, so no pass over the data is spent on inferring one. Missing files are read as empty
tables, and lines that aren't records as nothing, where the format says so.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import constants as C
from ..operators.metrics import newest

VALIDATION = "struct<deeplink:string, key:string, resultType:string, condition:string, value:string>"
LINK = "struct<deeplink:string, description:string, message:string, originalType:string>"
ENTRY = f"deeplink string, description string, message string, qna_description string, originalType string, validation {VALIDATION}"
PLAN = f"struct<contexts: array<struct<goal:string, title:string, score:double, actions: array<struct<actionName:string, description:string, stepGroups: array<struct<steps: array<string>, validationDeeplink: {VALIDATION}, actionableDeeplink: {LINK}>>, category:string>>>>>"
RECORD = f"id string, run string, query string, of string, query_variations array<string>, response {PLAN}, meta struct<latency_ms:double, cache_hit:boolean, cache_match:string, model:string, cost_usd:double>, fallback string"
KEPT = f"id string, key string, query string, query_variations array<string>, response {PLAN}"


def _or_empty(spark: SparkSession, read, schema: str | StructType) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a catalog file, {"deeplinks": [...]} or a bare array, with their place (link_id from 1); without a link: none."""
    shape = spark.createDataFrame([], ENTRY).schema.simpleString()
    text = spark.read.text(path, wholetext=True)
    both = text.select(F.coalesce(F.from_json("value", f"deeplinks array<{shape}>").getField("deeplinks"), F.from_json("value", f"array<{shape}>")).alias("entries"))
    rows = both.select(F.posexplode("entries").alias("at", "e")).select((F.col("at") + 1).cast("bigint").alias("link_id"), "e.*").filter("deeplink IS NOT NULL")
    return rows.select("link_id", "deeplink", "description", "message", "qna_description", F.col("originalType").alias("original_type"), *(F.col(f"validation.{x}").alias(f"validation_{y}") for x, y in (("deeplink", "deeplink"), ("key", "key"), ("resultType", "result_type"), ("condition", "condition"), ("value", "value"))))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(siis_id, id, original_query, title, content) of {"responses": [...]}; a missing file has none."""
    article = "array<struct<id:string, original_query:string, siis_response: struct<title:string, content:string>>>"

    def read() -> DataFrame:
        rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"responses {article}").getField("responses")).alias("at", "r"))
        return rows.select((F.col("at") + 1).cast("bigint").alias("siis_id"), "r.id", "r.original_query", "r.siis_response.title", "r.siis_response.content")

    return _or_empty(spark, read, "siis_id bigint, id string, original_query string, title string, content string")


def complaints(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, ord, query): one complaint a line, without its number; blank lines are none but keep their place.

    Files are read by lines, in as many splits as they have. A line's place is its place in its split after all lines of the file's splits
    before, which are known from one row a split.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("split"), "value", F.monotonically_increasing_id().alias("seq")
    )
    splits = lines.groupBy("file", "split").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(splits.select("file", "split", (before - F.col("first_seq") + 1).alias("shift")), ["file", "split"])
    query = F.regexp_replace(F.regexp_replace("value", r"^\s*\d+[.)]\s*", ""), r"^\s+|\s+$", "")
    return placed.select("source_file", (F.col("seq") + F.col("shift")).alias("ord"), query.alias("query")).filter("query <> ''")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Batch records, one JSON object a line; unreadable lines and missing files give nothing."""
    parsed = F.from_json("value", RECORD + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return _or_empty(spark, lambda: spark.read.text(path).select(parsed.alias("r")).select("r.*").filter("_bad IS NULL").drop("_bad"), RECORD)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def kept_plans(spark: SparkSession, path: str) -> DataFrame:
    """Plans kept for a start; those without a key or plan aren't kept."""
    return _or_empty(spark, lambda: spark.read.schema(KEPT).json(path), KEPT).filter("key <> '' AND response IS NOT NULL")


def write_kept_plans(df: DataFrame, path: str) -> None:
    df.select("id", "key", "query", "query_variations", "response").write.mode("overwrite").json(path)


def report(summary: DataFrame, title: str) -> str:
    """A report of a one-row summary as Markdown."""
    row = summary.limit(1).collect()
    lines = [f"# {title}", "", "| measure | value |", "|---|---|"]
    lines += [f"| {k} | {'n/a' if v is None else v} |" for k, v in (row[0].asDict().items() if row else [])]
    return "\n".join(lines) + "\n"


def write_snapshot(samples: DataFrame, counters: DataFrame, path: str, most: int = C.SNAPSHOT) -> None:
    """The state of the metrics: its counters, and the newest samples that a snapshot keeps (the limit is the feature)."""
    newest(samples, most).write.mode("overwrite").json(f"{path}/samples")
    counters.write.mode("overwrite").json(f"{path}/counters")


def snapshot(spark: SparkSession, path: str, samples: StructType, counters: StructType) -> tuple[DataFrame, DataFrame]:
    """(samples, counters) of a snapshot; empty where there is none."""
    return tuple(_or_empty(spark, lambda n=name, k=kind: spark.read.schema(k).json(f"{path}/{n}"), kind) for name, kind in (("samples", samples), ("counters", counters)))
