"""Queries of the text functions: each is one program of stages, rendered for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..cluster import spread, table
from ..functions import text as T
from ..functions.dialect import Checker, Spark, Stage, frame, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, source: str, columns: str, stages: list[Stage], out: dict) -> None:
    """out: result column -> stage or input column, or an expression of a dialect."""
    show = lambda d: [f"{x(d) if callable(x) else x} AS {alias}" for alias, x in out.items()]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frame(spread(table(spark, sf_dir, source).selectExpr(*columns.split(", "))), stages).selectExpr(*show(Spark()))

    QUERIES[name] = query
    SQL[name] = f"SELECT {', '.join(show(Checker()))} FROM {sql(f'(SELECT {columns} FROM {source})', stages)}"


COMPLAINT = ("complaints", "complaint_id, query")
ARTICLE = ("siis_responses", "siis_id, original_query, title, content")

register("scrub_urls", *ARTICLE, [("clean", lambda d: T.scrub(d, T.spaces(d, "content")))], {"siis_id": "siis_id", "clean": "clean"})
register("contains_url", "documents", "doc_id, text", [("flat", lambda d: T.spaces(d, "text"))], {"doc_id": "doc_id", "has_url": lambda d: T.contains_url(d, "flat"), "word_count": lambda d: T.word_count(d, "flat")})
register("canonical_key", *COMPLAINT, T.canonical("query"), {"complaint_id": "complaint_id", "canonical_key": "canonical_key"})
register("content_tokens", *COMPLAINT, [*T.canonical("query"), *T.content_tokens("canonical_key")], {"complaint_id": "complaint_id", "content_tokens": lambda d: d.join("content_tokens"), "n_tokens": lambda d: d.size("content_tokens")})
register("symptom_core", *COMPLAINT, [("base", lambda d: T.scrub(d, T.spaces(d, "query"))), *T.symptom("base")], {"complaint_id": "complaint_id", "symptom": "symptom"})
register("keywords", *COMPLAINT, [("base", lambda d: T.scrub(d, T.spaces(d, "query"))), *T.keywords("base")], {"complaint_id": "complaint_id", "keywords": "keywords"})
register("typo_variant", *COMPLAINT, [("base", lambda d: T.scrub(d, T.spaces(d, "query"))), *T.typo("base")], {"complaint_id": "complaint_id", "typo": "typo"})
register("variations", *COMPLAINT, T.variations("query"), {"complaint_id": "complaint_id", "variations": lambda d: d.join("variations", " | "), "n_variations": lambda d: d.size("variations")})
register("variation_validity", *COMPLAINT, T.variations("query"), {
    "complaint_id": "complaint_id",
    "valid": lambda d: f"({d.size('variations')} BETWEEN 8 AND 10 AND {d.size(d.keep('variations', lambda e: f"{T.trim(d, e)} = '' OR {T.contains_url(d, e)}"))} = 0 AND {d.size(d.distinct_folded('variations'))} = {d.size('variations')})",
})
register("join_key", *COMPLAINT, [("norm", lambda d: T.trim(d, d.replace(d.replace(f"lower({T.spaces(d, 'query')})", r"^\s*\d+[.)]\s*"), "[^a-z0-9]+", " ")))], {"complaint_id": "complaint_id", "norm": "norm"})
register("numbering_strip", *COMPLAINT, [("strict", lambda d: T.trim(d, d.replace(T.spaces(d, "query"), r"^\s*\d+[.)]\s*"))), ("weak", lambda d: T.trim(d, d.replace(T.spaces(d, "query"), r"^\s*\d+\.\s*")))], {"complaint_id": "complaint_id", "strict": "strict", "weak": "weak"})
register("title_built", *ARTICLE, T.title("title"), {"siis_id": "siis_id", "title_built": "title_built", "valid": lambda d: T.valid_title(d, "title_built")})
register("topic", *ARTICLE, T.topic("title"), {"siis_id": "siis_id", "topic": "topic"})
register("goal_sentence", *ARTICLE, [*T.topic("title"), *T.goal("topic")], {"siis_id": "siis_id", "goal_built": "goal_built", "valid": lambda d: T.valid_goal(d, "goal_built")})
register("action_name", *ARTICLE, T.action_name("original_query"), {"siis_id": "siis_id", "action_name": "action_name", "valid": lambda d: T.valid_action_name(d, "action_name")})
register("description_built", *ARTICLE, T.description("title"), {"siis_id": "siis_id", "description_built": "description_built", "valid": lambda d: T.valid_description(d, "description_built")})
register("repair_description", "deeplinks", "link_id, description", [
    ("ok", lambda d: T.valid_description(d, T.spaces(d, "description"))),
    ("stripped", lambda d: d.replace(T.spaces(d, "description"), r"(?i)^\s*it\s+will\s*")), *T.description("stripped"),
], {"link_id": "link_id", "repaired": "CASE WHEN ok THEN description ELSE description_built END"})
register("search_terms", "deeplinks", "link_id, description", T.tokens("description"), {"link_id": "link_id", "terms": lambda d: d.join("terms")})
register("usable_target", "deeplinks", "link_id, message", T.usable_target("coalesce(message, '')"), {"link_id": "link_id", "usable": "usable"})
