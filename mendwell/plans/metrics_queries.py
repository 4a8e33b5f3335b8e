"""Queries over metrics samples and recorded runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import table
from ..functions import constants as C
from ..operators import metrics as M


def _samples(spark, sf_dir):
    return table(spark, sf_dir, "samples")


def _paths(df):
    """Every sample in the path it took and in 'all'."""
    path = F.when(F.coalesce("hit", F.lit(False)), "fast").otherwise("cold")
    return df.select("ms", F.explode(F.array(F.lit("all"), path)).alias("path"))


def latency_percentiles(spark, sf_dir):
    return M.percentiles(_paths(_samples(spark, sf_dir)), ["path"])


def latency_by_client(spark, sf_dir):
    return M.percentiles(_samples(spark, sf_dir).filter("client_key IS NOT NULL"), ["client_key"])


def metrics_summary(spark, sf_dir):
    return M.summary(_samples(spark, sf_dir).withColumn("scope", F.lit("all")), ["scope"])


def hit_rate_by_client(spark, sf_dir):
    return M.summary(_samples(spark, sf_dir), ["client_key"])


def metrics_counters(spark, sf_dir):
    """Recorded runs by how they were answered."""
    r = table(spark, sf_dir, "results")
    return r.groupBy("run").agg(
        F.count("*").alias("requests"), F.count_if(F.col("cache_hit")).alias("cache_hits"), F.count_if(~F.coalesce("cache_hit", F.lit(False))).alias("cold_path"),
        *(F.count_if(F.col("cache_hit") & (F.col("cache_match") == m)).alias(m) for m in ("exact", "variation", "fuzzy")),
        F.count_if(F.col("fallback") == "no_siis_context").alias("no_siis_context"), F.count_if(F.col("fallback") == "no_match").alias("no_match"),
    )


def semantic_hit_rate(spark, sf_dir):
    return table(spark, sf_dir, "results").filter("run = 'paraphrase'").agg(F.count("*").alias("n"), (F.floor(F.avg(F.coalesce("cache_hit", F.lit(False)).cast("double")) * 1000 + 0.5) / 1000).alias("hit_rate"))


def within_budget(spark, sf_dir):
    """Share within the budget of each path, three digits; 1 of an empty one."""
    rows = _paths(_samples(spark, sf_dir)).filter("ms IS NOT NULL")
    return rows.groupBy("path").agg(F.count("*").alias("n"), (F.floor(F.avg((F.col("ms") < C.BUDGET_MS).cast("double")) * 1000 + 0.5) / 1000).alias("within"))


def last_n_samples(spark, sf_dir):
    return M.newest(_samples(spark, sf_dir).select("sample_id", "t", "ms").distinct()).select("sample_id", "t", "ms")


QUERIES = {f.__name__: f for f in (latency_percentiles, latency_by_client, metrics_summary, hit_rate_by_client, metrics_counters, semantic_hit_rate, within_budget, last_n_samples)}

_H = "floor(({}) * 100 + 0.5) / 100"
_PATHS = "(SELECT ms, unnest(['all', CASE WHEN coalesce(hit, FALSE) THEN 'fast' ELSE 'cold' END]) AS path FROM samples)"


def _percentiles(source: str, by: str) -> str:
    at = lambda p: _H.format(f"quantile_disc(ms, {p})")
    return f"SELECT {by}, count(*) AS n, {at(0.5)} AS p50, {at(0.95)} AS p95, {at(0.99)} AS p99, {_H.format('min(ms)')} AS min, {_H.format('max(ms)')} AS max, {_H.format('sum(ms::decimal(20,6))::double / count(*)')} AS mean FROM {source} WHERE ms IS NOT NULL GROUP BY 1"


def _summary(by: str) -> str:
    share = lambda c, of, empty: f"CASE WHEN count(*) FILTER ({of}) = 0 THEN {empty} ELSE {_H.format(f'count(*) FILTER (({of}) AND coalesce({c}, FALSE)) / count(*) FILTER ({of})')} END"
    return f"SELECT {by}, count(*) AS requests, {share('hit', 'TRUE', '0.0')} AS hit_rate, {share('coalesce(contexts, 0) = 0', 'TRUE', '0.0')} AS empty_rate, {share(f'ms < {C.BUDGET_MS}', 'ms IS NOT NULL', '1.0')} AS within_budget FROM samples GROUP BY 1"


SQL = {
    "latency_percentiles": _percentiles(_PATHS, "path"),
    "latency_by_client": _percentiles("(SELECT * FROM samples WHERE client_key IS NOT NULL)", "client_key"),
    "metrics_summary": _summary("'all' AS scope"),
    "hit_rate_by_client": _summary("client_key"),
    "metrics_counters": "SELECT run, count(*) AS requests, count(*) FILTER (cache_hit) AS cache_hits, count(*) FILTER (NOT coalesce(cache_hit, FALSE)) AS cold_path, " + ", ".join(f"count(*) FILTER (cache_hit AND cache_match = '{m}') AS {m}" for m in ("exact", "variation", "fuzzy")) + ", count(*) FILTER (fallback = 'no_siis_context') AS no_siis_context, count(*) FILTER (fallback = 'no_match') AS no_match FROM results GROUP BY 1",
    "semantic_hit_rate": "SELECT count(*) AS n, floor(avg(coalesce(cache_hit, FALSE)::int::double) * 1000 + 0.5) / 1000 AS hit_rate FROM results WHERE run = 'paraphrase'",
    "within_budget": f"SELECT path, count(*) AS n, floor(avg((ms < {C.BUDGET_MS})::int::double) * 1000 + 0.5) / 1000 AS within FROM {_PATHS} WHERE ms IS NOT NULL GROUP BY 1",
    "last_n_samples": f"SELECT sample_id, t, ms FROM (SELECT DISTINCT sample_id, t, ms FROM samples WHERE t IS NOT NULL) ORDER BY t DESC, sample_id DESC LIMIT {C.SAMPLES_KEPT}",
}
