"""Queries over kept plans, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import spread, table
from ..functions import constants as C
from ..functions import text as T
from ..functions.dialect import sql
from ..operators import nested
from ..operators import plan_cache as P
from .plan_sql import PLANS


def _records(spark, sf_dir):
    return table(spark, sf_dir, "cache_records")


def _complaints(spark, sf_dir):
    return spread(table(spark, sf_dir, "complaints").select("complaint_id", "query"))


def _keys(spark, sf_dir):
    return P.keyed(_complaints(spark, sf_dir).select("query"), "query", "key").select("key").filter("key <> ''").distinct()


def cache_entries(spark, sf_dir):
    return P.entries(_records(spark, sf_dir)).select("key", "cache_id", "result_id", "stored_at")


def cache_paraphrases(spark, sf_dir):
    return P.paraphrase_index(_records(spark, sf_dir))


def cache_ttl_live(spark, sf_dir):
    """Alive within the lifetime at the time the last record was stored."""
    kept = P.entries(_records(spark, sf_dir))
    now = F.broadcast(kept.agg(F.max("stored_at").alias("now")))  # one row
    return P.live(kept.crossJoin(now), F.col("now").cast("timestamp")).select("key", "cache_id")


def cache_evict(spark, sf_dir):
    return P.evict(P.entries(_records(spark, sf_dir))).select("key", "cache_id")


def cache_fuzzy(spark, sf_dir):
    return P.fuzzy(_keys(spark, sf_dir), P.entries(_records(spark, sf_dir))).select("key", "kept_key", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))


def cache_cascade(spark, sf_dir):
    return P.lookup(_complaints(spark, sf_dir), _records(spark, sf_dir))


def cache_stats(spark, sf_dir):
    return P.lookup(_complaints(spark, sf_dir), _records(spark, sf_dir)).groupBy("match").agg(F.count("*").alias("n"))


def canonical_collisions(spark, sf_dir):
    keyed = P.frame(_complaints(spark, sf_dir).select("query"), T.canonical("query")).filter("canonical_key <> ''")
    return keyed.groupBy("canonical_key").agg(F.count("*").alias("n"), F.countDistinct("query").alias("n_spellings")).filter("n > 1")


def cache_list(spark, sf_dir):
    """Kept plans with their sample, hits, number of contexts, and age when the last one was stored."""
    records = _records(spark, sf_dir)
    kept = P.entries(records).join(records.select("cache_id", F.col("query").alias("sample"), "hits"), "cache_id")
    n = nested.flat_tables(table(spark, sf_dir, "results"), "result_id", "response")["goal"].groupBy("result_id").agg(F.count("*").alias("contexts"))
    now = F.broadcast(records.filter("cache_key <> ''").agg(F.max("stored_at").alias("now")))  # one row
    age = F.floor((F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("stored_at").cast("timestamp"))) / 1e6 + 0.5).cast("bigint")
    return kept.join(n, "result_id", "left").crossJoin(now).select("key", "sample", F.col("hits").cast("bigint").alias("hits"), F.coalesce("contexts", F.lit(0)).alias("contexts"), age.alias("age_s"))


QUERIES = {f.__name__: f for f in (cache_list, cache_entries, cache_paraphrases, cache_ttl_live, cache_evict, cache_fuzzy, cache_cascade, cache_stats, canonical_collisions)}

_WITH = f"""WITH own AS (SELECT * FROM cache_records WHERE cache_key IS NOT NULL AND cache_key <> ''),
kept AS (SELECT cache_key AS key, arg_max(cache_id, (stored_at, cache_id)) AS cache_id, arg_max((result_id,), (stored_at, cache_id)) AS r, max(stored_at) AS stored_at, min((stored_at, cache_id)) AS seq FROM own GROUP BY 1),
said AS (SELECT cache_id, stored_at, cache_key AS key, unnest(query_variations) AS said, generate_subscripts(query_variations, 1) AS pos FROM own),
idx AS (SELECT vkey, arg_max(key, (stored_at, cache_id, pos)) AS key FROM {sql('said', T.canonical('said', 'vkey'))} WHERE vkey <> '' AND vkey <> key GROUP BY 1),
asked AS (SELECT complaint_id, canonical_key AS key, variations FROM {sql('(SELECT complaint_id, query FROM complaints)', [*T.canonical('query'), *T.variations('query')])} WHERE canonical_key <> ''),
a AS (SELECT key, list_distinct(content) AS ts FROM {sql('(SELECT DISTINCT key FROM asked)', T.content_tokens('key', 'content'))}),
b AS (SELECT key AS kept_key, seq, list_distinct(content) AS us FROM {sql('(SELECT key, seq FROM kept)', T.content_tokens('key', 'content'))}),
pairs AS (SELECT key, kept_key, seq, len(ts) AS n, len(us) AS m, len(list_intersect(ts, us)) AS i FROM a, b WHERE len(ts) >= 2 AND len(us) >= 1 AND list_has_any(ts, us)),
near AS (SELECT key, kept_key, seq, greatest(i / (n + m - i), CASE WHEN i / least(n, m) >= {C.CONTAINED} AND i >= {C.CONTAINED_TOKENS} THEN i / least(n, m) ELSE 0 END) AS score FROM pairs),
fuzzy AS (SELECT key, kept_key, score FROM near WHERE score >= {C.FUZZY} QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, seq) = 1),
mine AS (SELECT complaint_id, pos, vkey FROM {sql('(SELECT complaint_id, unnest(variations) AS said, generate_subscripts(variations, 1) AS pos FROM asked)', T.canonical('said', 'vkey'))}),
hits AS (SELECT complaint_id, 1 AS step, 0 AS pos, key AS kept_key FROM asked JOIN kept USING (key)
  UNION ALL SELECT complaint_id, 2, 0, idx.key FROM asked JOIN idx ON asked.key = vkey JOIN kept ON kept.key = idx.key
  UNION ALL SELECT complaint_id, 3, pos * 2, vkey FROM mine JOIN kept ON kept.key = vkey
  UNION ALL SELECT complaint_id, 3, pos * 2 + 1, idx.key FROM mine JOIN idx USING (vkey) JOIN kept ON kept.key = idx.key
  UNION ALL SELECT complaint_id, 4, 0, kept_key FROM asked JOIN fuzzy USING (key)),
firsts AS (SELECT complaint_id, min((step, pos, kept_key)) AS hit FROM hits GROUP BY 1),
answers AS (SELECT complaint_id, asked.key AS canonical_key, CASE hit[1] WHEN 1 THEN 'exact' WHEN 2 THEN 'variation' WHEN 3 THEN 'variation' WHEN 4 THEN 'fuzzy' ELSE 'miss' END AS match, hit[3] AS kept_key FROM asked LEFT JOIN firsts USING (complaint_id))"""
SQL = {
    "cache_list": PLANS + ", " + _WITH.removeprefix("WITH ") + " SELECT key, c.query AS sample, c.hits::bigint AS hits, coalesce(n.contexts, 0) AS contexts, floor((epoch_us((SELECT max(stored_at) FROM kept)) - epoch_us(kept.stored_at)) / 1e6 + 0.5)::bigint AS age_s FROM kept JOIN cache_records c USING (cache_id) LEFT JOIN (SELECT result_id, count(*) AS contexts FROM goals GROUP BY 1) n ON n.result_id = kept.r[1]",
    "cache_entries": _WITH + " SELECT key, cache_id, r[1] AS result_id, stored_at FROM kept",
    "cache_paraphrases": _WITH + " SELECT vkey, key FROM idx",
    "cache_ttl_live": _WITH + f" SELECT key, cache_id FROM kept WHERE epoch_us((SELECT max(stored_at) FROM kept)) - epoch_us(stored_at) <= {C.LIFETIME_S * 1000000}",
    "cache_evict": _WITH + f" SELECT key, cache_id FROM kept ORDER BY stored_at DESC, seq DESC LIMIT {C.KEPT}",
    "cache_fuzzy": _WITH + " SELECT key, kept_key, floor(score * 1e6 + 0.5) / 1e6 AS score FROM fuzzy",
    "cache_cascade": _WITH + " SELECT complaint_id, canonical_key, match, kept_key, cache_id FROM answers LEFT JOIN (SELECT key AS kept_key, cache_id FROM kept) USING (kept_key)",
    "cache_stats": _WITH + " SELECT match, count(*) AS n FROM answers GROUP BY 1",
    "canonical_collisions": f"SELECT canonical_key, count(*) AS n, count(DISTINCT query) AS n_spellings FROM {sql('(SELECT query FROM complaints)', T.canonical('query'))} WHERE canonical_key <> '' GROUP BY 1 HAVING count(*) > 1",
}
