"""Search and mapping queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import cut, spread, table
from ..functions import constants as C
from ..functions import text as T
from ..functions.dialect import Checker, sql
from ..operators import nested, pipeline
from ..operators import retrieval as R
from .extraction_queries import WITH as ARTICLES
from .plan_sql import PLANS

K = Checker()
_R6 = "floor({} * 1e6 + 0.5) / 1e6"


# ---------------------------------------------------------------- SQL pieces


def _terms(source: str, key: str, text: str) -> str:
    return f"(SELECT {key}, terms FROM {sql(f'(SELECT {key}, {text} AS t0 FROM {source})', T.tokens('t0'))})"


def _index(docs: str, key: str) -> str:
    """docs: a table with (key, text)."""
    return f"""lists AS (SELECT * FROM {_terms(docs, key, 'text')}),
posts AS (SELECT {key}, term, count(*) AS tf, any_value(n) AS len FROM (SELECT {key}, len(terms) AS n, unnest(terms) AS term FROM lists) GROUP BY 1, 2),
freq AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
tot AS (SELECT count(*) AS n_docs, coalesce(avg(len(terms)), 0.0) AS avg_len FROM lists)"""


def _bm25(queries: str, q: str, key: str) -> str:
    return f"""qlists AS (SELECT {q}, {K.distinct('terms')} AS ts FROM {_terms(queries, q, 'text')}),
qt AS (SELECT {q}, ord, term, coalesce(df, 0) AS df, ln(1 + (n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM (SELECT {q}, unnest(ts) AS term, generate_subscripts(ts, 1) AS ord FROM qlists) LEFT JOIN freq USING (term) CROSS JOIN tot),
whole AS (SELECT {q}, sum(idf) AS all_idf FROM qt GROUP BY 1),
lex AS (SELECT {q}, {key}, sum(idf * (tf * {C.K1 + 1}) / (tf + {C.K1} * (1 - {C.B} + {C.B} * (len / avg_len)))) AS bm25, sum(idf) AS held, min(ord) AS first_ord FROM qt JOIN posts USING (term) CROSS JOIN tot GROUP BY 1, 2),
lexical AS (SELECT {q}, {key}, bm25, held / all_idf AS coverage, first_ord FROM lex JOIN whole USING ({q}))"""


def _buckets(name: str, source: str, key: str) -> str:
    grams = " UNION ALL ".join(f"SELECT {key}, substr(s, i, {n}) AS gram FROM (SELECT {key}, s, unnest(range(1, greatest(length(s) - {n - 1}, 1) + 1)) AS i FROM {name}_s)" for n in range(C.GRAMS[0], C.GRAMS[1] + 1))
    plain = K.concat("' '", T.trim(K, K.replace("lower(coalesce(text, ''))", "[^a-z0-9]+", " ")), "' '")
    fold = f"list_reduce(list_concat([453], list_transform(string_split(gram, ''), lambda c: ascii(c))), lambda h, c: (xor(h, c) * 403) & {C.BUCKETS - 1})"
    return f"""{name}_s AS (SELECT {key}, {plain} AS s FROM {source}),
{name}_c AS (SELECT {key}, {fold} AS bucket, count(*)::double AS c FROM ({grams}) WHERE length(gram) >= {C.GRAMS[0]} AND length(trim(gram)) >= 2 GROUP BY 1, 2),
{name} AS (SELECT {key}, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS w FROM {name}_c)"""


def _search(docs: str, key: str, queries: str, q: str, k: int, alpha: float, leaf: str = "") -> str:
    own = "" if not leaf else f"""
leaf_lists AS (SELECT {q}, {K.distinct('terms')} AS ts FROM {_terms(queries, q, leaf)}),
leaf_idf AS (SELECT {q}, term, ln(1 + (n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM (SELECT {q}, unnest(ts) AS term FROM leaf_lists) LEFT JOIN freq USING (term) CROSS JOIN tot),
leaf_cov AS (SELECT {q}, {key}, sum(idf) / any_value(whole) AS coverage FROM (SELECT *, sum(idf) OVER (PARTITION BY {q}) AS whole FROM leaf_idf) JOIN posts USING (term) GROUP BY 1, 2),"""
    cov = "coalesce(coverage, 0.0)" if not leaf else "coalesce(leaf_cov.coverage, 0.0)"
    join = "" if not leaf else f" LEFT JOIN leaf_cov USING ({q}, {key})"
    return f"""{_index(docs, key)},{own}
{_bm25(queries, q, key)},
{_buckets('dvec', docs, key)},
{_buckets('qvec', queries, q)},
near AS (SELECT {q}, {key}, sum(a.w * b.w) AS dense FROM qvec a JOIN dvec b USING (bucket) GROUP BY 1, 2),
counted AS (SELECT {q}, count({key}) AS n FROM (SELECT DISTINCT {q} FROM qt) LEFT JOIN lexical USING ({q}) GROUP BY 1),
pool AS (SELECT {q}, {key} FROM counted, (SELECT {key} FROM {docs}) WHERE n < {C.WIDEN} UNION ALL SELECT {q}, {key} FROM counted JOIN lexical USING ({q}) WHERE n >= {C.WIDEN}),
scored AS (SELECT {q}, {key}, coalesce(bm25 / greatest(max(bm25) OVER (PARTITION BY {q}), 1e-9), 0.0) AS keyword, coalesce(dense, 0.0) AS dense, {cov} AS coverage, first_ord FROM pool LEFT JOIN lexical USING ({q}, {key}) LEFT JOIN near USING ({q}, {key}){join}),
hits AS (SELECT *, {alpha} * keyword + {1 - alpha} * dense AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {q} ORDER BY floor(score * 1e9 + 0.5) / 1e9 DESC, first_ord ASC NULLS LAST, {key}) AS rank FROM hits QUALIFY rank <= {k})"""


_CATALOG = "catalog AS (SELECT link_id AS doc_id, concat_ws(' . ', nullif(description, ''), nullif(message, ''), nullif(qna_description, '')) AS text, original_type AS kind, message, description, deeplink FROM deeplinks WHERE deeplink IS NOT NULL)"
_TITLES = "titles AS (SELECT DISTINCT title AS q, title AS text FROM siis_responses WHERE title IS NOT NULL)"


def _catalog(spark, sf_dir):
    return R.catalog_text(table(spark, sf_dir, "deeplinks"))


def _titles(spark, sf_dir):
    return table(spark, sf_dir, "siis_responses").filter("title IS NOT NULL").select(F.col("title").alias("q"), F.col("title").alias("text")).distinct()


# ------------------------------------------------------------------- queries


def term_freq(spark, sf_dir):
    return R.postings(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "term", "tf")


def doc_freq(spark, sf_dir):
    return R.frequencies(R.postings(table(spark, sf_dir, "documents"), "doc_id", "text"))


def avg_doc_len(spark, sf_dir):
    return R.totals(table(spark, sf_dir, "documents"), "doc_id", "text").select("n_docs", R.rounded(F.col("avg_len")).alias("avg_len"))


def bm25_topk(spark, sf_dir):
    """The five best documents for each held-out passage."""
    hits = R.bm25_best(table(spark, sf_dir, "benchmark"), "item_id", spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", 5)
    return hits.select("item_id", "doc_id", R.rounded(F.col("bm25")).alias("bm25"), R.rounded(F.col("coverage")).alias("coverage"), F.col("rank").cast("bigint").alias("rank"))


def _shown(df):
    return df.select("q", "doc_id", *(R.rounded(F.col(x)).alias(x) for x in ("score", "keyword", "dense", "coverage")), F.col("rank").cast("bigint").alias("rank"))


def hybrid_topk(spark, sf_dir):
    return _shown(R.search(_titles(spark, sf_dir), "q", _catalog(spark, sf_dir), "doc_id", 5))


def keyword_mode_topk(spark, sf_dir):
    return _shown(R.search(_titles(spark, sf_dir), "q", _catalog(spark, sf_dir), "doc_id", 5, 1.0))


def gram_buckets(spark, sf_dir):
    return R.buckets(table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", F.col("bucket").cast("bigint").alias("bucket"), R.rounded(F.col("w")).alias("w"))


def dense_cosine(spark, sf_dir):
    """The five catalog entries nearest to each passage by their n-grams."""
    near = R.nearest(R.dense_vectors(table(spark, sf_dir, "benchmark"), "item_id", "text"), "item_id", R.dense_vectors(_catalog(spark, sf_dir), "doc_id", "text"), "doc_id", 5)
    return near.select("item_id", "doc_id", F.col("cosine").alias("dense"), "rank")


def _groups(spark, sf_dir):
    """(gid, steps, action_name, category, ordinals): the step groups of all recorded plans."""
    flat = nested.flat_tables(table(spark, sf_dir, "results"), "result_id", "response")
    ids = ["result_id", "context_no", "action_no"]
    steps = flat["step"].groupBy(*ids, "group_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_no", "step"))), lambda x: x["step"]).alias("steps"))
    acts = flat["action"].select(*ids, F.col("actionName").alias("action_name"), "category")
    return steps.join(acts, ids, "left").withColumn("gid", F.concat_ws("-", "result_id", "context_no", "action_no", "group_no"))


def _resolved(spark, sf_dir, mode="hybrid"):
    """Groups of equal steps and action are resolved once."""
    groups = cut(_groups(spark, sf_dir).select("gid", "steps", "action_name", "category"))
    alike = groups.select("steps", "action_name").distinct().withColumn("key", F.sha2(F.to_json(F.struct("steps", "action_name")), 256))
    done = R.resolve(alike.select(F.col("key").alias("gid"), "steps", "action_name"), table(spark, sf_dir, "deeplinks"), mode).withColumnRenamed("gid", "key")
    return groups.withColumn("key", F.sha2(F.to_json(F.struct("steps", "action_name")), 256)).join(done, "key")


_SHOWN = ("gid", "reason", "polarity", "on_settings", "target", "doc_id", "coverage", "dense", "message_match")


def screen_trail(spark, sf_dir):
    g = R.frame(_groups(spark, sf_dir).select("gid", "steps", "action_name"), R.TRAIL)
    return g.select("gid", F.array_join("candidates", " | ").alias("candidates"), "polarity", "on_settings")


def resolve_screen(spark, sf_dir):
    return _resolved(spark, sf_dir).select(*_SHOWN)


def resolve_screen_keyword(spark, sf_dir):
    return _resolved(spark, sf_dir, "keyword").select(*_SHOWN)


def _decided(spark, sf_dir, mode="hybrid"):
    return R.mapped(_resolved(spark, sf_dir, mode), table(spark, sf_dir, "deeplinks"))


def map_deeplinks(spark, sf_dir):
    """What each group of steps gets: the entry's link, texts and type, and the link that checks it with its four fields; the placeholder's; or nothing."""
    return _decided(spark, sf_dir).select("gid", "decision", "deeplink", F.col("link_description").alias("description"), F.col("link_message").alias("message"), F.col("link_type").alias("original_type"), *R.CHECKS)


def map_report(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("n"))


def ablation(spark, sf_dir):
    both = [_decided(spark, sf_dir, m).withColumn("mode", F.lit(m)) for m in ("hybrid", "keyword")]
    return both[0].unionByName(both[1]).groupBy("mode", "decision").agg(F.count("*").alias("n"))


def screen_phrase(spark, sf_dir):
    """The way to a screen as one phrase: what is passed on the way, and the screen that is tried first."""
    g = R.frame(_groups(spark, sf_dir).select("gid", "steps", "action_name"), R.TRAIL)
    passed = F.array_join(F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0))), " ")
    return g.select("gid", F.when(F.size("parts") > 0, F.trim(F.concat_ws(" ", F.nullif(passed, F.lit("")), F.get("reversed", F.lit(0))))).alias("phrase"))


def embedding_cosine_topk(spark, sf_dir):
    """The five nearest other vectors by cosine; the queries are the vectors whose id is divisible by 20, the index all of them."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return R.nearest(e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "q"), "q", e, "vec_id", 5, same=True)


def troubleshoot(spark, sf_dir):
    """The whole way for each article and the question it was fetched for."""
    return pipeline.troubleshoot(spread(table(spark, sf_dir, "siis_responses").select("siis_id", "original_query", "title", "content")), table(spark, sf_dir, "deeplinks"))


def troubleshoot_plan(spark, sf_dir):
    """The plans of the answered articles as flat rows: one for each group of steps."""
    a = spread(table(spark, sf_dir, "siis_responses").select("siis_id", "original_query", "title", "content"))
    outcomes, groups = pipeline.planned(a, table(spark, sf_dir, "deeplinks"))
    rows = groups.join(outcomes.filter("outcome = 'answered'").select("siis_id"), "siis_id")
    return rows.select("siis_id", "action_no", "group_no", "action_name", "description", "category", F.array_join("steps", " | ").alias("steps"), "decision", "deeplink", "link_message", *R.CHECKS)


QUERIES = {f.__name__: f for f in (troubleshoot, troubleshoot_plan, embedding_cosine_topk, term_freq, doc_freq, avg_doc_len, bm25_topk, hybrid_topk, keyword_mode_topk, gram_buckets, dense_cosine, screen_trail, resolve_screen, resolve_screen_keyword, map_deeplinks, map_report, ablation, screen_phrase)}

_GROUPS = f"""{PLANS},
groups AS (SELECT concat_ws('-', s.result_id, s.context_no, s.action_no, s.group_no) AS gid, s.steps, a.v->>'$.actionName' AS name1, a.v->>'$.action_name' AS name2, a.v->>'$.category' AS category
  FROM (SELECT result_id, context_no, action_no, group_no, list(v->>'$' ORDER BY step_no) AS steps FROM stps GROUP BY ALL) s LEFT JOIN acts a USING (result_id, context_no, action_no)),
named AS (SELECT gid, steps, coalesce(name1, name2) AS action_name, category, '' AS context FROM groups),
trails AS (SELECT * FROM {sql('named', R.TRAIL)})"""


def _resolve(mode: str, groups: str = "") -> str:
    """groups: CTEs ending in named (gid, steps, action_name, category, context) and trails, instead of the recorded plans'."""
    alpha, open_gate = (1.0, "TRUE") if mode == "keyword" else (C.ALPHA, "FALSE")
    strip = K.replace("coalesce(message, '')", C.NAME_VERBS).replace(", 'g')", ")")
    return f"""{groups or _GROUPS},
{_CATALOG},
listed AS (SELECT gid, context, polarity, len(candidates) AS n_candidates, unnest(candidates) AS leaf, generate_subscripts(candidates, 1) AS depth FROM trails),
able AS (SELECT *, lower(leaf) AS folded, depth = n_candidates AS from_topic FROM {sql('listed', T.usable_target('leaf'))} WHERE usable),
usable AS (SELECT u.*, coalesce(u.folded = t.topic, FALSE) AS is_topic FROM (SELECT * FROM able QUALIFY row_number() OVER (PARTITION BY gid, folded ORDER BY depth) = 1) u LEFT JOIN (SELECT gid, folded AS topic FROM able WHERE from_topic) t USING (gid)),
asks AS (SELECT leaf, context, row_number() OVER () AS ask, trim(concat_ws(' ', leaf, context)) AS text FROM (SELECT DISTINCT leaf, context FROM usable)),
leaves AS (SELECT DISTINCT leaf FROM usable),
{_search('catalog', 'doc_id', 'asks', 'ask', 6, alpha, 'leaf')},
names AS (SELECT doc_id, kind, name_terms FROM {sql(f'(SELECT doc_id, kind, {strip} AS screen FROM catalog)', R.collapsed('screen', 'name_terms'))}),
leafs AS (SELECT leaf, leaf_terms FROM {sql('leaves', R.collapsed('leaf', 'leaf_terms'))}),
cand AS (SELECT gid, depth, leaf, polarity, doc_id, coverage, dense, rank, {R.name_match(K)} AS message_match,
  score + CASE WHEN kind = CASE polarity WHEN 'on' THEN 'onURL' WHEN 'off' THEN 'offURL' ELSE 'onClickURL' END THEN 0.12 WHEN polarity <> 'open' AND kind = 'onClickURL' THEN 0.04 WHEN polarity <> 'open' AND kind IN ('onURL', 'offURL') THEN -0.08 ELSE 0 END AS adjusted
  FROM usable JOIN asks USING (leaf, context) JOIN ranked USING (ask) JOIN names USING (doc_id) JOIN leafs USING (leaf) WHERE NOT is_topic OR polarity <> 'open' OR kind = 'onClickURL'),
gated AS (SELECT *, coverage >= {C.COVERAGE} AND ({open_gate} OR dense >= {C.DENSE}) AND message_match >= {C.MESSAGE} AS passes FROM cand),
tops AS (SELECT * FROM gated QUALIFY row_number() OVER (PARTITION BY gid, depth ORDER BY passes DESC, floor(adjusted * 1e9 + 0.5) / 1e9 DESC, rank) = 1),
chosen AS (SELECT * FROM tops QUALIFY row_number() OVER (PARTITION BY gid ORDER BY passes DESC, CASE WHEN passes THEN 0 ELSE -floor(coverage * message_match * 1e9 + 0.5) / 1e9 END, depth) = 1),
resolved AS (SELECT t.gid, t.category, CASE WHEN h.gid IS NULL THEN CASE WHEN len(parts) > 0 THEN 'no-usable-target' ELSE 'no-screen-in-steps' END WHEN c.gid IS NULL THEN 'no-candidates' WHEN passes THEN 'matched' ELSE 'below-threshold' END AS reason,
  t.polarity, t.on_settings, c.leaf AS target, CASE WHEN passes THEN c.doc_id END AS doc_id, {_R6.format('coverage')} AS coverage, {_R6.format('dense')} AS dense, {_R6.format('message_match')} AS message_match
  FROM trails t LEFT JOIN (SELECT DISTINCT gid FROM usable) h USING (gid) LEFT JOIN chosen c USING (gid)),
decided AS (SELECT *, CASE WHEN coalesce(category, 'manual') = 'manual' THEN 'manual-no-deeplink' WHEN reason = 'matched' THEN 'matched' WHEN reason = 'below-threshold' AND on_settings AND ph_deeplink IS NOT NULL THEN 'placeholder' ELSE 'no-match' END AS decision
  FROM resolved LEFT JOIN (SELECT deeplink AS ph_deeplink, coalesce(original_type, 'placeholder') AS ph_type FROM deeplinks WHERE contains(deeplink, 'dummy_positive') ORDER BY link_id LIMIT 1) ON TRUE)"""


_ASKED = f"""{ARTICLES},
questions AS (SELECT * FROM {sql('(SELECT siis_id, original_query, title, content FROM siis_responses)', [('query', lambda d: T.scrub(d, T.spaces(d, 'original_query')))])}),
own AS (SELECT siis_id, section_no, group_no, list(step ORDER BY step_no) AS steps FROM grouped GROUP BY 1, 2, 3),
named AS (SELECT concat_ws('-', siis_id, section_no, group_no::bigint) AS gid, siis_id, steps, action_name, category, query AS context FROM own JOIN actions USING (siis_id, section_no) JOIN (SELECT siis_id, query FROM questions) USING (siis_id)),
trails AS (SELECT * FROM {sql('named', R.TRAIL)})"""
_SHARED = f"""{_resolve('hybrid', _ASKED)},
tallied AS (SELECT siis_id, count(*) AS n_groups, sum(len(steps))::bigint AS n_steps, count(*) FILTER (d.category <> 'manual') AS n_auto, count(*) FILTER (decision = 'matched') AS n_matched, count(*) FILTER (decision = 'placeholder') AS n_placeholder FROM named n JOIN decided d USING (gid) GROUP BY 1),
acted AS (SELECT siis_id, count(*) AS n_actions FROM actions GROUP BY 1),
outcomes AS (SELECT * FROM {sql('(SELECT q.*, n_actions, n_groups, n_steps, n_auto, n_matched, n_placeholder FROM questions q LEFT JOIN acted USING (siis_id) LEFT JOIN tallied USING (siis_id))', [*pipeline.OUTCOME, ('qs', lambda d: d.distinct(pipeline.overlap_words(d, 'query'))), ('ts', lambda d: d.distinct(pipeline.overlap_words(d, 'title')))])})"""
_TOP = f"SELECT q, doc_id, {', '.join(f'{_R6.format(x)} AS {x}' for x in ('score', 'keyword', 'dense', 'coverage'))}, rank FROM ranked"
_ENTRY_TEXTS = f"""entry_texts AS (SELECT * FROM {sql('(SELECT link_id, deeplink, original_type, description, message, validation_deeplink, validation_key, validation_result_type, validation_condition, validation_value FROM deeplinks)', [('own_description', lambda d: T.scrub(d, "coalesce(description, '')")), ('own_message', lambda d: T.scrub(d, "coalesce(message, '')"))])})"""
_CHECK_FIELDS = ", ".join(f"CASE WHEN decision = 'matched' AND validation_deeplink IS NOT NULL THEN {c} END AS {c}" for c in R.CHECKS)
_IF = lambda x: f"CASE WHEN outcome = 'answered' THEN {x} END"
SQL = {
    "troubleshoot": f"{_SHARED} SELECT siis_id, outcome, {', '.join(f'{_IF(x)} AS {x}' for x in ('goal_text', 'title_text', 'n_actions', 'n_groups', 'n_steps', 'n_matched', 'n_placeholder'))}, {_IF('greatest(0.05, least(0.99, floor((0.45 * CASE WHEN n_auto = 0 THEN 1.0 ELSE n_matched / n_auto END + 0.30 * least(1.0, n_steps / 8) + 0.25 * CASE WHEN len(qs) = 0 OR len(ts) = 0 THEN 0.4 ELSE len(list_intersect(qs, ts)) / len(ts) END) * 100 + 0.5) / 100))::double')} AS score FROM outcomes",
    "troubleshoot_plan": f"""{_SHARED}, {_ENTRY_TEXTS},
      mine AS (SELECT n.gid, n.siis_id, split_part(n.gid, '-', 2)::bigint AS section_no, split_part(n.gid, '-', 3)::bigint AS group_no, n.steps FROM named n JOIN outcomes o USING (siis_id) WHERE o.outcome = 'answered')
      SELECT m.siis_id, a.action_no, m.group_no, a.action_name, a.description, a.category, array_to_string(m.steps, ' | ') AS steps, d.decision, CASE decision WHEN 'matched' THEN t.deeplink WHEN 'placeholder' THEN ph_deeplink END AS deeplink,
      CASE decision WHEN 'matched' THEN own_message WHEN 'placeholder' THEN substr('Open ' || coalesce(target, 'Settings'), 1, 60) END AS link_message, {_CHECK_FIELDS}
      FROM mine m JOIN decided d USING (gid) JOIN actions a USING (siis_id, section_no) LEFT JOIN entry_texts t ON t.link_id = d.doc_id""",
    "embedding_cosine_topk": f"""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::double AS x FROM embeddings), w AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM e GROUP BY 1), u AS (SELECT vec_id, dim, x / norm AS x FROM e JOIN w USING (vec_id)),
      near AS (SELECT a.vec_id AS q, b.vec_id, {_R6.format('sum(a.x * b.x)')} AS cosine FROM u a JOIN u b USING (dim) WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, vec_id) AS rank FROM near QUALIFY rank <= 5""",
    "term_freq": f"WITH {_index('documents', 'doc_id')} SELECT doc_id, term, tf FROM posts",
    "doc_freq": f"WITH {_index('documents', 'doc_id')} SELECT * FROM freq",
    "avg_doc_len": f"WITH {_index('documents', 'doc_id')} SELECT n_docs, {_R6.format('avg_len')} AS avg_len FROM tot",
    "bm25_topk": f"WITH {_index('documents', 'doc_id')}, {_bm25('benchmark', 'item_id', 'doc_id')} SELECT item_id, doc_id, {_R6.format('bm25')} AS bm25, {_R6.format('coverage')} AS coverage, row_number() OVER (PARTITION BY item_id ORDER BY floor(bm25 * 1e9 + 0.5) / 1e9 DESC, first_ord, doc_id) AS rank FROM lexical QUALIFY rank <= 5",
    "hybrid_topk": f"WITH {_CATALOG}, {_TITLES}, {_search('catalog', 'doc_id', 'titles', 'q', 5, C.ALPHA)} {_TOP}",
    "keyword_mode_topk": f"WITH {_CATALOG}, {_TITLES}, {_search('catalog', 'doc_id', 'titles', 'q', 5, 1.0)} {_TOP}",
    "gram_buckets": f"WITH {_buckets('v', 'benchmark', 'item_id')} SELECT item_id, bucket::bigint AS bucket, {_R6.format('w')} AS w FROM v",
    "dense_cosine": f"WITH {_CATALOG}, {_buckets('a', 'benchmark', 'item_id')}, {_buckets('b', 'catalog', 'doc_id')}, near AS (SELECT i.item_id, c.doc_id, {_R6.format('coalesce(sum(a.w * b.w), 0)')} AS dense FROM (SELECT DISTINCT item_id FROM a) i CROSS JOIN (SELECT DISTINCT doc_id FROM b) c LEFT JOIN a ON a.item_id = i.item_id LEFT JOIN b ON b.doc_id = c.doc_id AND b.bucket = a.bucket GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dense DESC, doc_id) AS rank FROM near QUALIFY rank <= 5",
    "screen_trail": f"{_GROUPS} SELECT gid, array_to_string(candidates, ' | ') AS candidates, polarity, on_settings FROM trails",
    "resolve_screen": f"{_resolve('hybrid')} SELECT {', '.join(_SHOWN)} FROM resolved",
    "resolve_screen_keyword": f"{_resolve('keyword')} SELECT {', '.join(_SHOWN)} FROM resolved",
    "map_deeplinks": f"""{_resolve('hybrid')}, {_ENTRY_TEXTS}
      SELECT gid, decision, CASE decision WHEN 'matched' THEN t.deeplink WHEN 'placeholder' THEN ph_deeplink END AS deeplink,
      CASE decision WHEN 'matched' THEN own_description WHEN 'placeholder' THEN 'Open ' || coalesce(target, 'the relevant') || ' settings on the device' END AS description,
      CASE decision WHEN 'matched' THEN own_message WHEN 'placeholder' THEN substr('Open ' || coalesce(target, 'Settings'), 1, 60) END AS message,
      CASE decision WHEN 'matched' THEN original_type WHEN 'placeholder' THEN ph_type END AS original_type,
      {_CHECK_FIELDS}
      FROM decided LEFT JOIN entry_texts t ON t.link_id = decided.doc_id""",
    "screen_phrase": f"{_GROUPS} SELECT gid, CASE WHEN len(parts) > 0 THEN trim(concat_ws(' ', nullif(array_to_string(parts[1:len(parts) - 1], ' '), ''), array_to_string(string_split_regex(parts[-1], '\\s+')[1:4], ' '))) END AS phrase FROM trails",
    "map_report": f"{_resolve('hybrid')} SELECT decision, count(*) AS n FROM decided GROUP BY 1",
    "ablation": " UNION ALL ".join(f"SELECT * FROM ({_resolve(m)} SELECT '{m}' AS mode, decision, count(*) AS n FROM decided GROUP BY 1, 2)" for m in ("hybrid", "keyword")),
}
