"""Queries over recorded plans: order, scores, rules, tallies; and pairing, history and search. With their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..cluster import table
from ..functions import constants as C
from ..functions import text as T
from ..functions.dialect import Checker, frame, sql
from ..operators import nested
from ..operators import plan_rules as R
from .plan_sql import PLANS

K = Checker()


def _flat(spark, sf_dir):
    return nested.flat_tables(table(spark, sf_dir, "results"), "result_id", "response")


def _uris(spark, sf_dir):
    links = table(spark, sf_dir, "deeplinks")
    return links.select(F.col("deeplink").alias("uri")).union(links.select("validation_deeplink")).filter("uri IS NOT NULL").distinct()


def uri_union(spark, sf_dir):
    return _uris(spark, sf_dir)


def _used(spark, sf_dir):
    g = _flat(spark, sf_dir)["group"]
    return g.select(*R.GROUP, F.explode(F.array("actionableDeeplink_deeplink", "validationDeeplink_deeplink")).alias("uri")).filter("uri IS NOT NULL")


def uri_semi(spark, sf_dir):
    """Recorded links that the catalog has."""
    return _used(spark, sf_dir).join(_uris(spark, sf_dir), "uri", "left_semi").groupBy("uri").agg(F.count("*").alias("n"))


def uri_anti(spark, sf_dir):
    """Recorded links that it hasn't."""
    return _used(spark, sf_dir).join(_uris(spark, sf_dir), "uri", "left_anti").groupBy("uri").agg(F.count("*").alias("n"))


def order_actions(spark, sf_dir):
    return R.in_order(_flat(spark, sf_dir)["action"]).select(*R.ACTION, "category", "order_no", "moved")


def plan_flatten(spark, sf_dir):
    """The checklist: every step with its action's name."""
    f = _flat(spark, sf_dir)
    return f["step"].join(f["action"].select(*R.ACTION, "actionName"), R.ACTION).select(*R.GROUP, "step_no", F.col("actionName").alias("action_name"), "step")


def plan_top4(spark, sf_dir):
    """The first four actions of each context, shown as causes; the limit is the feature."""
    w = Window.partitionBy(*R.GOAL).orderBy("action_no")
    return _flat(spark, sf_dir)["action"].withColumn("cause_no", F.row_number().over(w).cast("bigint")).filter("cause_no <= 4").select(*R.GOAL, "cause_no", F.col("actionName").alias("action_name"))


def plan_repair(spark, sf_dir):
    """Actions that stay after repair: with a group that has steps; descriptions rebuilt where they break their rule."""
    f = _flat(spark, sf_dir)
    acts = f["action"].join(f["step"].select(*R.ACTION).distinct(), R.ACTION, "left_semi")
    fixed = R.category(acts).withColumn("ok", F.expr(f"coalesce({T.valid_description(R.D, 'description')}, false)")).withColumn("stripped", F.expr(R.D.replace("coalesce(description, '')", r"(?i)^\s*it\s+will\s*")))
    built = frame(fixed, T.description("stripped", "built"))
    return built.select(*R.ACTION, F.when(F.col("ok"), F.col("description")).otherwise(F.col("built")).alias("description"), (~F.col("ok")).alias("repaired"))


def score_goal(spark, sf_dir):
    """Confidence of each recorded context from its links, steps, and the query's overlap with its title."""
    f = _flat(spark, sf_dir)
    acts = R.category(f["action"]).select(*R.ACTION, "category")
    g = f["group"].join(acts, R.ACTION)
    links = g.groupBy(*R.GOAL).agg(F.sum((F.col("category") != "manual").cast("int")).alias("auto"), F.sum(((F.col("category") != "manual") & F.col("actionableDeeplink_deeplink").isNotNull() & ~F.coalesce(F.col("actionableDeeplink_deeplink").contains("dummy_positive"), F.lit(False))).cast("int")).alias("matched"))
    n = f["step"].groupBy(*R.GOAL).agg(F.count("*").alias("n_steps"))
    q = table(spark, sf_dir, "results").select("result_id", "query")
    words = lambda x: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) > 3))
    rows = f["goal"].join(links, R.GOAL, "left").join(n, R.GOAL, "left").join(q, "result_id", "left").withColumn("a", words(F.col("query"))).withColumn("b", words(F.col("title")))
    overlap = F.when((F.size("a") == 0) | (F.size("b") == 0), 0.4).otherwise(F.size(F.array_intersect("a", "b")) / F.size("b"))
    rate = F.when(F.coalesce("auto", F.lit(0)) == 0, 1.0).otherwise(F.col("matched") / F.col("auto"))
    raw = 0.45 * rate + 0.30 * F.least(F.lit(1.0), F.coalesce("n_steps", F.lit(0)) / 8) + 0.25 * overlap
    return rows.select(*R.GOAL, F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.floor(raw * 100 + 0.5) / 100)).alias("score"))


def validate_rules(spark, sf_dir):
    return R.violations(_flat(spark, sf_dir), _uris(spark, sf_dir))


def validate_summary(spark, sf_dir):
    return validate_rules(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("result_id").alias("n_results"))


def validate_tally(spark, sf_dir):
    f = _flat(spark, sf_dir)
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    acts = R.category(f["action"]).groupBy("category").agg(F.count("*").alias("n")).select(F.concat(F.lit("category "), "category").alias("what"), "n")
    parts = [count("contexts", f["goal"]), count("actions", f["action"]), count("groups", f["group"]), count("steps", f["step"]), count("links", f["group"].filter("actionableDeeplink_deeplink IS NOT NULL")), count("validations", f["group"].filter("validationDeeplink_deeplink IS NOT NULL")), acts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rule_compliance(spark, sf_dir):
    f = _flat(spark, sf_dir)
    valid = lambda df, name, check, x: df.select(F.lit(name).alias("rule"), F.expr(f"coalesce({check(R.D, x)}, false)").alias("ok"))
    rows = valid(f["goal"], "goal", T.valid_goal, "goal").unionByName(valid(f["goal"], "title", T.valid_title, "title")).unionByName(valid(f["action"], "description", T.valid_description, "description"))
    auto = f["action"].filter("category = 'auto'").join(f["group"].filter("actionableDeeplink_deeplink IS NOT NULL").select(*R.ACTION).distinct().withColumn("ok", F.lit(True)), R.ACTION, "left").select(F.lit("auto with link").alias("rule"), F.coalesce("ok", F.lit(False)).alias("ok"))
    uri = _used(spark, sf_dir).join(_uris(spark, sf_dir).withColumn("ok", F.lit(True)), "uri", "left").select(F.lit("uri in catalog").alias("rule"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.unionByName(auto).unionByName(uri).groupBy("rule").agg(F.count("*").alias("checked"), F.sum(F.col("ok").cast("bigint")).alias("valid"))


def step_accuracy(spark, sf_dir):
    """0 to 3 for each primary context: groups with steps, steps that instruct, and order."""
    f = _flat(spark, sf_dir)
    primary = table(spark, sf_dir, "results").filter("run = 'primary'").select("result_id")
    full = f["group"].join(f["step"].select(*R.GROUP).distinct().withColumn("full", F.lit(1)), R.GROUP, "left").groupBy(*R.GOAL).agg((F.sum(F.coalesce("full", F.lit(0))) / F.count("*")).alias("completeness"))
    good = f["step"].groupBy(*R.GOAL).agg((F.sum(F.expr(f"cast(NOT {T.contains_url(R.D, 'step')} AND size(split(step, '\\\\s+')) >= 2 as int)")) / F.count("*")).alias("correctness"))
    previous = F.lag(R.rank(F.col("category"))).over(Window.partitionBy(*R.GOAL).orderBy("action_no"))
    order = f["action"].withColumn("fell", F.coalesce(previous > R.rank(F.col("category")), F.lit(False)).cast("int")).groupBy(*R.GOAL).agg(F.max("fell").alias("fell"))
    rows = f["goal"].join(primary, "result_id", "left_semi").join(full, R.GOAL, "left").join(good, R.GOAL, "left").join(order, R.GOAL, "left")
    return rows.select(*R.GOAL, (F.floor((F.coalesce("completeness", F.lit(0.0)) + F.coalesce("correctness", F.lit(0.0)) + F.when(F.coalesce("fell", F.lit(0)) == 0, 1.0).otherwise(0.0)) * 1e6 + 0.5) / 1e6).alias("accuracy"))


def link_relevance(spark, sf_dir):
    """0 to 2 over the groups of primary plans that may have a link: 2 a screen's own entry, 1 the placeholder."""
    f = _flat(spark, sf_dir)
    primary = table(spark, sf_dir, "results").filter("run = 'primary'").select("result_id")
    g = f["group"].join(primary, "result_id", "left_semi").join(R.category(f["action"]).select(*R.ACTION, "category"), R.ACTION).filter("category <> 'manual'")
    points = F.when(F.col("actionableDeeplink_deeplink").isNull(), 0).when(F.col("actionableDeeplink_deeplink").contains("dummy_positive"), 1).otherwise(2)
    return g.agg(F.count("*").alias("n"), (F.floor(F.avg(points) * 1e6 + 0.5) / 1e6).alias("relevance"))


def _norm(x):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"^\s*\d+[.)]\s*", ""), "[^a-z0-9]+", " "))


def reference_pairing(spark, sf_dir):
    """Each complaint's article: the first with the same text, else the one at its line's place."""
    a = table(spark, sf_dir, "siis_responses").select("siis_id", "original_query")
    by_text = a.withColumn("norm", _norm(F.col("original_query"))).groupBy("norm").agg(F.min("siis_id").alias("by_text"))
    place = a.select(F.col("siis_id").alias("by_place"), F.col("siis_id").alias("of_place"))
    c = table(spark, sf_dir, "complaints").select("complaint_id", F.col("ord").cast("bigint").alias("by_place"), _norm(F.col("query")).alias("norm"))
    return c.join(by_text, "norm", "left").join(place, "by_place", "left").select("complaint_id", F.coalesce("by_text", "of_place").alias("siis_id"))


def reference_lookup(spark, sf_dir):
    """The article that each recorded plan names: the first delivered under that name."""
    first = table(spark, sf_dir, "siis_responses").filter("id IS NOT NULL").groupBy("id").agg(F.min("siis_id").alias("siis_id"))
    return table(spark, sf_dir, "results").select("result_id", "id").join(first, "id", "left").select("result_id", "siis_id")


def reference_texts(spark, sf_dir):
    """Articles as they are given to the pipeline: those with a title or content, what is missing as empty text."""
    a = table(spark, sf_dir, "siis_responses").filter("coalesce(title, '') <> '' OR coalesce(content, '') <> ''")
    return a.select("siis_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))


def category_notes(spark, sf_dir):
    """What is told with each action of the recorded plans, by its category."""
    notes = F.create_map(*(F.lit(x) for kv in C.NOTES.items() for x in kv))
    return R.category(_flat(spark, sf_dir)["action"]).select(*R.ACTION, F.try_element_at(notes, F.col("category")).alias("note"))


def failure_count(spark, sf_dir):
    """All violations, and how many of them the report shows."""
    return validate_rules(spark, sf_dir).agg(F.count("*").alias("n_failures")).select("n_failures", F.least("n_failures", F.lit(40)).cast("bigint").alias("n_shown"))


def history_recent(spark, sf_dir):
    """The 30 newest complaints of each device; the limit is the feature."""
    w = Window.partitionBy("device_model").orderBy(F.col("received_at").desc(), "complaint_id")
    return table(spark, sf_dir, "complaints").select("device_model", "complaint_id", "received_at").withColumn("nth", F.row_number().over(w).cast("bigint")).filter("nth <= 30").select("device_model", "nth", "complaint_id")


def explore_search(spark, sf_dir):
    """Articles whose title or question has a word, or whose title is in the segment of black screens."""
    a = table(spark, sf_dir, "siis_responses")
    hay = F.lower(F.concat_ws(" ", "title", "original_query"))
    return a.filter(hay.contains("battery") | F.lower(F.coalesce("title", F.lit(""))).rlike("blank|black")).select("siis_id", F.substring(F.coalesce("title", "original_query"), 1, 70).alias("shown"))


def failure_report(spark, sf_dir):
    """The first 40 violations; the limit is the feature."""
    return validate_rules(spark, sf_dir).orderBy("result_id", "path", "rule").limit(40)


def placeholder_entry(spark, sf_dir):
    """The catalog's generic entry: the first whose link is marked so."""
    links = table(spark, sf_dir, "deeplinks").filter(F.col("deeplink").contains("dummy_positive"))
    return links.orderBy("link_id").limit(1).select("link_id", "deeplink")


def valid_links(spark, sf_dir):
    """Which entries of the catalog could be emitted: the scheme, a description, and no web address in what is shown."""
    links = table(spark, sf_dir, "deeplinks")
    ok = f"coalesce(deeplink LIKE '{C.SCHEME}%', false) AND trim(coalesce(description, '')) <> '' AND NOT {T.contains_url(R.D, "coalesce(description, '')")} AND NOT {T.contains_url(R.D, "coalesce(message, '')")}"
    return links.select("link_id", F.expr(ok).alias("valid"))


QUERIES = {f.__name__: f for f in (
    failure_report, placeholder_entry, valid_links, uri_union, uri_semi, uri_anti, order_actions, plan_flatten, plan_top4, plan_repair, score_goal, validate_rules, validate_summary, validate_tally, rule_compliance, step_accuracy, link_relevance, reference_pairing, reference_lookup, reference_texts, category_notes, failure_count, history_recent, explore_search,
)}

_F = lambda x, *names: "coalesce(" + ", ".join(f"{x}->>'$.{n}'" for n in names) + ")" if len(names) > 1 else f"({x}->>'$.{names[0]}')"
_RANK = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.CATEGORY_ORDER.items()) + " ELSE 1 END"
_LINK, _CHECK = "coalesce(v->'actionableDeeplink', v->'actionable_deeplink')", "coalesce(v->'validationDeeplink', v->'validation_deeplink')"
_P = f"""{PLANS},
uris AS (SELECT deeplink AS uri FROM deeplinks WHERE deeplink IS NOT NULL UNION SELECT validation_deeplink FROM deeplinks WHERE validation_deeplink IS NOT NULL),
g AS (SELECT result_id, context_no, v->>'$.goal' AS goal, v->>'$.title' AS title, v->>'$.score' AS score FROM goals),
a AS (SELECT result_id, context_no, action_no, {_F('v', 'actionName', 'action_name')} AS name, v->>'$.description' AS description, v->>'$.category' AS raw_category, coalesce(v->>'$.category', 'manual') AS category FROM acts),
gr AS (SELECT result_id, context_no, action_no, group_no, l->>'$.deeplink' AS link, l->>'$.description' AS link_description, l->>'$.message' AS link_message, {_F('l', 'originalType', 'original_type')} AS link_type,
  c->>'$.deeplink' AS chk, c->>'$.key' AS chk_key, {_F('c', 'resultType', 'result_type')} AS chk_type, c->>'$.condition' AS chk_condition, c->>'$.value' AS chk_value FROM (SELECT *, {_LINK} AS l, {_CHECK} AS c FROM grps)),
st AS (SELECT result_id, context_no, action_no, group_no, step_no, v->>'$' AS step FROM stps),
used AS (SELECT * FROM (SELECT result_id, context_no, action_no, group_no, unnest([link, chk]) AS uri FROM gr) WHERE uri IS NOT NULL)"""
_GP = "'contexts[' || context_no || ']'"
_AP = f"{_GP} || '.actions[' || action_no || ']'"
_SP = f"{_AP} || '.stepGroups[' || group_no || ']'"
_NOT = lambda check, x: f"NOT coalesce({check(K, x)}, FALSE)"
_FOREIGN = lambda x: f"({x} NOT IN (SELECT uri FROM uris) OR {x} IS NULL OR NOT starts_with({x}, '{C.SCHEME}'))"
_CHECKS = " UNION ALL ".join([
    f"SELECT result_id, {_GP} || '.goal' AS path, 'goal' AS rule FROM g WHERE {_NOT(T.valid_goal, 'goal')}",
    f"SELECT result_id, {_GP} || '.title', 'title' FROM g WHERE {_NOT(T.valid_title, 'title')}",
    f"SELECT result_id, {_GP} || '.score', 'score' FROM g WHERE NOT coalesce(try_cast(score AS double) BETWEEN 0 AND 1, FALSE)",
    f"SELECT result_id, {_GP} || '.actions', 'no-actions' FROM g WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.result_id = g.result_id AND a.context_no = g.context_no)",
    f"SELECT DISTINCT result_id, {_GP} || '.actions', 'order' FROM (SELECT *, lag({_RANK}) OVER (PARTITION BY result_id, context_no ORDER BY action_no) > {_RANK} AS fell FROM a) WHERE fell",
    f"SELECT result_id, {_AP} || '.actionName', 'action-name' FROM a WHERE {_NOT(T.valid_action_name, 'name')}",
    f"SELECT result_id, {_AP} || '.description', 'description' FROM a WHERE {_NOT(T.valid_description, 'description')}",
    f"SELECT result_id, {_AP} || '.category', 'category' FROM a WHERE category NOT IN ('auto', 'manual', 'critical')",
    f"SELECT result_id, {_AP} || '.stepGroups', 'no-groups' FROM a WHERE NOT EXISTS (SELECT 1 FROM gr WHERE gr.result_id = a.result_id AND gr.context_no = a.context_no AND gr.action_no = a.action_no)",
    f"SELECT result_id, {_SP} || '.steps', 'no-steps' FROM gr WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.result_id = gr.result_id AND st.context_no = gr.context_no AND st.action_no = gr.action_no AND st.group_no = gr.group_no)",
    f"SELECT result_id, {_SP} || '.steps[' || step_no || ']', 'step' FROM st WHERE {_NOT(T.valid_step, 'step')}",
    f"SELECT result_id, {_SP} || '.actionableDeeplink', 'manual-link' FROM gr JOIN a USING (result_id, context_no, action_no) WHERE coalesce(link, link_description, link_message, link_type) IS NOT NULL AND category = 'manual'",
    f"SELECT result_id, {_SP} || '.actionableDeeplink', 'link' FROM gr JOIN a USING (result_id, context_no, action_no) WHERE coalesce(link, link_description, link_message, link_type) IS NOT NULL AND ({_FOREIGN('link')} OR trim(coalesce(link_description, '')) = '' OR coalesce({T.contains_url(K, 'link_description')}, FALSE) OR coalesce({T.contains_url(K, 'link_message')}, FALSE))",
    f"SELECT result_id, {_SP} || '.validationDeeplink', 'validation' FROM gr WHERE coalesce(chk, chk_key, chk_type, chk_condition, chk_value) IS NOT NULL AND ({_FOREIGN('chk')} OR trim(coalesce(chk_key, '')) = '' OR coalesce(chk_type NOT IN ('boolean', 'integer', 'str', 'float'), FALSE) OR coalesce(chk_condition NOT IN ('greater', 'equal', 'less'), FALSE))",
])
_WORDS = lambda x: f"list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda e: length(e) > 3))"
_NORM = lambda x: f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '^\\s*\\d+[.)]\\s*', ''), '[^a-z0-9]+', ' ', 'g'))"
_TEXT = T.description("stripped", "built")
SQL = {
    "reference_lookup": "SELECT result_id, s.siis_id FROM results LEFT JOIN (SELECT id, min(siis_id) AS siis_id FROM siis_responses WHERE id IS NOT NULL GROUP BY 1) s USING (id)",
    "reference_texts": "SELECT siis_id, coalesce(title, '') AS title, coalesce(content, '') AS content FROM siis_responses WHERE coalesce(title, '') <> '' OR coalesce(content, '') <> ''",
    "category_notes": f"{_P} SELECT result_id, context_no, action_no, CASE category {' '.join(f'WHEN {Checker().lit(k)} THEN {Checker().lit(v)}' for k, v in C.NOTES.items())} END AS note FROM a",
    "failure_count": f"{_P} SELECT count(*) AS n_failures, least(count(*), 40)::bigint AS n_shown FROM ({_CHECKS})",
    "failure_report": f"{_P} SELECT * FROM ({_CHECKS}) ORDER BY result_id, path, rule LIMIT 40",
    "placeholder_entry": "SELECT link_id, deeplink FROM deeplinks WHERE contains(deeplink, 'dummy_positive') ORDER BY link_id LIMIT 1",
    "valid_links": f"SELECT link_id, coalesce(deeplink LIKE '{C.SCHEME}%', false) AND trim(coalesce(description, '')) <> '' AND NOT {T.contains_url(K, "coalesce(description, '')")} AND NOT {T.contains_url(K, "coalesce(message, '')")} AS valid FROM deeplinks",
    "uri_union": f"{_P} SELECT uri FROM uris",
    "uri_semi": f"{_P} SELECT uri, count(*) AS n FROM used WHERE uri IN (SELECT uri FROM uris) GROUP BY 1",
    "uri_anti": f"{_P} SELECT uri, count(*) AS n FROM used WHERE uri NOT IN (SELECT uri FROM uris) GROUP BY 1",
    "order_actions": f"{_P} SELECT result_id, context_no, action_no, category, order_no, place <> order_no AS moved FROM (SELECT *, row_number() OVER (PARTITION BY result_id, context_no ORDER BY {_RANK}, action_no) - 1 AS order_no, row_number() OVER (PARTITION BY result_id, context_no ORDER BY action_no) - 1 AS place FROM a)",
    "plan_flatten": f"{_P} SELECT st.result_id, st.context_no, st.action_no, group_no, step_no, name AS action_name, step FROM st JOIN a USING (result_id, context_no, action_no)",
    "plan_top4": f"{_P} SELECT result_id, context_no, row_number() OVER (PARTITION BY result_id, context_no ORDER BY action_no) AS cause_no, name AS action_name FROM a QUALIFY cause_no <= 4",
    "plan_repair": f"{_P}, keep AS (SELECT a.*, coalesce({T.valid_description(K, 'description')}, FALSE) AS ok, regexp_replace(coalesce(description, ''), '(?i)^\\s*it\\s+will\\s*', '') AS stripped FROM a SEMI JOIN st USING (result_id, context_no, action_no)) SELECT result_id, context_no, action_no, CASE WHEN ok THEN description ELSE built END AS description, NOT ok AS repaired FROM {sql('keep', _TEXT)}",
    "score_goal": f"""{_P}, links AS (SELECT result_id, context_no, count(*) FILTER (category <> 'manual') AS auto, count(*) FILTER (category <> 'manual' AND link IS NOT NULL AND NOT contains(link, 'dummy_positive')) AS matched FROM gr JOIN a USING (result_id, context_no, action_no) GROUP BY 1, 2),
      n AS (SELECT result_id, context_no, count(*) AS n_steps FROM st GROUP BY 1, 2),
      w AS (SELECT g.result_id, g.context_no, coalesce(auto, 0) AS auto, matched, coalesce(n_steps, 0) AS n_steps, {_WORDS('query')} AS qa, {_WORDS('g.title')} AS tb FROM g LEFT JOIN links USING (result_id, context_no) LEFT JOIN n USING (result_id, context_no) LEFT JOIN results USING (result_id))
      SELECT result_id, context_no, greatest(0.05, least(0.99, floor((0.45 * CASE WHEN auto = 0 THEN 1.0 ELSE matched / auto END + 0.30 * least(1.0, n_steps / 8) + 0.25 * CASE WHEN len(qa) = 0 OR len(tb) = 0 THEN 0.4 ELSE len(list_intersect(qa, tb)) / len(tb) END) * 100 + 0.5) / 100))::double AS score FROM w""",
    "validate_rules": f"{_P} SELECT * FROM ({_CHECKS})",
    "validate_summary": f"{_P} SELECT rule, count(*) AS n, count(DISTINCT result_id) AS n_results FROM ({_CHECKS}) GROUP BY 1",
    "validate_tally": f"{_P} " + " UNION ALL ".join([f"SELECT '{n}' AS what, count(*) AS n FROM {t}" for n, t in (("contexts", "g"), ("actions", "a"), ("groups", "gr"), ("steps", "st"), ("links", "gr WHERE link IS NOT NULL"), ("validations", "gr WHERE chk IS NOT NULL"))]) + " UNION ALL SELECT 'category ' || category, count(*) FROM a GROUP BY 1",
    "rule_compliance": f"""{_P} SELECT rule, count(*) AS checked, sum(ok::int)::bigint AS valid FROM (SELECT 'goal' AS rule, coalesce({T.valid_goal(K, 'goal')}, FALSE) AS ok FROM g UNION ALL SELECT 'title', coalesce({T.valid_title(K, 'title')}, FALSE) FROM g
      UNION ALL SELECT 'description', coalesce({T.valid_description(K, 'description')}, FALSE) FROM a UNION ALL SELECT 'auto with link', EXISTS (SELECT 1 FROM gr WHERE gr.result_id = a.result_id AND gr.context_no = a.context_no AND gr.action_no = a.action_no AND link IS NOT NULL) FROM a WHERE raw_category = 'auto'
      UNION ALL SELECT 'uri in catalog', uri IN (SELECT uri FROM uris) FROM used) GROUP BY 1""",
    "step_accuracy": f"""{_P}, comp AS (SELECT result_id, context_no, avg((EXISTS (SELECT 1 FROM st WHERE st.result_id = gr.result_id AND st.context_no = gr.context_no AND st.action_no = gr.action_no AND st.group_no = gr.group_no))::int) AS c FROM gr GROUP BY 1, 2),
      corr AS (SELECT result_id, context_no, avg((NOT {T.contains_url(K, 'step')} AND len(string_split_regex(step, '\\s+')) >= 2)::int) AS c FROM st GROUP BY 1, 2),
      ord AS (SELECT result_id, context_no, max(fell::int) AS fell FROM (SELECT *, coalesce(lag({_RANK.replace('category', 'raw_category', 1)}) OVER (PARTITION BY result_id, context_no ORDER BY action_no) > {_RANK.replace('category', 'raw_category', 1)}, FALSE) AS fell FROM a) GROUP BY 1, 2)
      SELECT g.result_id, g.context_no, floor((coalesce(comp.c, 0) + coalesce(corr.c, 0) + CASE WHEN coalesce(fell, 0) = 0 THEN 1 ELSE 0 END) * 1e6 + 0.5) / 1e6 AS accuracy FROM g JOIN results r ON r.result_id = g.result_id AND run = 'primary' LEFT JOIN comp ON comp.result_id = g.result_id AND comp.context_no = g.context_no LEFT JOIN corr ON corr.result_id = g.result_id AND corr.context_no = g.context_no LEFT JOIN ord ON ord.result_id = g.result_id AND ord.context_no = g.context_no""",
    "link_relevance": f"{_P} SELECT count(*) AS n, floor(avg(CASE WHEN link IS NULL THEN 0 WHEN contains(link, 'dummy_positive') THEN 1 ELSE 2 END) * 1e6 + 0.5) / 1e6 AS relevance FROM gr JOIN a USING (result_id, context_no, action_no) SEMI JOIN (SELECT result_id FROM results WHERE run = 'primary') p USING (result_id) WHERE category <> 'manual'",
    "reference_pairing": f"WITH b AS (SELECT {_NORM('original_query')} AS norm, min(siis_id) AS by_text FROM siis_responses GROUP BY 1) SELECT complaint_id, coalesce(by_text, s.siis_id) AS siis_id FROM (SELECT complaint_id, ord, {_NORM('query')} AS norm FROM complaints) c LEFT JOIN b USING (norm) LEFT JOIN siis_responses s ON s.siis_id = c.ord",
    "history_recent": "SELECT device_model, row_number() OVER (PARTITION BY device_model ORDER BY received_at DESC, complaint_id) AS nth, complaint_id FROM complaints QUALIFY nth <= 30",
    "explore_search": "SELECT siis_id, substr(coalesce(title, original_query), 1, 70) AS shown FROM siis_responses WHERE contains(lower(concat_ws(' ', title, original_query)), 'battery') OR regexp_matches(lower(coalesce(title, '')), 'blank|black')",
}
