"""Rules, scores and tallies over flat plans.

All rules are columns of the flat tables of a plan; a violation is a row. Parents with children are told by
the children's grouped keys, so each level costs one shuffle on its parent's key.

Defined results: missing categories count as manual; unknown ones rank as manual in orders and violate the category
rule; missing texts violate their rule; plans without contexts have no violations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions.dialect import Spark

D = Spark()
GOAL = ["result_id", "context_no"]
ACTION = [*GOAL, "action_no"]
GROUP = [*ACTION, "group_no"]


def category(df: DataFrame) -> DataFrame:
    return df.withColumn("category", F.coalesce("category", F.lit("manual")))


def rank(col) -> F.Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in C.CATEGORY_ORDER.items() for x in kv)), col), F.lit(1))


def in_order(actions: DataFrame) -> DataFrame:
    """The actions with order_no from 0: least disruptive first, else as they come; moved tells which change place."""
    w = Window.partitionBy(*GOAL).orderBy(rank(F.col("category")), "action_no")
    out = category(actions).withColumn("order_no", (F.row_number().over(w) - 1).cast("bigint"))
    place = (F.row_number().over(Window.partitionBy(*GOAL).orderBy("action_no")) - 1).cast("bigint")
    return out.withColumn("moved", place != F.col("order_no"))


def rule(d, text: str, check: str) -> str:
    """A rule that missing texts violate."""
    return f"coalesce({check}, false)"


def violations(flat: dict[str, DataFrame], uris: DataFrame) -> DataFrame:
    """(result_id, path, rule): one row for each broken rule. uris: (uri) of the catalog."""
    goals, actions, groups, steps = flat["goal"], category(flat["action"]), flat["group"], flat["step"]
    known = uris.select("uri").distinct()
    gp = F.concat(F.lit("contexts["), "context_no", F.lit("]"))
    ap = F.concat(gp, F.lit(".actions["), "action_no", F.lit("]"))
    sp = F.concat(ap, F.lit(".stepGroups["), "group_no", F.lit("]"))
    broken = lambda df, path, name, bad: df.filter(bad).select("result_id", path.alias("path"), F.lit(name).alias("rule"))
    ok = lambda check, x: ~F.expr(rule(D, x, check(D, x)))
    some = lambda df, keys: df.select(*keys).distinct().withColumn("has", F.lit(True))
    without = lambda df, kids, keys: df.join(some(kids, keys), keys, "left_anti")
    previous = F.lag(rank(F.col("category"))).over(Window.partitionBy(*GOAL).orderBy("action_no"))
    fallen = actions.withColumn("fell", previous > rank(F.col("category"))).filter("fell").select(*GOAL).distinct()
    linked = groups.join(actions.select(*ACTION, "category"), ACTION).withColumn("uri", F.col("actionableDeeplink_deeplink")).join(known.withColumn("known", F.lit(True)), "uri", "left")
    checked = groups.withColumn("uri", F.col("validationDeeplink_deeplink")).join(known.withColumn("known", F.lit(True)), "uri", "left")
    has_link = F.coalesce("actionableDeeplink_deeplink", "actionableDeeplink_description", "actionableDeeplink_message", "actionableDeeplink_originalType").isNotNull()
    has_check = F.coalesce("validationDeeplink_deeplink", "validationDeeplink_key", "validationDeeplink_resultType", "validationDeeplink_condition", "validationDeeplink_value").isNotNull()
    foreign = F.col("known").isNull() | ~F.coalesce(F.col("uri").startswith(C.SCHEME), F.lit(False))
    bad_link = foreign | (F.trim(F.coalesce("actionableDeeplink_description", F.lit(""))) == "") | F.expr(f"coalesce({T.contains_url(D, 'actionableDeeplink_description')}, false) OR coalesce({T.contains_url(D, 'actionableDeeplink_message')}, false)")
    bad_check = foreign | (F.trim(F.coalesce("validationDeeplink_key", F.lit(""))) == "") | F.coalesce(~F.col("validationDeeplink_resultType").isin("boolean", "integer", "str", "float"), F.lit(False)) | F.coalesce(~F.col("validationDeeplink_condition").isin("greater", "equal", "less"), F.lit(False))
    number = F.expr("try_cast(score as double)")
    parts = [
        broken(goals, F.concat(gp, F.lit(".goal")), "goal", ok(T.valid_goal, "goal")),
        broken(goals, F.concat(gp, F.lit(".title")), "title", ok(T.valid_title, "title")),
        broken(goals, F.concat(gp, F.lit(".score")), "score", ~F.coalesce(number.between(0, 1), F.lit(False))),
        broken(without(goals, actions, GOAL), F.concat(gp, F.lit(".actions")), "no-actions", F.lit(True)),
        broken(fallen, F.concat(gp, F.lit(".actions")), "order", F.lit(True)),
        broken(actions, F.concat(ap, F.lit(".actionName")), "action-name", ok(T.valid_action_name, "actionName")),
        broken(actions, F.concat(ap, F.lit(".description")), "description", ok(T.valid_description, "description")),
        broken(actions, F.concat(ap, F.lit(".category")), "category", ~F.col("category").isin(*C.CATEGORY_ORDER)),
        broken(without(actions, groups, ACTION), F.concat(ap, F.lit(".stepGroups")), "no-groups", F.lit(True)),
        broken(without(groups, steps, GROUP), F.concat(sp, F.lit(".steps")), "no-steps", F.lit(True)),
        broken(steps, F.concat(sp, F.lit(".steps["), "step_no", F.lit("]")), "step", ok(T.valid_step, "step")),
        broken(linked, F.concat(sp, F.lit(".actionableDeeplink")), "manual-link", has_link & (F.col("category") == "manual")),
        broken(linked, F.concat(sp, F.lit(".actionableDeeplink")), "link", has_link & bad_link),
        broken(checked, F.concat(sp, F.lit(".validationDeeplink")), "validation", has_check & bad_check),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
