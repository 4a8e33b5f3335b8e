"""The registered queries over the project's tables and their SQL; more are added by the other modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..cluster import table
from ..operators import nested
from .plan_sql import PLANS

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = nested.nodes(table(spark, sf_dir, "results"), "result_id", "response")
    return every.select("result_id", "node_kind", "context_no", "action_no", "group_no", "step_no")


def _flat(kind: str) -> Query:
    return lambda spark, sf_dir: nested.flat_tables(table(spark, sf_dir, "results"), "result_id", "response")[kind]


QUERIES: dict[str, Query] = {
    "p3_found": p3_found,
    "p3_goals": _flat("goal"),
    "p3_actions": _flat("action"),
    "p3_groups": _flat("group"),
    "p3_steps": _flat("step"),
}
SQL: dict[str, str] = {}


def _rows(kind: str, of: str, *ordinals: str) -> str:
    every = ("context_no", "action_no", "group_no", "step_no")
    return f"SELECT result_id, '{kind}' AS node_kind, {', '.join(x if x in ordinals else f'-1 AS {x}' for x in every)} FROM {of}"


SQL["p3_found"] = PLANS + " " + " UNION ALL ".join([
    _rows("goal", "goals", "context_no"), _rows("action", "acts", "context_no", "action_no"),
    _rows("group", "grps", "context_no", "action_no", "group_no"), _rows("step", "stps", "context_no", "action_no", "group_no", "step_no"),
])
SQL["p3_steps"] = PLANS + " SELECT result_id, context_no, action_no, group_no, step_no, v->>'$' AS step FROM stps"
_LINKS = {"validationDeeplink": ("deeplink", "key", "resultType", "condition", "value"), "actionableDeeplink": ("deeplink", "description", "message", "originalType")}
_SNAKE = {"validationDeeplink": "validation_deeplink", "actionableDeeplink": "actionable_deeplink", "resultType": "result_type", "originalType": "original_type"}


def _either(x: str, key: str, op: str) -> str:
    return f"coalesce({x}{op}'$.{key}', {x}{op}'$.{_SNAKE[key]}')" if key in _SNAKE else f"({x}{op}'$.{key}')"


SQL["p3_groups"] = PLANS + " SELECT result_id, context_no, action_no, group_no, " + ", ".join(f'{_either(_either("v", link, "->"), x, "->>")} AS "{link}_{x}"' for link, xs in _LINKS.items() for x in xs) + " FROM grps"
SQL["p3_goals"] = PLANS + " SELECT result_id, context_no, v->>'$.goal' AS goal, v->>'$.title' AS title, v->>'$.score' AS score FROM goals"
SQL["p3_actions"] = PLANS + " SELECT result_id, context_no, action_no, coalesce(v->>'$.actionName', v->>'$.action_name') AS \"actionName\", v->>'$.description' AS description, v->>'$.category' AS category FROM acts"
