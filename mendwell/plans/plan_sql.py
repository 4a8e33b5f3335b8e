"""SQL over the nested plans of the results table, for checking: the same flat rows from the checking engine's JSON functions."""

_ARRAY = "CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN CAST([] AS JSON[]) WHEN json_type({x}) = 'ARRAY' THEN CAST({x} AS JSON[]) ELSE [{x}] END"
_TEXT = "CASE WHEN json_type({x}) = 'VARCHAR' THEN CASE WHEN json_valid({x}->>'$') THEN CAST({x}->>'$' AS JSON) END ELSE {x} END"


def _level(name: str, source: str, ids: str, value: str, number: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT {ids}, unnest(a) AS v, generate_subscripts(a, 1)::int - 1 AS {number} FROM (SELECT {ids}, {_ARRAY.format(x='x')} AS a FROM (SELECT {ids}, {value} AS x FROM {source}))) WHERE v IS NOT NULL AND json_type(v) <> 'NULL')"


PLANS = ",\n".join([
    "WITH texts AS (SELECT result_id, CAST(response AS JSON) AS j FROM results WHERE response IS NOT NULL AND json_valid(response))",
    f"read_once AS (SELECT result_id, {_TEXT.format(x='j')} AS j FROM texts)",
    "opened AS (SELECT result_id, CASE WHEN json_type(j) = 'OBJECT' AND (j->'contexts') IS NULL AND (j->'response') IS NOT NULL THEN j->'response' ELSE j END AS j FROM read_once)",
    f"roots AS (SELECT result_id, {_TEXT.format(x='j')} AS j FROM opened)",
    _level("goals", "roots", "result_id", "CASE WHEN json_type(j) = 'ARRAY' THEN j ELSE j->'contexts' END", "context_no"),
    _level("acts", "goals", "result_id, context_no", "v->'actions'", "action_no"),
    _level("grps", "acts", "result_id, context_no, action_no", "coalesce(v->'stepGroups', v->'step_groups')", "group_no"),
    _level("stps", "grps", "result_id, context_no, action_no, group_no", "v->'steps'", "step_no"),
])
