import json

from hypothesis import given, settings
from hypothesis import strategies as st

from mendwell.operators import nested as N


def kinds(text):
    return sorted((p.count("/"), *o) for p, o, v in N.triples(text, N.PLAN) if p.rsplit("/", 1)[-1] in ("contexts", "actions", "stepGroups", "steps"))


PLAN = {"contexts": [{"goal": "g", "actions": [{"actionName": "n", "stepGroups": [{"steps": ["a", None, "b"], "actionableDeeplink": {"deeplink": "u"}}, None]}, None]}, None]}
NODES = [(0, 0), (1, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0, 0), (3, 0, 0, 0, 2)]


def test_wrapping_and_spelling_dont_change_positions():
    t = json.dumps(PLAN)
    for text in (t, json.dumps({"response": PLAN}), json.dumps(t), json.dumps({"response": t}), json.dumps(PLAN["contexts"]), t.replace("stepGroups", "step_groups"), f"  {t}\n"):
        assert kinds(text) == NODES, text


def test_lone_ones_nulls_and_missing():
    assert kinds('{"contexts": {"actions": {"stepGroups": {"steps": "x"}}}}') == [(0, 0), (1, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0, 0)]
    assert kinds('{"contexts": null}') == kinds('{"contexts": []}') == kinds("{}") == kinds("null") == kinds("5") == []
    assert kinds('{"contexts": [{"x_trace": {"steps": ["a"]}, "actions": []}]}') == [(0, 0)]


def test_unreadable_texts_give_nothing():
    for text in (None, "", " ", "{", json.dumps(PLAN)[:-1], json.dumps(PLAN) + "x", '{"contexts": [NaN]}', "[1,]", '{"a" 1}', '"\\x"', "[" * 3000):
        assert N.triples(text, N.PLAN) == []


def test_deep_nesting_needs_no_stack():
    deep = '{"contexts": [{"x": ' + "[" * 20000 + "]" * 20000 + "}]}"
    assert kinds(deep) == [(0, 0)]


def test_last_of_equal_keys_holds():
    t = N.triples('{"contexts": [{"goal": "a", "actions": [{}], "Goal": "b", "actions": null}]}', N.PLAN)
    assert [(p, v) for p, o, v in t] == [("contexts", None), ("contexts/goal", "b")]


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(json_values)
def test_reads_all_json(value):
    stack, last = 0, None
    for kind, _ in N.events(json.dumps(value)):
        stack += {"{": 1, "[": 1, "}": -1, "]": -1}.get(kind, 0)
        last = kind
    assert stack == 0 and last in ("}", "]", "string", "scalar")


def test_tables_lead_to_their_parents(spark):
    df = spark.createDataFrame([(1, json.dumps(PLAN), "x"), (2, None, "y"), (3, "{", "z"), (None, json.dumps(PLAN), "n")], "result_id bigint, response string, path string")
    t = N.flat_tables(df, "result_id", "response")
    assert [tuple(r) for r in t["goal"].collect()] == [(1, 0, "g", None, None)]
    assert [(r.result_id, r.group_no, r.step_no, r.step) for r in t["step"].orderBy("step_no").collect()] == [(1, 0, 0, "a"), (1, 0, 2, "b")]
    ids = ["result_id", "context_no", "action_no", "group_no"]
    assert t["step"].join(t["group"], ids, "left_anti").count() == 0
    assert t["group"].collect()[0].actionableDeeplink_deeplink == "u"


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "result_id bigint, response string")
    assert N.nodes(empty, "result_id", "response").count() == 0
    twice = spark.createDataFrame([(1, json.dumps(PLAN))] * 2, "result_id bigint, response string")
    assert N.nodes(twice, "result_id", "response").count() == len(NODES)


def test_texts_as_elements_keep_their_positions(spark):
    def plan(encode):
        step = lambda n: {"steps": [n, "z"]}
        actions = [{"actionName": "a", "stepGroups": [step("p"), encode(step("q"))]}, None, encode({"actionName": "b", "stepGroups": step("r")}), encode({"actionName": "c", "stepGroups": [encode(step("s")), encode(step("t"))]})]
        return json.dumps({"contexts": [encode({"goal": "g"}), encode({"goal": "h", "actions": actions})]})

    plain = plan(lambda x: x)
    forms = {2: plan(json.dumps), 3: plan(lambda x: json.dumps(json.dumps(x))), 4: json.dumps(plan(json.dumps))}
    for text in forms.values():
        assert N.triples(text, N.PLAN) == N.triples(plain, N.PLAN)
    rows = {}
    for r in N.nodes(spark.createDataFrame([(1, plain), *forms.items()], "result_id bigint, response string"), "result_id", "response").collect():
        rows.setdefault(r.result_id, set()).add(tuple(r)[1:])
    assert len(rows[1]) == 2 + 3 + 5 + 10 and all(x == rows[1] for x in rows.values())


def test_lone_texts_stand_for_the_array():
    group = {"steps": ["a"]}
    for actions in ({"stepGroups": group}, json.dumps({"stepGroups": group}), json.dumps([{"stepGroups": json.dumps([group])}]), json.dumps(json.dumps([{"stepGroups": [group]}]))):
        assert kinds(json.dumps({"contexts": [{"actions": actions}]})) == [(0, 0), (1, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0, 0)]
