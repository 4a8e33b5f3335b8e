"""Nested records to related flat tables.

Each record is read once as a stream of JSON tokens, with an explicit stack, and leaves as
path-value-ordinal triples. Triples are grouped by the repeated ancestor they hang from, and each
group is pivoted into one table. Rows carry their ordinals, which lead to their parent:
the parent of (context, action, group, step) is the row of the level above with the same ordinals.

Defined results
    * null, empty or unreadable text: no rows. NaN, Infinity, control characters in strings and text
      after the value make a record unreadable.
    * a key that occurs twice in an object: the last one holds, also if they differ in spelling only.
    * a lone object or string in place of an array: an array of one. Null elements: no row, but they keep
      their position. Missing, null and empty arrays: nothing.
    * a wrapper object around the record, and JSON inside a string, are read through, to any depth.
    * repeated record ids give the same rows once; extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from json.decoder import JSONDecodeError, scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import spread


@dataclass(frozen=True)
class Level:
    """One repeated ancestor: the array's key, the name of its rows, its ordinal column, and its scalar fields."""

    key: str
    kind: str
    ordinal: str
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Shape:
    """The nesting of a record, from the outside in."""

    levels: tuple[Level, ...]
    wrappers: tuple[str, ...] = field(default=("response", "result", "data", "payload", "plan", "body", "output"))


PLAN = Shape(
    (
        Level("contexts", "goal", "context_no", ("goal", "title", "score")),
        Level("actions", "action", "action_no", ("actionName", "description", "category")),
        Level("stepGroups", "group", "group_no", tuple(f"{link}.{x}" for link, xs in (("validationDeeplink", ("deeplink", "key", "resultType", "condition", "value")), ("actionableDeeplink", ("deeplink", "description", "message", "originalType"))) for x in xs)),
        Level("steps", "step", "step_no", ("",)),
    )
)

TRIPLES = "path string, ordinals array<int>, value string"
_SPACE = re.compile(r"[ \t\r\n]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null", re.ASCII)


def events(text: str) -> Iterator[tuple[str, str | None]]:
    """Tokens of one JSON text: '{', '}', '[', ']', 'key', 'string', 'scalar'. Raises ValueError where it isn't JSON.

    The grammar is followed with a stack of open brackets, so depth is bounded by memory alone.
    """
    at, stack, n = _SPACE.match(text).end(), [], len(text)
    expect = "value"
    while True:
        if at >= n:
            raise ValueError("ends early")
        c = text[at]
        if expect in ("value", "value or ]"):
            if c == "]" and expect == "value or ]":
                stack.pop()
                yield "]", None
                at += 1
            elif c == '"':
                s, at = scanstring(text, at + 1, True)
                yield "string", s
            elif c == "{" or c == "[":
                stack.append(c)
                yield c, None
                at = _SPACE.match(text, at + 1).end()
                expect = "key or }" if c == "{" else "value or ]"
                continue
            else:
                m = _SCALAR.match(text, at)
                if not m:
                    raise ValueError("no value")
                at = m.end()
                yield "scalar", m.group()
        elif c == "}" and expect == "key or }":
            stack.pop()
            yield "}", None
            at += 1
        else:
            if c != '"':
                raise ValueError("no key")
            s, at = scanstring(text, at + 1, True)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no colon")
            yield "key", s
            at = _SPACE.match(text, at + 1).end()
            expect = "value"
            continue
        while True:  # after a value
            at = _SPACE.match(text, at).end()
            if not stack:
                if at < n:
                    raise ValueError("more text")
                return
            c = text[at : at + 1]
            if c == ",":
                at = _SPACE.match(text, at + 1).end()
                expect = "key" if stack[-1] == "{" else "value"
                break
            if c != ("}" if stack[-1] == "{" else "]"):
                raise ValueError("no comma")
            stack.pop()
            yield c, None
            at += 1


@lru_cache(65_536)
def spelling(key: str) -> str:
    """Keys of the record versions differ in case and in marks between words."""
    return re.sub(r"[^a-z0-9]", "", key.lower())


@lru_cache
def _spelled(shape: Shape) -> tuple[list[str], list[dict[str, str]], list[set[str]], set[str], list[str]]:
    """The keys of the levels, their fields by spelling, the objects that hold such fields, the wrappers, and the levels' paths."""
    names = [spelling(x.key) for x in shape.levels]
    scalars = [{".".join(map(spelling, f.split("."))): f for f in x.fields} for x in shape.levels]
    heads = [{f.split(".")[0] for f in s if "." in f} for s in scalars]
    paths = ["/".join(x.key for x in shape.levels[: i + 1]) for i in range(len(shape.levels))]
    return names, scalars, heads, set(map(spelling, shape.wrappers)), paths


def triples(text: str | None, shape: Shape) -> list[tuple[str, list[int], str | None]]:
    """The (path, ordinals, value) triples of one record; an object has a triple of its own with path '<array>' and no value.

    Paths name the plan's keys from the outermost array; what lies elsewhere is passed over.
    """
    if text is None or not text.strip(" \t\r\n﻿"):
        return []
    names, scalars, heads, wrappers, paths = _spelled(shape)
    out: list[tuple[str, list[int], str | None]] = []
    # A frame is (role, depth, ordinals, counter, seen keys). Roles: root (before the outermost array), array (of
    # the level depth), node (an element of it), link (an object of scalars in a node), skip.
    stack: list[list] = []

    def value(s: str, kind: str, role: str, depth: int, ordinals: list[int], prefix: str) -> None:
        if kind == "scalar" and s == "null":
            return
        if role == "element":
            if names[depth] == names[-1]:
                out.append((paths[depth], ordinals, s))
        elif role == "leaf":
            f = scalars[depth].get(prefix)
            if f is not None:
                out.append((f"{paths[depth]}/{f}", ordinals, s))

    def read(source: str, role: str, depth: int, ordinals: list[int]) -> None:
        pending: tuple[str, int, list[int], str] = (role, depth, ordinals, "")
        base = len(stack)
        for kind, s in events(source):
            if kind == "key":
                top = stack[-1]
                k, role = spelling(s), top[0]
                seen = top[4]
                if top[5] is not None:
                    seen[top[5]] = (seen[top[5]][0], len(out))
                if k in seen:  # the last one holds
                    first, end = seen[k]
                    del out[first:end]
                    for x, (a, b) in seen.items():
                        if a >= end:
                            seen[x] = (a - end + first, b - end + first)
                seen[k] = (len(out), len(out))
                top[5] = k
                if role == "root":
                    pending = ("array", 0, [], "") if k == names[0] else ("root", 0, [], "") if k in wrappers else ("skip", 0, [], "")
                elif role == "node":
                    d = top[1]
                    if d + 1 < len(names) and k == names[d + 1]:
                        pending = ("array", d + 1, top[2], "")
                    elif k in heads[d]:
                        pending = ("link", d, top[2], k)
                    else:
                        pending = ("leaf", d, top[2], k)
                elif role == "link":
                    pending = ("leaf", top[1], top[2], f"{top[6]}.{k}")
                else:
                    pending = ("skip", 0, [], "")
                continue
            if kind in "}]":
                top = stack.pop()
                if top[5] is not None:
                    top[4][top[5]] = (top[4][top[5]][0], len(out))
            else:
                if stack and len(stack) > base and stack[-1][0] == "list":
                    top = stack[-1]
                    d = top[1]
                    pending = ("element", d, [*top[2], top[3]], "")
                    top[3] += 1
                elif stack and len(stack) > base and stack[-1][0] == "skiplist":
                    pending = ("skip", 0, [], "")
                role, depth, ordinals, prefix = pending
                lone = role == "array" and kind in ("{", "string", "scalar") and not (kind == "scalar" and s == "null")
                if lone:
                    role, ordinals = "element", [*ordinals, 0]  # a lone one is an array of one
                if kind == "{":
                    if role == "element":
                        out.append((paths[depth], ordinals, None))
                        stack.append(["node", depth, ordinals, 0, {}, None, ""])
                    else:
                        stack.append([role if role in ("root", "link") else "skip", depth, ordinals, 0, {}, None, prefix])
                elif kind == "[":
                    if role == "array" or role == "root":
                        stack.append(["list", depth, ordinals, 0, {}, None, ""])
                    else:
                        stack.append(["skiplist", depth, ordinals, 0, {}, None, ""])
                elif kind == "string" and role in ("root", "array", "element") and s.lstrip(" \t\r\n﻿")[:1] in ("{", "[", '"') and (role == "root" or names[depth] != names[-1]):
                    before = len(out), len(stack)
                    try:
                        if lone:  # the text of an array, or of its only element
                            read(s.strip(" \t\r\n﻿"), "array", depth, ordinals[:-1])
                        else:
                            read(s.strip(" \t\r\n﻿"), role, depth, ordinals)
                    except ValueError:
                        if role == "root":
                            raise
                        del out[before[0] :], stack[before[1] :]
                elif kind in ("string", "scalar"):
                    value(s, kind, role, depth, ordinals, prefix)

    try:
        read(text.strip(" \t\r\n﻿"), "root", 0, [])
    except (ValueError, JSONDecodeError):
        return []
    return out


def to_triples(df: DataFrame, id_col: str, json_col: str, shape: Shape = PLAN) -> DataFrame:
    """(record id, path, ordinals, value) of every record. Narrow: each record is read where it lies."""
    kind = df.schema[id_col].dataType

    def read(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            keep, path, ordinals, values = [], [], [], []
            for i, text in zip(ids, texts):
                for p, o, v in triples(text.as_py(), shape):
                    keep.append(i)
                    path.append(p)
                    ordinals.append(o)
                    values.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keep, batch.column(0).type), pa.array(path, pa.string()), pa.array(ordinals, pa.list_(pa.int32())), pa.array(values, pa.string())], names=[id_col, "path", "ordinals", "value"]
            )

    source = spread(df.select(F.col(id_col), F.col(json_col)).filter(F.col(id_col).isNotNull() & F.col(json_col).isNotNull()))
    return source.mapInArrow(read, f"`{id_col}` {kind.simpleString()}, {TRIPLES}")


def nodes(df: DataFrame, id_col: str, json_col: str, shape: Shape = PLAN) -> DataFrame:
    """One row per node of any level: id, node_kind, the ordinals (-1 below the node's own level), and the fields of all levels.

    The triples of one node share the record id and its ordinals, so that one shuffle pivots all tables. Columns a
    caller doesn't select are pruned from it.
    """
    t = to_triples(df, id_col, json_col, shape)
    depth = F.size("ordinals")
    kinds = F.element_at(F.array(*(F.lit(x.kind) for x in shape.levels)), depth)
    ords = [F.coalesce(F.get("ordinals", F.lit(i)), F.lit(-1)).alias(x.ordinal) for i, x in enumerate(shape.levels)]
    keyed = t.select(id_col, kinds.alias("node_kind"), *ords, "path", "value")
    fields: list[Column] = []
    for i, x in enumerate(shape.levels):
        base = "/".join(y.key for y in shape.levels[: i + 1])
        for f in x.fields:
            fields.append(F.max(F.when(F.col("path") == (f"{base}/{f}" if f else base), F.col("value"))).alias(column(x, f)))
    return keyed.groupBy(id_col, "node_kind", *(x.ordinal for x in shape.levels)).agg(*fields)


def column(level: Level, name: str) -> str:
    """The column of a field: its name, or the level's own name for elements that are values."""
    return name.replace(".", "_") if name else level.kind


def flat_tables(df: DataFrame, id_col: str, json_col: str, shape: Shape = PLAN) -> dict[str, DataFrame]:
    """The related tables by the kind of their rows; each has the id, the ordinals down to its own, and its fields."""
    every, out = nodes(df, id_col, json_col, shape), {}
    for i, x in enumerate(shape.levels):
        out[x.kind] = every.filter(F.col("node_kind") == x.kind).select(id_col, *(y.ordinal for y in shape.levels[: i + 1]), *(column(x, f) for f in x.fields))
    return out
