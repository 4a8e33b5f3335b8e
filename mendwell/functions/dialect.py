"""Text expressions written once and rendered for Spark and for the checking engine.

A program is a list of named stages over a table. ``frame`` renders it as DataFrame columns, all built-in expressions that
Catalyst inlines; ``sql`` renders the same stages as nested SELECTs. Patterns use the syntax common to both regular
expression engines; the word boundary is spelled out for Spark, where the engine's own counts accented letters.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def for_spark(p: str) -> str:
    """The pattern with its ends and word boundaries spelled out: as one look where a word begins or ends there for sure, else as both."""

    def edge(m: re.Match) -> str:
        head, tail = p[: m.start()], p[m.end() :]
        if re.match(r"(?:\((?:\?:)?)*(?:[A-Za-z]|\\w)", tail):
            return "(?<![A-Za-z0-9_])"
        if re.search(r"[A-Za-z)?}\]]$", head) and not head.endswith("(?i)"):
            return "(?![A-Za-z0-9_])"
        return _EDGE

    # '$' is the very end here, where the engine's own also stands before a last line end
    return re.sub(r"(?<!\\)\$", lambda m: r"\z", re.sub(r"\\b", edge, p))


class Spark:
    """Expressions in Spark's SQL."""

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def pattern(self, p: str) -> str:
        return self.lit(for_spark(p))

    def replace(self, x: str, p: str, to: str = "") -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, {self.lit(re.sub(r'\\(\d)', r'$\1', to.replace('$', '\\$')))})"

    def matches(self, x: str, p: str) -> str:
        return f"({x} rlike {self.pattern(p)})"

    def extract(self, x: str, p: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.pattern(p)}, {group})"

    def extract_all(self, x: str, p: str, group: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)}, {group})"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, {self.pattern(p)})"

    def each(self, xs: str, f: Callable[[str], str]) -> str:
        return f"transform({xs}, e -> {f('e')})"

    def each_numbered(self, xs: str, f: Callable[[str, str], str]) -> str:
        """f gets the element and its number from 1."""
        return f"transform({xs}, (e, i) -> {f('e', '(i + 1)')})"

    def keep(self, xs: str, f: Callable[[str], str]) -> str:
        return f"filter({xs}, e -> {f('e')})"

    def join(self, xs: str, by: str = " ") -> str:
        return f"array_join({xs}, {self.lit(by)})"

    def size(self, xs: str) -> str:
        return f"cast(size({xs}) as bigint)"

    def first(self, xs: str, n: str | int) -> str:
        return f"slice({xs}, 1, {n})"

    def since(self, xs: str, start: str | int) -> str:
        return f"slice({xs}, {start}, greatest(size({xs}), 1))"

    def at(self, xs: str, n: str | int) -> str:
        return f"get({xs}, {n} - 1)"

    def distinct(self, xs: str) -> str:
        """Each value at its first place."""
        return f"array_distinct({xs})"

    def distinct_folded(self, xs: str) -> str:
        """Each value at its first place, whatever its case."""
        return f"filter({xs}, (e, i) -> array_position(transform({xs}, y -> lower(y)), lower(e)) = i + 1)"

    def sorted(self, xs: str) -> str:
        return f"array_sort({xs})"

    def concat(self, *xs: str) -> str:
        return f"concat({', '.join(xs)})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def concat_arrays(self, a: str, b: str) -> str:
        return f"concat({a}, {b})"

    def lacking(self, xs: str, others: str) -> str:
        """The values of xs that others don't have, whatever their case."""
        return f"filter({xs}, e -> NOT array_contains(transform({others}, y -> lower(y)), lower(e)))"

    def reverse(self, xs: str) -> str:
        return f"reverse({xs})"

    def flatten(self, xs: str) -> str:
        return f"flatten({xs})"

    def has(self, xs: str, x: str) -> str:
        return f"array_contains({xs}, {x})"

    def among(self, x: str, values) -> str:
        return f"({x} in ({', '.join(map(self.lit, values))}))"


class Checker(Spark):
    """Expressions in the checking engine's SQL."""

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def pattern(self, p: str) -> str:
        return self.lit(p)

    def replace(self, x: str, p: str, to: str = "") -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, {self.lit(to)}, 'g')"

    def matches(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.pattern(p)})"

    def split(self, x: str, p: str) -> str:
        return f"string_split_regex({x}, {self.pattern(p)})"

    def each(self, xs: str, f: Callable[[str], str]) -> str:
        return f"list_transform({xs}, lambda e: {f('e')})"

    def each_numbered(self, xs: str, f: Callable[[str, str], str]) -> str:
        return f"list_transform({xs}, lambda e, i: {f('e', 'i')})"

    def keep(self, xs: str, f: Callable[[str], str]) -> str:
        return f"list_filter({xs}, lambda e: {f('e')})"

    def join(self, xs: str, by: str = " ") -> str:
        return f"array_to_string({xs}, {self.lit(by)})"

    def size(self, xs: str) -> str:
        return f"len({xs})"

    def first(self, xs: str, n: str | int) -> str:
        return f"({xs})[1:{n}]"

    def since(self, xs: str, start: str | int) -> str:
        return f"({xs})[{start}:]"

    def at(self, xs: str, n: str | int) -> str:
        return f"({xs})[{n}]"

    def distinct(self, xs: str) -> str:
        return f"list_filter({xs}, lambda e, i: list_position({xs}, e) = i)"

    def distinct_folded(self, xs: str) -> str:
        return f"list_filter({xs}, lambda e, i: list_position(list_transform({xs}, lambda y: lower(y)), lower(e)) = i)"

    def sorted(self, xs: str) -> str:
        return f"list_sort({xs})"

    def concat(self, *xs: str) -> str:
        return f"({' || '.join(xs)})"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def concat_arrays(self, a: str, b: str) -> str:
        return f"list_concat({a}, {b})"

    def lacking(self, xs: str, others: str) -> str:
        return f"list_filter({xs}, lambda e: NOT list_contains(list_transform({others}, lambda y: lower(y)), lower(e)))"

    def reverse(self, xs: str) -> str:
        return f"list_reverse({xs})"

    def has(self, xs: str, x: str) -> str:
        return f"list_contains({xs}, {x})"


Stage = tuple[str, Callable[[Spark], str]]


def frame(df: DataFrame, stages: list[Stage]) -> DataFrame:
    for name, render in stages:
        df = df.withColumn(name, F.expr(render(Spark())))
    return df


def sql(source: str, stages: list[Stage]) -> str:
    """The stages over a table or a parenthesised query."""
    for name, render in stages:
        source = f"(SELECT *, {render(Checker())} AS {name} FROM {source})"
    return source
