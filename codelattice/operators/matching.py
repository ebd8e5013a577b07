"""Matchers on call sites, arguments and attributes.

Rules are turned into columns on the driver: exact names become ``IN`` lists (which reach the scan), wildcards at an end become
prefix, suffix and contains tests, argument constraints become expressions over the array of arguments. Nothing is joined or shuffled.

``call_sites`` needs ``target`` and, for argument constraints, ``arguments array<struct<value:string, is_variable:boolean, position:int>>``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def pattern_match(value: Column, patterns: Sequence[str], wildcard: bool | None = None) -> Column:
    """Whether a call's name matches one of the patterns.

    With wildcards (if any pattern holds a ``*``) stars at the ends stand for anything and a star inside is an ordinary character.
    """
    if wildcard is None:
        wildcard = any("*" in p for p in patterns)
    exact, tests = [], []
    for p in dict.fromkeys(patterns):
        if not wildcard or "*" not in (p[:1], p[-1:]):
            exact.append(p)
        elif p.strip("*") == "" and p:
            tests.append(value.isNotNull())
        elif p[0] == "*" and p[-1] == "*":
            tests.append(F.contains(value, F.lit(p.strip("*"))))
        elif p[0] == "*":
            tests.append(F.endswith(value, F.lit(p[1:])))
        else:
            tests.append(F.startswith(value, F.lit(p[:-1])))
    return any_of(([value.isin(*exact)] if exact else []) + tests)


def name_pattern(value: Column, patterns: Sequence[str]) -> Column:
    """A dataflow pattern: the name up to its bracket equals it, ends with ``.p``, begins with ``p.`` or has it as last segment."""
    name = F.substring_index(value, "(", 1)
    return (F.coalesce(value, F.lit("")) != "") & any_of(
        [(name == p) | F.endswith(name, F.lit("." + p)) | F.startswith(name, F.lit(p + ".")) | (F.substring_index(name, ".", -1) == p) for p in dict.fromkeys(patterns) if p]
    )


def clean_value(value: Column) -> Column:
    """Blanks and one layer of matching quotes removed."""
    v = F.trim(value)
    quoted = v.rlike(r"(?s)^(?:\".*\"|'.*')$") & (F.length(v) >= 2)
    return F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


def normalize_value(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low.isin("true", "false"), low).when(low.isin("none", "null", "nil"), F.lit("none")).otherwise(value)


def _normal(value: str) -> str:
    low = value.lower()
    return low if low in ("true", "false") else "none" if low in ("none", "null", "nil") else value


def wildcard_match(value: Column, pattern: str) -> Column:
    """A glob over the whole value: ``*`` any characters, ``?`` one."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in _normal(pattern))
    return normalize_value(value).rlike(f"(?s)^{body}$")


def number(value: Column) -> Column:
    """A number literal as double: decimal, hexadecimal, octal (also with a leading zero) and binary integers, else floats; null if none."""
    v = F.regexp_replace(F.trim(value), r"(?<=\w)_(?=\w)", "")
    sign = F.when(F.startswith(v, F.lit("-")), F.lit(-1.0)).otherwise(F.lit(1.0))
    digits = F.regexp_replace(v, r"^[+-]", "")
    out = None
    for pattern, base in ((r"^0[xX]([0-9a-fA-F]+)$", 16), (r"^0[oO]([0-7]+)$", 8), (r"^0[bB]([01]+)$", 2), (r"^0([0-7]+)$", 8)):
        n = F.conv(F.regexp_extract(digits, pattern, 1), base, 10).cast("double") * sign
        out = F.when(digits.rlike(pattern), n) if out is None else out.when(digits.rlike(pattern), n)
    return out.when(v.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), v.try_cast("double"))


@dataclass(frozen=True)
class Constraint:
    """What an argument must be: a value (text, truth, number, None or a list of these) or a comparator with its operand."""

    value: Any = None
    wildcard: bool = False
    comparator: str = ""


def _single(actual: Column, expected: Any, wildcard: bool) -> Column:
    if isinstance(expected, bool):
        return F.lower(F.trim(actual)).isin(*(("true", "1") if expected else ("false", "0")))
    if isinstance(expected, int | float):
        return F.coalesce(number(actual) == float(expected), F.lit(False))
    if expected is None:
        return actual.isin("None", "nil", "null")
    if isinstance(expected, str):
        return wildcard_match(actual, expected) if wildcard else normalize_value(actual) == _normal(expected)
    return F.lit(False)


def value_match(actual: Column, c: Constraint, lists: bool = True, comparators: bool = False) -> Column:
    """Whether an argument's text satisfies a constraint.

    Plain call matchers take lists and ignore comparators; typed matchers take comparators and let no list match.
    """
    v = clean_value(actual)
    if comparators and c.comparator:
        n = number(v)
        if c.comparator == "regex":
            return v.rlike(c.value) if isinstance(c.value, str) else F.lit(False)
        if c.comparator in ("lt", "gt", "lte", "gte") and isinstance(c.value, int | float):
            bound = float(c.value)
            return F.coalesce({"lt": n < bound, "gt": n > bound, "lte": n <= bound, "gte": n >= bound}[c.comparator], F.lit(False))
        return F.lit(False)
    if isinstance(c.value, list | tuple):
        return any_of([_single(v, x, c.wildcard) for x in c.value]) if lists else F.lit(False)
    return _single(v, c.value, c.wildcard)


def tuple_element(value: Column, index: int) -> Column:
    """An element of a tuple or list literal, split at its commas; of anything else the whole as element 0. Null where there is none."""
    v = F.trim(value)
    is_tuple = v.rlike(r"(?s)^(?:\(.*\)|\[.*\])$")
    inner = F.when(is_tuple, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    whole = v if index == 0 else F.lit(None).cast("string")
    return F.when(is_tuple, clean_value(F.get(F.split(inner, ","), F.lit(index)))).otherwise(whole)


def keyword_value(arguments: Column, name: str) -> Column:
    """A keyword argument's text: of the arguments that hold ``=``, cut at the first one, the last of that name; null if there is none."""
    mine = F.filter(arguments, lambda a: F.contains(a["value"], F.lit("=")) & (F.trim(F.substring_index(a["value"], "=", 1)) == name))
    return F.trim(F.regexp_extract(F.try_element_at(mine, F.lit(-1))["value"], r"(?s)^[^=]*=(.*)$", 1))


def _holds(value: Column, c: Constraint, lists: bool, comparators: bool) -> Column:
    """``value_match`` with the value computed once, however often the test mentions it; null counts as false."""
    return F.coalesce(F.exists(F.array(value), lambda v: value_match(v, c, lists, comparators)), F.lit(False))


def argument_match(arguments: Column, positional: Mapping[str, Constraint] = {}, keyword: Mapping[str, Constraint] = {}, lists: bool = True, comparators: bool = False) -> Column:  # noqa: B006
    """All constraints together. Positions are ``"N"`` or ``"N[M]"`` (an element of a tuple); what isn't there matches nothing."""
    tests: list[Column] = []
    for place, c in positional.items():
        m = re.fullmatch(r"(\d+)(?:\[(\d+)\])?", place)
        if not m or (comparators and c.comparator == "missing"):
            tests.append(F.lit(False))
            continue
        actual = F.get(arguments, F.lit(int(m.group(1))))["value"]
        if m.group(2) is not None:
            actual = tuple_element(actual, int(m.group(2)))
        tests.append(_holds(actual, c, lists, comparators))
    for name, c in keyword.items():
        if comparators and c.comparator == "missing":
            tests.append(keyword_value(arguments, name).isNull())
        else:
            tests.append(_holds(keyword_value(arguments, name), c, lists, comparators))
    return all_of(tests)


def call_matcher(call_sites: DataFrame, patterns: Sequence[str], positional: Mapping[str, Constraint] = {}, keyword: Mapping[str, Constraint] = {}) -> DataFrame:  # noqa: B006
    """Call sites whose name matches a pattern and whose arguments satisfy all constraints; confidence 1, scope local."""
    hit = pattern_match(F.col("target"), patterns)
    if positional or keyword:
        hit = hit & argument_match(F.col("arguments"), positional, keyword)
    return call_sites.where(hit).withColumns({"confidence": F.lit(1.0), "scope": F.lit("local"), "match_method": F.lit("call")})


def variable_matcher(call_sites: DataFrame, pattern: str) -> DataFrame:
    """One row for each argument that is a bare identifier matching the pattern."""
    rows = call_sites.withColumn("argument", F.explode("arguments")).where(F.col("argument.is_variable"))
    rows = rows.where(pattern_match(F.col("argument.value"), [pattern]))
    return rows.withColumns({"tainted_var": F.col("argument.value"), "confidence": F.lit(1.0), "scope": F.lit("local"), "match_method": F.lit("variable")}).drop("argument")


def attribute_matcher(statements: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Statements that read an attribute: equal to a pattern or ending in ``.pattern``."""
    a = F.col("attribute_access")
    return statements.where((a != "") & any_of([a.isin(*patterns)] + [F.endswith(a, F.lit("." + p)) for p in patterns]))


def exploded(arrays: Sequence[Column]) -> Column:
    """The elements of all arrays, null where there is none.

    ``flatten`` is compiled along with what it holds, which filters of arrays are not. The explode is an outer one: a plain one would
    add a filter on the array's size and so compute everything twice.
    """
    return F.explode_outer(F.flatten(F.array(*arrays)))


def match_rules(call_sites: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Many rules in one pass: a row for each rule whose condition holds, with its id."""
    ids = [F.array_repeat(F.lit(r), F.when(c, 1).otherwise(0)) for r, c in rules.items()]
    return call_sites.withColumn("rule_id", exploded(ids)).where(F.col("rule_id").isNotNull())
