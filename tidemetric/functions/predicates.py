"""Predicates from data: filter lists, filter text and targeting rules, all as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {"=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v}
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_.]*$")


def all_of(rules: list[tuple[str, str, object]]) -> Column:
    """AND of (field, op, value) with op in = != < <= > >= IN; an empty list is true."""
    out = []
    for field, op, value in rules:
        if not _NAME.match(field):
            raise ValueError(f"not a field name: {field!r}")
        if op.upper() == "IN":
            out.append(F.col(field).isin(*value))
        elif op in _OPS:
            out.append(_OPS[op](F.col(field), F.lit(value)))
        else:
            raise ValueError(f"no such operator: {op!r}")
    return reduce(lambda a, b: a & b, out, F.lit(True))


def filter_text(text: str) -> Column:
    """A filter over plain columns as Spark parses it; statements, subqueries and calls are refused."""
    if ";" in text or "--" in text or "/*" in text:
        raise ValueError("one predicate is expected")
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    if re.search(r"\b(select|from|join|union|insert|update|delete|drop|create|alter)\b", bare, re.IGNORECASE):
        raise ValueError("a filter holds comparisons only")
    if re.search(r"\b(?!(?:and|or|not|in|is|null)\b)[A-Za-z_]\w*\s*\(", bare, re.IGNORECASE):
        raise ValueError("a filter holds no function calls")
    return F.expr(text)


def _rule(attributes: Column, name: str, op: str, values: list[str]) -> Column:
    found = F.try_element_at(attributes, F.lit(name))
    first = values[0] if values else ""
    number, limit = found.try_cast("double"), F.lit(first).try_cast("double")
    tests = {
        "EQUALS": lambda: found == first,
        "NOT_EQUALS": lambda: found != first,
        "IN": lambda: found.isin(*values),
        "NOT_IN": lambda: ~found.isin(*values),
        "CONTAINS": lambda: found.contains(first),
        "GT": lambda: number > limit,
        "LT": lambda: number < limit,
        "GTE": lambda: number >= limit,
        "LTE": lambda: number <= limit,
    }
    if op not in tests:
        raise ValueError(f"no such operator: {op!r}")
    return F.coalesce(tests[op](), F.lit(False))


def targeting(attributes: Column, groups: list[list[tuple[str, str, list[str]]]]) -> Column:
    """AND over groups, OR within a group, of (attribute, op, values) on a map column.

    A missing attribute, or one that is no number where a number is asked for, is false.
    No groups target everyone; an empty group targets no one.
    """
    one_of = [reduce(lambda a, b: a | b, [_rule(attributes, *r) for r in group], F.lit(False)) for group in groups]
    return reduce(lambda a, b: a & b, one_of, F.lit(True))
