"""Predicates and their compilation to columns of a known type."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TraversalError, UnsupportedOperation
from .values import class_of, class_of_literal, literal


@dataclass(frozen=True)
class P:
    """A predicate: an operator and its operands."""

    op: str
    operands: tuple[Any, ...]

    @staticmethod
    def eq(x: Any) -> P:
        return P("eq", (x,))

    @staticmethod
    def ne(x: Any) -> P:
        return P("ne", (x,))

    neq = ne

    @staticmethod
    def gt(x: Any) -> P:
        return P("gt", (x,))

    @staticmethod
    def gte(x: Any) -> P:
        return P("gte", (x,))

    @staticmethod
    def lt(x: Any) -> P:
        return P("lt", (x,))

    @staticmethod
    def lte(x: Any) -> P:
        return P("lte", (x,))

    @staticmethod
    def between(low: Any, high: Any) -> P:
        """low <= value < high"""
        return P("between", (low, high))

    @staticmethod
    def within(*xs: Any) -> P:
        return P("within", _flat(xs))

    @staticmethod
    def without(*xs: Any) -> P:
        return P("without", _flat(xs))


def _flat(xs: tuple) -> tuple:
    return tuple(xs[0]) if len(xs) == 1 and isinstance(xs[0], (list, tuple, set, frozenset)) else xs


def predicate(value: Any) -> P:
    """A predicate as it is; a bare value means eq, a list of one eq, of several or none within."""
    if isinstance(value, P):
        return value
    if isinstance(value, (list, tuple, set, frozenset)):
        items = tuple(value)
        return P.eq(items[0]) if len(items) == 1 else P("within", items)
    return P.eq(value)


def only(p: P, *ops: str) -> P:
    if p.op not in ops:
        raise UnsupportedOperation(f"{p.op} is not supported here; {', '.join(ops)} are")
    return p


_COMPARE = {
    "eq": lambda a, b: a == b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}


def _compare(op: str, value: Column, kind: str, operand: Any) -> Column:
    """One comparison that is never null for a value that is present; false between classes that do not compare."""
    other = class_of_literal(operand)
    if kind == "any":
        return reduce(lambda a, b: a | b, [_tagged(op, value, operand, other)])
    if {kind, other} <= {"int", "float"}:
        if kind == other == "int":
            return _COMPARE[op](value.cast("bigint"), literal(operand))
        a, b = value.cast("double"), F.lit(float(operand))
        return _COMPARE[op](a, b) & ~F.isnan(a) & F.lit(operand == operand)
    if kind != other or kind == "vector":
        return F.lit(False)
    return _COMPARE[op](value, literal(operand))


def _tagged(op: str, value: Column, operand: Any, other: str) -> Column:
    tag = value["tag"]
    if other in ("int", "float"):
        number = F.when(tag == "i", value["l"].cast("double")).when(tag == "f", value["d"])
        exact = _COMPARE[op](value["l"], literal(operand)) if other == "int" else _COMPARE[op](number, F.lit(operand))
        loose = _COMPARE[op](number, F.lit(float(operand))) & ~F.isnan(number)
        return F.coalesce(F.when(tag == "i", exact).when(tag == "f", loose), F.lit(False))
    field, column, operand = {
        "string": ("s", value["s"], operand),
        "bool": ("b", value["l"], int(bool(operand))),
        "bytes": ("x", value["s"], operand.hex().upper() if isinstance(operand, (bytes, bytearray)) else getattr(operand, "hex", "").upper()),
    }.get(other, ("none", value["s"], ""))
    return F.coalesce((tag == field) & _COMPARE[op](column, F.lit(operand)), F.lit(False))


def compiled(p: P, value: Column, kind: T.DataType) -> Column:
    """The predicate over a typed column.  A missing value fails every predicate, also ne and without."""
    c = class_of(kind)

    def one(op: str, x: Any) -> Column:
        return _compare(op, value, c, x)

    if p.op in _COMPARE:
        found = one(p.op, p.operands[0])
    elif p.op == "ne":
        found = ~one("eq", p.operands[0])
    elif p.op == "between":
        found = one("gte", p.operands[0]) & one("lt", p.operands[1])
    elif p.op in ("within", "without"):
        same = [x for x in p.operands if class_of_literal(x) == c and c in ("int", "string")]
        rest = [x for x in p.operands if not (class_of_literal(x) == c and c in ("int", "string"))]
        parts = [one("eq", x) for x in rest]
        if same:
            parts.append((value.cast("bigint") if c == "int" else value).isin(*same))
        found = reduce(lambda a, b: a | b, parts, F.lit(False)) if parts else F.lit(False)
        if p.op == "without":
            found = ~found
    else:
        raise TraversalError(f"unknown predicate {p.op}")
    return value.isNotNull() & found
