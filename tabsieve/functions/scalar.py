"""Arithmetic, comparison, truth and cast over columns whose type is known.

Operands are cast to their generalized type and so is the result, which keeps 32-bit types 32-bit. Integer division
truncates toward zero; integer overflow and division by zero raise (Spark's ANSI mode). Float division follows IEEE 754.
A comparison with a NaN is false, and != is true; the guard for that is added only where a NaN is possible, so that
plain column filters are pushed to the scan: after a division, in columns said to hold NaN, and in arithmetic on what
may have overflowed to an infinity. Null columns follow Spark's three-valued logic.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..types import ColType, generalize, named, of_spark

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


@dataclass(frozen=True)
class Typed:
    column: Column
    type: ColType
    maybe_nan: bool = False
    maybe_inf: bool = False
    plain: bool = False  # a column as it is read
    value: float | None = None  # of a float literal


def col(df: DataFrame, name: str, finite: bool = True) -> Typed:
    """A column of df, by its exact name. finite=False: a float column that may hold NaN or infinities."""
    if name not in df.columns:
        raise AnalysisError(f"no such column: {name}")
    kind = of_spark(df.schema[name].dataType)
    odd = not finite and kind.is_float
    return Typed(F.col(f"`{name.replace('`', '``')}`"), kind, odd, odd, plain=True)


def lit_int(value: int) -> Typed:
    if not INT_MIN <= value <= INT_MAX:
        raise AnalysisError(f"{value} is not a 32-bit integer")
    return Typed(F.lit(value).cast("int"), ColType.INT)


def lit_float(value: float) -> Typed:
    """A 32-bit float literal."""
    try:
        value = struct.unpack("f", struct.pack("f", value))[0]
    except OverflowError:
        raise AnalysisError(f"{value} is not a 32-bit float") from None
    return Typed(F.lit(value).cast("float"), ColType.FLOAT, value=value)


def to(x: Typed, kind: ColType) -> Column:
    return x.column if x.type == kind else x.column.cast(kind.spark)


def _binary(a: Typed, b: Typed) -> tuple[ColType, Column, Column]:
    kind = generalize(a.type, b.type)
    return kind, to(a, kind), to(b, kind)


def _result(x: Column, kind: ColType, a: Typed, b: Typed) -> Typed:
    """Of + - *: floats may overflow, and what is computed on an infinity may be NaN."""
    nan = a.maybe_nan or b.maybe_nan or a.maybe_inf or b.maybe_inf
    return Typed(x.cast(kind.spark), kind, kind.is_float and nan, kind.is_float)


def add(a: Typed, b: Typed) -> Typed:
    kind, x, y = _binary(a, b)
    return _result(x + y, kind, a, b)


def sub(a: Typed, b: Typed) -> Typed:
    kind, x, y = _binary(a, b)
    return _result(x - y, kind, a, b)


def mul(a: Typed, b: Typed) -> Typed:
    kind, x, y = _binary(a, b)
    return _result(x * y, kind, a, b)


def div(a: Typed, b: Typed) -> Typed:
    kind, x, y = _binary(a, b)
    if not kind.is_float:
        return Typed(F.call_function("div", x.cast("long"), y.cast("long")).cast(kind.spark), kind)
    # by zero: the sign is that of the dividend and of the zero; 0 and NaN give NaN
    x, y = x.cast("double"), y.cast("double")
    minus_zero = F.lit("-0.0") == y.cast("string")
    infinite = F.when((x > 0) != minus_zero, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    zero = F.when(x.isNull(), x).when((x == 0) | F.isnan(x), F.lit(float("nan"))).otherwise(infinite)
    return Typed(F.when(y == 0, zero).otherwise(F.try_divide(x, y)).cast(kind.spark), kind, True, True)


def cast(x: Typed, kind: str | ColType) -> Typed:
    """To a number type; fractions are cut off. A value that does not fit raises."""
    kind = named(kind)
    if x.type == ColType.OTHER:
        raise AnalysisError("only numbers can be cast")
    narrowed = x.type == ColType.DOUBLE and kind == ColType.FLOAT
    return Typed(to(x, kind), kind, x.maybe_nan and kind.is_float, (x.maybe_inf or narrowed) and kind.is_float)


_COMPARE = {
    "=": lambda x, y: x == y,
    "!=": lambda x, y: x != y,
    "<": lambda x, y: x < y,
    "<=": lambda x, y: x <= y,
    ">": lambda x, y: x > y,
    ">=": lambda x, y: x >= y,
}


_MIRRORED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _scan_bound(op: str, a: Typed, b: Typed) -> Column | None:
    """What an integer column must fulfil itself if its cast compares so with a float literal: a wider bound that the scan
    can take, as it can't take the cast. The cast moves a value by less than 2**-23 of the literal, or past it."""
    if a.value is not None:
        a, b, op = b, a, _MIRRORED.get(op, op)
    if not a.plain or a.type not in (ColType.INT, ColType.INT64) or b.value is None or op == "!=":
        return None
    slack, most = abs(b.value) * 2.0**-23 + 1, 1 << (31 if a.type == ColType.INT else 63)
    low, high = math.floor(b.value - slack), math.ceil(b.value + slack)
    bounds = [a.column >= F.lit(low).cast(a.type.spark)] if op in (">", ">=", "=") and -most <= low < most else []
    bounds += [a.column <= F.lit(high).cast(a.type.spark)] if op in ("<", "<=", "=") and -most <= high < most else []
    return bounds[0] & bounds[1] if len(bounds) == 2 else bounds[0] if bounds else None


def compare(op: str, a: Typed, b: Typed) -> Column:
    _, x, y = _binary(a, b)
    out = _COMPARE[op](x, y)
    if (bound := _scan_bound(op, a, b)) is not None:
        out = bound & out
    if nans := [F.isnan(c) for c, t in ((x, a), (y, b)) if t.maybe_nan]:
        for n in nans:
            out = (out | n) if op == "!=" else (out & ~n)
    return out


def _truthy(x: Typed) -> Column:
    if x.type == ColType.OTHER:
        raise AnalysisError("only numbers have a truth value")
    return x.column != F.lit(0).cast(x.type.spark)


def truthy_and(a: Typed, b: Typed) -> Column:
    return _truthy(a) & _truthy(b)


def truthy_or(a: Typed, b: Typed) -> Column:
    return _truthy(a) | _truthy(b)


def truthy_not(a: Typed) -> Column:
    return ~_truthy(a)
