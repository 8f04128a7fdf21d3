"""Column types and how they combine."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T

from .errors import AnalysisError


class ColType(IntEnum):
    """In order of generality: of two of the first four, the result has the larger."""

    INT = 0
    INT64 = 1
    FLOAT = 2
    DOUBLE = 3
    CHAR = 4
    OTHER = 5  # carried, not computed on

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    @property
    def is_float(self) -> bool:
        return self in (ColType.FLOAT, ColType.DOUBLE)


_SPARK = {ColType.INT: T.IntegerType(), ColType.INT64: T.LongType(), ColType.FLOAT: T.FloatType(), ColType.DOUBLE: T.DoubleType(), ColType.CHAR: T.ByteType()}
_NAMES = {"int": ColType.INT, "int64": ColType.INT64, "float": ColType.FLOAT, "double": ColType.DOUBLE, "char": ColType.CHAR}


def of_spark(kind: T.DataType) -> ColType:
    return next((c for c, s in _SPARK.items() if s == kind), ColType.OTHER)


def named(name: str | ColType) -> ColType:
    if isinstance(name, ColType):
        return name
    try:
        return _NAMES[name.lower()]
    except KeyError:
        raise AnalysisError(f"no such type: {name}") from None


def generalize(a: ColType, b: ColType) -> ColType:
    """The type of an operation on a and b: INT with FLOAT is FLOAT, INT64 with FLOAT too. CHAR goes with CHAR only."""
    if ColType.OTHER in (a, b):
        raise AnalysisError("only numbers can be computed on or compared")
    if a == b:
        return a
    if ColType.CHAR in (a, b):
        raise AnalysisError("CHAR cannot be combined with another type")
    return max(a, b)
