"""From the tree to columns: names are resolved exactly, types aligned, labels set."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame

from ..errors import AnalysisError
from ..functions import scalar as S
from ..types import ColType
from .tree import Arith, Compare, Condition, Expr, FloatLit, IntLit, Logic, Name, Select, render

_ARITH = {"+": S.add, "-": S.sub, "*": S.mul, "/": S.div}


def _operands(c: Condition, op: str) -> list[Condition]:
    """What a run of the same operation joins, in order."""
    out, todo = [], [c]
    while todo:
        match todo.pop():
            case Logic(o, left, right) if o == op:
                todo += [right, left]
            case x:
                out.append(x)
    return out


def _balanced(op: str, xs: list[Column]) -> Column:
    """xs joined by AND or OR as a tree of little depth, so that long chains do not exhaust the planner's stack."""
    while len(xs) > 1:
        pairs = [(x & y if op == "and" else x | y) for x, y in zip(xs[::2], xs[1::2])]
        xs = pairs + xs[len(pairs) * 2 :]
    return xs[0]


class Lowering:
    """Over one table: its DataFrame, its key column (read as `id`), the float columns that may hold NaN."""

    def __init__(self, df: DataFrame, key: str | None, mode: str = "standard", nan_columns: Iterable[str] = ()):
        self.df, self.key, self.mode, self.nan = df, key, mode, set(nan_columns)

    def expr(self, e: Expr) -> S.Typed:
        match e:
            case IntLit(value):
                return S.lit_int(value)
            case FloatLit(value):
                return S.lit_float(value)
            case Name("id") if self.key is not None:
                return S.col(self.df, self.key, self.key not in self.nan)
            case Name(name):
                return S.col(self.df, name, name not in self.nan)
            case Arith(op, left, right):
                return _ARITH[op](self.expr(left), self.expr(right))
        raise TypeError(e)

    def condition(self, c: Condition) -> Column:
        match c:
            case Compare(op, left, right):
                return S.compare(op, self.expr(left), self.expr(right))
            case Logic(op, _, _):
                return _balanced(op, [self.condition(x) for x in _operands(c, op)])
        raise TypeError(c)

    def select(self, q: Select) -> DataFrame:
        try:
            return self._select(q)
        except RecursionError:
            raise AnalysisError("the query is nested too deeply") from None

    def _select(self, q: Select) -> DataFrame:
        out = []
        for o in q.outputs:
            x = self.expr(o.expr)
            if x.type == ColType.OTHER and self.mode == "reference":
                raise AnalysisError(f"{render(o.expr)} is of a type that cannot be selected")
            out.append(x.column.alias(o.label or render(o.expr)))
        df = self.df if q.where is None else self.df.where(self.condition(q.where))
        return df.select(*out)
