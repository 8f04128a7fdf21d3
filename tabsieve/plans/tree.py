"""The query tree and how its expressions are written out as labels."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class IntLit:
    value: int


@dataclass(frozen=True)
class FloatLit:
    value: float


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Arith:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Compare:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Logic:
    op: str  # "and" or "or"
    left: Condition
    right: Condition


Expr = IntLit | FloatLit | Name | Arith
Condition = Compare | Logic


@dataclass(frozen=True)
class Output:
    expr: Expr
    label: str | None = None


@dataclass(frozen=True)
class Select:
    outputs: tuple[Output, ...]
    table: str
    where: Condition | None = None


def render(e: Expr) -> str:
    """The label of an expression without one: binary operations in parentheses, no spaces, floats with six decimals."""
    match e:
        case IntLit(value):
            return str(value)
        case FloatLit(value):
            return f"{value:f}"
        case Name(name):
            return name
        case Arith(op, left, right):
            return f"({render(left)}{op}{render(right)})"
    raise TypeError(e)
