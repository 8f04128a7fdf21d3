"""Typed scalar operators as Spark columns; usable without SQL text."""

from .scalar import Typed, add, cast, col, compare, div, lit_float, lit_int, mul, sub, truthy_and, truthy_not, truthy_or

__all__ = ["Typed", "add", "cast", "col", "compare", "div", "lit_float", "lit_int", "mul", "sub", "truthy_and", "truthy_not", "truthy_or"]
