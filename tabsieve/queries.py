"""The registered queries of the engine itself, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import functions as fn
from . import operators as ops
from . import queries_api
from .session import Engine

KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "customer": "c_custkey", "events": "event_id", "nation": "n_nationkey"}

Query = Callable[[SparkSession, str], DataFrame]


def engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    e = Engine(spark)
    for t in tables:
        e.register_parquet(t, f"{sf_dir}/{t}.parquet", KEYS[t])
    return e


def text(sql: str, mode: str = "standard") -> Query:
    table = sql.split(" from ")[1].split()[0]
    return lambda spark, sf_dir: engine(spark, sf_dir, table).sql(sql, mode)


def over(table: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


#: name: (query, SQL)
ALL: dict[str, tuple[Query, str]] = {}


def _add(name: str, query: str, sql: str | None = None, mode: str = "standard") -> None:
    ALL[name] = text(query, mode), sql or query


_add("scan_project", "select l_orderkey, l_linenumber from lineitem")
_add("scan_key_id", "select id, l_quantity from lineitem", "select l_orderkey as id, l_quantity from lineitem")
_add("scan_carried", "select id, l_shipdate, l_returnflag from lineitem", "select l_orderkey as id, l_shipdate, l_returnflag from lineitem")
_add("literal_int", "select id, 7 as k from part", "select p_partkey as id, 7::INT as k from part")
_add("literal_float", "select id, 1.5 as k from part", "select p_partkey as id, 1.5::FLOAT as k from part")
_add("literal_negative", "select id, -3 as k, -0.25 as x from part", "select p_partkey as id, (-3)::INT as k, (-0.25)::FLOAT as x from part")
_add("label_as", "select p_size as size from part")
_add("label_bare", "select p_size size from part")
_add("label_auto", "select p_size + (5 * 20) from part", 'select p_size + 5 * 20 as "(p_size+(5*20))" from part')
for _name, _op in {"eq": "=", "neq": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    _add(f"filter_{_name}", f"select id, p_size from part where p_size {_op} 10", f"select p_partkey as id, p_size from part where p_size {_op} 10")
    _add(f"filter_{_name}_double", f"select id, l_quantity from lineitem where l_quantity {_op} 25.0", f"select l_orderkey as id, l_quantity from lineitem where l_quantity {_op} 25.0::FLOAT")
_LINE = "select l_orderkey as id, l_linenumber, l_quantity from lineitem where "
_line = "select id, l_linenumber, l_quantity from lineitem where "
_add("filter_col_col", _line + "l_quantity > l_linenumber", _LINE + "l_quantity > l_linenumber::DOUBLE")
_add("filter_and", _line + "l_linenumber = 1 and l_quantity < 10.0", _LINE + "l_linenumber = 1 and l_quantity < 10")
_add("filter_or", _line + "l_linenumber = 1 or l_quantity < 10.0", _LINE + "l_linenumber = 1 or l_quantity < 10")
_add("filter_paren_and", _line + "l_quantity < 30.0 and (l_linenumber = 1 or l_linenumber = 3)", _LINE + "l_quantity < 30 and (l_linenumber = 1 or l_linenumber = 3)", "reference")
_add("filter_paren_or", _line + "l_quantity < 3.0 or (l_linenumber = 1 and l_quantity > 40.0)", _LINE + "l_quantity < 3 or (l_linenumber = 1 and l_quantity > 40)", "reference")
_add("filter_paren_left", _line + "(l_quantity < 3.0 or l_linenumber = 1) and l_quantity > 2.0", _LINE + "(l_quantity < 3 or l_linenumber = 1) and l_quantity > 2")
_MIX = "l_linenumber < 3 and l_quantity >= 40.0 or l_quantity < 5.0"
_add("filter_mixed_standard", _line + _MIX, _LINE + "(l_linenumber < 3 and l_quantity >= 40) or l_quantity < 5")
# names of the grammar's reference mode have no underscore, so its queries run over renamed columns
_RENAMED = {"l_linenumber": "line", "l_quantity": "quantity", "l_suppkey": "supp", "l_partkey": "part", "l_tax": "tax", "l_discount": "discount"}


def _reference(sql: str) -> Query:
    """A query in reference mode over lineitem, its columns under names without underscores."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        back = {v: k for k, v in _RENAMED.items()}
        df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnsRenamed(_RENAMED)
        plain = sql
        for old, new in _RENAMED.items():
            plain = plain.replace(old, new)
        out = Engine(spark, "reference").register_df("lineitem", df, "l_orderkey").sql(plain)
        return out.withColumnsRenamed(back)

    return run


for _n in ("filter_paren_and", "filter_paren_or"):
    ALL[_n] = _reference(_line + {"filter_paren_and": "l_quantity < 30.0 and (l_linenumber = 1 or l_linenumber = 3)", "filter_paren_or": "l_quantity < 3.0 or (l_linenumber = 1 and l_quantity > 40.0)"}[_n]), ALL[_n][1]
ALL["filter_mixed_reference"] = _reference(_line + _MIX), _LINE + "l_linenumber < 3 and (l_quantity >= 40 or l_quantity < 5)"
_add("filter_none", "select id from orders", "select o_orderkey as id from orders")
_add("filter_expressions", _line + "l_linenumber * 2 + 1 <= l_suppkey - 3", _LINE + "l_linenumber * 2 + 1 <= l_suppkey - 3")

_truth = lambda f: over("part", lambda d: ops.where(d, f(fn.sub(fn.col(d, "p_size"), fn.lit_int(10)), fn.sub(fn.col(d, "p_size"), fn.lit_int(20)))).select("p_partkey", "p_size"))
ALL["truthy_and"] = _truth(fn.truthy_and), "select p_partkey, p_size from part where p_size - 10 <> 0 and p_size - 20 <> 0"
ALL["truthy_or"] = _truth(fn.truthy_or), "select p_partkey, p_size from part where p_size - 10 <> 0 or p_size - 20 <> 0"
ALL["truthy_not"] = _truth(lambda a, b: fn.truthy_not(a)), "select p_partkey, p_size from part where p_size - 10 = 0"

for _name, _op in {"add": "+", "sub": "-", "mul": "*"}.items():
    _add(f"math_{_name}_int", f"select id, p_size {_op} 7 as x from part", f"select p_partkey as id, (p_size {_op} 7)::INT as x from part")
    _add(f"math_{_name}_int64", f"select id, l_suppkey {_op} l_linenumber as x from lineitem", f"select l_orderkey as id, l_suppkey {_op} l_linenumber as x from lineitem")
    _add(f"math_{_name}_double", f"select id, l_quantity {_op} 1.5 as x from lineitem", f"select l_orderkey as id, l_quantity {_op} 1.5 as x from lineitem")
    ALL[f"math_{_name}_float"] = (
        over("lineitem", lambda d, f=getattr(fn, _name): ops.project(d, id=fn.col(d, "l_orderkey"), x=f(fn.cast(fn.col(d, "l_quantity"), "float"), fn.lit_float(0.1)))),
        f"select l_orderkey as id, l_quantity::FLOAT {_op} 0.1::FLOAT as x from lineitem",
    )
_add("math_intdiv", "select id, p_size / 3 as x from part", "select p_partkey as id, (p_size // 3)::INT as x from part")
_add("math_intdiv_negative", "select id, (p_size - 25) / 4 as x from part", "select p_partkey as id, ((p_size - 25) // 4)::INT as x from part")
_add("math_intdiv_int64", "select id, (l_suppkey - 50) / l_linenumber as x from lineitem", "select l_orderkey as id, (l_suppkey - 50) // l_linenumber as x from lineitem")
ALL["math_fdiv"] = (
    over("lineitem", lambda d: ops.project(d, id=fn.col(d, "l_orderkey"), x=fn.div(fn.cast(fn.col(d, "l_extendedprice"), "float"), fn.cast(fn.col(d, "l_quantity"), "float")))),
    "select l_orderkey as id, l_extendedprice::FLOAT / l_quantity::FLOAT as x from lineitem",
)
_add("math_fdiv_double", "select id, l_extendedprice / l_quantity as x from lineitem", "select l_orderkey as id, l_extendedprice / l_quantity as x from lineitem")
_add("math_promote_int_float", "select id, p_size + 0.5 as x from part", "select p_partkey as id, p_size::FLOAT + 0.5::FLOAT as x from part")
_add("math_promote_int64_float", "select id, l_suppkey * 0.5 as x from lineitem", "select l_orderkey as id, l_suppkey::FLOAT * 0.5::FLOAT as x from lineitem")
_add("math_precedence", "select id, l_suppkey - l_linenumber * 2 - 1 as x from lineitem", "select l_orderkey as id, l_suppkey - l_linenumber * 2 - 1 as x from lineitem")
ALL["math_right_assoc"] = _reference("select id, l_suppkey - l_linenumber - 1 as x from lineitem"), "select l_orderkey as id, l_suppkey - (l_linenumber - 1) as x from lineitem"
ALL["math_right_nested"] = _reference("select id, l_suppkey * l_linenumber + 1 as x from lineitem"), "select l_orderkey as id, l_suppkey * (l_linenumber + 1) as x from lineitem"
for _kind, _sql in {"int": "trunc(s_acctbal)::INT", "int64": "trunc(s_acctbal)::BIGINT", "float": "s_acctbal::FLOAT", "double": "s_acctbal"}.items():
    ALL[f"cast_{_kind}"] = over("supplier", lambda d, k=_kind: ops.project(d, id=fn.col(d, "s_suppkey"), x=fn.cast(fn.col(d, "s_acctbal"), k))), f"select s_suppkey as id, {_sql} as x from supplier"
ALL["cast_char"] = over("part", lambda d: ops.project(d, id=fn.col(d, "p_partkey"), x=fn.cast(fn.col(d, "p_size"), "char"))), "select p_partkey as id, p_size::TINYINT as x from part"
ALL["num_rows"] = over("lineitem", ops.num_rows), "select count(*) as num_rows from lineitem"

# the ten benchmark shapes over lineitem
SUITE = [
    ("l_suppkey, l_linenumber", "l_suppkey > 60 and l_linenumber < 4"),
    ("l_quantity, l_discount", "l_quantity > 30.0 and l_discount < 0.0625"),
    ("l_suppkey, l_linenumber", "l_suppkey > 10 and l_linenumber < 7"),
    ("l_quantity, l_discount", "l_quantity > 5.0 and l_discount < 0.0875"),
    ("l_linenumber, l_suppkey", "(l_linenumber + 40) > (l_suppkey - 10)"),
    ("l_tax, l_quantity", "(l_tax + 40.0) > (l_quantity - 1.0)"),
    ("l_suppkey, l_linenumber", "l_suppkey * l_linenumber >= 50 and l_suppkey * l_linenumber <= 200"),
    ("l_quantity, l_discount", "l_quantity * l_discount >= 0.5 and l_quantity * l_discount <= 1.5"),
    ("l_suppkey, l_linenumber, l_partkey", "l_suppkey >= 40 and l_suppkey <= 60 or l_linenumber >= 2 and l_linenumber <= 3 or l_partkey >= 900 and l_partkey <= 1100"),
    ("l_quantity, l_tax, l_discount", "l_quantity >= 20.0 and l_quantity <= 25.0 or l_tax >= 0.03125 and l_tax <= 0.0625 or l_discount >= 0.03125 and l_discount <= 0.0625"),
]


def _duck(where: str) -> str:
    """Decimal literals as 32-bit floats."""
    import re

    return re.sub(r"\b(\d+\.\d+)\b", r"\1::FLOAT", where)


def _nested(where: str) -> str:
    """The grouping of reference mode, written out: each AND and OR takes all that follows."""
    import re

    parts = re.split(r" (and|or) ", where)
    out = parts[-1]
    for k in range(len(parts) - 3, -1, -2):
        out = f"{parts[k]} {parts[k + 1]} ({out})"
    return out


for _k, (_cols, _where) in enumerate(SUITE):
    _sql = f"select l_orderkey as id, {_cols} from lineitem where "
    if _k < 8:
        _add(f"suite_{_k}", f"select id, {_cols} from lineitem where {_where}", _sql + _duck(_where))
    else:
        _add(f"suite_{_k}_standard", f"select id, {_cols} from lineitem where {_where}", _sql + _duck(_where))
        ALL[f"suite_{_k}_reference"] = _reference(f"select id, {_cols} from lineitem where {_where}"), _sql + _duck(_nested(_where))

ALL |= queries_api.ALL
QUERIES: dict[str, Query] = {name: q for name, (q, _) in ALL.items()}
SQL: dict[str, str] = {name: s for name, (_, s) in ALL.items()}
