"""Registered queries of the catalog, the cursor and the engine's other calls, and their SQL.

Each returns what the calls gave as a DataFrame. Small tables (nation, region) go in row by row; the others as DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from . import operators as ops
from .errors import AnalysisError, EngineError, ParseError
from .result import Result
from .scratch import new_path
from .session import Engine
from .sources import Database, Table, benchmark_table
from .streaming import start, stream_table
from .timing import Timer

Query = Callable[[SparkSession, str], DataFrame]

#: name: (query, SQL)
ALL: dict[str, tuple[Query, str]] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        ALL[f.__name__] = f, sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _nation(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """The 25 rows of nation, as a client would hold them."""
    rows = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int"), F.col("n_regionkey").cast("int"))
    return [tuple(r) for r in rows.collect()]


def _database(spark: SparkSession) -> tuple[Engine, Database]:
    e = Engine(spark)
    return e, e.create_database(new_path(spark, "database"))


def _orders(db: Database) -> Table:
    t = db.create_table("orders", "int64", "o_orderkey")
    t.add_column("o_custkey", "int64")
    t.add_column("o_totalprice", "double")
    return t


_ORDERS = ("o_orderkey", "o_custkey", "o_totalprice")
_NATION = "select n_nationkey::INT as id, n_regionkey::INT as n_regionkey from nation"
_ALL_ORDERS = "select o_orderkey as id, o_custkey, o_totalprice from orders"


@_query(_NATION)
def catalog_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create a database and a table, add a column, insert row by row, query."""
    e, db = _database(spark)
    t = db.create_table("nation", "int", "n_nationkey")
    t.add_column("n_regionkey", "int")
    for row in _nation(spark, sf_dir):
        t.insert(*row)
    return e.sql("select id, n_regionkey from nation")


@_query(_ALL_ORDERS + " where o_totalprice > 100000::FLOAT")
def catalog_bulk_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, db = _database(spark)
    _orders(db).insert_df(_read(spark, sf_dir, "orders").select(*_ORDERS))
    return e.sql("select id, o_custkey, o_totalprice from orders where o_totalprice > 100000.0")


@_query(_ALL_ORDERS + " where o_custkey <= 100")
def catalog_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written before a database was closed is there when it is opened again, by another engine."""
    e, db = _database(spark)
    _orders(db).insert_df(_read(spark, sf_dir, "orders").select(*_ORDERS))
    e.close_database()
    again = Engine(spark)
    again.open_database(db.path)
    return again.sql("select id, o_custkey, o_totalprice from orders where o_custkey <= 100")


@_query("select o_orderkey as id, CASE WHEN o_orderkey % 2 = 0 THEN 2.5::FLOAT ELSE 1.5::FLOAT END as x from orders")
def catalog_add_column_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written before a column was added have its default."""
    e, db = _database(spark)
    t, rows = _orders(db), _read(spark, sf_dir, "orders").select(*_ORDERS)
    t.insert_df(rows.filter("o_orderkey % 2 = 1"))
    t.add_column("x", "float", 1.5)
    t.insert_df(rows.filter("o_orderkey % 2 = 0").withColumn("x", F.lit(2.5).cast("float")))
    return e.sql("select id, x from orders")


@_query("select * from (values ('nation', 0, 'INT', 'n_regionkey', 0, 'INT'), ('orders', 1, 'INT64', 'o_custkey', 0, 'INT64'), ('orders', 1, 'INT64', 'o_totalprice', 1, 'DOUBLE')) t(table_name, table_id, key_type, column_name, column_id, column_type)")  # noqa: E501
def catalog_ids_and_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, db = _database(spark)
    db.create_table("nation", "int", "n_nationkey").add_column("n_regionkey", "int")
    _orders(db)
    rows = [(n, db.table_id(n), t.key_type.name, c.name, t.column_id(c.name), t.column_type(c.name).name) for n, t in db.tables.items() for c in t.columns]
    return spark.createDataFrame(rows, "table_name string, table_id int, key_type string, column_name string, column_id int, column_type string")


@_query("select 2 * count(*) as num_rows from orders")
def catalog_num_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, db = _database(spark)
    t, rows = _orders(db), _read(spark, sf_dir, "orders").select(*_ORDERS)
    t.insert_df(rows)
    t.insert_df(rows)
    return spark.createDataFrame([(t.num_rows(),)], "num_rows long")


@_query(f"{_NATION} union all select 100, 7")
def catalog_preload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preloaded table that grows shows its new rows."""
    e, db = _database(spark)
    t = db.create_table("nation", "int", "n_nationkey")
    t.add_column("n_regionkey", "int")
    t.insert_many(_nation(spark, sf_dir))
    e.preload("nation")
    t.insert(100, 7)
    return e.sql("select id, n_regionkey from nation")


@_query(_NATION)
def catalog_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark).register_df("nation", _read(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as int) n_nationkey", "cast(n_regionkey as int) n_regionkey"), "n_nationkey")
    e.preload("nation")
    e.release("nation")
    r = e.query("select id, n_regionkey from nation").preload()
    r.release()
    return r.df


@_query("select o_orderkey, o_custkey, o_totalprice from orders")
def catalog_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table dumped with its key, and the dump read back."""
    _, db = _database(spark)
    t = _orders(db)
    t.insert_df(_read(spark, sf_dir, "orders").select(*_ORDERS))
    t.to_csv(path := new_path(spark, "dump"))
    return spark.read.csv(path, header=True, schema=t.schema)


def _regions(spark: SparkSession, sf_dir: str, blocks: int = 4) -> Result:
    """A result over nation in blocks."""
    df = _read(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as int) n_nationkey", "cast(n_regionkey as int) n_regionkey")
    return Engine(spark).register_df("nation", df.repartition(blocks, "n_nationkey"), "n_nationkey").query("select id, n_regionkey from nation")


@_query(_NATION)
def cursor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _regions(spark, sf_dir)
    rows = []
    while (row := r.next_row()) is not None:
        rows.append(tuple(row))
    return spark.createDataFrame(rows, r.schema)


@_query("select i as n_read, count(*) - i as remaining from nation, range(26) t(i) where i <= 25 group by i")
def cursor_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each row, how many remain."""
    r = _regions(spark, sf_dir)
    rows = [(0, r.remaining())]
    while r.next_row() is not None:
        rows.append((len(rows), r.remaining()))
    return spark.createDataFrame(rows, "n_read long, remaining long")


@_query("select count(*) as in_blocks, count(*) as after_skips, true as at_end from nation")
def cursor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows counted block by block; and read up to the middle of each block, then skipping to the next."""
    r = _regions(spark, sf_dir)
    sizes = [len(b) for b in r.blocks()]
    seen, before = 0, r.remaining()
    while r.next_block():
        r.next_row()
        seen += before - r.remaining()
        before = r.remaining()
    seen += before - r.remaining()
    return spark.createDataFrame([(sum(sizes), seen, r.next_row() is None)], "in_blocks long, after_skips long, at_end boolean")


@_query("select printf('%10d%10d%10.2f', s_suppkey, s_nationkey, s_acctbal) as line from supplier")
def cursor_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Engine(spark).register_df("supplier", _read(spark, sf_dir, "supplier"), "s_suppkey").query("select id, s_nationkey, s_acctbal from supplier")
    return spark.createDataFrame([(r.format_row(row),) for row in r.rows()], "line string")


@_query("select 'id,uniformi,normali5,normali20,uniformf,normalf5,normalf20' as columns, 10000::BIGINT as n, 10000::BIGINT as n_keys, true as in_range, true as spread")
def generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark table's shape: keys from 0, uniform values within their bounds, deviations near 5 and 20."""
    df = benchmark_table(spark, 10_000)
    inside = F.min("uniformi") >= -100, F.max("uniformi") <= 99, F.min("uniformf") >= -100, F.max("uniformf") < 100, F.min("id") == 0, F.max("id") == 9_999
    near = [F.abs(F.stddev(c) - d) < d / 10 for c, d in (("normali5", 5), ("normalf5", 5), ("normali20", 20), ("normalf20", 20))]
    both = lambda xs: reduce(and_, xs)
    return df.agg(F.lit(",".join(df.columns)).alias("columns"), F.count("*").alias("n"), F.count_distinct("id").alias("n_keys"), both(inside).alias("in_range"), both(near).alias("spread"))


@_query("select s_suppkey as id, s_acctbal from supplier where s_acctbal > 1000::FLOAT union all select s_suppkey, s_acctbal from supplier where s_acctbal > 1000::FLOAT")
def prepare_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared once, executed twice."""
    p = Engine(spark).register_parquet("supplier", f"{sf_dir}/supplier.parquet", "s_suppkey").prepare("select id, s_acctbal from supplier where s_acctbal > 1000.0")
    return p.execute().df.unionByName(p.execute().df)


@_query("select s_suppkey as id from supplier where s_nationkey < 10")
def query_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).register_parquet("supplier", f"{sf_dir}/supplier.parquet", "s_suppkey").query("select id from supplier where s_nationkey < 10").df


@_query("select f as flag, count(*) as n from supplier, (values ('use_gpu'), ('use_mmap'), ('use_multi'), ('use_stream'), ('none')) t(f) where s_nationkey < 10 group by f")
def mode_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever the flags, the rows are the same."""
    rows = []
    for flag in ("use_gpu", "use_mmap", "use_multi", "use_stream", "none"):
        e = Engine(spark, multi_threads=2, **({} if flag == "none" else {flag: True}))
        rows.append((flag, e.register_parquet("supplier", f"{sf_dir}/supplier.parquet", "s_suppkey").query("select id from supplier where s_nationkey < 10").count()))
    return spark.createDataFrame(rows, "flag string, n long")


@_query("select false as shuffles, false as python, true as pushed, true as pruned")
def explain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Engine(spark).register_parquet("lineitem", f"{sf_dir}/lineitem.parquet", "l_orderkey").explain("select id, l_quantity from lineitem where l_quantity <= 25.0")
    row = ("Exchange" in plan, "Python" in plan, "LessThanOrEqual(l_quantity,25.0)" in plan, "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan)
    return spark.createDataFrame([row], "shuffles boolean, python boolean, pushed boolean, pruned boolean")


@_query("select true as ran, count(*) as n from region")
def timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Timer() as t:
        n = Engine(spark).register_parquet("region", f"{sf_dir}/region.parquet", "r_regionkey").query("select id from region").count()
    return spark.createDataFrame([(0 < t.seconds < 600, n)], "ran boolean, n long")


@_query("select * from (values ('after close', 'AnalysisError'), ('closed twice', 'none'), ('insert after close', 'CatalogError'), ('opened twice', 'CatalogError'), ('exists', 'CatalogError')) t(what, error)")
def engine_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing the engine closes its database and forgets its tables."""
    e, db = _database(spark)
    t = db.create_table("t", "int")

    def error(call: Callable[[], object]) -> str:
        try:
            call()
        except EngineError as x:
            return type(x).__name__
        return "none"

    rows = [("opened twice", error(lambda: e.open_database(db.path))), ("exists", error(lambda: Database.create(spark, db.path)))]
    e.close()
    rows += [("after close", error(lambda: e.sql("select id from t"))), ("closed twice", error(e.close)), ("insert after close", error(lambda: t.insert(1)))]
    return spark.createDataFrame(rows, "what string, error string")


_WRONG = {
    "select id lineitem": "ParseError",
    "select * from lineitem": "ParseError",
    "select id from lineitem where": "ParseError",
    "select id from nosuch": "AnalysisError",
    "select nosuch from lineitem": "AnalysisError",
    "select L_QUANTITY from lineitem": "AnalysisError",
    "select l_returnflag + 1 from lineitem": "AnalysisError",
    "select 3000000000 as x from lineitem": "AnalysisError",
}


@_query(f"select * from (values {', '.join(f"('{t}', '{x}')" for t, x in _WRONG.items())}) t(query, error)")
def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, rows = Engine(spark).register_parquet("lineitem", f"{sf_dir}/lineitem.parquet", "l_orderkey"), []
    for text in _WRONG:
        try:
            e.sql(text)
            rows.append((text, "none"))
        except (ParseError, AnalysisError) as x:
            rows.append((text, type(x).__name__))
    return spark.createDataFrame(rows, "query string, error string")


@_query("select event_id as id, value from events where value > 50::FLOAT")
def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over a stream of Parquet files, written to a folder, read again."""
    rows = _read(spark, sf_dir, "events").select("event_id", "value")
    rows.write.parquet(source := new_path(spark, "stream-in"))
    e = stream_table(Engine(spark), "events", source, rows, "event_id")
    start(e.sql("select id, value from events where value > 50.0"), out := new_path(spark, "stream-out"), new_path(spark, "stream-state")).awaitTermination()
    return spark.read.schema("id long, value double").parquet(out)


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem")


@_query("select l_orderkey as id, l_quantity / (l_linenumber - 3)::DOUBLE as x from lineitem where l_linenumber <> 3 union all select l_orderkey, 'inf'::DOUBLE from lineitem where l_linenumber = 3")
def math_fdiv_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A positive number divided by zero is infinite."""
    d = _lineitem(spark, sf_dir)
    return ops.project(d, id=fn.col(d, "l_orderkey"), x=fn.div(fn.col(d, "l_quantity"), fn.cast(fn.sub(fn.col(d, "l_linenumber"), fn.lit_int(3)), "double")))


@_query("select l_orderkey as id, l_linenumber from lineitem where l_linenumber > 3")
def nan_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n - 3) / (n - 3) >= 1 or > 1: NaN where n = 3, for which neither holds; rows below 3 are left out by the second."""
    d = _lineitem(spark, sf_dir)
    x = fn.cast(fn.sub(fn.col(d, "l_linenumber"), fn.lit_int(3)), "float")
    ratio = fn.div(x, x)
    return ops.where(d, fn.compare(">=", ratio, fn.lit_float(1.0)) & fn.compare(">", fn.col(d, "l_linenumber"), fn.lit_int(2))).selectExpr("l_orderkey id", "l_linenumber")


@_query("select l_orderkey as id, l_linenumber from lineitem where l_linenumber = 3")
def nan_not_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN differs from itself."""
    d = _lineitem(spark, sf_dir)
    x = fn.cast(fn.sub(fn.col(d, "l_linenumber"), fn.lit_int(3)), "float")
    ratio = fn.div(x, x)
    return ops.where(d, fn.compare("!=", ratio, ratio)).selectExpr("l_orderkey id", "l_linenumber")


@_query("select l_orderkey as id from lineitem where false")
def nan_of_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inf - inf, after both have overflowed, compares with nothing."""
    d = _lineitem(spark, sf_dir)
    big = fn.mul(fn.mul(fn.cast(fn.col(d, "l_quantity"), "float"), fn.lit_float(1e30)), fn.lit_float(1e30))
    return ops.where(d, fn.compare(">", fn.sub(big, big), fn.lit_float(0.0))).selectExpr("l_orderkey id")


@_query("select p_partkey as id, p_size, p_size as p_size_again from part where p_size + 1 > 10 or p_size + 1 < 3")
def repeated_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output twice, and an expression of both arms of an OR."""
    return Engine(spark).register_parquet("part", f"{sf_dir}/part.parquet", "p_partkey").sql("select id, p_size, p_size as p_size_again from part where p_size + 1 > 10 or p_size + 1 < 3")


@_query("select p_partkey as id, 1.5::FLOAT + 2.75::FLOAT as a_label_of_more_than_fifteen_letters from part")
def literal_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).register_parquet("part", f"{sf_dir}/part.parquet", "p_partkey").sql("select id, 1.5 + 2.75 as a_label_of_more_than_fifteen_letters from part")
