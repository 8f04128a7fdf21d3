"""Overflow and NaN, long chains, buffers and manifests, cursors; random conditions against DuckDB."""

import math
import random

import duckdb
import pytest

from tabsieve import AnalysisError, CatalogError, Engine, ParseError, Timer
from tabsieve.scratch import clean_up, new_path
from tabsieve.sources import Database


def test_nan_of_overflow(spark):
    df = spark.createDataFrame([(1, 1e30, 1e300), (2, 1.0, 1.0)], "k int, f float, d double")
    e = Engine(spark).register_df("t", df, "k")
    for where in ("f * f - f * f > 0.0", "f * f - f * f = f * f - f * f", "d * d - d * d >= 0.0", "f * f * 0.0 < 1.0"):
        assert 1 not in [r.id for r in e.sql(f"select id from t where {where}").collect()], where
    assert [r.id for r in e.sql("select id from t where f * f - f * f != 0.0").collect()] == [1]


def test_declared_nan_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, math.nan), (2, 1.0)], "k int, f float")
    df.write.parquet(path := str(tmp_path / "t"))
    assert Engine(spark).register_parquet("t", path, "k", nan_columns=["f"]).sql("select id from t where f > 0.0").count() == 1
    db = (e := Engine(spark)).create_database(str(tmp_path / "db"))
    t = db.create_table("t", "int", "k")
    t.add_column("f", "float", may_be_nan=True)
    t.add_column("g", "float")
    t.insert(1, math.nan, 0.0)
    t.insert(2, 1, 0)
    with pytest.raises(CatalogError):
        t.insert(3, 1.0, math.inf)
    e.close_database()
    e.open_database(str(tmp_path / "db"))
    assert [r.id for r in e.sql("select id from t where f > 0.0").collect()] == [2]
    assert [r.id for r in e.sql("select id from t where f != f").collect()] == [1]


@pytest.mark.parametrize("mode", ["standard", "reference"])
def test_long_chains(spark, simple, mode):
    e = Engine(spark, mode).register_df("t", simple, "key")
    long = " or ".join(f"col0 = {k}" for k in range(-2000, 5))
    assert e.query(f"select col0 from t where {long}").count() == 5
    assert e.query("select col0 from t where " + " and ".join(["col0 < 5"] * 2000)).count() == 5
    with pytest.raises((ParseError, AnalysisError)):
        e.query("select " + "(" * 5000 + "col0" + ")" * 5000 + " from t")
    with pytest.raises(AnalysisError):
        e.query("select " + " + ".join(["col0"] * 5000) + " as x from t")


def test_insert_is_checked_and_buffer_kept(spark, tmp_path):
    db = Database.create(spark, str(tmp_path / "db"))
    t = db.create_table("t", "int")
    t.add_column("a", "int")
    t.add_column("c", "char")
    t.insert(1, 2, 3)
    for bad in ((1, "x", 3), (1, 1.5, 3), (1 << 31, 1, 3), (1, 1, 128), (1, True, 3), (1, 2)):
        with pytest.raises(CatalogError):
            t.insert(*bad)
    t.insert(2, None, 3)
    with pytest.raises(CatalogError):
        t.add_column("d", "int", 1.5)
    assert t.num_rows() == 2
    db.close()
    for call in (lambda: t.insert(1, 2, 3), lambda: t.insert_df(t.df), lambda: t.add_column("z", "int"), lambda: db.create_table("u")):
        with pytest.raises(CatalogError):
            call()
    assert Database.open(spark, str(tmp_path / "db")).table("t").num_rows() == 2


def test_failed_write_keeps_the_buffer(spark, tmp_path):
    db = Database.create(spark, str(tmp_path / "db"))
    t = db.create_table("t", "int")
    t.insert(1)
    (tmp_path / "db" / "tables").write_text("a file where a folder must be")
    with pytest.raises(Exception):  # noqa: B017
        t.flush()
    (tmp_path / "db" / "tables").unlink()
    assert t.num_rows() == 1


def test_manifests_are_renamed_into_place(spark, tmp_path):
    db = Database.create(spark, path := str(tmp_path / "db"))
    db.create_table("t", "int")
    (tmp_path / "db" / "manifest-00000099.json.tmp").write_text("{ half writ")  # what a crash leaves
    assert list(Database.open(spark, path).tables) == ["t"]
    assert len(list((tmp_path / "db").glob("manifest-*.json"))) == 1


def test_preload_sees_inserts(spark, tmp_path):
    e = Engine(spark)
    t = e.create_database(str(tmp_path / "db")).create_table("t", "int")
    t.insert(1)
    e.preload("t")
    assert e.query("select id from t").count() == 1
    t.insert(2)
    assert e.query("select id from t").count() == 2 == t.num_rows()
    e.preload("t")
    e.release("t")
    t.insert_df(t.df)
    assert e.query("select id from t").count() == 4


def test_cursor(spark):
    df = spark.range(10).repartition(3, "id").selectExpr("cast(id as int) k", "cast(id as int) _part")
    r = Engine(spark).register_df("t", df, "k").query("select id, _part, id from t")
    assert sorted(tuple(x) for b in r.blocks() for x in b) == [(i, i, i) for i in range(10)]
    sizes = [len(b) for b in r.blocks()]
    for k in range(len(sizes)):
        assert r.next_block() and r.remaining() == sum(sizes[k:])
        assert r.next_row() is not None and r.remaining() == sum(sizes[k:]) - 1
    assert not r.next_block() and r.next_row() is None and r.remaining() == 0
    r.rewind()
    assert r.remaining() == 10 and r.next_row() is not None


def test_print_null(spark):
    df = spark.createDataFrame([(1, None, 2.5)], "k int, a int, f float")
    r = Engine(spark).register_df("t", df, "k").query("select id, a, f from t")
    assert r.format_row(r.next_row()) == "         1      NULL      2.50"


def test_timer_and_clean_up(spark):
    with Timer() as t:
        pass
    assert 0 <= t.seconds == t.seconds < 5
    with pytest.raises(RuntimeError):
        Timer().stop()
    spark.range(3).write.parquet(path := new_path(spark, "x"))
    assert spark.read.parquet(path).count() == 3
    assert clean_up(spark) >= 1 and clean_up(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_scan_bounds_of_float_literals(spark, tmp_path):
    """An integer column against a float literal: the scan gets a bound, the rows are those of the cast."""
    near = [m * (1 << e) + d for e in (0, 10, 23, 24, 25, 30) for m in (-1, 1) for d in range(-3, 4)]
    rows = [(k, max(-(1 << 31), min((1 << 31) - 1, v)), v << 20) for k, v in enumerate(near)]
    spark.createDataFrame(rows, "k int, i int, l bigint").coalesce(1).write.parquet(path := str(tmp_path / "t"))
    e = Engine(spark).register_parquet("t", path, "k")
    df = spark.read.parquet(path).cache()
    for literal in ("0.5", "-1.0", "16777216.0", "16777217.0", "-1073741824.0", "2147483648.0", "17592186044416.0"):
        for column in ("i", "l"):
            for op in ("=", "!=", "<", "<=", ">", ">="):
                want = sorted(r.k for r in df.filter(f"cast({column} as float) {op} cast({literal}BD as float)").collect())
                assert sorted(r.id for r in e.sql(f"select id from t where {column} {op} {literal}").collect()) == want, (column, op, literal)
        assert sorted(r.id for r in e.sql(f"select id from t where {literal} < i").collect()) == sorted(r.k for r in df.filter(f"cast({literal}BD as float) < cast(i as float)").collect())
    df.unpersist()
    assert "GreaterThanOrEqual(i,3)" in e.explain("select id from t where i > 5.0")


def _number(rng, depth):
    """(dialect, DuckDB) of a random expression over ints; both trees are written out in full."""
    if depth == 0 or rng.random() < 0.3:
        name = rng.choice(["a", "b", None])
        return (name, name) if name else ((k := str(rng.randrange(10))), k)
    op = rng.choice("+-*")
    (x, dx), (y, dy) = _number(rng, depth - 1), _number(rng, depth - 1)
    return f"({x} {op} {y})", f"({dx} {op} {dy})"


def _condition(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        (x, dx), (y, dy) = _number(rng, 2), _number(rng, 2)
        op = rng.choice(["=", "!=", "<", "<=", ">", ">="])
        return f"{x} {op} {y}", f"{dx} {op} {dy}"
    parts = [_condition(rng, depth - 1) for _ in range(rng.randrange(2, 4))]
    op = rng.choice([" and ", " or "])
    return f"({op.join(p for p, _ in parts)})", f"({op.join(d for _, d in parts)})"


def test_random_conditions_equal_duckdb(spark):
    rng = random.Random(12)
    rows = [(k, rng.randrange(-9, 10), rng.randrange(-9, 10)) for k in range(200)]
    con = duckdb.connect()
    con.execute("create table t (key int, a int, b int)")
    con.executemany("insert into t values (?, ?, ?)", rows)
    e = Engine(spark).register_df("t", spark.createDataFrame(rows, "key int, a int, b int").coalesce(1).cache())
    for _ in range(60):
        (x, dx), (w, dw) = _number(rng, 3), _condition(rng, 3)
        got = sorted(tuple(r) for r in e.sql(f"select key, {x} as x from t where {w}").collect())
        assert got == sorted(con.execute(f"select key, {dx} as x from t where {dw}").fetchall()), (x, w)


def test_random_flat_lists_in_both_modes(spark):
    """Without parentheses: usual precedence in one mode, all to the right in the other."""
    rng = random.Random(13)
    rows = [(k, rng.randrange(-3, 4), rng.randrange(-3, 4)) for k in range(100)]
    df = spark.createDataFrame(rows, "key int, a int, b int").coalesce(1).cache()
    for _ in range(25):
        parts = [f"{rng.choice('ab')} {rng.choice(['=', '<', '>'])} {rng.randrange(-2, 3)}" for _ in range(rng.randrange(2, 6))]
        ops = [rng.choice(["and", "or"]) for _ in parts[1:]]
        text = parts[0] + "".join(f" {o} {p}" for o, p in zip(ops, parts[1:]))
        nested = parts[-1]
        for o, p in zip(reversed(ops), reversed(parts[:-1])):
            nested = f"{p} {o} ({nested})"
        for mode, python in (("standard", text), ("reference", nested)):
            want = [k for k, a, b in rows if eval(python.replace("=", "=="), {"a": a, "b": b})]
            e = Engine(spark, mode).register_df("t", df, "key")
            assert sorted(r.id for r in e.sql(f"select id from t where {text}").collect()) == want, (mode, text)
