import math

import pytest
from pyspark.sql import functions as F

from tabsieve import AnalysisError, ColType, Engine
from tabsieve import functions as fn
from tabsieve.types import generalize, of_spark

SCHEMA = "key int, i int, l bigint, f float, d double, c tinyint, s string"
ROWS = [(1, 7, 10, 1.5, 2.5, 3, "a"), (2, -7, -10, -1.5, -2.5, -3, "b"), (3, 0, 0, 0.0, 0.0, 0, "c"), (4, 2147483647, 1 << 40, 1e30, 1e300, 127, "d")]


@pytest.fixture(scope="module")
def types(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_generalize():
    C = ColType
    assert generalize(C.INT, C.FLOAT) == C.FLOAT and generalize(C.INT64, C.FLOAT) == C.FLOAT and generalize(C.FLOAT, C.DOUBLE) == C.DOUBLE
    assert generalize(C.INT, C.INT64) == C.INT64 and generalize(C.CHAR, C.CHAR) == C.CHAR
    for other in (C.INT, C.DOUBLE, C.OTHER):
        with pytest.raises(AnalysisError):
            generalize(C.CHAR, other)


@pytest.mark.parametrize("op", ["add", "sub", "mul", "div"])
def test_result_types(types, op):
    names = {"i": ColType.INT, "l": ColType.INT64, "f": ColType.FLOAT, "d": ColType.DOUBLE}
    small = types.filter("key in (1, 2)")
    for a, ta in names.items():
        for b, tb in names.items():
            x = getattr(fn, op)(fn.col(small, a), fn.col(small, b))
            df = small.select(x.column.alias("x"))
            assert of_spark(df.schema["x"].dataType) == x.type == generalize(ta, tb)
            df.collect()
    x = getattr(fn, op)(fn.col(small, "c"), fn.col(small, "c"))
    assert of_spark(small.select(x.column.alias("x")).schema["x"].dataType) == ColType.CHAR


def test_integer_division_truncates(types):
    e = Engine(types.sparkSession).register_df("t", types, "key")
    assert [r.x for r in e.sql("select i / 2 as x from t where i < 100").collect()] == [3, -3, 0]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        e.sql("select 1 / i as x from t").collect()
    with pytest.raises(Exception, match="OVERFLOW"):
        e.sql("select i + 1 as x from t").collect()


def test_float_division(types):
    e = Engine(types.sparkSession).register_df("t", types, "key")
    x = [r.x for r in e.sql("select f / 0.0 as x from t where key < 4").collect()]
    assert x[0] == math.inf and x[1] == -math.inf and math.isnan(x[2])
    assert e.sql("select d / (0.0 / -1.0) as x from t where key = 1").first().x == -math.inf


def test_nan_compares_as_ieee(types):
    e = Engine(types.sparkSession).register_df("t", types, "key")
    assert e.sql("select key from t where f / f > 0.0").count() == 3
    assert e.sql("select key from t where f / f != 1.0").count() == 1
    assert e.sql("select key from t where f / f = f / f").count() == 3


def test_float_literals_are_32_bit(spark):
    df = spark.createDataFrame([(1, 0.1)], "k int, d double")
    e = Engine(spark).register_df("t", df, "k")
    assert e.sql("select k from t where d = 0.1").count() == 0
    assert e.sql("select 0.1 as x from t").schema["x"].dataType.simpleString() == "float"


def test_strings_and_char(types):
    e = Engine(types.sparkSession).register_df("t", types, "key")
    assert e.sql("select s from t").count() == 4
    for text in ("select s + 1 from t", "select key from t where s = 1", "select c + 1 from t"):
        with pytest.raises(AnalysisError):
            e.sql(text)
    with pytest.raises(AnalysisError):
        e.sql("select s from t", "reference")


def test_cast_truncates(types):
    small = types.filter("key < 3")
    for kind in ("int", "int64", "char"):
        x = fn.cast(fn.col(small, "d"), kind)
        assert [r.x for r in small.select(x.column.alias("x")).collect()] == [2, -2]
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        types.select(fn.cast(fn.col(types, "l"), "int").column).collect()


def test_plans(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select(F.col("id").cast("int").alias("a"), F.rand(1).alias("b"), F.rand(2).alias("c")).write.parquet(path)
    e = Engine(spark).register_parquet("t", path, "a")
    plan = e.explain("select id, b from t where id < 10 and b > 0.5")
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<a:int,b:double>" in plan and "LessThan(a,10)" in plan
