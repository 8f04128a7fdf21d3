import pytest

from tabsieve import CatalogError, ColType, Engine
from tabsieve.sources import Database, benchmark_table


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "db")
    e = Engine(spark)
    db = e.create_database(path)
    t = db.create_table("test", "int", "k")
    t.add_column("col0", "int")
    for i in range(100):
        t.insert(i, 5 * i)
    assert t.num_rows() == 100
    t.add_column("x", "float", 1.5)
    t.insert(100, 500, 2.5)
    assert (t.column_id("x"), t.column_type("x"), t.key_type, db.table_id("test")) == (1, ColType.FLOAT, ColType.INT, 0)
    e.close_database()
    e.close_database()
    with pytest.raises(CatalogError):
        Database.create(spark, path)
    db = e.open_database(path)
    with pytest.raises(CatalogError):
        e.open_database(path)
    rows = {r.id: (r.col0, r.x) for r in e.sql("select id, col0, x from test where id >= 98").collect()}
    assert rows == {98: (490, 1.5), 99: (495, 1.5), 100: (500, 2.5)}
    t = db.table("test")
    for bad in (lambda: t.insert(1), lambda: t.add_column("x", "int"), lambda: db.create_table("test"), lambda: db.table("no"), lambda: t.column_id("no"), lambda: t.insert_df(spark.range(1))):
        with pytest.raises(CatalogError):
            bad()
    t.insert_df(t.df.limit(3))
    assert t.num_rows() == 104
    e.close()


def test_missing_or_broken(spark, tmp_path):
    with pytest.raises(CatalogError):
        Database.open(spark, str(tmp_path / "none"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "manifest-00000000.json").write_text("{")
    with pytest.raises(CatalogError):
        Database.open(spark, str(tmp_path / "bad"))


def test_empty_table(spark, tmp_path):
    e = Engine(spark)
    e.create_database(str(tmp_path / "db")).create_table("t", "int64").add_column("a", "double")
    assert e.sql("select id, a from t where a > 1.0").collect() == []


def test_generator(spark):
    df = benchmark_table(spark, 20_000)
    e = Engine(spark, "reference").register_df("test", df, "id")
    share = lambda w: e.sql(f"select id from test where {w}").count() / 20_000
    assert abs(share("uniformi > 60 and normali5 < 0") - 0.082) < 0.01
    mixed = "uniformi >= -1 and uniformi <= 1 or normali5 >= -1 and normali5 <= 1 or normali20 >= -1 and normali20 <= 1"
    assert abs(share(mixed) - 0.186) < 0.015
    assert df.collect() == benchmark_table(spark, 20_000).collect()


def test_stream(spark, tmp_path):
    from tabsieve.streaming import start, stream_table

    src = str(tmp_path / "in")
    df = benchmark_table(spark, 500)
    df.write.parquet(src)
    e = stream_table(Engine(spark), "test", src, df, "id")
    start(e.sql("select id, uniformi from test where uniformi > 50"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.filter("uniformi > 50").count()


def test_csv(spark, tmp_path, simple):
    r = Engine(spark).register_df("t", simple, "key").query("select id, col0 from t where col0 > 7")
    r.to_csv(str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["id", "col0"]
    r.preload().release()
