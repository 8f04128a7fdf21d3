import pytest

from tabsieve import AnalysisError, Engine, ParseError
from tabsieve.plans.parser import parse
from tabsieve.plans.tree import Logic, render

CONDITIONS = [
    ("col0 < 9 and col0 >= 7 or col0 = 3", [3, 7, 8]),
    ("col0 >= 8 or col0 = 3 and col0 < 1", [8, 9]),
    ("col0 = 8 and col0 = 8", [8]),
    ("col0 = 8 or col0 = 8", [8]),
    ("col0 = 2", [2]),
    ("(col0 = 2)", [2]),
    ("col0 < 5 and (col0 = 7 or col0 = 2)", [2]),
    ("col0 = 7 or col0 = 2 or col0 = 8", [2, 7, 8]),
    ("col0 < 5 and (col0 = 2 or col0 = 8 or col0 = 1)", [1, 2]),
]


@pytest.mark.parametrize("mode", ["standard", "reference"])
@pytest.mark.parametrize("where,want", CONDITIONS)
def test_conditions(spark, simple, mode, where, want):
    e = Engine(spark, mode).register_df("test", simple, "key")
    rows = e.query(f"select col0 from test where {where}").df.collect()
    assert sorted(r.col0 for r in rows) == want


def test_expressions_and_labels(spark, simple):
    e = Engine(spark).register_df("test", simple.limit(1), "key")
    for mode in ("standard", "reference"):
        df = e.sql("select col0 + 5 * 20 from test", mode)
        assert df.columns == ["(col0+(5*20))"] and df.first()[0] == 100
        assert e.sql("select col0 + 10 * (1 + 2) from test", mode).first()[0] == 30
    assert e.sql("select col0, col1, col0, id as key0, 1.5 half from test").columns == ["col0", "col1", "col0", "key0", "half"]
    assert tuple(e.sql("select col0, col1, col0 from test").first()) == (0, 1, 0)
    assert e.sql("select 1.5 + 2.7 as x from test").first().x == pytest.approx(4.2)


def shape(text, mode):
    return render(parse(f"select {text} from t", mode).outputs[0].expr)


def test_precedence():
    for text, standard, reference in [
        ("a * b + c", "((a*b)+c)", "(a*(b+c))"),
        ("a - b - c", "((a-b)-c)", "(a-(b-c))"),
        ("a / b * c", "((a/b)*c)", "(a/(b*c))"),
        ("a + b * c", "(a+(b*c))", "(a+(b*c))"),
    ]:
        assert shape(text, "standard") == standard
        assert shape(text, "reference") == reference
    where = lambda mode: parse("select a from t where a = 1 and b = 2 or c = 3", mode).where
    assert where("standard").op == "or" and where("reference").op == "and"
    assert isinstance(where("reference").right, Logic) and where("reference").right.op == "or"


def test_what_reference_mode_rejects():
    bad = ["(a = 1 and b = 2) or c = 3", "c = 1 and (a = 1 or b = 2) and d = 3", "((a = 2))", "a <> 2", "not a = 2"]
    for text in bad:
        with pytest.raises(ParseError):
            parse(f"select a from t where {text}", "reference")
    for text in ("select * from t", "select a-1 from t", "select a -1 from t", "select - a from t", "select a from t;", "select l_a from t", "select a", "", "select a from t where"):
        with pytest.raises(ParseError):
            parse(text, "reference")
    for text in ("(a = 1 and b = 2) or c = 3", "c = 1 and (a = 1 or b = 2) and d = 3", "((a = 2))", "(a + 1) * 2 = 4", "((a + 1)) > (b)"):
        parse(f"select a from t where {text};")
    assert shape("a-1", "standard") == "(a-1)"
    assert parse("select a from t where (a + 1) > (b - 2)", "reference").where.op == ">"
    with pytest.raises(ParseError) as e:
        parse("select a ? from t")
    assert e.value.position == 9


def test_names(spark, simple):
    e = Engine(spark).register_df("test", simple.withColumnRenamed("col2", "id"), "key")
    assert [r.id for r in e.sql("select id from test where id < 2").collect()] == [0, 1]
    for text in ("select Col0 from test", "select nope from test", "select col0 from Test", "select 99999999999 from test"):
        with pytest.raises(AnalysisError):
            e.sql(text)


def test_example_has_all_rows(spark):
    df = spark.createDataFrame([(i, 5 * i) for i in range(100)], "k int, col0 int")
    r = Engine(spark).register_df("test", df, "k").query("select id, col0 from test where col0 <= 25")
    assert sorted(map(tuple, r.rows())) == [(i, 5 * i) for i in range(6)]
    seen = []
    while (row := r.next_row()) is not None:
        seen.append(tuple(row))
        assert r.remaining() == 6 - len(seen)
    assert len(seen) == 6 and sum(len(b) for b in r.blocks()) == 6
    assert r.format_row(row=next(r.rows())) == f"{0:10d}{0:10d}"


def test_deep_parentheses():
    for mode in ("standard", "reference"):
        parse(f"select a from t where {'(' * 60}a{')' * 60} + 1 = 2", mode)
    parse(f"select a from t where {'(' * 60}a = 1{')' * 60}")
