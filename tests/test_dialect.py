"""The query dialect on tables of its own: an orchard of trees and their pickings."""
import random

import pytest

from conftest import rows
from sylvan.engine import Engine
from sylvan.plans import EngineError, PlanError, QuerySyntaxError, parse_query, plan_text
from sylvan.plans import nodes as N
from sylvan.plans.diagnostics import Diagnostic

TREES = [("pear", 1, 310, True, None), ("plum", 2, 180, False, "old"), ("fig", 3, 180, None, ""), ("quince", 4, 95, True, "old"), ("plum", 5, 260, True, "new")]
PICKINGS = [(2, "mon", 12), (2, "tue", 3), (4, "mon", 7), (9, "sun", 1)]


@pytest.fixture(scope="module")
def engine(spark):
    t = spark.createDataFrame(TREES, "kind string, plot long, height long, bears boolean, mark string")
    p = spark.createDataFrame(PICKINGS, "plot long, day string, baskets long")
    return Engine.from_tables(spark, {"trees": t, "pickings": p})


@pytest.mark.parametrize(
    ("query", "text"),
    [
        ("select kind from trees limit 3;", "SELECT kind FROM trees LIMIT 3"),
        ("SELECT plot, kind FROM trees WHERE height <= 95 ORDER BY kind ASC, plot DESC", "SELECT plot, kind FROM trees WHERE (height <= 95) ORDER BY kind ASC, plot DESC"),
        ("SELECT DISTINCT t.kind AS k FROM trees AS t JOIN pickings AS p ON t.plot = p.plot", "SELECT DISTINCT t.kind AS k FROM trees AS t JOIN pickings AS p ON (t.plot = p.plot)"),
        ("SELECT plot FROM trees WHERE bears OR mark = 'old' AND height < 7", "SELECT plot FROM trees WHERE (bears OR ((mark = 'old') AND (height < 7)))"),
        ("SELECT plot FROM trees WHERE NOT bears OR NOT mark = 'x'", "SELECT plot FROM trees WHERE (NOT (bears) OR NOT ((mark = 'x')))"),
        ("SELECT plot FROM trees WHERE height NOT BETWEEN 10 AND 20 AND mark IS NULL", "SELECT plot FROM trees WHERE ((height NOT BETWEEN 10 AND 20) AND (mark IS NULL))"),
        ("SELECT kind FROM trees WHERE kind NOT IN ('o''clock', 4, FALSE)", "SELECT kind FROM trees WHERE (kind NOT IN ('o''clock', 4, FALSE))"),
        ("SELECT kind FROM orchard.trees GROUP BY kind HAVING kind LIKE '_l%'", "SELECT kind FROM orchard.trees GROUP BY kind HAVING (kind LIKE '_l%')"),
        ("SELECT * FROM trees WHERE (((plot > 2)))", "SELECT * FROM trees WHERE (plot > 2)"),
        ("SELECT * FROM trees WHERE plot <> height", "SELECT * FROM trees WHERE (plot != height)"),
    ],
)
def test_plan_text(query, text):
    assert plan_text(parse_query(query)) == text
    assert parse_query(plan_text(parse_query(query))) == parse_query(query)


def test_tree():
    q = parse_query("SELECT kind FROM trees WHERE bears AND NOT felled OR plot < 12")
    assert q.where == N.Binary("OR", N.Binary("AND", N.Name("bears"), N.Not(N.Name("felled"))), N.Binary("<", N.Name("plot"), N.Literal(12)))


#: (query with a caret in front of the place, message, code)
ERRORS = [
    ("SELECT kind ^trees", "expected FROM", "E001"),
    ("SELECT kind FROM trees WHERE plot = ^~ 4", "invalid token", "E000"),
    ("SELECT kind FROM trees WHERE kind ^NOT LIKE 'p%'", "unexpected trailing tokens", "E001"),
    ("SELECT kind FROM trees WHERE plot IN ()^", "expected identifier or literal", "E001"),
    ("SELECT kind FROM trees LIMIT many^", "expected integer after LIMIT", "E001"),
    ("SELECT trees.* ^FROM trees", "expected identifier after .", "E001"),
    ("SELECT max^(height) FROM trees", "expected FROM", "E001"),
    ("SELECT kind FROM trees GROUP ^kind", "expected BY after GROUP", "E001"),
    ("SELECT kind FROM trees JOIN pickings^", "expected ON after JOIN table", "E001"),
    ("SELECT kind FROM trees WHERE height > ^123456789012345678901", "invalid token", "E000"),
    ("SELECT kind FROM trees WHERE mark = ^'never closed", "invalid token", "E000"),
    ("SELECT kind ^variety FROM trees", "expected FROM", "E001"),
    ("SELECT kind FROM trees WHERE height > 1^.5", "unexpected trailing tokens", "E001"),
    ("^", "expected SELECT", "E001"),
]


@pytest.mark.parametrize(("marked", "message", "code"), ERRORS)
def test_errors(marked, message, code):
    with pytest.raises(QuerySyntaxError) as e:
        parse_query(marked.replace("^", ""))
    assert (e.value.message, e.value.position, e.value.diagnostics[0].code) == (message, marked.index("^"), code)


def test_several_errors_are_found():
    text = "SELECT plot day FROM pickings WHERE baskets ="
    with pytest.raises(QuerySyntaxError) as e:
        parse_query(text)
    assert [d.message for d in e.value.diagnostics] == ["expected FROM", "expected expression"]
    shown = e.value.render().split("\n")
    at = text.index("day")
    assert shown[0] == "Error[E001]: expected FROM" and shown[1].endswith(f":1:{at + 1}") and shown[3] == f"1 | {text}"
    assert shown[4] == "  | " + " " * at + "^~~" and e.value.render().count("Error[E001]") == 2


def test_render_on_later_line():
    text = Diagnostic("too tall", 14, 18, label="this one", notes=("at most 90",)).render("plan", "SELECT a,\r\nb, tall c".encode())
    assert text == "Error[E001]: too tall\n  --> plan:2:4\n  |\n2 | b, tall c\n  |    ^~~~ this one\n   = note: at most 90\n"


def test_extended_dialect():
    query = "SELECT t.kind FROM trees t WHERE t.height > 99.5"
    assert plan_text(parse_query(query, extended=True)) == "SELECT t.kind FROM trees AS t WHERE (t.height > 99.5)"
    with pytest.raises(QuerySyntaxError):
        parse_query(query)


@pytest.mark.parametrize(
    ("query", "result"),
    [
        ("SELECT plot FROM trees WHERE height > 180 ORDER BY plot", [(1,), (5,)]),
        ("SELECT PLOT FROM trees WHERE kind = 'fig'", [(3,)]),
        ("SELECT t.kind, p.day FROM trees AS t JOIN pickings AS p ON t.plot = p.plot WHERE p.baskets > 3 ORDER BY p.baskets", [("quince", "mon"), ("plum", "mon")]),
        ("SELECT DISTINCT kind FROM trees ORDER BY kind DESC", [("quince",), ("plum",), ("pear",), ("fig",)]),
        ("SELECT plot FROM trees WHERE bears ORDER BY plot", [(1,), (4,), (5,)]),
        ("SELECT plot FROM trees WHERE bears = 0", [(2,)]),
        ("SELECT plot FROM trees WHERE bears = 'true' AND height ORDER BY plot", [(1,), (4,), (5,)]),
        ("SELECT mark, plot FROM trees ORDER BY mark, plot", [("", 3), ("new", 5), ("old", 2), ("old", 4), (None, 1)]),
        ("SELECT mark, plot FROM trees ORDER BY mark DESC, plot", [("old", 2), ("old", 4), ("new", 5), ("", 3), (None, 1)]),
        ("SELECT height AS tall, plot FROM trees WHERE tall = 95", [(95, 4)]),
        ("SELECT plot AS height FROM trees ORDER BY height LIMIT 2", [(1,), (2,)]),
        ("SELECT kind FROM trees GROUP BY kind HAVING kind LIKE 'p%' ORDER BY kind", [("pear",), ("plum",)]),
        ("SELECT plot FROM trees WHERE mark NOT IN ('old') ORDER BY plot", [(3,), (5,)]),
        ("SELECT plot FROM trees WHERE NULL", []),
        ("SELECT plot FROM main.trees LIMIT 0", []),
        ("SELECT baskets FROM pickings ORDER BY baskets LIMIT 98765432109", [(1,), (3,), (7,), (12,)]),
        ("SELECT column_name FROM information_schema.columns WHERE table_name = 'pickings' ORDER BY ordinal_position", [("plot",), ("day",), ("baskets",)]),
    ],
)
def test_results(engine, query, result):
    assert [tuple(r) for r in engine.sql(query).collect()] == result


def test_names_take_the_schema_spelling(engine):
    assert engine.sql("SELECT KIND, Height AS Tall FROM trees").columns == ["kind", "Tall"]
    assert engine.sql("SELECT a.plot, b.plot FROM trees AS a JOIN pickings AS b ON a.height > b.baskets").columns == ["plot", "plot"]


@pytest.mark.parametrize(
    "query",
    [
        "SELECT bark FROM trees",
        "SELECT kind FROM shrubs",
        "SELECT height FROM trees GROUP BY kind",
        "SELECT kind FROM trees GROUP BY kind HAVING plot = 1",
        "SELECT kind FROM trees HAVING kind = 'fig'",
        "SELECT plot FROM trees AS t JOIN pickings AS p ON TRUE",
        "SELECT DISTINCT kind FROM trees ORDER BY height",
        "SELECT x.plot FROM trees AS x JOIN pickings AS x ON TRUE",
    ],
)
def test_rejected(engine, query):
    with pytest.raises((EngineError, PlanError)):
        engine.sql(query)


def test_errors_name_their_class():
    assert str(PlanError("no")) == "error: no" and str(EngineError("no")) == "internal error: no"


@pytest.mark.parametrize("seed", range(3))
def test_random_filters(spark, seed):
    """Filters put together at random, against Python with SQL's three-valued logic."""
    rng = random.Random(seed)
    data = [(k, rng.choice([None, *range(5)]), rng.choice([None, "a", "b", "ab"])) for k in range(60)]
    e = Engine.from_tables(spark, {"t": spark.createDataFrame(data, "k long, n long, s string")})

    def leaf():
        if rng.random() < 0.5:
            op, v = rng.choice([("=", 2), ("!=", 3), ("<", 2), (">=", 1)])
            f = {"=": lambda x: x == v, "!=": lambda x: x != v, "<": lambda x: x < v, ">=": lambda x: x >= v}[op]
            return f"n {op} {v}", lambda r: None if r[1] is None else f(r[1])
        v = rng.choice("ab")
        return f"s LIKE '{v}%'", lambda r: None if r[2] is None else r[2].startswith(v)

    def tree(depth):
        if not depth:
            return leaf()
        (ta, fa), (tb, fb) = tree(depth - 1), tree(depth - 1)
        kind = rng.choice(["AND", "OR", "NOT"])
        if kind == "NOT":
            return f"NOT ({ta})", lambda r: None if fa(r) is None else not fa(r)
        stop = kind == "OR"
        return f"({ta}) {kind} ({tb})", lambda r: stop if stop in (fa(r), fb(r)) else None if None in (fa(r), fb(r)) else not stop

    for _ in range(6):
        text, f = tree(3)
        assert [r.k for r in e.sql(f"SELECT k FROM t WHERE {text} ORDER BY k").collect()] == [r[0] for r in data if f(r)], text


def test_like_has_no_escape(spark):
    e = Engine.from_tables(spark, {"t": spark.createDataFrame([("c\\d",), ("c%d",), ("cYd",)], "x string")})
    assert rows(e.sql(r"SELECT x FROM t WHERE x LIKE 'c\d'")) == [("c\\d",)]
    assert rows(e.sql("SELECT x FROM t WHERE x LIKE 'c_d'")) == [("c%d",), ("cYd",), ("c\\d",)]


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id as a", "id * 2 as b", "id as c").write.parquet(str(tmp_path / "t"))
    e = Engine.from_tables(spark, {"t": spark.read.parquet(str(tmp_path / "t"))})
    plan = e.sql("SELECT b FROM t WHERE a = 5")._jdf.queryExecution().toString()
    assert "GreaterThan" in plan or "EqualTo(a,5)" in plan
    assert "ReadSchema: struct<a:bigint,b:bigint>" in plan
