"""Statements that change rows, and what SQL's rules say about nulls, repeats and integers."""

import pytest

from querywright.operators.catalog import build_catalog
from querywright.plans.dml import after, changed, returning
from querywright.plans.spark_sql import run, to_spark
from querywright.sources.lexer import SqlError


@pytest.fixture(scope="module")
def tables(spark):
    for name, kind, rows in (
        ("t", "k int, v string", [(1, "a"), (2, "b"), (None, "keepme")]),
        ("u", "k int, v string", [(1, "x"), (1, "w"), (2, "y"), (9, "z")]),
        ("w", "v string, n int", [("x", 5)]),
        ("nums", "a int", [(1,), (2,), (None,)]),
    ):
        spark.createDataFrame(rows, kind).createOrReplaceTempView(name)
    return spark


KEPT = (None, "keepme")
AFTER = {
    "INSERT INTO t VALUES (2, 'new'), (7, 'n') ON CONFLICT (k) DO UPDATE SET v = excluded.v": [(1, "a"), (2, "new"), (7, "n"), KEPT],
    "INSERT INTO t VALUES (NULL, 'n1'), (NULL, 'n2') ON CONFLICT (k) DO UPDATE SET v = excluded.v": [(1, "a"), (2, "b"), KEPT, (None, "n1"), (None, "n2")],
    "INSERT INTO t VALUES (7, 'n1'), (7, 'a2') ON CONFLICT (k) DO NOTHING": [(1, "a"), (2, "b"), (7, "a2"), KEPT],
    "INSERT INTO t VALUES (1, 'new') ON CONFLICT (k) DO UPDATE SET v = v || '!' WHERE k > 0": [(1, "a!"), (2, "b"), KEPT],
    "UPDATE t SET v = u.v FROM u WHERE u.k = t.k": [(1, "w"), (2, "y"), KEPT],
    "UPDATE t SET v = u.v || w.n FROM u, w WHERE u.k = t.k AND w.v = u.v": [(1, "x5"), (2, "b"), KEPT],
    "UPDATE t SET v = u.v FROM u WHERE u.k > t.k AND t.k > 1": [(1, "a"), (2, "z"), KEPT],
    "UPDATE t SET v = u.v FROM u WHERE u.k = t.k AND EXISTS (SELECT 1 FROM w WHERE w.v = u.v AND t.k = 1)": [(1, "x"), (2, "b"), KEPT],
    "UPDATE t SET (k, v) = (5, 'z') WHERE k = 1": [(5, "z"), (2, "b"), KEPT],
    "UPDATE t SET (k, v) = (SELECT max(k), max(v) FROM u WHERE u.k = t.k) WHERE k = 1": [(1, "x"), (2, "b"), KEPT],
    "UPDATE t SET k = k / 2": [(0, "a"), (1, "b"), KEPT],
    "DELETE FROM t USING u WHERE u.k = t.k": [KEPT],
    "DELETE FROM t WHERE k = 1": [(2, "b"), KEPT],
}


@pytest.mark.parametrize("text", AFTER)
def test_rows_after(tables, text):
    assert sorted(map(tuple, after(tables, text).collect()), key=repr) == sorted(AFTER[text], key=repr)


RETURNED = {
    "UPDATE t SET v = u.v FROM u WHERE u.k = t.k RETURNING t.k, t.v, u.v AS uv, u.*": [(1, "w", "w", 1, "w"), (2, "y", "y", 2, "y")],
    "UPDATE t SET v = upper(v) WHERE k < 3 RETURNING *": [(1, "A"), (2, "B")],
    "DELETE FROM t WHERE k = 1 RETURNING k, v || '!' AS w": [(1, "a!")],
    "DELETE FROM t USING u WHERE u.k = t.k RETURNING t.*, u.v AS uv": [(1, "a", "w"), (2, "b", "y")],
    "INSERT INTO t VALUES (2, 'new'), (7, 'n') ON CONFLICT (k) DO UPDATE SET v = excluded.v || t.v RETURNING k, v AS vv": [(2, "newb"), (7, "n")],
    "INSERT INTO t VALUES (2, 'new'), (7, 'n') ON CONFLICT (k) DO NOTHING RETURNING *": [(7, "n")],
}


@pytest.mark.parametrize("text", RETURNED)
def test_rows_returned(tables, text):
    assert sorted(map(tuple, returning(tables, text).collect())) == RETURNED[text]
    assert changed(tables, text)[0].columns == ["k", "v"]


@pytest.mark.parametrize(
    ("text", "dialect"),
    [
        ("INSERT INTO t VALUES (7, 'n1') ON CONFLICT DO NOTHING", "postgresql"),
        ("INSERT OR ABORT INTO t VALUES (7, 'n1')", "sqlite"),
        ("INSERT INTO t DEFAULT VALUES", "postgresql"),
        ("UPDATE t SET (k, v) = (5, 'z', 3) WHERE k = 1", "postgresql"),
        ("UPDATE t SET nope = 1", "postgresql"),
        ("UPDATE t SET v = DEFAULT", "postgresql"),
        ("DELETE FROM t WHERE k = 1 RETURNING k", "postgresql"),
        ("DELETE FROM t WHERE k = 1 LIMIT 1", "mysql"),
        ("WITH x AS (SELECT 1 AS k) DELETE FROM t USING x WHERE x.k = t.k", "postgresql"),
        ("MERGE INTO t USING u ON t.k = u.k WHEN MATCHED THEN DELETE", "postgresql"),
        ("SELECT 1", "postgresql"),
    ],
)
def test_what_is_not_run_is_an_error(tables, text, dialect):
    with pytest.raises(SqlError):
        after(tables, text, dialect)


def test_two_new_rows_for_one_old_one_fail(tables):
    with pytest.raises(Exception, match="a second time"):
        after(tables, "INSERT INTO t VALUES (7, 'n1'), (7, 'a2') ON CONFLICT (k) DO UPDATE SET v = excluded.v").collect()


def test_keys_of_the_catalog(tables):
    catalog = build_catalog(["CREATE TABLE t (k int PRIMARY KEY, v text)"])
    rows = lambda text, dialect: sorted((r["k"], r["v"]) for r in after(tables, text, dialect, catalog).collect() if r["k"] is not None)
    assert rows("INSERT INTO t VALUES (1, 'n') ON CONFLICT DO NOTHING", "postgresql") == [(1, "a"), (2, "b")]
    assert rows("INSERT OR IGNORE INTO t VALUES (1, 'n'), (3, 'c')", "sqlite") == [(1, "a"), (2, "b"), (3, "c")]
    assert rows("INSERT OR REPLACE INTO t VALUES (1, 'n')", "sqlite") == [(1, "n"), (2, "b")]


def test_quantifiers_over_nulls(tables):
    for op, every, some in ((">", (None, True, True), (True, None, False)), ("<=", (False, False, True), (None, True, False))):
        text = f"SELECT (3 {op} ALL (SELECT a FROM nums)), (3 {op} ALL (SELECT a FROM nums WHERE a < 3 AND a > (CASE WHEN '{op}' = '>' THEN 0 ELSE 1 END))), (3 {op} ALL (SELECT a FROM nums WHERE a > 9)), (3 {op} ANY (SELECT a FROM nums)), (1 {op} ANY (SELECT a FROM nums)), (3 {op} ANY (SELECT a FROM nums WHERE a > 9))"
        assert tuple(run(tables, text).first()) == every + some
    assert run(tables, "SELECT k FROM t WHERE 3 > ALL (SELECT a FROM nums)").count() == 0
    assert tuple(run(tables, "SELECT 5 IN (SELECT a FROM nums), 1 IN (SELECT a FROM nums), 5 NOT IN (SELECT a FROM nums), 5 IN (SELECT a FROM nums WHERE a > 9)").first()) == (None, True, None, False)


def test_integer_division_by_dialect():
    assert [to_spark("SELECT 7 / 2", d) for d in ("postgresql", "sqlite", "mysql")] == ["SELECT (7 div 2)", "SELECT (7 div 2)", "SELECT (7 / 2)"]
    assert to_spark("SELECT 7.0 / 2, x / 2, count(*) / 2") == "SELECT (7.0 / 2), (`x` / 2), (count(*) div 2)"


def test_types_are_not_comparisons(tables):
    assert tuple(run(tables, "SELECT (NULL::int < 3) AS a, (5::int < 3) AS b, 4 > 9 AS c").first()) == (None, False, False)


def test_deep_correlation(tables):
    text = "SELECT t.k FROM t WHERE EXISTS (SELECT * FROM u WHERE u.k = t.k AND EXISTS (SELECT 1 FROM w WHERE w.v = u.v AND EXISTS (SELECT 1 FROM nums WHERE a = t.k AND a < w.n)))"
    assert [r["k"] for r in run(tables, text).collect()] == [1]


def test_asof_joins_by_one_sort(tables):
    join = "FROM u ASOF LEFT JOIN nums ON u.k = nums.a AND nums.a {} u.k"
    plan = run(tables, "SELECT * " + join.format("<="))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Join" not in plan and plan.count("Exchange") == 1
    assert sorted(map(tuple, run(tables, "SELECT * " + join.format("<=")).collect())) == [(1, "w", 1), (1, "x", 1), (2, "y", 2), (9, "z", None)]
    assert [r["a"] for r in run(tables, "SELECT nums.a " + join.format("<")).collect()] == [None] * 4
