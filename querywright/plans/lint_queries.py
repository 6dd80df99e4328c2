"""Diagnostics as queries: SQL texts of our own, and what must be said of them, written by hand."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from querywright.operators.analyze import analyze_texts
from querywright.operators.catalog import build_catalog

DDL = """
CREATE TYPE mood AS ENUM ('glad', 'sad');
CREATE TABLE members (id SERIAL PRIMARY KEY, name VARCHAR(80) NOT NULL, email TEXT, joined TIMESTAMP, feeling mood);
CREATE TABLE visits (id SERIAL PRIMARY KEY, member_id INTEGER NOT NULL REFERENCES members(id), fee DECIMAL(8,2), note TEXT, CONSTRAINT fee_positive CHECK (fee >= 0));
CREATE TABLE tokens (id UUID PRIMARY KEY, label TEXT UNIQUE, active BOOLEAN DEFAULT true);
CREATE VIEW active_members AS SELECT id, name FROM members WHERE joined IS NOT NULL;
ALTER TABLE visits ADD COLUMN place VARCHAR(40);
ALTER TABLE visits ADD CONSTRAINT visits_member FOREIGN KEY (member_id) REFERENCES members (id);
"""

#: name -> (text, expected (code, severity, line, column, length, message, help)).
CASES: dict[str, tuple[str, list[tuple]]] = {
    "lint_table_not_found": ("SELECT m.id FROM membres m;\nSELECT x.id FROM members m", [("E0001", "error", 1, 18, 7, "Table 'membres' not found", "Check that the table exists in your schema definition"), ("E0001", "error", 1, 8, 1, "Table or alias 'm' not found in FROM clause", None), ("E0001", "error", 2, 8, 1, "Table or alias 'x' not found in FROM clause", None)]),
    "lint_column_not_found": ("SELECT m.nmae,\n       fees\nFROM members m JOIN visits v ON v.member_id = m.id\nWHERE v.palce = 'x'", [("E0002", "error", 1, 10, 4, "Column 'nmae' not found in table 'members'", "Did you mean 'name'?"), ("E0002", "error", 2, 8, 4, "Column 'fees' not found", "Did you mean 'fee'?"), ("E0002", "error", 4, 9, 5, "Column 'palce' not found in table 'visits'", "Did you mean 'place'?")]),
    "lint_type_mismatch": ("SELECT id FROM visits WHERE fee = note;\nSELECT name + 1 FROM members", [("E0003", "error", 1, 29, 3, "Type mismatch: cannot compare numeric(8,2) with text", "Types are not implicitly compatible. Consider using explicit CAST."), ("E0003", "error", 2, 8, 4, "Arithmetic operation requires numeric types, but got varchar(80)", None)]),
    "lint_null_violation": ("INSERT INTO members (name, email) VALUES (NULL, 'a@b.c');\nUPDATE visits SET member_id = NULL WHERE id = 1", [("E0004", "error", 1, 43, 4, "Potential NOT NULL violation: column 'name' cannot be assigned NULL", "This column is defined as NOT NULL. Provide a non-NULL value or change the schema constraint."), ("E0004", "error", 2, 31, 4, "Potential NOT NULL violation: column 'member_id' cannot be assigned NULL", "This column is defined as NOT NULL. Provide a non-NULL value or change the schema constraint.")]),
    "lint_count_mismatch": ("INSERT INTO members (name, email) VALUES ('a');\nINSERT INTO tokens VALUES ('x', 'y')", [("E0005", "error", 0, 0, 0, "INSERT has 1 value(s) but 2 column(s) were specified", "Provide 2 value(s) to match the column list"), ("E0005", "error", 0, 0, 0, "INSERT has 2 value(s) but 3 column(s) were specified", "Table 'tokens' has 3 columns. Specify columns explicitly or provide 3 values")]),
    "lint_ambiguous": ("SELECT id FROM members m JOIN visits v ON m.id = v.member_id", [("E0006", "error", 1, 8, 2, "Column 'id' is ambiguous (found in tables: m, v)", "Qualify the column with a table name: m.id")]),
    "lint_join_type": ("SELECT v.id FROM visits v JOIN tokens t ON v.member_id = t.id", [("E0007", "error", 1, 44, 11, "JOIN condition type mismatch: integer vs uuid", "JOIN condition should compare compatible types. Consider using explicit CAST.")]),
    "lint_suppression": ("SELECT nope FROM members; -- check:disable E0002\n-- check:disable\nSELECT nada FROM members;\nSELECT zilch FROM members -- check:disable E0001", [("E0002", "error", 4, 8, 5, "Column 'zilch' not found", None)]),
    "lint_setop": ("SELECT id, name FROM members UNION SELECT id FROM visits;\nSELECT name FROM members EXCEPT SELECT fee FROM visits", [("E0003", "error", 1, 36, 6, "Set operation column count mismatch: left has 2, right has 1", "UNION/INTERSECT/EXCEPT requires both sides to have the same number of columns."), ("E0003", "error", 2, 33, 6, "Set operation type mismatch at column 1: varchar(80) vs numeric(8,2)", "Corresponding columns in UNION/INTERSECT/EXCEPT should be type-compatible.")]),
    "lint_suggestion": ("SELECT emial, m.joind FROM members m", [("E0002", "error", 1, 8, 5, "Column 'emial' not found", "Did you mean 'email'?"), ("E0002", "error", 1, 17, 5, "Column 'joind' not found in table 'members'", "Did you mean 'joined'?")]),
    "lint_dml_columns": ("INSERT INTO members (name, emial) VALUES ('a', 'b');\nUPDATE visits SET fe = 1, note = 'x'", [("E0002", "error", 1, 28, 5, "Column 'emial' not found in table 'members'", "Did you mean 'email'?"), ("E0002", "error", 2, 19, 2, "Column 'fe' not found in table 'visits'", "Did you mean 'fee'?")]),
    "lint_dml_types": ("INSERT INTO tokens (id, active) VALUES (1, true);\nUPDATE visits SET fee = 'x' WHERE id = 1", [("E0003", "error", 1, 41, 1, "Type mismatch: column 'id' expects uuid, but got integer", "Value type is not compatible with the column type. Consider using explicit CAST."), ("E0003", "error", 2, 25, 3, "Type mismatch: column 'fee' expects numeric(8,2), but got text", "Value type is not compatible with the column type. Consider using explicit CAST.")]),
    "lint_scopes": ("WITH w AS (SELECT id AS k FROM members) SELECT w.id FROM w;\nSELECT s.fee FROM (SELECT note FROM visits) s;\nSELECT a.email FROM active_members a;\nSELECT m.id FROM members m WHERE EXISTS (SELECT 1 FROM visits v WHERE v.member_id = m.id AND v.nothing = 1)", [("E0002", "error", 1, 50, 2, "Column 'id' not found in CTE 'w'", None), ("E0002", "error", 2, 10, 3, "Column 'fee' not found in subquery 's'", None), ("E0002", "error", 3, 10, 5, "Column 'email' not found in view 'active_members'", None), ("E0002", "error", 4, 96, 7, "Column 'nothing' not found in table 'visits'", None)]),
    "lint_clean": ("SELECT m.name, count(*) AS n, sum(v.fee) FROM members m LEFT JOIN visits v ON v.member_id = m.id GROUP BY m.name HAVING count(*) > 1 ORDER BY n DESC;\nSELECT * FROM members NATURAL JOIN active_members;\nSELECT id FROM members JOIN active_members USING (id)", []),
}
COLUMNS = ["code", "severity", "line", "column", "length", "message", "help"]


def _literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(rows: list[tuple], names: list[str], kinds: list[str]) -> str:
    picks = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip((f'"{n}"' for n in names), kinds, strict=True))
    quoted = ", ".join(f'"{n}"' for n in names)
    body = ", ".join(f"({', '.join(map(_literal, r))})" for r in rows) if rows else f"({', '.join('NULL' for _ in names)})"
    return f"SELECT {picks} FROM (VALUES {body}) AS t({quoted})" + ("" if rows else " WHERE false")


def _lint(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze_texts(spark, {"q.sql": text}, build_catalog([DDL])).select(*COLUMNS)


def lint_parse_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analyze_texts(spark, {"q.sql": "SELECT id FROM members WHERE;\nSELECT nope FROM members"}, build_catalog([DDL]))
    return rows.select("stmt_no", "code", "kind", "line")


def lint_catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_catalog([DDL]).frames(spark)["cat_columns"].select("relation", "ordinal", "column", "sql_type", "nullable", "primary_key")


def lint_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return build_catalog([DDL]).frames(spark)["cat_constraints"].select("relation", "type", "name", F.array_join("columns", ",").alias("columns"), "ref_table", "text")


CHANGED = """
CREATE TABLE parts (id INT PRIMARY KEY, label TEXT, size INT, old_price NUMERIC(9,2));
CREATE TABLE scraps (id INT);
CREATE TABLE crates (id INT, part_id INT UNIQUE REFERENCES parts (id));
ALTER TABLE parts DROP COLUMN size;
ALTER TABLE parts RENAME COLUMN old_price TO price;
ALTER TABLE crates RENAME TO boxes;
ALTER TABLE boxes ALTER COLUMN id SET NOT NULL;
ALTER TABLE boxes OWNER TO someone;
ALTER TABLE parts ADD COLUMN weight REAL NOT NULL DEFAULT 1;
DROP TABLE IF EXISTS scraps, nowhere;
CREATE INDEX parts_label ON parts (label);
"""


def lint_catalog_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns after they, or their tables, are dropped, renamed and added."""
    return build_catalog([CHANGED]).frames(spark)["cat_columns"].select("relation", "ordinal", "column", "sql_type")


MORE: dict[str, str] = {
    "lint_setop_star": "SELECT * FROM members UNION SELECT id, name FROM members;\nSELECT * FROM tokens UNION ALL SELECT id, label, active FROM tokens",
    "lint_changing_cte": "WITH gone AS (DELETE FROM visits WHERE fee < 0 RETURNING member_id, fee) SELECT g.member_id, g.fees FROM gone g",
}


def _codes(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze_texts(spark, {"a.sql": text}, build_catalog([DDL])).select("code", "line", "message")


STAR = """
CREATE TABLE region (r_regionkey INT PRIMARY KEY, r_name TEXT NOT NULL);
CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey INT NOT NULL REFERENCES region);
CREATE TYPE status AS ENUM ('F', 'O');
CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT NOT NULL UNIQUE, o_orderstatus status, o_totalprice DOUBLE PRECISION, CONSTRAINT dear CHECK (o_totalprice > 1000));
"""


def check_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the driver's tables that break declared constraints (some are declared too strictly on purpose)."""
    from querywright.operators.constraints import violations
    from querywright.session import load_tables

    return violations(load_tables(spark, sf_dir, ["region", "nation", "orders"]), build_catalog([STAR]))


CONSTRAINTS_SQL = """
SELECT * FROM (VALUES ('region', 'not_null', 'r_regionkey', CAST(0 AS BIGINT)), ('region', 'not_null', 'r_name', 0), ('nation', 'not_null', 'n_nationkey', 0), ('nation', 'not_null', 'n_regionkey', 0),
  ('orders', 'not_null', 'o_orderkey', 0), ('orders', 'not_null', 'o_custkey', 0)) AS t(relation, "constraint", columns, violations)
UNION ALL SELECT 'region', 'primary_key', 'r_regionkey', count(*) - count(DISTINCT r_regionkey) FROM region
UNION ALL SELECT 'nation', 'primary_key', 'n_nationkey', count(*) - count(DISTINCT n_nationkey) FROM nation
UNION ALL SELECT 'nation', 'foreign_key', 'n_regionkey', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
UNION ALL SELECT 'orders', 'primary_key', 'o_orderkey', count(*) - count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'orders', 'unique', 'o_custkey', count(*) - count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'orders', 'enum', 'o_orderstatus', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'orders', 'check', 'dear', count(*) FROM orders WHERE NOT o_totalprice > 1000
"""


def facts_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the catalogue's own queries mention each of the driver's tables."""
    from querywright.operators.facts import facts, table_usage

    rows = [(f"{n}.sql", text) for n, (text, _) in CASES.items()]
    return table_usage(facts(spark.createDataFrame(rows, "file string, text string")))


USAGE = [("members", 18, 12), ("visits", 12, 10), ("membres", 1, 1), ("tokens", 3, 3), ("active_members", 3, 2)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: partial(_lint, text) for n, (text, _) in CASES.items()} | {n: partial(_codes, text) for n, text in MORE.items()} | {"lint_catalog_changes": lint_catalog_changes, "lint_parse_error": lint_parse_error, "lint_catalog_columns": lint_catalog_columns, "lint_constraints": lint_constraints, "check_constraints": check_constraints, "facts_usage": facts_usage}


def oracle_sql() -> dict[str, str]:
    kinds = ["VARCHAR", "VARCHAR", "INTEGER", "INTEGER", "INTEGER", "VARCHAR", "VARCHAR"]
    out = {n: _values(rows, COLUMNS, kinds) for n, (_, rows) in CASES.items()}
    out["lint_parse_error"] = _values([(1, "E1000", "ParseError", 0), (2, "E0002", "ColumnNotFound", 2)], ["stmt_no", "code", "kind", "line"], ["INTEGER", "VARCHAR", "VARCHAR", "INTEGER"])
    tables = {
        "members": [("id", "integer", False, True), ("name", "varchar(80)", False, False), ("email", "text", True, False), ("joined", "timestamp", True, False), ("feeling", "mood", True, False)],
        "visits": [("id", "integer", False, True), ("member_id", "integer", False, False), ("fee", "numeric(8,2)", True, False), ("note", "text", True, False), ("place", "varchar(40)", True, False)],
        "tokens": [("id", "uuid", False, True), ("label", "text", True, False), ("active", "boolean", True, False)],
        "active_members": [("id", "unknown", True, False), ("name", "unknown", True, False)],
    }
    rows = [(t, i, c, k, str(n).lower(), str(p).lower()) for t, cs in tables.items() for i, (c, k, n, p) in enumerate(cs, 1)]
    out["lint_catalog_columns"] = _values(rows, ["relation", "ordinal", "column", "sql_type", "nullable", "primary_key"], ["VARCHAR", "INTEGER", "VARCHAR", "VARCHAR", "BOOLEAN", "BOOLEAN"])
    found = [("members", "primary_key", "", "id", "", ""), ("visits", "primary_key", "", "id", "", ""), ("visits", "check", "fee_positive", "", "", "fee >= 0"), ("visits", "foreign_key", "", "member_id", "members", ""), ("visits", "foreign_key", "visits_member", "member_id", "members", ""), ("tokens", "primary_key", "", "id", "", ""), ("tokens", "unique", "", "label", "", "")]
    out["lint_constraints"] = _values(found, ["relation", "type", "name", "columns", "ref_table", "text"], ["VARCHAR"] * 6)
    changed = [("parts", 1, "id", "integer"), ("parts", 2, "label", "text"), ("parts", 3, "price", "numeric(9,2)"), ("parts", 4, "weight", "real"), ("boxes", 1, "id", "integer"), ("boxes", 2, "part_id", "integer")]
    out["lint_catalog_changes"] = _values(changed, ["relation", "ordinal", "column", "sql_type"], ["VARCHAR", "INTEGER", "VARCHAR", "VARCHAR"])
    out["lint_setop_star"] = _values([("E0003", 1, "Set operation column count mismatch: left has 5, right has 2")], ["code", "line", "message"], ["VARCHAR", "INTEGER", "VARCHAR"])
    out["lint_changing_cte"] = _values([("E0002", 1, "Column 'fees' not found in CTE 'gone'")], ["code", "line", "message"], ["VARCHAR", "INTEGER", "VARCHAR"])
    out["check_constraints"] = CONSTRAINTS_SQL
    out["facts_usage"] = _values(USAGE, ["relation", "statements", "files"], ["VARCHAR", "BIGINT", "BIGINT"])
    return out
