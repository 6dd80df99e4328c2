import pytest

from querywright.operators.analyze import analyze_text, directives
from querywright.operators.catalog import build_catalog

DDL = """
CREATE TABLE people (id SERIAL PRIMARY KEY, name VARCHAR(50) NOT NULL, born DATE);
CREATE TABLE trips (id SERIAL PRIMARY KEY, person_id INT NOT NULL, miles NUMERIC(8, 1), note TEXT);
CREATE TABLE badges (id UUID, person_id INT, title TEXT);
CREATE VIEW travellers AS SELECT p.id, p.name AS label FROM people p;
"""


def codes(text, mode="strict", ddl=DDL, dialect="postgresql"):
    return [d["code"] for d in analyze_text(text, build_catalog([ddl], dialect, mode), dialect, mode)]


CLEAN = [
    "SELECT p.name, t.miles FROM people p JOIN trips t ON t.person_id = p.id WHERE t.miles > 3 ORDER BY p.name",
    "SELECT name AS n FROM people ORDER BY n",
    "SELECT * FROM (SELECT id, name FROM people) x WHERE x.id = 1",
    "WITH a AS (SELECT id FROM people), b(k) AS (SELECT id FROM a) SELECT k FROM b",
    "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT n FROM r",
    "SELECT p.id FROM people p WHERE EXISTS (SELECT 1 FROM trips t WHERE t.person_id = p.id AND EXISTS (SELECT 1 FROM badges b WHERE b.person_id = p.id AND t.miles > 1))",
    "SELECT p.id, x.m FROM people p, LATERAL (SELECT max(miles) AS m FROM trips t WHERE t.person_id = p.id) x",
    "SELECT label FROM travellers",
    "INSERT INTO people (name) VALUES ('a'), ('b')",
    "UPDATE trips t SET miles = t.miles + 1 FROM people p WHERE p.id = t.person_id",
    "DELETE FROM trips USING people WHERE people.id = trips.person_id",
    "SELECT count(*) FILTER (WHERE miles > 1) OVER (PARTITION BY person_id) FROM trips",
    "SELECT g.i FROM generate_series(1, 3) AS g(i)",
    "SELECT id FROM people UNION SELECT person_id FROM trips",
    "SELECT p.id FROM people p CROSS JOIN LATERAL unnest(ARRAY[1, 2]) AS u(x) WHERE u.x = 1",
    "BEGIN; COMMIT",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts(text):
    assert codes(text) == []


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("SELECT 1 FROM nowhere", ["E0001"]),
        ("SELECT * FROM nowhere", ["E0001", "E0001"]),
        ("SELECT zzz.id FROM people", ["E0001"]),
        ("SELECT p.nam FROM people p", ["E0002"]),
        ("SELECT x.nothing FROM (SELECT id FROM people) x", ["E0002"]),
        ("SELECT id FROM people p JOIN trips t ON true", ["E0006"]),
        ("INSERT INTO people (name, born) VALUES ('x')", ["E0005"]),
        ("INSERT INTO people (name) VALUES (NULL)", ["E0004"]),
        ("UPDATE people SET nam = 'x'", ["E0002"]),
        ("SELECT t.id FROM trips t JOIN badges b ON b.id = t.person_id", ["E0007"]),
        ("SELECT id FROM trips WHERE miles = note", ["E0003"]),
        ("SELECT note * 2 FROM trips", ["E0003"]),
        ("SELECT born FROM people UNION SELECT person_id FROM badges", ["E0003"]),
        ("SELECT born, name FROM people EXCEPT SELECT person_id FROM trips", ["E0003"]),
        ("SELECT FROM", ["E1000"]),
    ],
)
def test_each_rule(text, wanted):
    assert codes(text) == wanted == codes(text, "reference")


@pytest.mark.parametrize(
    ("text", "reference", "strict"),
    [
        ("SELECT person_id FROM trips JOIN badges USING (person_id)", ["E0006", "E0006"], []),
        ("SELECT id FROM people UNION SELECT id FROM trips", ["E0006"], []),
        ("WITH a AS (SELECT * FROM people) SELECT a.name FROM a", ["E0002"], []),
        ("SELECT id FROM people WHERE born = '2020-01-01'", ["E0003"], []),
        ("SELECT NAME FROM PEOPLE", ["E0001", "E0002"], []),
        ("WITH a AS (SELECT id FROM people) SELECT A.ID FROM a", ["E0001"], []),
        ("SELECT 1 FROM (SELECT nope FROM people) x", ["E0002"], ["E0002"]),
        ("SELECT DISTINCT ON (nope) id FROM people", [], ["E0002"]),
        ("SELECT 1 FROM people WHERE id IN (SELECT id FROM trips WHERE miles = note)", [], ["E0003"]),
        ("SELECT id FROM people; SELECT FROM; SELECT nope FROM people", ["E1000"], ["E1000", "E0002"]),
    ],
)
def test_modes_differ_where_documented(text, reference, strict):
    assert codes(text, "reference") == reference
    assert codes(text) == strict


def test_suggestions_and_places():
    (d,) = analyze_text("SELECT id,\n  naem FROM people", build_catalog([DDL]))
    assert (d["line"], d["column"], d["length"], d["help"]) == (2, 3, 4, "Did you mean 'name'?")


def test_directives():
    text = "SELECT a -- x:disable e0001, E0002\n-- x:disable\n\n-- x:disable E0003\nSELECT b\nSELECT '-- x:disable' -- y"
    assert directives(text) == {1: {"E0001", "E0002"}, 5: {"*", "E0003"}}
    assert codes("SELECT nope FROM people -- x:disable") == []
    assert codes("SELECT nope FROM people -- x:disable E0001") == ["E0002"]
    assert codes("INSERT INTO people (name, born) VALUES ('x') -- x:disable") == ["E0005"]  # it has no place


def test_mysql_and_sqlite():
    ddl = "CREATE TABLE `t` (`id` INT UNSIGNED AUTO_INCREMENT PRIMARY KEY, `kind` ENUM('a','b'), `n` MEDIUMINT, KEY `k` (`n`)) ENGINE=InnoDB;"
    assert codes("SELECT `id` FROM `t` WHERE `kind` = 'a' LIMIT 1, 2 # rest", ddl=ddl, dialect="mysql") == []
    assert codes("SELECT `ix` FROM `t`", ddl=ddl, dialect="mysql") == ["E0002"]
    assert codes("SELECT [id] FROM t", ddl="CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT)", dialect="sqlite") == []
