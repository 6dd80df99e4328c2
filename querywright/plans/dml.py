"""Statements that change rows, as queries for the rows after them.

Files do not change in place: changed() gives one SELECT (through Spark SQL) for the table's content after an INSERT, UPDATE
or DELETE, which can be written where it belongs, and one for the rows of its RETURNING. What a statement says and no query
expresses is an SqlError, never left out.

Joins against other tables stay joins, so Catalyst may broadcast a small side or sort-merge two large ones. The tables of
UPDATE ... FROM and DELETE ... USING are reduced to one row for each of their keys before they meet the target, so a target
row never comes twice: of several matches the smallest row counts, column by column in the order of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField

from querywright.operators.catalog import Catalog
from querywright.plans.integers import mark_integer_divisions, session_catalog
from querywright.plans.parser import parse
from querywright.plans.spark_sql import Frame, Printer, conjuncts, ident
from querywright.plans.tree import Node
from querywright.sources.lexer import SqlError, dialect_of

MATCH = "`__match`"


def changed(spark: SparkSession, text: str, dialect: str = "postgresql", catalog: Catalog | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of the statement's target after it, rows of its RETURNING or None); tables are those of the session. The catalog
    tells the keys that a conflict without columns is about."""
    (s,) = parse(text, dialect)
    if dialect_of(dialect) != "mysql":
        mark_integer_divisions(s, session_catalog(spark, [s]))
    made = {"insert": _Insert, "update": _Update, "delete": _Delete}.get(s.kind)
    if made is None:
        raise SqlError(f"{s.word or s.kind} does not change rows here")
    for field, word in (("ctes", "WITH"), ("more", "several tables"), ("targets", "a list of targets"), ("order_by", "ORDER BY"), ("limit", "LIMIT"), ("default", "DEFAULT VALUES")):
        if s.fields.get(field):
            raise SqlError(f"{s.kind.upper()} with {word} is not run")
    change = made(spark, Printer(dialect_of(dialect)), s, catalog)
    return spark.sql(change.rows()), spark.sql(change.returned()) if s.returning else None


def after(spark: SparkSession, text: str, dialect: str = "postgresql", catalog: Catalog | None = None) -> DataFrame:
    """The rows of the statement's target after it. A statement with RETURNING has another result too: see changed()."""
    rows, returned = changed(spark, text, dialect, catalog)
    if returned is not None:
        raise SqlError("RETURNING gives rows of its own; changed() has both")
    return rows


def returning(spark: SparkSession, text: str, dialect: str = "postgresql", catalog: Catalog | None = None) -> DataFrame:
    """The rows that the statement returns."""
    _, returned = changed(spark, text, dialect, catalog)
    if returned is None:
        raise SqlError("the statement has no RETURNING")
    return returned


def _kind(f: StructField) -> str:
    return f.dataType.simpleString()


class _Change:
    """What the statements share: the target, its alias and fields, and the tables beside it."""

    def __init__(self, spark: SparkSession, p: Printer, s: Node, catalog: Catalog | None):
        self.spark, self.p, self.s, self.catalog = spark, p, s, catalog
        names, alias = (s.names, s.alias) if s.kind == "insert" else (s.table.names, s.table.alias)
        if not names:
            raise SqlError(f"{s.kind.upper()} needs one table; put the others into {'USING' if s.kind == 'delete' else 'FROM'}")
        self.target, self.name = ".".join(map(ident, names)), ident(alias or names[-1])
        self.table_name = names[-1].text
        self.fields = spark.table(self.target).schema.fields
        self.columns = {f.name.lower() for f in self.fields}

    # -- the tables beside the target --------------------------------------------------------------------------------------

    def beside(self, tables: list[Node]) -> None:
        """Reads names and columns of the tables of FROM or USING."""
        self.others: dict[str, list[str]] = {}
        self.tables = tables
        for t in tables:
            if t.kind not in ("table", "derived"):
                raise SqlError("a join beside the target is not run; list its tables, with its condition in WHERE")
            alias = (t.alias or t.names[-1]).text
            columns = self.spark.sql(f"SELECT * FROM {self.p.table(t)} LIMIT 0").columns
            self.others[alias.lower()] = columns

    def owner(self, e: Node) -> str | None:
        """The table beside the target that a column belongs to; None for the target's own."""
        if e.kind != "column":
            return None
        if len(e.names) > 1:
            table = e.names[-2].text.lower()
            return table if table in self.others and table != self.name.strip("`").lower() else None
        column = e.names[0].text.lower()
        if column in self.columns:
            return None
        return next((t for t, columns in self.others.items() if column in (c.lower() for c in columns)), None)

    def has_query(self, e: Node) -> bool:
        return any(x.query is not None or x.kind in ("subquery", "exists", "array_query") for x in e.walk())

    def source(self) -> tuple[str, str]:
        """(FROM clause of the target with its match, condition that a row is hit)."""
        where = self.s.where
        plain = f"{self.target} AS {self.name}"
        if not self.tables:
            return plain, f"coalesce({self.p.expr(where)}, false)" if where is not None else "true"
        inside, outside = [], []
        # Queries in the condition see the tables beside first, then the target.
        frame = Frame(Frame(None, [self.name.strip("`")]), list(self.others))
        for e in conjuncts(where):
            own = not self.has_query(e) and not any(self.owner(x) for x in e.walk())
            self.p.frame = None if own else frame
            (outside if own else inside).append(self.p.expr(e))
        self.p.frame = None
        rows = ", ".join(f"struct({ident(t)}.*) AS {ident(t)}" for t in self.others)
        others = " CROSS JOIN ".join([*(self.p.table(t, i > 0) for i, t in enumerate(self.tables)), *([self.p.passed(frame)] if frame.passed else [])])
        test = f" WHERE {' AND '.join(inside)}" if inside else ""
        found = f"{plain} LEFT JOIN LATERAL (SELECT min(struct({rows})) AS `m` FROM {others}{test}) AS {MATCH} ON true"
        return found, " AND ".join([f"{MATCH}.`m` IS NOT NULL", *[f"coalesce({x}, false)" for x in outside]])

    def matched(self, e: Node) -> Node:
        """The expression, with columns of the tables beside read from the match."""
        if e.kind == "column" and (table := self.owner(e)) is not None:
            return Node("raw", text=f"{MATCH}.`m`.{ident(table)}.{ident(e.names[-1])}")
        return Node(e.kind, e.span, [self.matched(k) for k in e.kids], **e.fields)

    # -- RETURNING -------------------------------------------------------------------------------------------------------

    def returned_items(self) -> str:
        """The items of RETURNING over rows that have the target's columns and, in a match, those beside."""
        out = []
        for i in self.s.returning:
            e = i.kids[0]
            if e.kind == "star" and (not e.names or e.names[-1].text.lower() == self.name.strip("`").lower()):
                out += [f"{self.name}.{ident(f.name)}" for f in self.fields]
                if not e.names:
                    out += [f"{MATCH}.`m`.{ident(t)}.*" for t in self.others]
            elif e.kind == "star":
                out.append(f"{MATCH}.`m`.{ident(e.names[-1])}.*")
            else:
                name = i.alias or (e.names[-1] if e.kind == "column" else None)
                out.append(self.p.expr(self.matched(e)) + (f" AS {ident(name)}" if name else ""))
        return ", ".join(out)

    def sets(self, assignments: list[Node]) -> dict[str, Node]:
        """Column (in lower case) -> expression; tuples are taken apart."""
        out: dict[str, Node] = {}
        for a in assignments:
            value = a.kids[0]
            if a.targets is None:
                pairs = [(a.target, value)]
            else:
                pairs = list(zip(a.targets, self.parts(value, len(a.targets)), strict=True))
            for names, v in pairs:
                column = names[-1].text.lower()
                if column not in self.columns:
                    raise SqlError(f"{self.table_name} has no column {names[-1].text}")
                if v.kind == "default":
                    raise SqlError("SET to DEFAULT is not run")
                out[column] = v
        return out

    def parts(self, value: Node, n: int) -> list[Node]:
        while value.kind == "nested":
            value = value.kids[0]
        if value.kind == "tuple" or value.kind == "call" and value.names[-1].text.upper() == "ROW":
            found = value.kids
        elif value.kind == "subquery":
            columns = [ident(f"c{i}") for i in range(n)]
            body = value.query.body
            if body.kind != "select" or len(body.items) != n or any(i.kids[0].kind == "star" for i in body.items):
                raise SqlError("a query for several columns has to list them")
            row = ", ".join(f"{self.p.expr(i.kids[0])} AS {c}" for i, c in zip(body.items, columns, strict=True))
            one = Node("select", body.span, **{**body.fields, "items": [Node("item", kids=[Node("raw", text=f"struct({row})")])]})
            text = self.p.query(Node("query", value.query.span, **{**value.query.fields, "body": one}))
            found = [Node("raw", text=f"({text}).{c}") for c in columns]
        else:
            found = [value] if n == 1 else []
        if len(found) != n:
            raise SqlError(f"{n} columns are set to {len(found)} values")
        return found

    def assigned(self, sets: dict[str, Node], hit: str) -> list[str]:
        out = []
        for f in self.fields:
            c = ident(f.name)
            value = sets.get(f.name.lower())
            out.append(f"{self.name}.{c}" if value is None else f"CAST(CASE WHEN {hit} THEN CAST({self.p.expr(value)} AS {_kind(f)}) ELSE {self.name}.{c} END AS {_kind(f)}) AS {c}")
        return out


class _Update(_Change):
    def __init__(self, *args):
        super().__init__(*args)
        self.beside(self.s.from_ or [])
        self.assignments = {c: self.matched(e) for c, e in self.sets(self.s.sets).items()}

    def rows(self) -> str:
        source, hit = self.source()
        return f"SELECT {', '.join(self.assigned(self.assignments, hit))} FROM {source}"

    def returned(self) -> str:
        source, hit = self.source()
        match = [f"{MATCH}.`m`"] if self.tables else []
        new = f"SELECT struct({', '.join(self.assigned(self.assignments, 'true'))}) AS `row`, {match[0] if match else 'NULL'} AS `m` FROM {source} WHERE {hit}"
        return f"SELECT {self.returned_items()} FROM (SELECT `row`.*, struct(`m`) AS {MATCH} FROM ({new})) AS {self.name}"


class _Delete(_Change):
    def __init__(self, *args):
        super().__init__(*args)
        self.beside(self.s.using or [])

    def rows(self) -> str:
        if self.tables:  # an anti join asks only whether there is a match
            where = self.p.expr(self.s.where) if self.s.where is not None else "true"
            others = " CROSS JOIN ".join(self.p.table(t, i > 0) for i, t in enumerate(self.tables))
            return f"SELECT {self.name}.* FROM {self.target} AS {self.name} LEFT ANTI JOIN {others} ON {where}"
        source, hit = self.source()
        return f"SELECT {self.name}.* FROM {source} WHERE NOT ({hit})"

    def returned(self) -> str:
        source, hit = self.source()
        match = f"struct({MATCH}.`m`)" if self.tables else "NULL"
        return f"SELECT {self.returned_items()} FROM (SELECT {self.name}.*, {match} AS {MATCH} FROM {source} WHERE {hit}) AS {self.name}"


class _Insert(_Change):
    """A new row conflicts where its key stands in the target; keys with a null never do. Of new rows with one key DO NOTHING
    keeps the smallest, column by column; DO UPDATE fails on them when it runs."""

    def __init__(self, *args):
        super().__init__(*args)
        self.others = {}
        self.tables = []
        s = self.s
        self.here, self.there, self.place = "`__here`", "`__there`", "`__place`"
        self.change_where = None
        if s.conflict is None and not s.or_word:
            return
        if s.or_word not in (None, "IGNORE", "REPLACE"):
            raise SqlError(f"INSERT OR {s.or_word} is not run")
        self.keys = [e.names[-1].text for e in s.conflict_target or []] or self.known_keys()
        if missing := [k for k in self.keys if k.lower() not in self.columns]:
            raise SqlError(f"{self.table_name} has no column {missing[0]}")
        if s.or_word == "REPLACE":
            self.change = {f.name.lower(): Node("raw", text=f"`excluded`.{ident(f.name)}") for f in self.fields}
        else:
            self.change = {c: self.own(e) for c, e in self.sets(s.conflict or []).items()}
            self.change_where = None if s.conflict_where is None else self.own(s.conflict_where)
        self.again = "first" if not self.change or s.or_word else "fail"

    def own(self, e: Node) -> Node:
        """The expression, with plain names as the target's columns."""
        if e.kind == "column" and len(e.names) == 1 and e.names[0].text.lower() in self.columns:
            return Node("raw", text=f"{self.name}.{ident(e.names[0])}")
        return Node(e.kind, e.span, [self.own(k) for k in e.kids], **e.fields)

    def known_keys(self) -> list[str]:
        found = [] if self.catalog is None else [x.columns for _, t in self.catalog.tables() if t.name.lower() == self.table_name.lower() for x in t.constraints if x.type in ("primary_key", "unique")]
        if len(found) != 1:
            raise SqlError(f"ON CONFLICT needs its columns: {len(found)} keys of {self.table_name} are known")
        return found[0]

    def new(self) -> str:
        s = self.s
        own = [n.text.lower() for n in s.columns] if s.columns else [f.name.lower() for f in self.fields]
        if unknown := [c for c in own if c not in self.columns]:
            raise SqlError(f"{self.table_name} has no column {unknown[0]}")
        width = [ident(f"v{i}") for i in range(len(own))]
        pick = ", ".join(f"CAST({width[own.index(f.name.lower())] if f.name.lower() in own else 'NULL'} AS {_kind(f)}) AS {ident(f.name)}" for f in self.fields)
        return f"SELECT {pick} FROM ({self.p.query(s.source)}) AS n({', '.join(width)})"

    @property
    def simple(self) -> bool:
        return self.s.conflict is None and not self.s.or_word

    def joined(self) -> tuple[str, str, str]:
        """(source, condition that the target has the row, condition that it is changed)."""
        keys = list(map(ident, self.keys))
        known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        order = ", ".join(ident(f.name) for f in self.fields)
        place = f"CASE WHEN {known} THEN row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order}) ELSE 1 END"
        test = f"{self.place} = 1" if self.again == "first" else f"CASE WHEN {self.place} = 1 THEN true ELSE raise_error('ON CONFLICT DO UPDATE meets a row a second time') END"
        new = f"SELECT *, true AS {self.there} FROM (SELECT *, {place} AS {self.place} FROM ({self.new()})) WHERE {test}"
        on = " AND ".join(f"{self.name}.{k} = `excluded`.{k}" for k in keys)
        source = f"(SELECT *, true AS {self.here} FROM {self.target}) AS {self.name} FULL JOIN ({new}) AS `excluded` ON {on}"
        here, there = f"{self.name}.{self.here} IS NOT NULL", f"`excluded`.{self.there} IS NOT NULL"
        change = f"{here} AND {there}" + (f" AND coalesce({self.p.expr(self.change_where)}, false)" if self.change_where is not None else "")
        return source, here, change if self.change else "false"

    def values(self, here: str, change: str) -> str:
        out = []
        for f in self.fields:
            c = ident(f.name)
            value = f"CAST({self.p.expr(self.change[f.name.lower()])} AS {_kind(f)})" if f.name.lower() in self.change else f"{self.name}.{c}"
            out.append(f"CASE WHEN NOT ({here}) THEN `excluded`.{c} WHEN {change} THEN {value} ELSE {self.name}.{c} END AS {c}")
        return ", ".join(out)

    def rows(self) -> str:
        if self.simple:
            return f"SELECT * FROM {self.target} UNION ALL {self.new()}"
        source, here, change = self.joined()
        return f"SELECT {self.values(here, change)} FROM {source}"

    def returned(self) -> str:
        if self.simple:
            return f"SELECT {self.returned_items()} FROM ({self.new()}) AS {self.name}"
        source, here, change = self.joined()
        return f"SELECT {self.returned_items()} FROM (SELECT {self.values(here, change)} FROM {source} WHERE NOT ({here}) OR ({change})) AS {self.name}"
