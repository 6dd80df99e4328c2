"""Spark SQL from trees of other dialects. Each rewriting of what Spark lacks is a method; all else is printed as it is.

The result is one declarative statement, so Catalyst plans it like any other: no rewriting collects rows, loops, or leaves
the JVM.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from querywright.functions.sqltypes import read_type, spark_type
from querywright.plans.parser import parse
from querywright.plans.tree import Name, Node
from querywright.sources.lexer import Span, SqlError, dialect_of

REGEX = {"~": (False, False), "~*": (True, False), "!~": (False, True), "!~*": (True, True)}
AGGREGATES = set("COUNT SUM AVG MIN MAX BOOL_AND BOOL_OR EVERY ARRAY_AGG STRING_AGG STDDEV VARIANCE".split())


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(n: Name | str) -> str:
    return "`" + (n.text if isinstance(n, Name) else n).replace("`", "``") + "`"


def to_spark(text: str, dialect: str = "postgresql", catalog=None) -> str:
    """Spark SQL for one statement. The catalog's types tell which divisions are of integers; without one, literals, casts and
    functions alone do."""
    from querywright.plans.integers import mark_integer_divisions

    found = parse(text, dialect)
    if len(found) != 1:
        raise SqlError(f"expected one statement, found {len(found)}")
    if dialect_of(dialect) != "mysql":
        mark_integer_divisions(found[0], catalog)
    return Printer(dialect_of(dialect)).statement(found[0])


def run(spark: SparkSession, text: str, dialect: str = "postgresql", args=None) -> DataFrame:
    """Runs a query of another dialect; $1 is args[0], :name is args["name"]. The types of the session's tables tell which
    divisions are of integers."""
    from querywright.plans.integers import session_catalog

    if isinstance(args, (list, tuple)) and "$" in text:
        args = {f"p{i}": v for i, v in enumerate(args, 1)}
    found = parse(text, dialect)
    return spark.sql(to_spark(text, dialect, session_catalog(spark, found)), args=args)


class Frame:
    """What one SELECT's FROM names, and the columns of further out that it passes to the queries in it."""

    def __init__(self, outer: Frame | None, aliases: list[str]):
        self.outer, self.aliases, self.hidden = outer, {a.lower() for a in aliases}, []
        self.listed, self.passed, self.name = aliases, {}, ""


class Printer:
    def __init__(self, dialect: str = "postgresql"):
        self.dialect, self.made = dialect, 0
        self.frame: Frame | None = None
        self.value = False  # whether what is printed is a value, not a condition that rows have to meet

    def fresh(self, stem: str) -> str:
        self.made += 1
        return f"__{stem}{self.made}"

    # -- queries ---------------------------------------------------------------------------------------------------------

    def statement(self, s: Node) -> str:
        if s.kind != "query":
            raise SqlError(f"{s.kind} is not a query")
        return self.query(s)

    def query(self, q: Node) -> str:
        head = ""
        if q.ctes:
            parts = [f"{ident(c.name)}{self.names(c.columns)} AS ({self.statement(c.body)})" for c in q.ctes]
            head = f"WITH {'RECURSIVE ' if q.recursive else ''}{', '.join(parts)} "
        if q.body.kind == "select" and (q.body.distinct_on or q.body.qualify is not None or q.ties or any(group_frames(o.kids[0]) for o in q.order_by or [])):
            return head + self.filtered(q)
        return head + self.body(q.body) + self.tail(q)

    def tail(self, q: Node) -> str:
        out = ""
        if q.order_by:
            out += " ORDER BY " + self.orders(q.order_by)
        if q.limit is not None and not q.ties:
            out += f" LIMIT {self.expr(q.limit)}"
        if q.offset is not None:
            out += f" OFFSET {self.expr(q.offset)}"
        return out

    def filtered(self, q: Node) -> str:
        """DISTINCT ON, QUALIFY, FETCH ... WITH TIES and an order by GROUPS frames: windows in a subquery, then a filter and the
        same order."""
        s, name = q.body, self.fresh("keep")
        order = self.orders(q.order_by) if q.order_by and not any(group_frames(o.kids[0]) for o in q.order_by) else ""
        if s.distinct_on:
            on = ", ".join(map(self.expr, s.distinct_on))
            keep, test = Node("raw", text=f"row_number() OVER (PARTITION BY {on} ORDER BY {order or on})"), "= 1"
        elif q.ties:
            keep, test = Node("raw", text=f"rank() OVER (ORDER BY {order})"), f"<= {self.expr(q.limit)}"
        elif s.qualify is not None:
            keep, test = s.qualify, ""
        else:
            keep, test = Node("bool", text="true"), ""
        aliased, extra, outer = {}, [], []
        for o in q.order_by or []:  # the outer order needs the sort keys by name
            e = o.kids[0]
            text = self.expr(e)
            known = next((i.alias.text for i in s.items if i.alias and (self.expr(i.kids[0]) == text or e.kind == "column" and len(e.names) == 1 and i.alias.text.lower() == e.names[0].text.lower())), None)
            if known is None and e.kind == "number":
                outer.append(self.order(o, e.text))
                continue
            if known is None:
                known = aliased.setdefault(text, self.fresh("o"))
                extra.append(Node("item", kids=[e], alias=Name(known, True, Span())))
            outer.append(self.order(o, ident(known)))
        if s.qualify is not None:  # names of items that the condition uses
            items = {i.alias.text.lower(): i.kids[0] for i in s.items if i.alias}
            keep = _replaced(s.qualify, items)
        drop = [name, *aliased.values()]
        inner = self.select(s, [*extra, Node("item", kids=[keep], alias=Name(name, True, Span()))])
        out = f"SELECT * EXCEPT ({', '.join(map(ident, drop))}) FROM ({inner}) WHERE {ident(name)} {test}"
        if outer:
            if aliased:  # sort before the keys go
                out = f"SELECT * EXCEPT ({', '.join(map(ident, drop))}) FROM (SELECT * FROM ({inner}) WHERE {ident(name)} {test} ORDER BY {', '.join(outer)})"
            else:
                out += " ORDER BY " + ", ".join(outer)
        if q.limit is not None and not q.ties:
            out += f" LIMIT {self.expr(q.limit)}"
        if q.offset is not None:
            out += f" OFFSET {self.expr(q.offset)}"
        return out

    def body(self, b: Node) -> str:
        if b.kind == "select":
            return self.select(b)
        if b.kind == "setop":
            sides = []
            for x in (b.left, b.right):
                inner = self.query(x) if x.kind == "query" else self.body(x)
                sides.append(f"({inner})" if x.kind in ("query", "setop") or x.kind == "select" and (x.distinct_on or x.qualify) else inner)
            return f"{sides[0]} {b.op}{' ALL' if b.all else ''} {sides[1]}"
        if b.kind == "values":
            return "VALUES " + ", ".join(f"({', '.join(map(self.expr, row))})" for row in b.rows)
        if b.kind == "query":
            return f"({self.query(b)})"
        raise SqlError(f"{b.kind} is not a query")

    def select(self, s: Node, more: list[Node] | None = None) -> str:
        self.frame = frame = Frame(self.frame, [a for t in s.from_ or [] for a in table_aliases(t)])
        value, self.value = self.value, False
        try:
            if more:
                s = Node("select", s.span, **{**s.fields, "items": [*s.items, *more]})
            s = self.without_groups(s)
            tables = [self.table(t, i > 0) for i, t in enumerate(s.from_ or [])]
            tail = f" WHERE {self.expr(s.where)}" if s.where is not None else ""
            if s.group_all:
                tail += " GROUP BY ALL"
            elif s.group_by:
                tail += " GROUP BY " + ", ".join(map(self.group, s.group_by))
            if s.having is not None:
                tail += f" HAVING {self.expr(s.having)}"
            if s.windows:
                tail += " WINDOW " + ", ".join(f"{ident(w.name)} AS {self.window(w.spec)}" for w in s.windows)
            self.value = True
            items = [(i, None if i.kids[0].kind == "star" else self.item(i)) for i in s.items]
            shown = [text if text is not None else self.item(i) for i, text in items]  # stars last: all that is passed is known then
            if frame.passed:
                tables.insert(0, self.passed(frame))
            return f"SELECT {'DISTINCT ' if s.distinct and not s.distinct_on else ''}{', '.join(shown)}{' FROM ' if tables else ''}{', '.join(tables)}{tail}"
        finally:
            self.frame, self.value = frame.outer, value

    def passed(self, frame: Frame) -> str:
        """One row of the columns of further out that queries inside name: Spark lets a query see the next one out alone."""
        return f"(SELECT {', '.join(f'{text} AS {ident(n)}' for n, text in frame.passed.values())}) AS {ident(frame.name)}"

    def without_groups(self, s: Node) -> Node:
        """GROUPS frames: the groups are numbered below, then a RANGE frame runs over the numbers. Below, each table is a
        column too, so that its qualified names hold."""
        calls = [x for i in s.items for x in group_frames(i.kids[0])]
        if not calls:
            return s
        if not s.from_:
            raise SqlError("a GROUPS frame needs a table")
        if s.group_by or s.group_all or s.having is not None:
            raise SqlError("a GROUPS frame over groups is not run; group in a subquery")
        numbers = []
        for c in calls:
            w, n = c.over, self.fresh("g")
            if w.base is not None or not w.order_by:
                raise SqlError("a GROUPS frame needs an order of its own")
            numbers.append((n, f"dense_rank() OVER ({self.partition(w)}ORDER BY {self.orders(w.order_by)}) AS {ident(n)}"))
            order = [Node("order", kids=[Node("column", names=[Name(n, True, Span())])], desc=False, nulls="")]
            c.fields["over"] = Node("window_spec", partition=w.partition, order_by=order, frame=("RANGE", *w.frame[1:]))
        where = f" WHERE {self.expr(s.where)}" if s.where is not None else ""
        aliases = self.frame.listed
        rows = [f"struct({ident(a)}.*) AS {ident(a)}" for a in aliases]
        tables = ", ".join(self.table(t, i > 0) for i, t in enumerate(s.from_))
        text = f"(SELECT *, {', '.join([*rows, *(x for _, x in numbers)])} FROM {tables}{where})"
        self.frame.hidden += [*aliases, *(n for n, _ in numbers)]
        return Node("select", s.span, **{**s.fields, "from_": [Node("raw", text=text)], "where": None})

    def item(self, i: Node) -> str:
        e = i.kids[0]
        if e.kind == "star":
            frame = self.frame
            if not e.names and frame is not None and frame.passed and not frame.hidden:
                return ", ".join(f"{ident(a)}.*" for a in frame.listed)
            out = "".join(ident(n) + "." for n in e.names or []) + "*"
            drop = [*(e.except_ or []), *(frame.hidden if frame is not None and not e.names else [])]
            return out + (f" EXCEPT ({', '.join(map(ident, drop))})" if drop else "")
        return self.expr(e) + (f" AS {ident(i.alias)}" if i.alias else "")

    def group(self, g: Node) -> str:
        if g.sets is None:
            return self.expr(g)
        parts = [", ".join(map(self.group, x)) if len(x) == 1 and x[0].sets is not None else f"({', '.join(map(self.expr, x))})" for x in g.sets]
        return {"sets": "GROUPING SETS", "rollup": "ROLLUP", "cube": "CUBE"}[g.kind] + f" ({', '.join(parts)})"

    def names(self, names: list[Name] | None) -> str:
        return f"({', '.join(map(ident, names))})" if names else ""

    def order(self, o: Node, text: str | None = None) -> str:
        nulls = o.nulls or (("FIRST" if o.desc else "LAST") if self.dialect == "postgresql" else ("LAST" if o.desc else "FIRST"))
        return f"{text or self.expr(o.kids[0])} {'DESC' if o.desc else 'ASC'} NULLS {nulls}"

    def orders(self, found: list[Node]) -> str:
        return ", ".join(map(self.order, found))

    # -- tables ----------------------------------------------------------------------------------------------------------

    def aliased(self, text: str, t: Node) -> str:
        if t.alias is None:
            return text
        return f"{text} AS {ident(t.alias)}{self.names(t.columns)}"

    def table(self, t: Node, beside: bool = False) -> str:
        """beside: other tables stand before it, so that it may need LATERAL."""
        if t.kind == "raw":
            return t.text
        if t.kind == "table":
            return self.aliased(".".join(map(ident, t.names)), t)
        if t.kind == "nested":
            return self.aliased(f"({self.table(t.table)})", t)
        if t.kind == "derived":
            frame = self.frame
            if frame is not None and not t.lateral:  # sees what the query around sees, and not its neighbours
                self.frame = frame.outer
            inner = self.query(t.query)
            self.frame = frame
            return self.aliased(f"{'LATERAL ' if t.lateral else ''}({inner})", t)
        if t.kind == "pivot":
            return self.aliased(f"{self.table(t.table, beside)} {t.word} {t.text}", t)
        if t.kind == "function":
            return self.table_function(t, beside)
        return self.join(t, beside)

    def table_function(self, t: Node, beside: bool) -> str:
        name = t.names[-1].text.lower()
        args = [self.expr(k) for k in t.kids]
        column = t.columns[0] if t.columns else t.alias or Name(name, False, Span())
        number = t.columns[1] if t.columns and len(t.columns) > 1 else Name("ordinality", False, Span())
        if name == "generate_series":
            source = f"sequence({', '.join(args)})"
        elif name == "unnest":
            source = args[0]
        else:
            return self.aliased(f"{'LATERAL ' if beside else ''}{name}({', '.join(args)})", t)
        if t.ordinality:
            inner = f"SELECT `x` AS {ident(column)}, `p` + 1 AS {ident(number)} FROM (SELECT posexplode({source}) AS (`p`, `x`))"
        else:
            inner = f"SELECT explode({source}) AS {ident(column)}"
        return f"{'LATERAL ' if beside else ''}({inner})" + (f" AS {ident(t.alias)}" if t.alias else "")

    def join(self, t: Node, beside: bool) -> str:
        kind, left, right = t.join, t.left, t.right
        if kind in ("RIGHT SEMI", "RIGHT ANTI"):
            kind, left, right = kind.replace("RIGHT", "LEFT"), right, left
        if kind.endswith("APPLY"):
            right.fields["lateral"] = True
            outer = kind.startswith("OUTER")
            return f"{self.table(left, beside)} {'LEFT' if outer else 'INNER'} JOIN {self.table(right, True)} ON true"
        if kind.startswith("ASOF"):
            return self.asof(t, beside)
        text = f"{self.table(left, beside)} {'NATURAL ' if t.natural else ''}{kind} JOIN {self.table(right, True)}"
        if t.using:
            return text + f" USING {self.names(t.using)}"
        return text + (f" ON {self.expr(t.on)}" if t.on is not None else "")

    def asof(self, t: Node, beside: bool) -> str:
        """The nearest row of the right table by the one inequality. With an equality, both sides are put under each other and
        read once in order, one shuffle and one sort; without one, or where a condition mixes both sides otherwise, each
        left row asks for its nearest."""
        tests = conjuncts(t.on)
        match = t.match or next((e for e in tests if e.kind == "binary" and e.op in ("<", "<=", ">", ">=")), None)
        if match is None or match.kind != "binary":
            raise SqlError("an ASOF join needs an inequality")
        right = t.right.alias or t.right.names[-1]
        theirs, down = (match.kids[1], match.op[0] == ">") if any(x.kind == "column" and len(x.names) > 1 and x.names[0].text.lower() == right.text.lower() for x in match.kids[1].walk()) else (match.kids[0], match.op[0] == "<")
        if (text := self.asof_by_sort(t, match, tests, right, theirs, down)) is not None:
            return text
        where = " AND ".join(self.expr(e) for e in [*([t.match] if t.match is not None else []), *tests]) or "true"
        using = "".join(f" AND {self.table_name(t.left)}.{ident(c)} = {ident(right)}.{ident(c)}" for c in t.using or [])
        inner = f"SELECT * FROM {self.table(t.right)} WHERE {where}{using} ORDER BY {self.expr(theirs)} {'DESC' if down else 'ASC'} LIMIT 1"
        return f"{self.table(t.left, beside)} {'LEFT' if kind_left(t) else 'INNER'} JOIN LATERAL ({inner}) AS {ident(right)} ON true"

    def asof_by_sort(self, t: Node, match: Node, tests: list[Node], right: Name, theirs: Node, down: bool) -> str | None:
        if t.left.kind not in ("table", "derived") or t.right.kind not in ("table", "derived") or t.left.kind == "derived" and t.left.alias is None:
            return None
        left = t.left.alias or t.left.names[-1]
        side = {left.text.lower(): "left", right.text.lower(): "right"}

        def of(e: Node) -> str | None:
            """The side that an expression's columns are of; None if that cannot be told, or of both."""
            found = {side.get(x.names[-2].text.lower()) if len(x.names) > 1 else None for x in e.walk() if x.kind == "column"}
            return found.pop() if len(found) == 1 and not any(x.query is not None for x in e.walk()) else None

        ours = match.kids[0] if theirs is match.kids[1] else match.kids[1]
        if of(ours) != "left" or of(theirs) != "right":
            return None
        keys = [(f"{ident(left)}.{ident(c)}", f"{ident(right)}.{ident(c)}") for c in t.using or []]
        only: dict[str, list[str]] = {"left": [], "right": []}
        for e in tests:
            if e is match:
                continue
            sides = [of(k) for k in e.kids] if e.kind == "binary" and e.op == "=" else []
            if sorted(map(str, sides)) == ["left", "right"]:
                a, b = e.kids if sides[0] == "left" else reversed(e.kids)
                keys.append((self.expr(a), self.expr(b)))
            elif (s := of(e)) is not None:
                only[s].append(self.expr(e))
            else:
                return None
        if not keys:
            return None
        names = [f"__k{i}" for i in range(len(keys))]
        ks = ", ".join(f"{{}} AS {ident(n)}" for n in names)
        l_name, r_name = ident(left), ident(right)
        first, last = (2, 1) if match.op in ("<=", ">=") else (1, 2)  # rows of one time: whether the right one comes first
        usable = " AND ".join([*(f"{b} IS NOT NULL" for _, b in keys), f"{self.expr(theirs)} IS NOT NULL", *only["right"]])
        ok = " AND ".join(only["left"]) or "true"
        lines = (
            f"SELECT struct({l_name}.*) AS {l_name}, NULL AS {r_name}, {ks.format(*(a for a, _ in keys))}, {self.expr(ours)} AS `__t`, {first} AS `__late`, ({ok}) AS `__ok` FROM {self.table(t.left)}",
            f"SELECT NULL, struct({r_name}.*), {', '.join(b for _, b in keys)}, {self.expr(theirs)}, {last}, false FROM {self.table(t.right)} WHERE {usable}",
        )
        order = f"PARTITION BY {', '.join(map(ident, names))} ORDER BY `__t` {'ASC' if down else 'DESC'} NULLS FIRST, `__late`, {r_name}"
        nearest = f"last_value({r_name}) IGNORE NULLS OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        rows = f"SELECT {l_name}, CASE WHEN `__ok` THEN {nearest} END AS {r_name} FROM ({' UNION ALL '.join(lines)})"
        some = f"{l_name} IS NOT NULL" + ("" if kind_left(t) else f" AND {r_name} IS NOT NULL")
        if self.frame is not None:
            self.frame.hidden += [left.text, right.text]
        return f"(SELECT {l_name}.*, {r_name}.*, {l_name}, {r_name} FROM ({rows}) WHERE {some})"

    def table_name(self, t: Node) -> str:
        return ident(t.alias or t.names[-1])

    # -- windows ---------------------------------------------------------------------------------------------------------

    def partition(self, w: Node) -> str:
        return f"PARTITION BY {', '.join(map(self.expr, w.partition))} " if w.partition else ""

    def window(self, w: Node) -> str:
        if w.base is not None and not w.partition and not w.order_by and not w.frame:
            return ident(w.base)
        out = (ident(w.base) + " " if w.base is not None else "") + self.partition(w)
        if w.order_by:
            out += "ORDER BY " + self.orders(w.order_by)
        if w.frame:
            bound = lambda b: b[0] if b[1] is None else f"{self.expr(b[1])} {b[0]}"
            unit, low, high = w.frame
            out += f" {unit} " + (f"BETWEEN {bound(low)} AND {bound(high)}" if high else bound(low))
        return f"({out.strip()})"

    # -- expressions -----------------------------------------------------------------------------------------------------

    def expr(self, e: Node) -> str:
        return getattr(self, "_" + e.kind)(e)

    def all(self, kids: list[Node]) -> str:
        return ", ".join(map(self.expr, kids))

    def _raw(self, e):
        return e.text

    def _column(self, e):
        if self.frame is not None and len(e.names) > 1:
            return self.reached(self.frame, e.names)
        return ".".join(map(ident, e.names))

    def reached(self, frame: Frame, names: list[Name]) -> str:
        """A qualified column as a query sees it: plain where the query or the next one out has the table, else passed on by
        the queries between."""
        plain, table = ".".join(map(ident, names)), names[-2].text.lower()
        at = frame
        while at is not None and table not in at.aliases:
            at = at.outer
        if at is None or at is frame or at is frame.outer:
            return plain
        between = frame.outer
        key = (table, names[-1].text.lower())
        if key not in between.passed:
            between.name = between.name or self.fresh("outer")
            between.passed[key] = self.fresh("x"), self.reached(between, names)
        return f"{ident(between.name)}.{ident(between.passed[key][0])}"

    def _star(self, e):
        return "".join(ident(n) + "." for n in e.names or []) + "*"

    def _number(self, e):
        return e.text.replace("_", "")

    def _string(self, e):
        return quote(e.text)

    def _bool(self, e):
        return e.text.lower()

    def _null(self, e):
        return "NULL"

    def _default(self, e):
        return "DEFAULT"

    def _param(self, e):
        return ":p" + e.text[1:] if e.text.startswith("$") else e.text

    def _nested(self, e):
        return f"({self.expr(e.kids[0])})"

    def _tuple(self, e):
        return f"({self.all(e.kids)})"

    def _named(self, e):
        return f"{e.name.text} => {self.expr(e.kids[0])}"

    def _unary(self, e):
        return f"({'NOT ' if e.op == 'NOT' else e.op}{self.expr(e.kids[0])})"

    def _subquery(self, e):
        return f"({self.query(e.query)})"

    def _exists(self, e):
        return f"EXISTS ({self.query(e.query)})"

    def _array_query(self, e):
        c = self.fresh("c")
        return f"(SELECT collect_list({ident(c)}) FROM ({self.query(e.query)}) AS q({ident(c)}))"

    def _array(self, e):
        return f"array({self.all(e.kids)})"

    def _binary(self, e):
        op, (a, b) = e.op, e.kids
        if b.kind == "quantified":
            return self.quantified(a, op, b)
        x, y = self.expr(a), self.expr(b)
        if op in REGEX:
            fold, no = REGEX[op]
            pattern = quote("(?i)" + b.text) if fold and b.kind == "string" else f"concat('(?i)', {y})" if fold else y
            return f"({x} {'NOT ' if no else ''}RLIKE {pattern})"
        if op in ("~~", "!~~"):
            return f"({x} {'NOT ' if op[0] == '!' else ''}LIKE {y})"
        if op in ("->", "->>"):
            return f"get_json_object({x}, {self.json_path(b, y)})"
        if op in ("#>", "#>>"):
            return f"get_json_object({x}, {quote('$' + ''.join(f'[{p}]' if p.isdigit() else '.' + p for p in b.text.strip('{}').split(',')))})"
        if op == "?":
            return f"coalesce(array_contains(json_object_keys({x}), {y}), false)"
        if op in ("@>", "<@"):
            return self.contains(a, b, x, y) if op == "@>" else self.contains(b, a, y, x)
        if op == "&&":
            return f"arrays_overlap({x}, {y})"
        if op == "#":
            return f"({x} ^ {y})"
        if op in ("^", "**"):
            return f"power({x}, {y})"
        if op == "DIV" or op == "/" and e.whole:
            return f"({x} div {y})"
        if op == "MOD":
            return f"({x} % {y})"
        if op == "XOR":
            return f"(({x}) <> ({y}))"
        return f"({x} {op} {y})"

    def json_path(self, b: Node, y: str) -> str:
        if b.kind == "string":
            return quote("$." + b.text) if re.fullmatch(r"\w+", b.text) else quote(f"$['{b.text}']")
        return quote(f"$[{b.text}]") if b.kind == "number" else f"concat('$.', {y})"

    def contains(self, a: Node, b: Node, x: str, y: str) -> str:
        """a @> b: of arrays, or of a JSON column and a literal object whose values are plain."""
        base = b.kids[0] if b.kind == "cast" else b
        if base.kind != "string":
            return f"(size(array_except({y}, {x})) = 0)"
        want = json.loads(base.text)
        if not isinstance(want, dict):
            raise SqlError("@> takes a JSON object")
        tests = [f"get_json_object({x}, {quote('$.' + k)}) {'= ' + quote(v if isinstance(v, str) else json.dumps(v)) if v is not None else 'IS NULL'}" for k, v in want.items()]
        return f"({' AND '.join(tests) or 'true'})"

    def quantified(self, a: Node, op: str, b: Node) -> str:
        x, every = self.expr(a), b.word == "ALL"
        if b.query is None:
            y = self.expr(b.kids[0])
            if op == "=" and not every:
                return f"array_contains({y}, {x})"
            return f"{'forall' if every else 'exists'}({y}, __e -> {x} {op} __e)"
        if op == "=" and not every or op in ("<>", "!=") and every:
            return self.member(a, b.query, every)
        q = self.query(b.query)
        of = lambda how: f"(SELECT {how} FROM ({q}) AS q(c))"
        nulls, none = of("count(*) > count(c)"), of("count(*) = 0")
        if op in ("=", "<>", "!="):
            lo, hi = of("min(c)"), of("max(c)")
            some = f"{x} <> {lo} OR {x} <> {hi}"
            best = lo
        else:
            best = of("max(c)" if (op[0] == ">") == every else "min(c)")
            some = f"NOT ({x} {op} {best})" if every else f"{x} {op} {best}"
        # One value decides; else a null among them leaves the outcome unknown.
        return f"CASE WHEN {none} THEN {'true' if every else 'false'} WHEN {some} THEN {'false' if every else 'true'} WHEN {nulls} THEN NULL ELSE {x} {op} {best} END"

    def member(self, a: Node, query: Node, no: bool) -> str:
        """IN of a query. As a condition of rows it is a join; as a value Spark has no NULL for it, so that is told apart."""
        x, value = self.expr(a), self.value
        q = self.query(query)
        test = f"({x} IN ({q}))"
        if not value or a.kind == "tuple":
            return f"({x} NOT IN ({q}))" if no else test
        some, nulls = (f"(SELECT {how} FROM ({q}) AS q(c))" for how in ("count(*) > 0", "count(*) > count(c)"))
        return f"CASE WHEN {test} THEN {str(not no).lower()} WHEN {nulls} OR {x} IS NULL AND {some} THEN NULL ELSE {str(no).lower()} END"

    def _in(self, e):
        no = "NOT " if e.no else ""
        if e.query is not None:
            return self.member(e.kids[0], e.query, bool(e.no))
        return f"({self.expr(e.kids[0])} {no}IN ({self.all(e.kids[1:])}))"

    def _between(self, e):
        x, a, b = map(self.expr, e.kids)
        if e.symmetric:
            a, b = f"least({a}, {b})", f"greatest({a}, {b})"
        return f"({x} {'NOT ' if e.no else ''}BETWEEN {a} AND {b})"

    def _like(self, e):
        x, y = map(self.expr, e.kids)
        no = "NOT " if e.no else ""
        if e.word == "SIMILAR":
            if e.kids[1].kind != "string":
                raise SqlError("SIMILAR TO takes a literal pattern")
            return f"({x} {no}RLIKE {quote('^(' + similar(e.kids[1].text) + ')$')})"
        word = "RLIKE" if e.word in ("RLIKE", "REGEXP") else e.word
        return f"({x} {no}{word} {y}{' ESCAPE ' + quote(e.escape) if e.escape else ''})"

    def _is(self, e):
        x = self.expr(e.kids[0])
        return f"({x} IS {'NOT ' if e.no else ''}{e.word})"

    def _distinct_from(self, e):
        a, b = map(self.expr, e.kids)
        return f"({a} IS {'NOT ' if e.no else ''}DISTINCT FROM {b})"

    def _case(self, e):
        head = f" {self.expr(e.operand)}" if e.operand is not None else ""
        whens = "".join(f" WHEN {self.expr(c)} THEN {self.expr(v)}" for c, v in e.whens)
        return f"CASE{head}{whens}{' ELSE ' + self.expr(e.other) if e.other is not None else ''} END"

    def _cast(self, e):
        t = spark_type(read_type(e.type))
        if t.typeName() in ("char", "varchar"):
            name = "string"
        else:
            name = t.simpleString()
        x = self.expr(e.kids[0])
        if e.type.upper().startswith("UNSIGNED"):
            name = "bigint"
        return f"{'try_cast' if e.op == 'TRY_CAST' else 'CAST'}({x} AS {name})"

    def _typed(self, e):
        return f"{'TIMESTAMP_NTZ' if e.type in ('TIMESTAMP', 'DATETIME') else 'TIMESTAMP' if e.type == 'TIMESTAMPTZ' else e.type} {quote(e.text)}"

    def _interval(self, e):
        v = e.kids[0]
        if v.kind == "string" and not e.unit:
            return f"INTERVAL {quote(v.text)}"
        if v.kind in ("string", "number"):
            return f"INTERVAL {quote(v.text)} {e.unit}"
        return f"({self.expr(v)} * INTERVAL '1' {e.unit})"

    def _extract(self, e):
        x, f = self.expr(e.kids[0]), e.field
        if f == "EPOCH":
            return f"(unix_micros(CAST({x} AS timestamp)) / 1000000D)"
        if f in ("DOW", "ISODOW"):
            return f"(extract(DAYOFWEEK FROM {x}) - 1)" if f == "DOW" else f"extract(DAYOFWEEK_ISO FROM {x})"
        if f == "DECADE":
            return f"(extract(YEAR FROM {x}) div 10)"
        if f in ("CENTURY", "MILLENNIUM"):
            n = 100 if f == "CENTURY" else 1000
            return f"((extract(YEAR FROM {x}) + {n - 1}) div {n})"
        return f"extract({ {'ISOYEAR': 'YEAROFWEEK'}.get(f, f) } FROM {x})"

    def _substring(self, e):
        return f"substring({self.all(e.kids)})"

    def _trim(self, e):
        if len(e.kids) == 1:
            return f"{ {'LEADING': 'ltrim', 'TRAILING': 'rtrim'}.get(e.where, 'trim') }({self.expr(e.kids[0])})"
        return f"trim({e.where or 'BOTH'} {self.expr(e.kids[1])} FROM {self.expr(e.kids[0])})"

    def _position(self, e):
        return f"position({self.expr(e.kids[0])} IN {self.expr(e.kids[1])})"

    def _overlay(self, e):
        x = list(map(self.expr, e.kids))
        return f"overlay({x[0]} PLACING {x[1]} FROM {x[2]}{' FOR ' + x[3] if len(x) > 3 else ''})"

    def _round_to(self, e):
        return f"date_trunc({quote(e.unit)}, {self.expr(e.kids[0])})"

    def _at_zone(self, e):
        x, zone = e.kids
        while x.kind == "nested":
            x = x.kids[0]
        if x.kind == "at_zone":  # a local time in one zone, as the local time of another
            return f"convert_timezone({self.expr(x.kids[1])}, {self.expr(zone)}, CAST({self.expr(x.kids[0])} AS timestamp_ntz))"
        return f"to_utc_timestamp({self.expr(x)}, {self.expr(zone)})"

    def _collate(self, e):
        name = e.names[-1].text
        return f"({self.expr(e.kids[0])} COLLATE {'UTF8_BINARY' if name.upper() in ('C', 'POSIX', 'BINARY', 'UCS_BASIC') else name})"

    def _subscript(self, e):
        x = self.expr(e.kids[0])
        if not e.slice:
            return f"try_element_at({x}, {self.expr(e.parts[0])})"
        low = self.expr(e.parts[0]) if e.parts[0] is not None else "1"
        high = self.expr(e.parts[1]) if len(e.parts) > 1 and e.parts[1] is not None else f"size({x})"
        out = f"slice({x}, {low}, greatest(0, {high} - ({low}) + 1))"
        if len(e.parts) > 2 and e.parts[2] is not None:
            out = f"filter({out}, (v, i) -> i % ({self.expr(e.parts[2])}) = 0)"
        return out

    def _member(self, e):
        return f"{self.expr(e.kids[0])}.{ident(e.name)}"

    def _method(self, e):
        return f"{e.name.text}({self.all(e.kids)})"

    def _call(self, e):
        name = e.names[-1].text
        made = getattr(self, "call_" + name.lower(), None)
        args = list(map(self.expr, e.kids))
        if made is not None and (text := made(e, args)) is not None:
            return self.over(text, e)
        if e.bare:
            return f"{name}()" if name.upper() != "LOCALTIMESTAMP" else "localtimestamp()"
        return self.over(self.plain(name, e, args), e)

    def over(self, text: str, e: Node) -> str:
        return text if e.over is None else f"{text} OVER {self.window(e.over)}"

    def plain(self, name: str, e: Node, args: list[str]) -> str:
        """A call; FILTER beside OVER becomes a CASE, as Spark has no such pair."""
        if e.filter is not None and e.over is not None:
            test = self.expr(e.filter)
            args = [f"CASE WHEN {test} THEN {'1' if a == '*' else a} END" for a in args]
        out = f"{name}({'DISTINCT ' if e.distinct else ''}{', '.join(args)})"
        if e.nulls == "IGNORE":
            out += " IGNORE NULLS"
        if e.within:
            out += f" WITHIN GROUP (ORDER BY {self.orders(e.within)})"
        if e.filter is not None and e.over is None:
            out += f" FILTER (WHERE {self.expr(e.filter)})"
        return out

    # -- functions with other names or rules ---------------------------------------------------------------------------------

    def call_string_agg(self, e, args):
        order = f" WITHIN GROUP (ORDER BY {self.orders(e.order_by)})" if e.order_by else ""
        test = f" FILTER (WHERE {self.expr(e.filter)})" if e.filter is not None else ""
        return f"listagg({'DISTINCT ' if e.distinct else ''}{', '.join(args)}){order}{test}"

    def call_group_concat(self, e, args):
        order = f" WITHIN GROUP (ORDER BY {self.orders(e.order_by)})" if e.order_by else ""
        separator = self.expr(e.separator) if e.separator is not None else args[1] if len(args) > 1 else quote(",")
        return f"listagg({'DISTINCT ' if e.distinct else ''}CAST({args[0]} AS string), {separator}){order}"

    def call_array_agg(self, e, args):
        test = f" FILTER (WHERE {self.expr(e.filter)})" if e.filter is not None else ""
        x = args[0]
        if e.distinct:
            return f"array_sort(collect_set({x}){test})"
        if not e.order_by:
            return f"transform(collect_list(struct({x} AS x)){test}, s -> s.x)"
        keys = ", ".join(f"{self.expr(o.kids[0])} AS k{i}" for i, o in enumerate(e.order_by))
        rows = f"collect_list(struct({keys}, {x} AS x)){test}"
        tests = []
        for i, o in enumerate(e.order_by):
            nulls_first = (o.nulls == "FIRST") if o.nulls else (o.desc == (self.dialect == "postgresql"))
            a, b, k = f"l.k{i}", f"r.k{i}", f"{-1 if not o.desc else 1}"
            tests += [f"WHEN {a} IS NULL AND {b} IS NOT NULL THEN {-1 if nulls_first else 1}", f"WHEN {b} IS NULL AND {a} IS NOT NULL THEN {1 if nulls_first else -1}", f"WHEN {a} < {b} THEN {k}", f"WHEN {a} > {b} THEN {-int(k)}"]
        return f"transform(array_sort({rows}, (l, r) -> CASE {' '.join(tests)} ELSE 0 END), s -> s.x)"

    def call_concat(self, e, args):
        if self.dialect != "postgresql":
            return None
        return f"concat_ws('', {', '.join(args)})"  # nulls count as empty

    def call_strpos(self, e, args):
        return f"instr({', '.join(args)})"

    def call_trunc(self, e, args):
        if len(args) == 2 and e.kids[0].kind == "string":
            return None
        x, d = args[0], args[1] if len(args) > 1 else "0"
        return f"(sign({x}) * floor(abs({x}) * power(10, {d})) / power(10, {d}))"

    call_truncate = call_trunc

    def call_log(self, e, args):
        return f"log10({args[0]})" if len(args) == 1 and self.dialect != "mysql" else None

    def call_random(self, e, args):
        return "rand()"

    def call_array_length(self, e, args):
        return f"nullif(size({args[0]}), 0)"

    def call_array_to_string(self, e, args):
        return f"array_join({', '.join(args)})"

    def call_string_to_array(self, e, args):
        return f"split({args[0]}, concat('\\\\Q', {args[1]}, '\\\\E'))"

    def call_unnest(self, e, args):
        return f"explode({args[0]})"

    def call_generate_series(self, e, args):
        return f"explode(sequence({', '.join(args)}))"

    def call_datediff(self, e, args):
        return f"datediff({', '.join(args)})" if len(args) == 2 else None

    def call_json_extract(self, e, args):
        return f"get_json_object({', '.join(args)})"

    def call_to_timestamp(self, e, args):
        return f"timestamp_seconds({args[0]})" if len(args) == 1 and self.dialect == "postgresql" else None


def conjuncts(e: Node | None) -> list[Node]:
    """The conditions that AND connects."""
    if e is None:
        return []
    if e.kind == "nested":
        return conjuncts(e.kids[0])
    return [x for k in e.kids for x in conjuncts(k)] if e.kind == "binary" and e.op == "AND" else [e]


def kind_left(t: Node) -> bool:
    return t.join == "ASOF LEFT"


def table_aliases(t: Node) -> list[str]:
    """The names under which a FROM item's tables are known."""
    if t.alias is not None:
        return [t.alias.text]
    if t.kind == "join":
        right = table_aliases(t.right) if t.join not in ("LEFT SEMI", "LEFT ANTI") else []
        return (table_aliases(t.left) if t.join not in ("RIGHT SEMI", "RIGHT ANTI") else []) + right
    if t.kind in ("nested", "pivot"):
        return table_aliases(t.table)
    return [t.names[-1].text] if t.names else []


def group_frames(e: Node) -> list[Node]:
    """The calls of an expression that have a GROUPS frame."""
    return [x for x in e.walk() if x.kind == "call" and x.over is not None and x.over.frame and x.over.frame[0] == "GROUPS"]


def similar(pattern: str) -> str:
    """A SIMILAR TO pattern as a regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append("\\" + pattern[i + 1])
            i += 1
        elif c == "[":
            j = pattern.find("]", i + 1)
            out.append(pattern[i : j + 1])
            i = j
        else:
            out.append({"%": ".*", "_": "."}.get(c, "\\" + c if c in ".^$" else c))
        i += 1
    return "".join(out)


def _replaced(e: Node, items: dict[str, Node]) -> Node:
    """The expression with names of items replaced by the items."""
    if e.kind == "column" and len(e.names) == 1 and (found := items.get(e.names[0].text.lower())) is not None:
        return Node("nested", e.span, [found])
    fields = dict(e.fields)
    return Node(e.kind, e.span, [_replaced(k, items) for k in e.kids], **fields)
