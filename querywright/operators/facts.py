"""What statements mention, as rows: relations, columns and functions with their places. Usage questions over many files
(which tables a corpus reads, which columns nobody names) are then joins with the catalog's DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywright.plans.parser import parse
from querywright.plans.tree import Node
from querywright.sources.lexer import SqlError

FACTS = "file string, stmt_no int, statement string, fact string, qualifier string, name string, line int, column int"


def mentions(s: Node) -> Iterator[tuple[str, str, str, int, int]]:
    """(fact, qualifier, name, line, column) of all that a statement mentions; names of its CTEs are no relations."""
    stack: list = [s]
    ctes: set[str] = set()
    found = []
    while stack:
        x = stack.pop()
        if isinstance(x, (list, tuple)):
            stack += reversed(x)
            continue
        if not isinstance(x, Node):
            continue
        if x.kind == "cte":
            ctes.add(x.name.text.lower())
        names = x.names
        if x.kind == "update" or x.kind == "delete":
            names = None
        if names and x.kind in ("table", "insert", "column", "call", "function", "create_table", "create_view", "alter_table"):
            fact = {"table": "relation", "insert": "relation", "column": "column", "call": "function", "function": "function"}.get(x.kind, "definition")
            found.append((fact, ".".join(n.text for n in names[:-1]), names[-1].text, names[-1].span.line, names[-1].span.column))
        stack += reversed([*x.fields.values(), *x.kids] if x.kind != "case" else [x.kids])
    for f in found:
        if not (f[0] == "relation" and not f[1] and f[2].lower() in ctes):
            yield f


def facts(files: DataFrame, dialect: str = "postgresql") -> DataFrame:
    """Facts of a DataFrame of files (file, text); files that cannot be read have none. One narrow map."""
    columns = [c.split()[0] for c in FACTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f, text in zip(batch["file"], batch["text"], strict=True):
                try:
                    found = parse(text or "", dialect)
                except (SqlError, RecursionError):
                    continue
                rows += [(f, i, s.kind, *m) for i, s in enumerate(found, 1) for m in mentions(s)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("file", "text").mapInPandas(run, FACTS)


def table_usage(found: DataFrame) -> DataFrame:
    """Statements and files that mention each relation."""
    relations = found.filter("fact = 'relation'")
    return relations.groupBy(F.lower("name").alias("relation")).agg(F.countDistinct("file", "stmt_no").alias("statements"), F.countDistinct("file").alias("files"))


def unused_columns(found: DataFrame, catalog: dict[str, DataFrame]) -> DataFrame:
    """Columns of tables that no statement names. The catalog is the small side; facts are reduced to names first."""
    named = found.filter("fact = 'column'").select(F.lower("name").alias("n")).distinct()
    columns = catalog["cat_columns"]
    return columns.join(named, F.lower(columns["column"]) == named["n"], "left_anti").select("schema", "relation", "column")
