"""What an editor asks of a catalog: descriptions, completions, the word at a position."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywright.operators.catalog import Catalog

_WORD = re.compile(r"[A-Za-z0-9_]+")


def word_at(text: str, line: int, character: int) -> str | None:
    """The identifier that touches a position (both counted from 0)."""
    lines = text.split("\n")
    if not 0 <= line < len(lines):
        return None
    return next((m[0] for m in _WORD.finditer(lines[line]) if m.start() <= character <= m.end()), None)


def hover(catalog: Catalog, word: str) -> str | None:
    """A table's columns as a Markdown table, a view's columns, or each table that owns a column of this name."""
    low = word.lower()
    for _, t in catalog.tables():
        if t.name.lower() == low:
            rows = [f"| {c.name} | {c.type} | {'YES' if c.nullable else 'NO'} |" for c in t.columns]
            return "\n".join([f"**Table: {t.name}**", "", "| Column | Type | Nullable |", "| --- | --- | --- |", *rows])
    for _, v in catalog.views():
        if v.name.lower() == low:
            return "\n".join([f"**View: {v.name}**", "", *(f"- {c}" for c in v.columns)])
    found = [f"**{t.name}.{c.name}**: {c.type} {'NULL' if c.nullable else 'NOT NULL'}" for _, t in catalog.tables() for c in t.columns if c.name.lower() == low]
    return "\n\n".join(found) or None


def completions(catalog: Catalog) -> list[tuple[str, str, str]]:
    """(label, kind, detail) of every table, column and view."""
    out = []
    for _, t in catalog.tables():
        out.append((t.name, "table", f"{len(t.columns)} columns"))
        out += [(c.name, "column", f"{t.name}.{c.name}: {c.type}") for c in t.columns]
    return out + [(v.name, "view", f"{len(v.columns)} columns") for _, v in catalog.views()]


def columns_like(frames: dict[str, DataFrame], prefix: str) -> DataFrame:
    """Columns whose name begins with a prefix, from the catalog's DataFrames."""
    return frames["cat_columns"].filter(F.lower("column").startswith(prefix.lower())).select("schema", "relation", "column", "sql_type")
