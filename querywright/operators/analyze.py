"""SQL text in, diagnostics out.

Files are analysed one by one, so a DataFrame of any number of files is a narrow map: the catalog (its pickled size is
checked) goes to the tasks, and no row is shuffled. What looks across files (caps, summaries, sinks) is in sinks.py.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from querywright.operators.catalog import Catalog
from querywright.operators.names import Names
from querywright.operators.types import Types
from querywright.plans.parser import parse
from querywright.sources.lexer import SqlError, split_statements

DIAGNOSTICS = "file string, stmt_no int, seq int, phase int, kind string, code string, severity string, message string, line int, column int, length int, offset int, help string"
CATALOG_LIMIT = 256 << 20
RULES = {"E0001": "table-not-found", "E0002": "column-not-found", "E0003": "type-mismatch", "E0004": "potential-null-violation", "E0005": "column-count-mismatch", "E0006": "ambiguous-column", "E0007": "join-type-mismatch", "E1000": "parse-error"}
_DIRECTIVE = re.compile(r"^--\s*[\w-]+:disable(?:\s+(?P<codes>[A-Za-z0-9,\s]+))?\s*$")


def directives(text: str) -> dict[int, set[str]]:
    """Codes that comments of the form `-- name:disable E0001, E0002` switch off, by line; `*` is every code. After code a
    comment is for its own line; alone on a line it is for the next line that is neither blank nor a comment."""
    out: dict[int, set[str]] = {}
    waiting: set[str] = set()
    for n, line in enumerate(text.split("\n"), 1):
        at = _comment(line)
        found = _DIRECTIVE.match(line[at:].strip()) if at is not None else None
        codes = {c.upper() for c in re.split(r"[\s,]+", found["codes"] or "") if c} or {"*"} if found else set()
        code = line[:at].strip() if at is not None else line.strip()
        if code:
            if codes or waiting:
                out[n] = codes | waiting
            waiting = set()
        else:
            waiting |= codes
    return out


def _comment(line: str) -> int | None:
    """Where a line's comment begins, outside quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif line.startswith("--", i):
            return i
    return None


def analyze_text(text: str, catalog: Catalog, dialect: str = "postgresql", mode: str = "strict") -> list[dict]:
    """Diagnostics of a text in the order of reading. A text that cannot be read gives one E1000; the strict mode then goes
    on statement by statement."""
    out: list[dict] = []
    off = directives(text)

    def add(stmt: int, phase: int, kind: str, code: str, message: str, span, help_: str | None, severity: str = "error") -> None:
        line = span.line if span is not None else 0
        if span is not None and ({"*", code} & off.get(line, set())):
            return
        out.append({"stmt_no": stmt, "seq": len(out) + 1, "phase": phase, "kind": kind, "code": code, "severity": severity, "message": message, "line": line, "column": span.column if span else 0, "length": span.length if span else 0, "offset": span.offset if span else 0, "help": help_})

    def unread(stmt: int, e: Exception, part: str) -> None:
        from querywright.sources.lexer import Span

        add(stmt, 0, "ParseError", "E1000", f"Parse error: {e}", Span(0, 0, min(len(part), 50)), None)

    try:
        statements = list(enumerate(parse(text, dialect), 1))
    except (SqlError, RecursionError) as e:
        unread(1, e, text)
        if mode != "strict":
            return out
        statements = []
        line = 0
        for i, (part, begin) in enumerate(_parts(text), 1):
            try:
                line = text.count("\n", 0, begin)
                statements += [(i, s) for s in parse("\n" * line + part, dialect)]
            except (SqlError, RecursionError):
                continue
    for i, s in statements:
        names = Names(catalog, mode)
        names.statement(s)
        n = len(names.found)
        Types(names).run()
        for k, (kind, code, message, span, help_) in enumerate(names.found):
            add(i, 1 if k < n else 2, kind, code, message, span, help_)
    return out


def _parts(text: str) -> Iterator[tuple[str, int]]:
    at = 0
    for part in split_statements(text):
        begin = text.index(part, at)
        at = begin + len(part)
        lead = len(part) - len(part.lstrip())
        yield part[lead:], begin + lead


def analyze(files: DataFrame, catalog: Catalog, dialect: str = "postgresql", mode: str = "strict", disable: Iterable[str] = ()) -> DataFrame:
    """Diagnostics of a DataFrame of files (file, text); null texts count as empty. One narrow map."""
    spark = files.sparkSession
    data = pickle.dumps(catalog)
    if len(data) > CATALOG_LIMIT:
        raise ValueError(f"the catalog takes {len(data)} bytes; broadcasts are limited to {CATALOG_LIMIT}")
    shared, off = spark.sparkContext.broadcast(data), set(disable)
    columns = StructType.fromDDL(DIAGNOSTICS).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = pickle.loads(shared.value)
        for batch in batches:
            rows = [{"file": f, **d} for f, t in zip(batch["file"], batch["text"], strict=True) for d in analyze_text(t or "", known, dialect, mode) if d["code"] not in off]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("file", "text").mapInPandas(run, DIAGNOSTICS)


def analyze_texts(spark: SparkSession, texts: dict[str, str], catalog: Catalog, **options) -> DataFrame:
    """Diagnostics of named texts."""
    return analyze(spark.createDataFrame(list(texts.items()), "file string, text string"), catalog, **options)
