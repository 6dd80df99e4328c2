"""Diagnostics for people and tools: text, JSON, SARIF, summaries, and the cap on errors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywright.operators.analyze import RULES

ORDER = ["file", "stmt_no", "seq"]


def disabled(diagnostics: DataFrame, codes: Iterable[str]) -> DataFrame:
    """Without these codes (exact case)."""
    return diagnostics.filter(~F.col("code").isin(list(codes)))


def capped(diagnostics: DataFrame, max_errors: int = 100) -> DataFrame:
    """Up to the max_errors-th error in order of file and place; 0 is no cap. The place is found by a top-k of that size, so
    the rows are not sorted as a whole nor sent to one task."""
    if max_errors <= 0:
        return diagnostics
    first = diagnostics.filter("severity = 'error'").select(*ORDER).orderBy(*ORDER).limit(max_errors + 1).collect()
    if len(first) <= max_errors:
        return diagnostics
    return diagnostics.filter(F.struct(*ORDER) < F.struct(*map(F.lit, first[-1])))


def summary(diagnostics: DataFrame) -> DataFrame:
    """errors, warnings and files with errors: one row."""
    error = F.col("severity") == "error"
    return diagnostics.agg(F.count_if(error).alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.countDistinct(F.when(error, F.col("file"))).alias("files_with_errors"))


def by_rule(diagnostics: DataFrame) -> DataFrame:
    """How often each rule was broken."""
    return diagnostics.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


def to_json(diagnostics: DataFrame) -> DataFrame:
    """(file, json): one document for each file with diagnostics. A file's diagnostics are gathered, not the corpus's."""
    has_span = (F.col("line") > 0) | (F.col("length") > 0)
    span = F.when(has_span, F.struct("offset", "length", "line", "column"))
    row = F.struct("stmt_no", "seq", F.struct("kind", "severity", "message", span.alias("span"), "help", F.array().cast("array<string>").alias("labels")).alias("d"))
    grouped = diagnostics.groupBy("file").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    found = F.transform("rows", lambda r: r["d"])
    return grouped.select("file", F.to_json(F.struct("file", found.alias("diagnostics")), {"ignoreNullFields": "false"}).alias("json"))


def to_sarif(diagnostics: DataFrame, tool: str = "querywright") -> DataFrame:
    """(file, sarif): one SARIF 2.1.0 document for each file with diagnostics."""
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"), (F.col("column") + F.col("length")).alias("endColumn")))
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("code").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    grouped = diagnostics.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("stmt_no", "seq", result.alias("r")))).alias("rows"))
    rules = F.array(*[F.struct(F.lit(c).alias("id"), F.lit(n).alias("name")) for c, n in RULES.items()])
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), F.transform("rows", lambda r: r["r"]).alias("results"))
    schema = "https://json.schemastore.org/sarif-2.1.0.json"
    return grouped.select("file", F.to_json(F.struct(F.lit(schema).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def clean_sarif(tool: str = "querywright") -> str:
    """The document of a file without diagnostics."""
    rules = [{"id": c, "name": n} for c, n in RULES.items()]
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": []}]}, separators=(",", ":"))


def to_text(diagnostics: DataFrame, sources: dict[str, str] | Callable[[str], str] | None = None, colour: bool = False) -> Iterator[str]:
    """One text for each diagnostic, in order, with its line of source where that is given: by file, or by a function of it
    that is asked once for each file that has diagnostics. Rows stream to the driver."""
    text_of = sources if callable(sources) else lambda f: (sources or {}).get(f, "")
    at, text = None, [""]
    paint = (lambda c, s: f"\x1b[{c}m{s}\x1b[0m") if colour else (lambda c, s: s)
    for r in diagnostics.orderBy(*ORDER).toLocalIterator():
        shade = {"error": "1;31", "warning": "1;33"}.get(r["severity"], "1;34")
        lines = [f"{paint(shade, r['severity'] + '[' + r['code'] + ']')}: {r['message']}", f"  --> {r['file']}" + (f":{r['line']}:{r['column']}" if r["line"] else "")]
        if r["file"] != at:
            at, text = r["file"], text_of(r["file"]).split("\n")
        if 0 < r["line"] <= len(text):
            number = str(r["line"])
            pad = " " * len(number)
            lines += [f"{pad} |", f"{number} | {text[r['line'] - 1]}", f"{pad} | {' ' * (r['column'] - 1)}{paint(shade, '^' * max(1, r['length']))}"]
        if r["help"]:
            lines.append(f"   = help: {r['help']}")
        yield "\n".join(lines) + "\n"
