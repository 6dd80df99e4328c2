"""Rows held against what the catalog declares: NOT NULL, keys, references, CHECKs and enums. An extension: the catalog keeps
these facts, and this is what they are good for on Spark.

Each check is one aggregate or one join, planned by Catalyst: nothing is collected, and keys are compared by hash joins or
sorts on the key's columns only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywright.operators.catalog import Catalog, Table
from querywright.plans.parser import parse
from querywright.plans.spark_sql import Printer

COLUMNS = ["relation", "constraint", "columns", "violations"]


def _row(df: DataFrame, t: Table, kind: str, columns: list[str]) -> DataFrame:
    return df.select(F.lit(t.name).alias("relation"), F.lit(kind).alias("constraint"), F.lit(",".join(columns)).alias("columns"), F.col("n").cast("long").alias("violations"))


def violations(tables: dict[str, DataFrame], catalog: Catalog, dialect: str = "postgresql") -> DataFrame:
    """(relation, constraint, columns, violations) of each constraint of the given tables; 0 where it holds."""
    parts: list[DataFrame] = []
    low = {k.lower(): v for k, v in tables.items()}
    for _, t in catalog.tables():
        df = low.get(t.name.lower())
        if df is None:
            continue
        # All row-wise checks of a table in one pass.
        tests = [("not_null", [c.name], F.col(c.name).isNull()) for c in t.columns if not c.nullable]
        for c in t.columns:
            labels = next((v for k, v in catalog.enums.items() if c.type.family == "custom" and k.lower() == c.type.name.lower()), None)
            if labels is not None:
                tests.append(("enum", [c.name], ~F.col(c.name).isin(labels)))
        for x in t.constraints:
            if x.type == "check":
                e = parse(f"SELECT {x.text}", dialect)[0].body.items[0].kids[0]
                tests.append(("check", x.columns or [x.name], ~F.expr(Printer(dialect).expr(e))))
        if tests:
            counts = df.agg(*[F.count_if(F.coalesce(test, F.lit(False))).alias(f"v{i}") for i, (_, _, test) in enumerate(tests)])
            rows = F.array(*[F.struct(F.lit(kind).alias("k"), F.lit(",".join(c)).alias("c"), F.col(f"v{i}").alias("n")) for i, (kind, c, _) in enumerate(tests)])
            parts.append(counts.select(F.explode(rows).alias("r")).select(F.lit(t.name).alias("relation"), F.col("r.k").alias("constraint"), F.col("r.c").alias("columns"), F.col("r.n").alias("violations")))
        for x in t.constraints:
            if x.type in ("primary_key", "unique"):
                some = reduce(or_, [F.col(c).isNull() for c in x.columns])
                again = df.filter(~some).groupBy(*x.columns).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))
                parts.append(_row(again, t, x.type, x.columns))
            elif x.type == "foreign_key" and (other := low.get(x.ref_table.split(".")[-1].lower())) is not None:
                theirs = x.ref_columns or next((y.columns for _, o in catalog.tables() if o.name.lower() == x.ref_table.split(".")[-1].lower() for y in o.constraints if y.type == "primary_key"), [])
                keys = other.select(*[F.col(c).alias(f"r{i}") for i, c in enumerate(theirs)]).distinct()
                mine = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(x.columns)]).na.drop()
                lost = mine.join(keys, [mine[f"k{i}"] == keys[f"r{i}"] for i in range(len(theirs))], "left_anti").agg(F.count(F.lit(1)).alias("n"))
                parts.append(_row(lost, t, "foreign_key", x.columns))
    if not parts:
        raise ValueError("no table has a constraint")
    return reduce(DataFrame.unionByName, parts)
