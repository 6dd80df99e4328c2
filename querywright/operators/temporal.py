"""Joins by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], strict: bool = False, suffix: str = "_right") -> DataFrame:
    """All rows of `left`; `values` of the last row of `right` with the same `by` whose `on` is not later (strict: earlier).
    Both sides are put under each other and read once in order, so the cost is one shuffle and one sort on (by, on): no
    row meets all earlier ones, as in an inequality join. Of right rows with one time, the largest values count."""
    kind = F.lit(1 if not strict else 0)
    fields = [f.name for f in left.schema.fields if f.name not in (*by, on)]
    row = F.struct(*[F.col(v) for v in values])
    a = left.select(*by, on, F.struct(*fields).alias("_row"), F.lit(None).cast(right.select(row.alias("x")).schema["x"].dataType).alias("_hit"), kind.alias("_late"))
    b = right.select(*by, on, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), row.alias("_hit"), F.lit(0 if not strict else 1).alias("_late"))
    order = Window.partitionBy(*by).orderBy(on, "_late", "_hit").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_last", F.last("_hit", ignorenulls=True).over(order)).filter(F.col("_row").isNotNull())
    return found.select(*by, on, "_row.*", *[F.col(f"_last.{v}").alias(v if v not in left.columns else v + suffix) for v in values])
