"""Sessions and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(name: str = "querywright", **conf: str) -> SparkSession:
    """A session with UTC, ANSI semantics and adaptive execution."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def load_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Parquet tables of a folder, also as temporary views; nothing is read before a query needs it."""
    out = {}
    for name in TABLES if names is None else names:
        out[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        out[name].createOrReplaceTempView(name)
    return out
