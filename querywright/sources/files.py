"""Files of SQL text as DataFrames, and lists of files for the command line."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sql(spark: SparkSession, *paths: str, glob_filter: str = "*.sql", recursive: bool = True) -> DataFrame:
    """(file, text) of files, folders and patterns, one row for each file; any store that Spark reads will do."""
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", glob_filter).option("recursiveFileLookup", recursive)
    return reader.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_named(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, text) of local files, read by tasks; a file is named as in the list. Empty files may have no row."""
    uris = {f"file://{os.path.realpath(p)}": p for p in reversed(paths)}
    names = F.broadcast(spark.createDataFrame(list(uris.items()), "uri string, name string"))
    found = spark.read.option("wholetext", True).text(list(uris)).select(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path"), "value")
    return found.select(F.concat(F.lit("file:///"), F.regexp_replace("path", "^file:/+", "")).alias("uri"), F.col("value").alias("text")).join(names, "uri").select(F.col("name").alias("file"), "text")


def read_ordered(spark: SparkSession, paths: list[str]) -> list[str]:
    """Texts in the order of the list, as DDL needs. Schema files are few and small."""
    rows = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("file"), "value").collect()
    found = {os.path.basename(r["file"]): r["value"] for r in rows} if len({os.path.basename(p) for p in paths}) == len(paths) else None
    if found is not None:
        return [found[os.path.basename(p)] for p in paths]
    return [next(r["value"] for r in rows if r["file"].endswith(p.split("://")[-1].lstrip("."))) for p in paths]


def expand(patterns: list[str]) -> list[str]:
    """Literal names as they are, patterns sorted."""
    out = []
    for p in patterns:
        out += sorted(glob.glob(p, recursive=True)) if any(c in p for c in "*?[") else [p]
    return out


def schema_files(folder: str) -> list[str]:
    """All .sql files below a folder, sorted."""
    return sorted(glob.glob(os.path.join(folder, "**", "*.sql"), recursive=True))
