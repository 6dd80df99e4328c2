"""Re-analysis of SQL files by Structured Streaming: each new or changed file of a folder is analysed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from querywright.operators.analyze import analyze
from querywright.operators.catalog import Catalog


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of the folder's .sql files, as they come."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql").load(folder)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def watch(spark: SparkSession, folder: str, catalog: Catalog, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, **options) -> StreamingQuery:
    """Starts a query that hands each batch of diagnostics to `sink(diagnostics, batch_id)`. A batch that is replayed after
    a failure has the same id, so an idempotent sink sees each file once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(analyze(batch, catalog, **options), batch_id)

    writer = stream_files(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
