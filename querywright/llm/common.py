"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; read through Spark, so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session whose executors are
    threads of the driver (master local) gets a folder of its own; on a cluster that is an error, as no folder of one
    machine will do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


_MADE: list[str] = []


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared one; sweep() deletes it."""
    path = posixpath.join(shared_dir(spark), f"{kind}-{uuid.uuid4().hex}")
    _MADE.append(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Deletes the folders that this process has named since the last sweep, and returns how many there were. For when all
    results are written: DataFrames that read from them can no longer run. Checkpoints are Spark's own to clean, by
    spark.cleaner.referenceTracking.cleanCheckpoints."""
    conf, found = spark._jsc.hadoopConfiguration(), 0
    for path in _MADE:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        found += bool(at.getFileSystem(conf).delete(at, True))
    _MADE.clear()
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_narrow(df: DataFrame) -> DataFrame:
    """The same for rows of a few numbers that a shuffle has dealt out: partitions are put together, without a shuffle, to
    an eighth of their number or two for each core, so that loops do not fill the shared folder with tiny files."""
    spark = df.sparkSession
    return cut(df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)))


def stored(df: DataFrame, kind: str) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read again."""
    path = fresh_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 16 << 20


def sized(keys: DataFrame) -> DataFrame:
    """Keys (a stored table of a few short columns) for the side of a semi or anti join that need not be in order: counted and
    weighed (written out as text), and marked for broadcast if they are at most BROADCAST_ROWS and BROADCAST_BYTES; else as
    they are, so that both sides shuffle. The result is the same."""
    from pyspark.sql import functions as F

    rows, size = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*keys.columns)))), F.lit(0))).first()
    return F.broadcast(keys) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else keys


#: Rows of an Arrow batch between the JVM and Python: each task holds a few batches of whole texts on both sides.
BATCH_ROWS = 2000


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with batches of BATCH_ROWS rows at most."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def map_chunks(df: DataFrame, work: Callable, schema, limit: int = 4 << 20) -> DataFrame:
    """Narrow map over (id, text) rows. `work(ids, texts)` returns a dict of columns or None; it is called with
    whole rows that together hold about `limit` characters, so the memory of a task does not grow with the batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            for a, b in chunk_rows(col, limit):
                made = work(ids.slice(a, b - a).to_pylist(), col.slice(a, b - a).to_pylist())
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    return map_arrow(df, run, schema)


def with_columns(df: DataFrame, used: list[str], work: Callable, out: dict[str, str], limit: int = 2 << 20) -> DataFrame:
    """All rows and columns of `df`, with columns set (replaced or added) by `work`, which gets the values of the columns
    `used` (the first a text) of whole rows that together hold about `limit` bytes of it. A narrow map: other columns pass
    through as they are, and the work is done once however the columns are used later."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType

    made = StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in out.items()))
    fields = [made[f.name] if f.name in out else f for f in df.schema.fields]
    schema = StructType(fields + [StructField(k, made[k].dataType) for k in out if k not in df.columns])
    kinds, at, names = {k: to_arrow_type(made[k].dataType) for k in out}, [df.columns.index(u) for u in used], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunk_rows(batch.column(at[0]), limit):
                part = batch.slice(a, b - a)
                new = work(*(part.column(i).to_pylist() for i in at))
                columns = dict(zip(df_names, part.columns, strict=True)) | {k: pa.array(new[k], type=kinds[k]) for k in kinds}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    df_names = df.columns
    return map_arrow(df, run, schema)


def spare(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def chunk_rows(col: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Like chunks(), from the lengths alone."""
    import pyarrow.compute as pc

    begin = size = 0
    for i, n in enumerate(pc.binary_length(col).to_pylist()):
        size += n or 0
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(col):
        yield begin, len(col)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI in the shared folder; local paths, file:, hdfs:, s3:, gs:."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)
