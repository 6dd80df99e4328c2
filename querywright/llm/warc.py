"""A deterministic sharded WARC writer and its reader.

Writing: each payload's SHA-1 and length are taken first; of records with equal payloads that with the smallest id is the
response and the others revisit it. Records are range-sorted by id into shards. The shards' limits are ids drawn by a hash
of the id alone, so neither the cluster nor the partitioning changes them. A task writes a shard's records in order, each
as one gzip member with regenerated headers, and rolls to the next file when `file_bytes` compressed bytes are reached.
A file is written under a temporary name of the task's attempt and renamed when it is whole; a second attempt finds a file
of that name, makes sure that it holds the bytes of its own, and drops the latter. The manifest (a Parquet table of files
with sizes and digests) is the commit: it is written to a temporary folder and renamed last, and readers read only what it
lists. A folder that has a manifest is not written to again, that is an error, and so are files of other records.

The html crosses the network once: revisit notes are unioned as small rows and meet their record by the sort. An id (or
null) with more records than a shard should have is dealt over several parts of its shard by payload.

Defined results: a null payload counts as empty and is a record too. Rows that repeat an id are separate records; among
equal payloads those with the smallest id are responses. A null id sorts first, is written without a number and can only
be a revisit where another record has the payload. An empty table gives a manifest without files. Other columns than the
three named ones are not read, whatever they are called. Ids are integers; another type that casts to long is cast, and one
that does not is Spark's error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querywright.llm.common import cut, filesystem, fresh_dir, map_arrow, stored

DATE = "2000-01-01T00:00:00Z"
FILE_BYTES = 64 << 20
SHARD_ROWS, MAX_SHARDS = 8192, 1 << 14


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP head, so the payload's length stays known."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = "" if page_id is None else str(page_id)
    uri = "".join(c if 32 < ord(c) < 127 else "%%%02X" % b for c in (url or "") for b in (c.encode("utf-8", "surrogatepass") if not 32 < ord(c) < 127 else b"\0"))
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _limits(ids: DataFrame, rows: int, shard_rows: int) -> list[int]:
    """Ids at which shards begin: about every shard_rows-th, drawn by a hash of the id, so they depend on the ids alone.
    There are MAX_SHARDS shards at most (larger ones roll to more files), so some 260,000 ids reach the driver at most."""
    shards = min(MAX_SHARDS, -(-rows // shard_rows))
    if shards < 2:
        return []
    every = max(1, rows // (shards * 16))
    drawn = sorted(r[0] for r in ids.filter(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).select("page_id").na.drop().distinct().collect())
    return [drawn[len(drawn) * i // shards] for i in range(1, shards)] if len(drawn) >= shards else drawn


def _parts(keys: DataFrame, rows: int, shard_rows: int) -> Column:
    """The part of its shard that a record goes to: by payload where its id has more records than a shard, else
    0. Such ids are fewer than shards, MAX_SHARDS at most, so the driver may hold them."""
    most = max(shard_rows, rows // MAX_SHARDS)
    large = {r["page_id"]: -(-r["n"] // most) for r in keys.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).collect()}
    if not large:
        return F.lit(0)
    ids = [x for x in large if x is not None]
    many = F.element_at(F.map_from_arrays(F.array(*map(F.lit, ids)).cast("array<bigint>"), F.array(*[F.lit(large[x]) for x in ids]).cast("array<int>")), F.col("page_id")) if ids else F.lit(None).cast("int")
    many = F.when(F.col("page_id").isNull(), F.lit(large.get(None, 1))).otherwise(F.coalesce(many, F.lit(1)))
    return F.pmod(F.xxhash64("sha"), many).cast("int")


def _shard(page: Column, limits: list[int]) -> Column:
    """Number of limits that are not above the id, by binary search; 0 for null."""
    if not limits:
        return F.lit(0)
    table, n = F.array(*map(F.lit, limits)).cast("array<bigint>"), len(limits)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(table, at + s - 1) <= page), at + s).otherwise(at))


class _ShardWriter:
    """Writes a task's records, shard by shard, to files that roll at `file_bytes`. A file gets its name when it is whole."""

    def __init__(self, path: str, file_bytes: int):
        self.fs, self.base = filesystem(path)
        self.fs.create_dir(self.base, recursive=True)
        self.tag = f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        self.file_bytes = file_bytes
        self.made: list[tuple] = []  # rows of the manifest
        self.place: tuple[int, int] | None = None
        self.roll, self.out = 0, None

    def add(self, place: tuple[int, int], member: bytes) -> None:
        if self.out is not None and (place != self.place or self.bytes >= self.file_bytes):
            self.close()
        if self.out is None:
            self._open(place)
        self.out.write(member)
        self.records += 1
        self.bytes += len(member)
        self.sha.update(member)

    def _open(self, place: tuple[int, int]) -> None:
        self.roll = self.roll + 1 if place == self.place else 0
        self.place, self.records, self.bytes, self.sha = place, 0, 0, hashlib.sha256()
        self.file = f"records-{place[0]:06d}-{place[1]:05d}-{self.roll:05d}.warc.gz"
        self.temp = posixpath.join(self.base, f".{self.file}.{self.tag}")
        self.out = self.fs.open_output_stream(self.temp, compression=None)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        name, sha = posixpath.join(self.base, self.file), self.sha.hexdigest()
        if self.fs.get_file_info(name).type.name == "File":  # of another attempt, whose bytes are the same
            if _sha256(self.fs, name) != sha:
                raise FileExistsError(f"{name} holds other records")
            self.fs.delete_file(self.temp)
        else:
            self.fs.move(self.temp, name)
        self.made.append((self.file, self.place[0], self.records, self.bytes, sha))


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", shard_rows: int = SHARD_ROWS, file_bytes: int = FILE_BYTES, level: int = 6) -> DataFrame:
    """Writes the records below `path` (in the shared folder) and returns the committed manifest."""
    spark = df.sparkSession
    if _exists(spark, posixpath.join(path, "manifest")):
        raise FileExistsError(f"{path} holds an archive already")
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    # 256 bits decide which payloads are equal; the record's own digest is SHA-1, as usual.
    keys = cut(rows.select("page_id", F.sha2("html", 256).alias("sha")))
    # Stored before it is joined, so that Spark can split the partition of a payload that very many pages share.
    first = stored(keys.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "first-pages")
    notes = keys.join(first, "sha").filter("page_id is null or page_id > first").select("page_id", "first", "sha").distinct()
    n_rows = keys.count()
    limits = _limits(keys, n_rows, shard_rows)
    shard = _shard(F.col("page_id"), limits)
    parts = _parts(keys, n_rows, shard_rows)
    null = lambda kind: F.lit(None).cast(kind)
    all_rows = rows.select("page_id", F.sha2("html", 256).alias("sha"), F.lit(1).alias("kind"), "url", "html", null("long").alias("first")).unionAll(notes.select("page_id", "sha", F.lit(0), null("string"), null("string"), "first"))
    placed = all_rows.withColumns({"shard": shard, "part": parts})
    ordered = placed.repartition(3 * len(limits) + 1, "shard", "part").sortWithinPartitions("shard", "part", "page_id", "sha", "kind").select("shard", "part", "page_id", "kind", "url", "html", "first", "sha")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _ShardWriter(path, file_bytes)
        note = None
        for batch in batches:
            for cols in _slices(batch):
                for shard, part, page, kind, url, html, refers, sha in zip(*cols, strict=True):
                    if kind == 0:  # the note of the records that follow
                        note = (page, sha, refers)
                        continue
                    payload = html.encode("utf-8", "surrogatepass")
                    refers_to = note[2] if note is not None and note[:2] == (page, sha) else None
                    writer.add((shard, part), gzip.compress(record(page, url, payload, digest(payload), refers_to), level, mtime=0))
        writer.close()
        columns = list(zip(*writer.made, strict=True)) or [[]] * len(_FILES)
        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, _FILES, strict=True)], schema=_FILES)

    found = map_arrow(ordered, save, "file string, shard int, records long, bytes long, sha256 string")
    temp = posixpath.join(path, "_manifest-temporary")
    found.write.mode("overwrite").parquet(temp)
    old, new = _hadoop_path(spark, temp), _hadoop_path(spark, posixpath.join(path, "manifest"))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(new) or not fs.rename(old, new):
        raise FileExistsError(f"the manifest of {path} could not be committed")
    return read_manifest(spark, path)


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _exists(spark: SparkSession, path: str) -> bool:
    found = _hadoop_path(spark, path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def _sha256(fs, name: str) -> str:
    made = hashlib.sha256()
    with fs.open_input_stream(name, compression=None) as f:
        while part := f.read(1 << 20):
            made.update(part)
    return made.hexdigest()


_FILES = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[list[list]]:
    for a in range(0, batch.num_rows, rows):
        yield [c.slice(a, rows).to_pylist() for c in batch.columns]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, shard int, records long, bytes long, sha256 string").parquet(posixpath.join(path, "manifest"))


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one record each; memory holds one record."""
    data = b""
    while data or (data := stream.read(1 << 20)):
        d = zlib.decompressobj(31)
        parts = []
        while True:
            parts.append(d.decompress(data))
            if d.eof:
                break
            data = stream.read(1 << 20)
            if not data:
                raise EOFError("a record is cut off")
        data = d.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """Headers, HTTP head and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"fields": fields, "payload": payload, "length": length, "block": block}


def _page(uri: str) -> int | None:
    name = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files that the manifest lists: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url, html (null for revisits). Digests of stored payloads and blocks are checked."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(path)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(posixpath.join(base, file), compression=None) as f:
                    for raw in members(f):
                        r = parse(raw)
                        h = r["fields"]
                        sha = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = h["WARC-Type"] == "revisit"
                        if digest(r["block"]) != h["WARC-Block-Digest"].removeprefix("sha1:") or not revisit and (digest(r["payload"]) != sha or len(r["payload"]) != r["length"]):
                            raise ValueError(f"a digest in {file} does not hold")
                        rows.append((_page(h["WARC-Record-ID"]), r["length"], sha, h["WARC-Type"], _page(h["WARC-Refers-To"]) if revisit else None, h["WARC-Target-URI"], None if revisit else r["payload"].decode("utf-8", "surrogatepass")))
                        size += len(raw)
                        if size > 4 << 20:
                            yield _batch(rows, names)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    files = read_manifest(spark, path).select("file", "bytes")
    # One file a task, dealt round.
    return map_arrow(files.select("file").repartition(max(1, files.count())), load, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def archive(df: DataFrame, **options) -> DataFrame:
    """Writes the pages to a fresh folder of the shared one and reads them back."""
    path = fresh_dir(df.sparkSession, "warc")
    write(df, path, **options)
    return read(df.sparkSession, path)
