"""Token count rollups that batches of signed changes maintain.

A change is one row: an insert adds a document and its tokens, a delete takes them away again, a revision replaces a count
by another. A batch is reduced to one signed row for each (source, lang, tokenizer), by partial aggregates, so a source
that holds a third of all rows sends a few rows a task. Totals are sums over the committed batches: additive, so their
order does not matter and late batches need no recomputation.

An id names a batch's changes. Each attempt at a batch writes a folder of its own below the id's and then a marker, which
commits it; readers read one marked attempt of each id. So a batch counts once however often it is replayed and however
many writers race for it, in any store: no rename or exclusive create is needed. A batch with a marked attempt is skipped.

Defined results: null sources, languages and versions are groups of their own; null counts count as 0; groups whose totals
are all zero are left out; an empty batch is committed too and changes nothing; repeated rows are changes of their own.
corpus_rollup() reads doc_id, source, lang and the text alone, whatever other columns are called; null texts count as empty.
Of documents with equal text that with the smallest id stays, with all rows of that id; rows with a null id stay too, as no
order tells which of them is a copy; an empty table gives no groups.
"""

from __future__ import annotations

import posixpath
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querywright.llm.bpe import encoder
from querywright.llm.common import map_chunks

MARKER = "_committed"
KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class Rollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(self.path, *parts))

    def _folder(self, batch_id: str) -> str:
        return posixpath.join("batches", f"id={quote(batch_id, safe='')}")

    def _attempts(self, folder: str) -> list[str]:
        """The marked attempts below a folder, in order."""
        found = self._fs.globStatus(self._path(folder, "attempt=*", MARKER)) or []
        return sorted(x.getPath().getParent().toString() for x in found)

    def committed(self, batch_id: str) -> bool:
        return bool(self._attempts(self._folder(batch_id)))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch; false if it was committed before. changes: op (insert, delete, revise), source, lang, tokenizer,
        n_tokens, and for revisions old_tokens."""
        if self.committed(batch_id):
            return False
        new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
        tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).otherwise(new - old)
        delta = changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))
        folder, attempt = self._folder(batch_id), f"attempt={uuid.uuid4().hex}"
        delta.write.parquet(posixpath.join(self.path, folder, attempt))
        self._fs.create(self._path(folder, attempt, MARKER), True).close()
        if posixpath.basename(self._attempts(folder)[0]) == attempt:
            return True
        self._fs.delete(self._path(folder, attempt), True)  # another writer's attempt counts
        return False

    def totals(self) -> DataFrame:
        one = {posixpath.dirname(x): x for x in reversed(self._attempts("batches/id=*"))}
        kind = StructType.fromDDL(DELTA)
        rows = self.spark.read.schema(kind).parquet(*one.values()) if one else self.spark.createDataFrame([], kind)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")


def token_counts(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id", "source", "lang"), text_col: str = "text") -> DataFrame:
    """The kept columns, th (a 256-bit hash of the text), n_words (runs of non-blanks) and n_bpe (ids of the vocabulary)."""
    fields = F.struct(*keep, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("th"))
    kind = df.select(fields.alias("k")).dtypes[0][1]

    def work(keys: list, texts: list) -> dict:
        return {"k": keys, "n_words": [len((t or "").encode("utf-8", "surrogatepass").split()) for t in texts], "n_bpe": [len(x) for x in encoder(path).encode(texts)]}

    rows = map_chunks(df.select(fields.alias("k"), F.col(text_col).alias("text")), work, StructType.fromDDL(f"k {kind}, n_words long, n_bpe long"), limit=1 << 20)
    return rows.select("k.*", "n_words", "n_bpe")


def corpus_rollup(df: DataFrame, vocabulary: str, path: str) -> DataFrame:
    """The life of a corpus as batches: every document is inserted under two tokenizers; documents that repeat the text
    of one with a smaller id are deleted from both; the second tokenizer's counts of the rest are revised by a closing token; the first
    batches come again and change nothing."""
    from querywright.llm.common import stored

    spark = df.sparkSession
    counts = stored(token_counts(df, vocabulary), "token-counts")
    # Stored before it is joined, so that Spark can split the partition of a text that very many documents share.
    first = stored(counts.groupBy("th").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "first-copies")
    copies = counts.join(first, "th", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    none = F.lit(None).cast("long")

    def changes(rows: DataFrame, op: str, tokenizer: str, n, old=none) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), n.alias("n_tokens"), old.alias("old_tokens"))

    words, bpe = F.col("n_words"), F.col("n_bpe")
    inserts = [("1-words", changes(counts, "insert", "words-1", words)), ("2-bpe", changes(counts, "insert", "bpe50k-1", bpe))]
    gone, rest = copies.filter("copy"), copies.filter("not copy")
    deletes = ("3-copies", changes(gone, "delete", "words-1", words).unionAll(changes(gone, "delete", "bpe50k-1", bpe)))
    revised = ("4-closing", changes(rest, "revise", "bpe50k-1", bpe + 1, bpe))
    store = Rollup(spark, path)
    for batch in (*inserts, deletes, revised, *inserts):
        store.commit(*batch)
    return store.totals()
