"""Best-two-fit packing of token sequences.

Only lengths matter to a packing, so the plan is made from their histogram, of `cap` numbers however large the corpus is.
A bin is filled greedily, longest piece first; then its smallest document goes back if two unpacked ones fit the gap that
it leaves more tightly. A bin's contents are repeated as often as the histogram allows, so the plan is a list of patterns
with multiplicities. A length's pieces are numbered (range-sorted, so that a length that a third of all pieces share is
spread over tasks), and number n of a length finds its sequence and offset in the plan. The numbers are checkpointed with
the pieces, so places do not depend on how a later plan deals the rows out.

Ties: of equal pairs of documents that may replace a bin's smallest one, the pair with the smallest first length is taken;
pieces of one length are numbered by id and piece, and those that agree in both (repeated rows) in any order.

Defined results: a null text counts as empty and has one piece, the closing token. A document longer than the cap is cut
into pieces of the cap, the first of which may be shorter. Repeated rows and rows with a null id are separate documents. An
empty table gives an empty result. Columns sequence_id and offset of a table given to pack() are replaced; its other columns
stay. best_two_fit() reads the id and the text alone, whatever the other columns are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querywright.llm.bpe import encoder
from querywright.llm.common import cut, map_arrow, map_chunks, spare, stored

CAP = 2048


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns (lengths in the order of their places) and how often each is used. counts[n]: pieces of length n; the cap
    is the last index."""
    cap = len(counts) - 1
    left = counts.astype(np.int64).copy()
    out = []
    while True:
        full = np.flatnonzero(left)
        if not len(full):
            return out
        seed = int(full[-1])
        found, gap = [seed], cap - seed
        left[seed] -= 1
        while gap:
            fit = np.flatnonzero(left[: gap + 1])
            if not len(fit):
                break
            n = int(fit[-1])
            times = min(gap // n, int(left[n]))
            found += [n] * times
            left[n] -= times
            gap -= n * times
        if gap and len(found) > 1:
            least = found[-1]
            room = gap + least
            left[least] += 1
            small = np.flatnonzero(left[: room + 1])
            # For each x the largest y <= x that fits beside it.
            at = np.searchsorted(small, np.minimum(room - small, small), side="right") - 1
            y = np.where(at >= 0, small[np.maximum(at, 0)], 0)
            lone = (y == small) & (left[small] < 2)
            y = np.where(lone, np.where(at > 0, small[np.maximum(at - 1, 0)], 0), y)
            both = np.where(y > 0, small + y, 0)
            best = int(both.argmax()) if len(both) else 0
            if len(both) and both[best] > least:
                found[-1:] = [int(small[best]), int(y[best])]
                left[small[best]] -= 1
                left[y[best]] -= 1
            else:
                left[least] -= 1
        lengths, uses = np.unique(found, return_counts=True)
        more = int((left[lengths] // uses).min())
        left[lengths] -= uses * more
        out.append((found, more + 1))


def places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the numbers at which a run of places begins, and the first sequence and the offset of each run."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP, close: int = 0) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32."""

    def work(ids: list, texts: list) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        end = np.array([close], dtype="<u4")
        for i, got in zip(ids, encoder(path).encode(texts), strict=True):
            got = np.concatenate([got, end])
            first = len(got) % cap or cap
            at = [0, *range(first, len(got) + 1, cap)]
            for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                for name, v in zip(out, (i, k, a, b - a, zlib.crc32(got[a:b].tobytes())), strict=True):
                    out[name].append(v)
        return out

    kind = dict(df.dtypes)[id_col]
    return map_chunks(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work, StructType.fromDDL(f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"), limit=1 << 20)


def pack(df: DataFrame, cap: int = CAP) -> DataFrame:
    """The rows of `df` (with a column length, 1 to cap) with sequence_id and offset. Sorted by doc_id and piece where it has them."""
    row = spare(df, "_row")
    rows = stored(df.drop("sequence_id", "offset"), "pieces")
    order = ["length", *[c for c in ("doc_id", "piece") if c in rows.columns]]
    # A piece of the cap's length is a sequence of its own, numbered below zero.
    whole = rows.filter(F.col("length") >= cap).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    numbered = rows.filter(F.col("length") < cap).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id())
    ordered = cut(numbered)
    # Range-sorted by length: at most one run of row numbers for each length and one for each partition.
    part = F.shiftright(row, 33).alias("p")
    runs = sorted((r["length"], r["first"], r["n"]) for r in ordered.groupBy("length", part).agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n")).collect())
    counts = np.zeros(cap + 1, dtype=np.int64)
    first: dict[int, list[tuple[int, int]]] = {}  # for each length, where its runs of row numbers begin, and the pieces before
    for n, begin, k in runs:
        first.setdefault(n, []).append((begin, int(counts[n])))
        counts[n] += k
    begins = {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for n, r in first.items()}
    plans = df.sparkSession.sparkContext.broadcast((begins, places(plan(counts))))
    schema = StructType([f for f in ordered.schema.fields if f.name != row] + StructType.fromDDL("sequence_id long, offset long").fields)
    at, number_at = ordered.columns.index("length"), ordered.columns.index(row)
    keep = [i for i in range(len(ordered.columns)) if i != number_at]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, where = plans.value
        for batch in batches:
            lengths, rows = batch.column(at).to_numpy(), batch.column(number_at).to_numpy()
            sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
            edge = np.flatnonzero(np.concatenate([[True], lengths[1:] != lengths[:-1], [True]])) if len(lengths) else [0]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                n = int(lengths[a])
                begin, before = begins[n]
                run = np.searchsorted(begin, rows[a:b], side="right") - 1
                number = before[run] + rows[a:b] - begin[run]
                begin, seq, off = where[n]
                run = np.searchsorted(begin, number, side="right") - 1
                sequence[a:b], offset[a:b] = seq[run] + number - begin[run], off[run]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(sequence), pa.array(offset)], names=[f.name for f in schema])

    return map_arrow(ordered, place, schema).unionByName(whole)


def best_two_fit(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP) -> DataFrame:
    """Packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(df, path, id_col, text_col, cap), cap)
