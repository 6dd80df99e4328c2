"""Removal of repeated passages through difference-cover suffix sorting.

A byte is removed if a string of `length` bytes (a window) covers it that also starts anywhere else.

1. Dealing out. Each window's smallest hash of `gram` bytes (leftmost of equals) is its mark; equal windows have equal
   marks at equal offsets, so only windows under one mark need comparing. Windows of a text that follow each other under
   one mark are a run, and the bytes they cover its context: about one run for 80 bytes. A mark that occurs once cannot
   repeat. Runs with equal contexts repeat as a whole and need no more work, however many they are.
2. Suffix sorting. What remains, different contexts under one mark, is dealt to tasks by mark, and by salt where a mark has
   more than `bucket` contexts. A task sorts all suffixes of its contexts with the difference cover {1, 2} mod 3: it sorts
   the sampled triples and names them, recurses on the names while they are not unique, sorts the remaining suffixes by
   their first symbol and the rank behind it, and merges. Neighbours in the order whose first `length` bytes agree repeat.
3. Merging across salts. Windows of a salted mark that do not repeat in their salt send a 128-bit name of their prefix, and
   each salt sends the names that do repeat in it, once; names that come twice repeat.
4. The removed ranges meet their document by its id and a hash of its text, and the remaining bytes are digested.

No task holds more than a bucket or a document, equal contexts are counted by partial aggregates, and rows are 5 numbers.
Defined results: a null text counts as empty. Texts shorter than `length` lose nothing. Windows never cross documents; a
row that repeats another is a document of its own, so both lose their windows; so are rows with a null id. An empty table
gives an empty result. Only the id and the text are read, whatever the other columns are called; they stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querywright.llm.common import chunk_rows, map_arrow, spare, stored, with_columns

LENGTH, GRAM, BUCKET = 200, 40, 2048
SEGMENT = 1 << 19
WIN_BITS = 12
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Marks:
    """Hashes of all grams of a buffer and the runs of windows under one mark."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        self._power = self._back = np.zeros(0, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._power) < n:
            for name, x in (("_power", _BASE), ("_back", _INVERSE)):
                p = np.full(n, x, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def hashes(self, raw: np.ndarray) -> np.ndarray:
        """A mixed polynomial hash, mod 2^64, of the gram at each place; the last gram - 1 places have none."""
        n, k = len(raw), self.gram
        self._powers(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self._power[:n], out=total[1:])
        h = (total[k:] - total[:-k]) * self._back[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h

    def runs(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For consecutive texts of a buffer: text number, first window (place in the buffer), windows and mark of each run."""
        none = np.zeros(0, dtype=np.int64)
        if len(raw) < self.length:
            return none, none, none, none.astype(np.uint64)
        h = self.hashes(raw)
        w = self.width
        # Hash above place: the smallest of a window is its leftmost smallest hash.
        key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        full = -(-len(key) // w) * w
        table = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
        table[: len(key)] = key
        table = table.reshape(-1, w)
        before = np.minimum.accumulate(table, axis=1).ravel()
        after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(raw) - self.length + 1
        place = np.minimum(after[:n], before[w - 1 : w - 1 + n]) & np.uint64((1 << 24) - 1)
        text = np.repeat(np.arange(len(sizes)), sizes)
        inside = text[:n] == text[self.length - 1 :]
        at = np.flatnonzero(inside)
        if not len(at):
            return none, none, none, none.astype(np.uint64)
        place, text = place[at].astype(np.int64), text[at]
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
        return text[new], at[new], np.diff(np.append(new, len(at))), h[place[new]]


def _runs_task(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(length, gram)
        digest = xxhash.xxh3_64_intdigest

        def out(held: list[tuple]) -> pa.RecordBatch | None:
            data = b"".join(x[3] for x in held)
            text, first, n, mark = marks.runs(np.frombuffer(data, dtype=np.uint8), np.array([len(x[3]) for x in held]))
            if not len(text):
                return None
            start = np.cumsum([0] + [len(x[3]) for x in held])[:-1]
            c = np.array([digest(data[a : a + k + length - 1]) for a, k in zip(first.tolist(), n.tolist(), strict=True)], dtype=np.uint64)
            pos = first - start[text] + np.array([x[2] for x in held])[text]
            ids, ths = [x[0] for x in held], np.array([x[1] for x in held], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), pa.array(c.view(np.int64)), pa.array([ids[i] for i in text.tolist()], type=kind), pa.array(ths[text]), pa.array(pos << WIN_BITS | n)], names=["m", "c", "doc_id", "th", "pos"])

        for batch in batches:
            kind = batch.schema.field(0).type
            held: list[tuple] = []
            size = 0
            for a, b in chunk_rows(batch.column(2), SEGMENT):
                for i, th, t in zip(*(batch.column(j).slice(a, b - a).to_pylist() for j in range(3)), strict=True):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    if len(raw) < length:
                        continue
                    # A long text goes on in segments that share length - 1 bytes; each window is in one of them.
                    for p in range(0, len(raw) - length + 1, SEGMENT):
                        held.append((i, th, p, raw[p : p + SEGMENT + length - 1]))
                        size += len(held[-1][3])
                        if size >= SEGMENT:
                            if (made := out(held)) is not None:
                                yield made
                            held, size = [], 0
            if held and (made := out(held)) is not None:
                yield made

    return run


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of an integer string (symbols from 1), by the difference cover {1, 2} mod 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    s = np.concatenate([s, np.zeros(3, dtype=np.int64)])
    shift = int(s.max()).bit_length()
    if 3 * shift > 63:  # rename, so that a triple fits a long
        values, s = np.unique(s, return_inverse=True)
        shift = int(len(values)).bit_length()
    ones = np.arange(1, n + (n % 3 == 1), 3)  # a place past the end keeps the halves of the recursion apart
    cover = np.concatenate([ones, np.arange(2, n, 3)])
    triple = s[cover] << 2 * shift | s[cover + 1] << shift | s[cover + 2]
    order = np.argsort(triple, kind="stable")
    ordered = triple[order]
    name = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
    names = np.empty(len(cover), dtype=np.int64)
    names[order] = name
    if name[-1] < len(cover):
        order = suffix_array(names)
        names[order] = np.arange(1, len(cover) + 1)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[cover] = names
    sampled = cover[order]
    sampled = sampled[sampled < n]
    width = int(len(cover) + 1).bit_length()
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(s[rest] << width | rank[rest + 1], kind="stable")]
    # The remaining suffixes' places among the sampled ones: both lists are sorted by the pairs, or triples, compared.
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    pair = lambda i: s[i] << width | rank[i + 1]
    behind = np.searchsorted(pair(one), pair(rest))
    if 2 * shift + width > 63:
        head = np.unique(np.concatenate([s[two] << shift | s[two + 1], s[rest] << shift | s[rest + 1]]))
        triple_of = lambda i: np.searchsorted(head, s[i] << shift | s[i + 1]) << width | rank[i + 2]
    else:
        triple_of = lambda i: (s[i] << shift | s[i + 1]) << width | rank[i + 2]
    behind += np.searchsorted(triple_of(two), triple_of(rest))
    out = np.empty(n, dtype=np.int64)
    at = behind + np.arange(len(rest))
    free = np.ones(n, dtype=bool)
    free[at] = False
    out[at], out[free] = rest, sampled
    return out


def repeated_windows(contexts: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """For each context (its bytes, number of windows) which of its windows also start elsewhere in the contexts."""
    size = np.array([len(x) for x in contexts])
    start = np.cumsum(size + 1) - size - 1
    raw = np.zeros(int(size.sum()) + len(contexts), dtype=np.uint8)
    symbols = np.empty(len(raw), dtype=np.int64)
    valid = np.zeros(len(raw), dtype=bool)
    for a, x, k in zip(start.tolist(), contexts, windows, strict=True):
        raw[a : a + len(x)] = np.frombuffer(x, dtype=np.uint8)
        valid[a : a + k] = True
    symbols[:] = raw.astype(np.int64) + 1
    symbols[start + size] = 257 + np.arange(len(contexts))  # separators differ, so no match crosses one
    order = suffix_array(symbols)
    order = order[valid[order]]
    # Adjacent prefixes, eight bytes at a time.
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    words = np.zeros(len(raw), dtype=np.uint64)
    for i in range(8):
        words |= padded[i : i + len(raw)].astype(np.uint64) << np.uint64(8 * (7 - i))
    a, b = order[:-1], order[1:]
    same = np.arange(len(a))
    for i in [*range(0, length - 7, 8), length - 8]:
        same = same[words[a[same] + i] == words[b[same] + i]]
    hit = np.zeros(len(raw), dtype=bool)
    hit[a[same]] = hit[b[same]] = True
    return [hit[x : x + k] for x, k in zip(start.tolist(), windows, strict=True)]


def _spans(hit: np.ndarray, pos: int, length: int) -> list[tuple[int, int]]:
    """Byte ranges of a document that the repeated windows of a run from `pos` cover."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return [(int(pos + at[a]), int(pos + at[b]) + length) for a, b in zip([0, *(cut + 1)], [*cut, len(at) - 1], strict=True)]


def _sort_task(length: int, kind: pa.DataType, limit: int = 1 << 19):
    """Task over contexts sorted by (m, salt): repeated ranges, and names of the windows of salted marks."""
    schema = pa.schema([("doc_id", kind), ("th", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("twice", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            found: list[tuple] = []
            hits = repeated_windows([r[7] for r in rows], [r[6] & ((1 << WIN_BITS) - 1) for r in rows], length)
            names: set = set()
            for (m, salt, n, salted, i, th, pos, data), hit in zip(rows, hits, strict=True):
                pos >>= WIN_BITS
                if n == 1:
                    found += [(i, th, a, b, None, None, None) for a, b in _spans(hit, pos, length)]
                if salted:
                    for k, twice in enumerate(hit.tolist()):
                        name = xxhash.xxh3_128_digest(data[k : k + length])
                        pair = int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True)
                        if n == 1 and not twice:
                            found.append((i, th, pos + k, pos + k + length, *pair, False))
                        elif (m, salt, name) not in names:  # known to repeat: its name alone, once, for the other salts
                            names.add((m, salt, name))
                            found.append((None, None, None, None, *pair, True))
            cols = list(zip(*found, strict=True)) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                for row in zip(*(x.slice(a, 512).to_pylist() for x in batch.columns), strict=True):
                    if row[:2] != last and size >= limit:
                        yield out(held)
                        held, size = [], 0
                    last = row[:2]
                    held.append(row)
                    size += len(row[7])
        if held:
            yield out(held)

    return run


def repeated_ranges(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """Byte ranges (doc_id, th, begin, end) that repeated windows cover; th is the hash of the text."""
    kind = dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    runs = map_arrow(docs, _runs_task(length, gram), StructType.fromDDL(f"m long, c long, doc_id {kind}, th long, pos long"))
    runs = stored(runs, "runs")
    # Tables that are joined are stored first: a join of plain tables is one whose hot keys Spark splits.
    marks = stored(runs.groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("m"), "marks")
    runs = stored(runs.join(marks, "m", "left_semi"), "marked-runs")
    contexts = stored(runs.groupBy("m", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "pos")).alias("one")), "contexts")
    whole = runs.join(contexts.filter("n > 1").select("m", "c"), ["m", "c"], "left_semi")
    place, windows = F.shiftright("pos", WIN_BITS), F.col("pos").bitwiseAND(F.lit((1 << WIN_BITS) - 1))
    whole = whole.select("doc_id", "th", place.alias("begin"), (place + windows + (length - 1)).alias("end"))
    # Marks with different contexts, at least one of which is not known to repeat yet.
    mixed = stored(contexts.groupBy("m").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).filter("k > 1 and least = 1").select("m", "k"), "mixed")
    salts = F.ceil(F.col("k") / F.lit(bucket)).cast("long")
    wanted = contexts.join(mixed, "m").select("one.doc_id", "one.th", F.struct("m", F.pmod(F.col("c"), salts).alias("salt"), F.col("n"), (salts > 1).alias("salted"), "one.pos").alias("w"))
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_list("w").alias("ws")).withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    some = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_id"]) & (docs["th"] == wanted["_th"])).select("doc_id", "th", "text", "ws")
    schema = StructType.fromDDL(f"m long, salt long, n long, salted boolean, doc_id {kind}, th long, pos long, data binary")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunk_rows(batch.column(2), 1 << 20):
                seen: set = set()
                rows: list[tuple] = []
                for i, th, t, ws in zip(*(x.slice(a, b - a).to_pylist() for x in batch.columns), strict=True):
                    if (i, th) in seen:  # a repeated row's runs are in the list once
                        continue
                    seen.add((i, th))
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    for w in ws:
                        p = w["pos"] >> WIN_BITS
                        rows.append((w["m"], w["salt"], w["n"], w["salted"], i, th, w["pos"], raw[p : p + (w["pos"] & ((1 << WIN_BITS) - 1)) + length - 1]))
                names = ["m", "salt", "n", "salted", "doc_id", "th", "pos", "data"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(list(zip(*rows, strict=True)) or [[]] * 8, kinds, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    cut_rows = map_arrow(some, cut_out, schema).repartition("m", "salt").sortWithinPartitions("m", "salt")
    sorted_out = map_arrow(cut_rows, _sort_task(length, to_arrow_type(schema["doc_id"].dataType)), StructType.fromDDL(f"doc_id {kind}, th long, begin long, end long, hi long, lo long, twice boolean"))
    sorted_out = stored(sorted_out, "sorted")
    found = sorted_out.filter("hi is null").select("doc_id", "th", "begin", "end")
    names = sorted_out.filter("hi is not null")
    twice = names.groupBy("hi", "lo").agg((F.count(F.lit(1)) + F.max(F.col("twice").cast("int"))).alias("n")).filter("n > 1").select("hi", "lo")
    across = names.filter("not twice").join(twice, ["hi", "lo"], "left_semi").select("doc_id", "th", "begin", "end")
    return whole.unionAll(found).unionAll(across)


def _merged(spans: list, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["begin"], min(n, s["end"])) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_spans(df: DataFrame, id_col: str, text_col: str, to: str, length: int, **options) -> DataFrame:
    """All columns of `df` and the repeated ranges of the row's text."""
    ranges = repeated_ranges(df, id_col, text_col, length, **options)
    th, left, right = spare(df, "_th"), spare(df, "_left"), spare(df, "_right")
    lists = ranges.groupBy("doc_id", "th").agg(F.collect_list(F.struct("begin", "end")).alias(to)).withColumnsRenamed({"doc_id": left, "th": right})
    keyed = df.withColumn(th, F.xxhash64(F.col(text_col)))
    return keyed.join(lists, keyed[id_col].eqNullSafe(lists[left]) & (keyed[th] == lists[right]), "left").drop(left, th, right)


def removal_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    kind = dict(df.dtypes)[id_col]
    rows = _with_spans(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", "_spans", length, **options).select("doc_id", "text", "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunk_rows(batch.column(1), 4 << 20):
                out: list[list] = [[], [], [], []]
                for t, spans in zip(*(x.slice(a, b - a).to_pylist() for x in batch.columns[1:]), strict=True):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    cuts = _merged(spans, len(raw))
                    for x, v in zip(out, (len(raw), sum(q - p for p, q in cuts), len(cuts), hashlib.sha256(kept_bytes(raw, cuts)).hexdigest()), strict=True):
                        x.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x) for x in out)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(rows, run, StructType.fromDDL(f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def kept_bytes(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in cuts)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in cuts), len(raw)], strict=True))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """All columns of `df`, the text without its repeated passages. A character that a range cuts in two goes as a whole."""
    spans = spare(df, "_spans")

    def keep(texts: list, found: list) -> dict:
        out = []
        for t, s in zip(texts, found, strict=True):
            if t is not None and s is not None:
                raw = t.encode("utf-8", "surrogatepass")
                t = kept_bytes(raw, _merged(s, len(raw))).decode("utf-8", "ignore")
            out.append(t)
        return {text_col: out}

    rows = _with_spans(df, id_col, text_col, spans, length, **options)
    return with_columns(rows, [text_col, spans], keep, {text_col: "string"}).select(*df.columns)
