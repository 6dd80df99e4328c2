"""Byte-level BPE through a lexicon of frequent words.

The lexicon is a minimal acyclic automaton of the corpus's frequent words: states with the same right language are one
(shared suffixes), and each transition carries the number of words that sort before it, so that the sum along a path is
the word's index (the transducer's output) into a table of id sequences. It is five flat arrays in one buffer, made on the
driver, at most `max_words` words, which executors write to an unlinked temporary file and memory-map. A batch's distinct
words walk it together, one byte of all words at a time; words that it lacks are merged exactly by the rank table.

Encoding equals the tokenizers library's for byte-level BPE with add_special_tokens=False, added tokens in the text
included; decoding equals decode(ids, skip_special_tokens=False).

The lexicon holds words of at most LONG characters that occur twice at least; all others are merged exactly too, so it
changes the time alone. Words of like frequency are taken together or not at all, so ties need no order.

Defined results: a null text counts as empty and has no ids. Texts are taken whole; memory is bounded by a batch's distinct
words. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querywright.llm.common import chunk_rows, map_arrow, map_chunks, stored

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts of plain characters only (see _ODD), where letters are these ranges.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ʯ"
_PLAIN = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_ODD = re.compile(rf"[^\n\r\t -~{_LETTERS}]")
MEMO = 300_000
LONG = 48
NONE = np.int32(2**31 - 1)
_HASH = np.int64(0x1E3779B97F4A7C15)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and added tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = lambda x: bytes(letters[c] for c in x)
        bytes_of: dict[int, bytes] = {i: back(t) for t, i in spec["model"]["vocab"].items()}
        id_of = {b: i for i, b in bytes_of.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        bytes_of |= {i: t.encode() for t, i in self.added.items()}
        size = max(bytes_of) + 1
        self.pieces = [bytes_of.get(i, b"") for i in range(size)]
        self.byte_ids = np.array([id_of[bytes([b])] for b in range(256)], dtype=np.int32)
        merges = [tuple(map(back, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        self.width = size
        keys = np.array([id_of[a] * size + id_of[b] for a, b in merges], dtype=np.int64)
        made = np.array([id_of[a + b] for a, b in merges], dtype=np.int64)
        self._rank: dict[int, tuple[int, int]] = {}
        self.keys, self.ranks, self.by_rank = keys, np.arange(len(keys)), made.astype(np.int32)
        self._fill_slots()
        self.split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merging of one word in O(n log n): a heap of pairs over a linked list."""
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        if not self._rank:
            self._rank = {k: (r, m) for r, (k, m) in enumerate(zip(self.keys.tolist(), self.by_rank.tolist(), strict=True))}
        n, size, rank = len(ids), self.width, self._rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if r := rank.get(ids[i] * size + ids[i + 1]):
                heap.append((r[0], i, ids[i], ids[i + 1], r[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := rank.get(made * size + ids[k]):
                    heapq.heappush(heap, (r[0], i, made, ids[k], r[1]))
            h = before[i]
            if h >= 0 and (r := rank.get(ids[h] * size + made)):
                heapq.heappush(heap, (r[0], h, ids[h], made, r[1]))
        return [x for x in ids if x >= 0]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words."""
        out: list[list[int]] = [[]] * len(words)
        for index, count, flat in self.merge_packed(words):
            ids, ends = flat.tolist(), np.cumsum(count).tolist()
            for i, a, b in zip(index.tolist(), [0, *ends], ends, strict=False):
                out[i] = ids[a:b]
        return out

    def merge_packed(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same as (word numbers, numbers of ids, their ids one after another) of some words at a time."""
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
        if len(short) < len(words):
            for i, w in enumerate(words):
                if len(w) > LONG:
                    ids = self.merge_long(w)
                    yield np.array([i]), np.array([len(ids)]), np.array(ids, dtype=np.uint32)
        short.sort(key=lambda i: len(words[i]))
        for lo in range(0, len(short), 8192):
            group = np.array(short[lo : lo + 8192])
            for rows, count, flat in self._merge_table([words[i] for i in group.tolist()]):
                yield group[rows], count, flat

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE, from a hash table with linear probing."""
        key = a.astype(np.int64) * self.width + b
        at = (key * _HASH) >> self._shift & self._mask
        found = self._slot_key[at]
        out = np.where(found == key, self._slot_rank[at], NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & self._mask
            found = self._slot_key[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self._slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def _fill_slots(self) -> None:
        bits = max(4, int(len(self.keys) * 8).bit_length())
        self._mask, self._shift = np.int64((1 << bits) - 1), np.int64(62 - bits)
        self._slot_key = np.full(1 << bits, -1, dtype=np.int64)
        self._slot_rank = np.full(1 << bits, NONE, dtype=np.int32)
        slots, ranks = self._slot_key, self._slot_rank
        with np.errstate(over="ignore"):
            places = ((self.keys * _HASH) >> self._shift & self._mask).tolist()
        for p, k, r in zip(places, self.keys.tolist(), self.ranks.tolist(), strict=True):
            while slots[p] >= 0:
                p = p + 1 & int(self._mask)
            slots[p], ranks[p] = k, r

    def _merge_table(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words of some length as rows of a table: in each round every row merges its first pair of the lowest rank, so
        the table gets one column narrower; rows without such a pair leave."""
        left = np.array([len(w) for w in words])
        width = int(left.max())
        ids = np.zeros((len(words), width), dtype=np.int32)
        ids[np.arange(width) < left[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        rank = np.full((len(words), width), NONE, dtype=np.int32)  # of the pair that begins at each place
        inside = np.arange(width) < left[:, None] - 1
        first, second = ids[:, :-1], ids[:, 1:]
        rank[inside] = self._ranks(first[inside[:, :-1]], second[inside[:, :-1]])
        where = np.arange(len(words))
        while len(where):
            best = rank.argmin(axis=1)
            r = np.arange(len(where))
            lowest = rank[r, best]
            live = lowest < NONE
            if not live.all():
                gone = ~live
                inside = np.arange(ids.shape[1]) < left[gone, None]
                yield where[gone], left[gone], ids[gone][inside].astype(np.uint32)
                ids, rank, where, left, best, lowest = ids[live], rank[live], where[live], left[live], best[live], lowest[live]
                if not len(where):
                    return
                r = np.arange(len(where))
            made = self.by_rank[lowest]
            rows, width = ids.shape
            keep = np.ones((rows, width), dtype=bool)
            keep[r, best + 1] = False
            ids = ids[keep].reshape(rows, width - 1)
            ids[r, best] = made
            keep[r, best + 1] = True
            keep[r, best] = False  # the pair goes; the one behind it, now at its place, gets a new rank
            rank = rank[keep].reshape(rows, width - 1)
            left = left - 1
            after = np.minimum(best + 1, width - 2)
            rank[r, best] = np.where(best + 1 < left, self._ranks(made, ids[r, after]), NONE)
            before = np.maximum(best - 1, 0)
            rank[r, before] = np.where(best > 0, self._ranks(ids[r, before], made), rank[r, before])


def pretokens(text: str) -> list[str]:
    """The words that merging never crosses."""
    return (PATTERN if _ODD.search(text) else _PLAIN).findall(text)


class Lexicon:
    """A minimal acyclic transducer from words (bytes) to id sequences."""

    FIELDS = ("first", "label", "target", "before", "final", "offset", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Lexicon:
        """Incremental construction from sorted words: a state is frozen, and merged with an equal one, as soon as no
        later word can pass through it."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[list] = [[False, []]]  # open states of the last word: final, [(label, frozen target)]
        last = b""

        def freeze(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in register:
                    register[key] = len(states)
                    states.append(key)
                path[-1][1].append((last[len(path) - 1], register[key]))

        ordered = sorted(words)
        for w in ordered:
            common = next((i for i, (x, y) in enumerate(zip(w, last, strict=False)) if x != y), min(len(w), len(last)))
            freeze(common)
            path += [[False, []] for _ in range(len(w) - common)]
            path[-1][0] = True
            last = w
        freeze(0)
        states.append((path[0][0], tuple(path[0][1])))
        size = [0] * len(states)  # words below each state; targets come before
        first, label, target, before = [0], [], [], []
        for i, (final, arcs) in enumerate(states):
            n = int(final)
            for x, t in arcs:
                label.append(x)
                target.append(t)
                before.append(n)
                n += size[t]
            size[i] = n
            first.append(len(label))
        offset = np.cumsum([0] + [len(words[w]) for w in ordered])
        return cls({
            "first": np.array(first, dtype=np.int32), "label": np.array(label, dtype=np.uint8), "target": np.array(target, dtype=np.int32),
            "before": np.array(before, dtype=np.int32), "final": np.array([f for f, _ in states], dtype=np.uint8),
            "offset": offset.astype(np.int32), "ids": np.array(list(chain.from_iterable(words[w] for w in ordered)), dtype=np.uint32),
        })

    def to_bytes(self) -> bytes:
        head, body, at = {}, [], 0
        for k in self.FIELDS:
            data = getattr(self, k).tobytes()
            head[k] = (str(getattr(self, k).dtype), at, len(data))
            pad = -len(data) % 8
            body.append(data + bytes(pad))
            at += len(data) + pad
        top = json.dumps(head).encode()
        top += b" " * (-(len(top) + 8) % 8)
        return len(top).to_bytes(8, "little") + top + b"".join(body)

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """The lexicon over a memory map of an unlinked temporary file; nothing stays behind."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(view[:8], "little")
        head = json.loads(view[8 : 8 + n])
        out = cls({k: np.frombuffer(view, dtype=d, offset=8 + n + a, count=size // np.dtype(d).itemsize) for k, (d, a, size) in head.items()})
        out._view = view
        # Each arc by state and label: sorted, as states and their arcs are in order.
        state = np.repeat(np.arange(len(out.first) - 1, dtype=np.int64), np.diff(out.first))
        out._arcs = state * 256 + out.label
        return out

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Index of each word, or -1; all words take one byte at a time."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(self._arcs):
            return out
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        start = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        live = np.arange(len(words))
        state = np.full(len(words), len(self.first) - 2, dtype=np.int64)
        total = np.zeros(len(words), dtype=np.int64)
        depth = 0
        while len(live):
            ended = size[live] == depth
            if ended.any():
                at = live[ended]
                ok = self.final[state[ended]] == 1
                out[at[ok]] = total[ended][ok]
                live, state, total = live[~ended], state[~ended], total[~ended]
                if not len(live):
                    break
            key = state * 256 + raw[start[live] + depth]
            arc = np.searchsorted(self._arcs, key)
            arc[arc == len(self._arcs)] = 0
            ok = self._arcs[arc] == key
            live, arc = live[ok], arc[ok]
            state, total = self.target[arc].astype(np.int64), total[ok] + self.before[arc]
            depth += 1
        return out

    def sequence(self, index: int) -> list[int]:
        return self.ids[self.offset[index] : self.offset[index + 1]].tolist()


class Encoder:
    """Encodes texts; words that were seen are kept, at most MEMO of them."""

    def __init__(self, path: str, lexicon: bytes | None = None):
        self.vocabulary = Vocabulary(path)
        self.lexicon = Lexicon.mapped(lexicon) if lexicon else None
        self._memo: dict[str, bytes] = {}
        self._pieces = _strings(self.vocabulary.pieces)
        self._names = _strings([b"%d," % i for i in range(self.vocabulary.width)])

    def _learn(self, words: set[str]) -> None:
        """Ids (as little-endian 32-bit bytes) of unseen words, from the lexicon or by merging."""
        memo = self._memo
        new = list(words.difference(memo))
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(words)
        if not new:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        rest = None
        if self.lexicon is not None:
            at = self.lexicon.lookup(raw)
            ids, offset = self.lexicon.ids, self.lexicon.offset
            known = np.flatnonzero(at >= 0)
            data, first, last = ids.tobytes(), 4 * offset[at[known]], 4 * offset[at[known] + 1]
            for i, a, b in zip(known.tolist(), first.tolist(), last.tolist(), strict=True):
                memo[new[i]] = data[a:b]
            rest = np.flatnonzero(at < 0).tolist()
        if rest is not None:
            new, raw = [new[i] for i in rest], [raw[i] for i in rest]
        for index, count, flat in self.vocabulary.merge_packed(raw):
            data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
            for i, a, b in zip(index.tolist(), [0, *ends], ends, strict=False):
                memo[new[i]] = data[a:b]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit numbers."""
        v = self.vocabulary
        parts: list[list] = []
        for t in texts:
            t = t or ""
            if v.split is not None and any(x in t for x in v.added):
                parts.append([(v.added[p] if i % 2 else pretokens(p)) for i, p in enumerate(v.split.split(t))])
            else:
                parts.append([pretokens(t)])
        self._learn(set(chain.from_iterable(p for doc in parts for p in doc if not isinstance(p, int))))
        get = self._memo.__getitem__
        return [np.frombuffer(b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in doc), dtype="<u4") for doc in parts]

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of([ids])[0].decode("utf-8", "replace")

    def bytes_of(self, found: list[np.ndarray]) -> list[bytes]:
        """The pieces of each sequence of ids, joined."""
        return _joined(found, *self._pieces)

    def names_of(self, found: list[np.ndarray]) -> list[bytes]:
        """The decimal ids of each sequence, joined by commas."""
        return [x[:-1] for x in _joined(found, *self._names)]


def _strings(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings in one buffer, with their places and sizes."""
    size = np.array([len(x) for x in found], dtype=np.int64)
    return np.frombuffer(b"".join(found), dtype=np.uint8), np.cumsum(size) - size, size


def _joined(found: list[np.ndarray], data: np.ndarray, first: np.ndarray, size: np.ndarray, block: int = 1 << 19) -> list[bytes]:
    """For each sequence of numbers its strings, joined. Short sequences are gathered together, long ones in blocks."""

    def gather(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        sizes = size[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(first[ids] - ends + sizes, sizes)
        at += np.arange(len(at))
        return data[at].tobytes(), np.concatenate([[0], ends])

    out: list[bytes] = []
    group: list[np.ndarray] = []

    def flush() -> None:
        if group:
            raw, ends = gather(np.concatenate(group))
            cuts = ends[np.cumsum([0, *map(len, group)])].tolist()
            out.extend(raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
            group.clear()

    held = 0
    for x in found:
        if held + len(x) > block:
            flush()
            held = 0
        if len(x) > block:
            out.append(b"".join(gather(x[i : i + block])[0] for i in range(0, len(x), block)))
        else:
            group.append(x)
            held += len(x)
    flush()
    return out


def frequent_words(df: DataFrame, text_col: str = "text", max_words: int = 1 << 15, flush: int = 150_000) -> list[str]:
    """The words that occur most often in the whole corpus, `max_words` at most: words of like frequency are taken together
    or not at all. Each task counts what it reads before the shuffle, so a frequent word sends a few rows, not one for
    each time it occurs; the driver gets a histogram, then the words taken."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            kept = [(w, n) for w, n in seen.items() if len(w) <= LONG]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], type=pa.string()), pa.array([n for _, n in kept], type=pa.int64())], names=["word", "n"])

        size = 0

        for batch in batches:
            for a, b in chunk_rows(batch.column(0), 1 << 20):
                for t in batch.column(0).slice(a, b - a).to_pylist():
                    seen.update(pretokens(t or ""))
                    size += len(t or "")
                if len(seen) > flush or size > 64 << 20:
                    yield out()
                    seen.clear()
                    size = 0
        if seen:
            yield out()

    counts = map_arrow(df.select(F.col(text_col).alias("t")), count, StructType.fromDDL("word string, n long")).groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts.filter("n > 1").withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "word-counts")
    # A sixteenth of an octave a level, so at most about a thousand rows; the levels taken hold max_words words at most.
    total, least = 0, None
    for level, n in sorted(((r[0], r[1]) for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        if (total := total + n) > max_words:
            break
        least = level
    return [] if least is None else sorted(r[0] for r in counts.filter(F.col("level") >= least).select("word").collect())


def compile_lexicon(words: list[str], path: str) -> bytes:
    """Words without repeats and their ids, compiled."""
    v = Vocabulary(path)
    raw = [w.encode() for w in dict.fromkeys(words) if w]
    return Lexicon.build(dict(zip(raw, v.merge(raw), strict=True))).to_bytes()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, key: str = "", lexicon=None) -> Encoder:
    """This process's encoder for a file and a broadcast lexicon (named by its digest); tasks that follow reuse it."""
    if (path, key) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, key] = Encoder(path, lexicon.value if lexicon is not None else None)
    return _ENCODERS[path, key]


def encode_decode(df: DataFrame, path: str, lexicon: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, digest of the ids, digest of the decoded text."""
    shared, key = df.sparkSession.sparkContext.broadcast(lexicon), hashlib.sha256(lexicon).hexdigest()

    def work(ids: list, texts: list) -> dict:
        e = encoder(path, key, shared)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        out: dict[str, list] = {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        found = e.encode(texts)
        for got, names, raw in zip(found, e.names_of(found), e.bytes_of(found), strict=True):
            out["n_tokens"].append(len(got))
            out["ids_sha256"].append(sha(names))
            out["decoded_sha256"].append(sha(raw.decode("utf-8", "replace").encode()))
        return out

    kind = dict(df.dtypes)[id_col]
    return map_chunks(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work, StructType.fromDDL(f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"), limit=1 << 20)


def default_path() -> str:
    """The public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def lexicon_of(spark: SparkSession, df: DataFrame, path: str, text_col: str = "text", max_words: int = 1 << 15) -> bytes:
    return compile_lexicon(frequent_words(df, text_col, max_words), path)
