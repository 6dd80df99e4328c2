"""SimHash fingerprints and their groups, found through a Gray-order hierarchical index.

Fingerprints: bit i of a document's fingerprint is set if it is set in over half of its shingles' XXH64 hashes.

Groups: documents whose fingerprints differ in at most `max_bits` bits are linked, and a group is what links reach.
1. Documents with one fingerprint are one entry from the start (a partial aggregate, so copies cost a row a task).
2. The 64 bits are cut into max_bits + 1 blocks; two fingerprints that link agree in one block at least. For each block,
   fingerprints are rotated so that the block leads, ranked in Gray order and sorted; those that agree in the block are
   one node of the index.
3. In a node the sorted fingerprints form a hierarchy: each group of neighbours keeps the bits on which all its members
   agree (mask and pattern), and upper nodes factor out what their children share. A search goes down only where the
   differences accumulated against the pattern stay within the limit, so whole groups are pruned at once.
4. A node of more than `node_rows` fingerprints is split by its next eight bits; a fingerprint is at home in one child and
   visits those children that it can still reach within its limit. This repeats, so that no task gets an unbounded node.
5. Each node sends one edge for each fingerprint that has a link there (a star), not all pairs. Connected components come
   from alternating large-star and small-star steps over distributed edges; nothing of them reaches the driver.

Defined results: null and empty texts have fingerprint zero and link like any other. Texts with fewer words than a shingle
have one shingle, all their words. A null id is never a component's name unless the component has no other. Equal texts and
repeated rows are one group; of a group's ids the smallest names it, and one_of_each() keeps, of rows with that id, the one
whose text has the smallest hash, once. Only the id and the text are read, whatever the other columns are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querywright.llm.common import cut, cut_narrow, map_arrow, map_chunks, sized, spare, stored

SEED = 42
STEP_BITS = 8
LEAF, FAN = 32, 16
#: A node's rows that are searched for before their links are merged, and the candidates held for each level meanwhile.
QUERIES, CANDIDATES = 1024, 1 << 17


def shingle_hashes(text: str | None, ngram: int) -> np.ndarray:
    """XXH64 of each shingle, in order, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone change, ASCII blanks part
    if not words:
        return np.zeros(0, dtype=np.uint64)
    norm, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= ngram:
        return np.frombuffer(digest(norm, SEED), dtype=">u8").astype(np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    made = b"".join([digest(norm[a : b - 1], SEED) for a, b in zip(starts, ends[ngram - 1 :], strict=False)])
    return np.frombuffer(made, dtype=">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3) -> DataFrame:
    """Per row: doc_id, fp (the fingerprint as a signed long)."""

    def work(ids: list, texts: list) -> dict:
        made = np.array([fingerprint(shingle_hashes(t, ngram)) for t in texts], dtype=np.uint64)
        return {"doc_id": ids, "fp": made.view(np.int64)}

    kind = dict(df.dtypes)[id_col]
    return map_chunks(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work, StructType.fromDDL(f"doc_id {kind}, fp long"))


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence: neighbours in that order differ in one bit."""
    rank = code.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(s))
    return rank


def blocks(n: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of n blocks of 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _rotated(fp: Column, by: int) -> Column:
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp


def _top(code: Column, bits: int) -> Column:
    return F.shiftrightunsigned(code, 64 - bits)


class Hierarchy:
    """Masked patterns over fingerprints in Gray order: levels[0] are groups of LEAF neighbours, each further level groups
    FAN nodes of the one below."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        every, some = _fold(np.bitwise_and, codes, LEAF), _fold(np.bitwise_or, codes, LEAF)
        self.levels = [(every, some)]
        while len(every) > FAN:
            every, some = _fold(np.bitwise_and, every, FAN), _fold(np.bitwise_or, some, FAN)
            self.levels.append((every, some))
        self.joined: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, labels: np.ndarray) -> None:
        """From now on codes are passed by if they have the query's label; so are groups whose members all have it."""
        low = high = labels
        self.joined = [(low, high)]
        for level in range(len(self.levels)):
            size = FAN if level else LEAF
            low, high = _fold(np.minimum, low, size), _fold(np.maximum, high, size)
            self.joined.append((low, high))

    def search(self, queries: np.ndarray, limit: int, labels: np.ndarray | None = None, most: int = CANDIDATES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (query index, code index) with at most `limit` differing bits, piece by piece. About `most` candidates are
        held for each level, however many there are: a piece whose members have more is cut before it is gone into."""
        top = len(self.levels)
        # (level whose groups are at hand, query and group of each candidate); above the top level there is one group.
        stack = [(top, np.arange(a, min(a + most, len(queries))), None) for a in range(0, len(queries), most)]
        while stack:
            level, at_q, at_n = stack.pop()
            size = len(self.levels[-1][0]) if level == top else FAN if level else LEAF
            below = len(self.levels[level - 1][0]) if level else len(self.codes)
            step = max(1, most // size)
            if len(at_q) > step:
                stack += [(level, at_q[a : a + step], None if at_n is None else at_n[a : a + step]) for a in range(0, len(at_q), step)]
                continue
            at_n = (np.arange(size)[None, :] + (np.zeros(len(at_q), dtype=np.int64) if at_n is None else at_n)[:, None] * size).ravel()
            at_q = np.repeat(at_q, size)
            if level < top:
                inside = at_n < below
                at_q, at_n = at_q[inside], at_n[inside]
            if level:
                every, some = (x[at_n] for x in self.levels[level - 1])
                near = np.bitwise_count((queries[at_q] ^ every) & ~(every ^ some)) <= limit  # bits that all members share
            else:
                near = np.bitwise_count(queries[at_q] ^ self.codes[at_n]) <= limit
            if labels is not None and self.joined:
                low, high = (x[at_n] for x in self.joined[level])
                near &= (low != high) | (low != labels[at_q])
            at_q, at_n = at_q[near], at_n[near]
            if len(at_q) and level:
                stack.append((level - 1, at_q, at_n))
            elif len(at_q):
                yield at_q, at_n


def _fold(how: np.ufunc, values: np.ndarray, size: int) -> np.ndarray:
    return how.reduceat(values, np.arange(0, len(values), size))


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest member of each one's component) after a and b are linked, by repeated minima and pointer jumps."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def _linked(node: np.ndarray, code: np.ndarray, home: np.ndarray, limit: int) -> np.ndarray:
    """For rows sorted by node and Gray rank, the smallest row that each is linked to within its node; of two visitors, no
    link is sought. Links become labels as they are found, so no list of a node's pairs exists."""
    edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
    size = np.diff(edge)
    label = np.arange(len(node))
    small = np.repeat(size <= LEAF, size)
    for lag in range(1, int(min(LEAF, size.max()))):
        a = np.flatnonzero(small[:-lag] & (node[lag:] == node[:-lag]))
        a = a[(np.bitwise_count(code[a] ^ code[a + lag]) <= limit) & (home[a] | home[a + lag])]
        if len(a):
            label = _merged(label, a, a + lag)
    for k in np.flatnonzero(size > LEAF):
        lo, hi = edge[k], edge[k + 1]
        own = np.flatnonzero(home[lo:hi])
        if len(own):
            label[lo:hi] = lo + _linked_node(code[lo:hi], own, limit)
    return label


def _linked_node(code: np.ndarray, own: np.ndarray, limit: int) -> np.ndarray:
    """The labels of one node's rows. Rows are queries in blocks; a block's links are merged before the next one starts,
    and what is joined already is not compared again. Near copies of one text so cost little more than their number."""
    index, label = Hierarchy(code[own]), np.arange(len(code))
    for lo in range(0, len(code), QUERIES):
        index.join(label[own])
        block = slice(lo, lo + QUERIES)
        found = list(index.search(code[block], limit, label[block]))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            label = _merged(label, a + lo, own[b])
    return label


def _node_edges(limit: int, flush: int = 200_000):
    """Task over rows (node key, fp, home) sorted by node and rank: edges (a, b) with a > b, one for each linked
    fingerprint of a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[np.ndarray]) -> pa.RecordBatch | None:
            node, code, home = rows
            if len(node) < 2:
                return None
            # The same fingerprint may stand in several nodes of a batch: labels stay within a node, as links do.
            label = _linked(node, code, home, limit)
            root = np.full(len(node), np.iinfo(np.int64).max)
            fp = code.view(np.int64)
            np.minimum.at(root, label, fp)
            u, v = fp, root[label]
            some = u != v
            return pa.RecordBatch.from_arrays([pa.array(u[some]), pa.array(v[some])], names=["a", "b"]) if some.any() else None

        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)])
            size += batch.num_rows
            if size >= flush:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if rows[0][0] != rows[0][-1] else 0
                if last and (made := out([x[:last] for x in rows])) is not None:
                    yield made
                held, size = [[x[last:] for x in rows]], len(rows[0]) - last
        if held and (made := out([np.concatenate(x) for x in zip(*held, strict=True)])) is not None:
            yield made

    return run


def fingerprint_edges(distinct: DataFrame, max_bits: int = 2, node_rows: int = 1 << 16) -> DataFrame:
    """Edges (a, b), a > b, that connect all fingerprints within `max_bits` of each other. distinct: column fp, no repeats."""
    cuts = blocks(max_bits + 1)
    # A node's key: the block, and the bits that its members (or those they reach) agree on.
    rows = None
    for r, (first, width) in enumerate(cuts):
        code = _rotated(F.col("fp"), first)
        part = distinct.select(F.lit(r).alias("r"), _top(code, width).alias("node"), F.lit(width).alias("bits"), code.alias("code"), F.col("fp"), F.lit(True).alias("home"), F.lit(max_bits).alias("left"))
        rows = part if rows is None else rows.unionAll(part)
    done = None
    masks = [m for m in range(1 << STEP_BITS) if m.bit_count() <= max_bits]
    while True:
        sizes = rows.groupBy("r", "bits", "node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > node_rows).filter(F.col("bits") + STEP_BITS <= 64)
        hot = cut(sizes.select("r", "bits", "node"))
        if hot.isEmpty():
            done = rows if done is None else done.unionAll(rows)
            break
        cold = rows.join(hot, ["r", "bits", "node"], "left_anti")
        done = cold if done is None else done.unionAll(cold)
        steps = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("d")) for m in masks])
        near = F.filter(steps, lambda x: x.d <= F.col("left"))
        own = F.expr(f"shiftrightunsigned(shiftleft(code, bits), {64 - STEP_BITS})")
        rows = rows.join(hot, ["r", "bits", "node"], "left_semi").withColumn("s", F.explode(near)).select(
            "r", F.shiftleft("node", STEP_BITS).bitwiseOR(own.bitwiseXOR(F.col("s.m"))).alias("node"), (F.col("bits") + STEP_BITS).alias("bits"), "code", "fp",
            (F.col("home") & (F.col("s.d") == 0)).alias("home"), (F.col("left") - F.col("s.d")).alias("left"),
        )
    keyed = done.select(F.xxhash64("r", "bits", "node").alias("key"), "fp", "home", _gray("code").alias("rank"))
    placed = keyed.repartition("key").sortWithinPartitions("key", "rank").select("key", "fp", "home")
    return map_arrow(placed, _node_edges(max_bits), StructType.fromDDL("a long, b long"))


def _gray(name: str) -> Column:
    """gray_rank() of a column; shifts doubled step by step, each through a let-binding so that the tree stays small."""
    fold = lambda s: lambda y: y.bitwiseXOR(F.shiftrightunsigned(y, s))
    x = F.col(name)
    for s in (1, 2, 4, 8, 16, 32):
        x = F.get(F.transform(F.array(x), fold(s)), F.lit(0))
    return x


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with an edge; the root is the smallest node that it reaches. Alternating large-star and
    small-star steps; each round's edges are checkpointed, and only their number and a checksum reach the driver. The least
    neighbours are checkpointed before they are joined: a join of two plain shuffles can split the partition of a node that
    a large family has its edges at."""
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    e = cut_narrow(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(e)
    while seen[0]:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut_narrow(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = both.join(low, both["a"] == low["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_narrow(large.distinct())
        low = cut_narrow(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"))
        joined = large.join(low, large["a"] == low["u"])
        small = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        more = joined.filter("b <> m").select("a", F.col("m").alias("b"))
        e = cut_narrow(small.unionAll(more).filter("a <> b").distinct())
        if (now := state(e)) == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, max_bits: int = 2, node_rows: int = 1 << 16) -> DataFrame:
    """Per row: doc_id, fp, component_id (the smallest id of the row's group)."""
    fps = stored(fingerprints(df, id_col, text_col, ngram), "fingerprints")
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(fingerprint_edges(distinct.select("fp"), max_bits, node_rows))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    # Stored before it is joined, so that Spark can split the partition of a text that very many documents share.
    named = stored(rooted.join(least, "root").select("fp", "component_id"), "components")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


BANDS, BAND_ROWS = 16, 4
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def samples(hashes: np.ndarray) -> list[int]:
    """Fingerprints of BANDS small samples of a shingle set. A sample is the BAND_ROWS shingles that come first under as
    many orders, so similar sets draw equal samples often: at a similarity of 0.8, one of them in 99.98 % of all cases."""
    distinct = np.unique(hashes)
    if not len(distinct):
        return []
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(distinct), 4096):
        x = distinct[i : i + 4096, None] * _MULTIPLIERS[None, :]
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(least[i * BAND_ROWS : (i + 1) * BAND_ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def set_hash(distinct: np.ndarray) -> int:
    """A name for a set of shingles, as a signed long."""
    return int(np.array([xxhash.xxh64_intdigest(distinct.astype("<u8").tobytes(), SEED)], dtype=np.uint64).view(np.int64)[0])


def prefix(distinct: np.ndarray, similarity: float, usual: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first members of a set in an order that is the same for all sets: unusual ones by value, then the usual ones
    (sorted, with their places) by place. Sets of at least `similarity` share a member of their prefixes."""
    size = len(distinct) - math.ceil(similarity * len(distinct) - 1e-9) + 1 if len(distinct) else 0
    if len(usual) and len(distinct):
        at = np.minimum(np.searchsorted(usual, distinct), len(usual) - 1)
        known = usual[at] == distinct
        distinct = np.concatenate([distinct[~known], distinct[known][np.argsort(place[at[known]])]])
    return distinct[:size]


def short_keys(members: np.ndarray) -> np.ndarray:
    """Members as 31-bit numbers. Two that become one only add pairs, which are compared exactly."""
    return ((members ^ (members >> np.uint64(32))) & np.uint64(0x7FFFFFFF)).astype(np.int32)


#: The order of prefixes: one set in SAMPLE is counted; shingles in USUAL or more of those come last, the ORDERED most usual.
SAMPLE, USUAL, ORDERED = 16, 2, 250_000
#: Members of a prefix key that one task pairs with all of the key's members.
KEY_ROWS = 512


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, similarity: float = 0.8, max_bits: int = 2, node_rows: int = 1 << 16) -> DataFrame:
    """Per row: doc_id, component_id. Links documents whose fingerprints differ in at most `max_bits` bits (all of them, by
    the index), and documents whose shingle sets have at least `similarity` (all of them too). Sets are compared exactly:
    1. Each with three of each of its samples: the smallest, the largest, and the one whose samples most others have. That
       joins large families without pairing them off.
    2. Sets that share a member of their prefixes and are not joined yet, whatever their number."""
    kind, spark = dict(df.dtypes)[id_col], df.sparkSession
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(ids: list, texts: list) -> dict:
        hashes = [shingle_hashes(t, ngram) for t in texts]
        fps = np.array([fingerprint(h) for h in hashes], dtype=np.uint64)
        sets = [np.unique(h) for h in hashes]
        names = [set_hash(x) for x in sets]
        some = [x.view(np.int64) if n % SAMPLE == 0 else None for x, n in zip(sets, names, strict=True)]
        return {"doc_id": ids, "fp": fps.view(np.int64), "th": names, "bands": [samples(x) for x in sets], "some": some}

    rows = stored(map_chunks(texts, work, StructType.fromDDL(f"doc_id {kind}, fp long, th long, bands array<long>, some array<long>"), limit=1 << 20), "samples")
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # One row for each different set; its other fingerprints (repeats count in them) are linked to its smallest.
    sets_of = stored(rows.groupBy("th").agg(F.min("fp").alias("fp"), F.max("fp").alias("other"), F.min("doc_id").alias("rep")), "sets")
    twins = rows.select("th", "fp").distinct().join(sets_of.filter("fp <> other").select("th", F.col("fp").alias("low")), "th").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))

    def shingles(ids: list, texts: list) -> dict:
        sets = [np.unique(shingle_hashes(t, ngram)) for t in texts]
        return {"th": [set_hash(x) for x in sets], "shingles": [x.view(np.int64) for x in sets]}

    def close(pairs: DataFrame) -> DataFrame:
        """Edges of the pairs (th, hub) whose sets have the similarity."""
        needed = pairs.select("th").unionAll(pairs.select(F.col("hub").alias("th"))).distinct().join(sets_of, "th").select("rep").distinct()
        wanted = texts.join(sized(stored(needed, "needed")), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
        made = map_chunks(wanted, shingles, StructType.fromDDL("th long, shingles array<long>"), limit=1 << 20).groupBy("th").agg(F.min("shingles").alias("shingles"))
        sets = stored(made.join(sets_of.select("th", "fp"), "th"), "shingles")
        both = pairs.join(sets.select("th", F.col("fp").alias("u"), F.col("shingles").alias("a")), "th").join(sets.select(F.col("th").alias("hub"), F.col("fp").alias("v"), F.col("shingles").alias("b")), "hub")
        shared = F.size(F.array_intersect("a", "b"))
        return both.filter(shared >= similarity * (F.size("a") + F.size("b") - shared)).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))

    # One row for each set and sample, however many copies there are; then those whose sample others have too.
    placed = stored(rows.select("th", F.explode("bands").alias("band")).groupBy("th", "band").agg(F.lit(1).alias("x")).select("th", "band"), "bands")
    shared_bands = stored(placed.groupBy("band").agg(F.min("th").alias("low"), F.max("th").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high"), "shared")
    members = stored(placed.join(shared_bands.select("band", "n"), "band"), "members")
    scores = members.groupBy("th").agg(F.sum("n").alias("score"))
    middle = members.join(scores, "th").groupBy("band").agg(F.max(F.struct("score", "th"))["th"].alias("mid"))
    hubs = stored(shared_bands.join(middle, "band").select("band", F.explode(F.array_distinct(F.array("low", "high", "mid"))).alias("hub")), "hubs")
    pairs = stored(members.join(hubs, "band").filter("th <> hub").select("th", "hub").distinct(), "pairs")
    near = fingerprint_edges(distinct.select("fp"), max_bits, node_rows).unionAll(twins)
    first = cut(components(near.unionAll(close(pairs))))

    # What is left: sets of different components that share a member of their prefixes.
    common = rows.filter("some is not null").groupBy("th").agg(F.min("some").alias("some")).select(F.explode("some").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    common = common.filter(F.col("n") >= USUAL).orderBy(F.desc("n"), "x").limit(ORDERED).select("x").toPandas()["x"].to_numpy(dtype=np.int64).view(np.uint64)
    by_value = np.argsort(common)
    order = spark.sparkContext.broadcast((common[by_value], -by_value))

    def prefixes(ids: list, texts: list) -> dict:
        sets = [np.unique(shingle_hashes(t, ngram)) for t in texts]
        return {"th": [set_hash(x) for x in sets], "size": [len(x) for x in sets], "keys": [short_keys(prefix(x, similarity, *order.value)) for x in sets]}

    rooted = sets_of.join(first, sets_of["fp"] == first["node"], "left").select("th", F.coalesce("root", "fp").alias("root"))
    made = map_chunks(texts, prefixes, StructType.fromDDL("th long, size int, keys array<int>"), limit=1 << 20).groupBy("th").agg(F.min("size").alias("size"), F.min("keys").alias("keys"))
    lists = stored(made.join(rooted, "th"), "prefixes")
    keys = lists.select(F.explode("keys").alias("key"), "root").groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
    keys = stored(keys.filter("low < high").select("key", F.ceil(F.col("n") / KEY_ROWS).cast("long").alias("parts")), "keys")
    hits = stored(lists.select("th", "size", "root", F.posexplode("keys").alias("at", "key")).join(keys, "key"), "hits")
    # A key's members are dealt over its parts, and meet there those of its members that are no larger. Of a pair's shared
    # members the first in order counts: what the two share comes with it or after it, so in the smaller set it stands in
    # a shorter prefix, and both have enough members from there on.
    left = hits.withColumn("part", F.pmod("th", "parts")).select("key", "part", *[F.col(c).alias(f"a_{c}") for c in ("th", "size", "root", "at")])
    short = F.col("at") <= F.col("size") - F.ceil(2 * similarity / (1 + similarity) * F.col("size") - 1e-9)
    right = hits.filter(short).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("key", "part", *[F.col(c).alias(f"b_{c}") for c in ("th", "size", "root", "at")])
    need = similarity * (F.col("a_size") + F.col("b_size")) - 1e-6
    most = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    larger = (F.col("a_size") > F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a_th") > F.col("b_th")))
    enough = larger & (F.col("b_size") >= similarity * F.col("a_size") - 1e-6) & (most * (1 + similarity) >= need)
    pair = left.join(right, ["key", "part"]).filter((F.col("a_root") != F.col("b_root")) & enough)
    met = stored(pair.select(F.col("a_th").alias("th"), F.col("b_th").alias("hub")).distinct(), "met")
    # Their prefixes tell more, at a tenth of the sets' bytes: what two sets share is in both prefixes, or beyond the prefix
    # that ends first. Members whose keys are equal are counted as shared, so no pair is lost by short keys.
    both = met.join(lists.select("th", F.col("size").alias("a_size"), F.col("keys").alias("a")), "th").join(lists.select(F.col("th").alias("hub"), F.col("size").alias("b_size"), F.col("keys").alias("b")), "hub")
    n = F.size(F.array_intersect("a", "b")) + F.size("a") - F.size(F.array_distinct("a"))
    beyond = F.ceil(similarity * F.greatest("a_size", "b_size") - 1e-9) - 1
    rest = stored(both.filter((n + beyond) * (1 + similarity) >= need).select("th", "hub"), "rest")

    edges = first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(close(rest))
    final = components(edges)
    named = distinct.join(final, distinct["fp"] == final["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    # Stored before it is joined, so that Spark can split the partition of a text that very many documents share.
    by_print = stored(named.join(least, "root").select("fp", "component_id"), "components")
    return rows.select("doc_id", "fp").join(by_print, "fp").select("doc_id", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns; of each group of near duplicates the row with the smallest (id, hash of the text) stays, once."""
    th, left, right = spare(df, "_th"), spare(df, "_left"), spare(df, "_right")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"))
    groups = stored(similar_groups(df.select(key.alias("doc_id"), F.col(text_col).alias("text")), **options), "groups")
    gone = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id.id").alias(left), F.col("doc_id.th").alias(right)).distinct()
    gone = sized(stored(gone, "gone"))
    keyed = df.withColumn(th, F.xxhash64(F.col(text_col)))
    kept = keyed.join(gone, keyed[id_col].eqNullSafe(gone[left]) & (keyed[th] == gone[right]), "left_anti")
    if not groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():  # rows that repeat a kept one
        kept = kept.dropDuplicates([id_col, th])
    return kept.select(*df.columns)
