import random
import re

import numpy as np
import pytest
import xxhash

from querywright.llm import simhash as S


def brute_print(t):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[j : j + 3]), 42) for j in range(len(words) - 2)] or ([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [])
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(prints, bits=2):
    """id -> smallest id reached; prints: (id, fingerprint)."""
    left, out = dict(prints), {}
    for i in sorted(left):
        if i in out:
            continue
        group, front = {i}, [i]
        while front:
            x = front.pop()
            near = [j for j in left if j not in group and (left[j] ^ left[x]).bit_count() <= bits]
            group |= set(near)
            front += near
        out |= dict.fromkeys(group, i)
    return out


@pytest.mark.parametrize("t", [None, "", " \n", "a", "A b", "Ünï Code X\x0by\x0cz", "a a a a a a", "x\x1cy z w q r"])
def test_fingerprints(t):
    assert S.fingerprint(S.shingle_hashes(t, 3)) == brute_print(t)


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(4096, dtype=np.uint64)
    order = codes[np.argsort(S.gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all() and sorted(S.gray_rank(codes).tolist()) == codes.tolist()


def test_hierarchy_finds_all_and_only_near_codes():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 12, dtype=np.uint64)
    codes = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 8, 300, dtype=np.uint64)) for b in base]))
    codes = codes[np.argsort(S.gray_rank(codes))]
    a, b = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2)
    want = sorted(zip(a.tolist(), b.tolist(), strict=True))
    for most in (1 << 17, 5000, 40, 1):
        found = [x for q, c in S.Hierarchy(codes).search(codes, 2, most=most) for x in zip(q.tolist(), c.tolist(), strict=True)]
        assert sorted(found) == want


def dense_codes(n, flips, seed=1):
    """Different codes that are up to `flips` bits from one."""
    rng = np.random.default_rng(seed)
    x = np.full(n * 2, np.uint64(0x123456789ABCDEF0))
    many = rng.integers(0, flips + 1, n * 2)
    for i in range(flips):
        x = np.where(many > i, x ^ (np.uint64(1) << rng.integers(0, 43, n * 2, dtype=np.uint64)), x)
    codes = rng.permutation(np.unique(x))[:n]
    return codes[np.argsort(S.gray_rank(codes))]


def test_labels_of_a_dense_node():
    """Labels that prune the search are those of all pairs; visitors link to homes alone."""
    codes = dense_codes(3000, 9)
    home = np.random.default_rng(2).random(len(codes)) < 0.7
    got = S._linked(np.zeros(len(codes), dtype=np.int64), codes, home, 2)
    a, b = np.nonzero((np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2) & (home[:, None] | home[None, :]))
    assert (got == S._merged(np.arange(len(codes)), a, b)).all() and len(np.unique(got)) > 10


def test_memory_of_a_dense_node():
    """The largest node that is not split, of fingerprints with millions of links, in a few dozen MB."""
    import tracemalloc

    codes = dense_codes(1 << 16, 5)
    tracemalloc.start()
    label = S._linked(np.zeros(len(codes), dtype=np.int64), codes, np.ones(len(codes), dtype=bool), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and (label == label[0]).mean() > 0.9


@pytest.mark.parametrize("node_rows", [1 << 16, 40, 8])
def test_links_of_dense_fingerprints(spark, node_rows):
    """Nodes of any size give the same components; small limits split nodes again and again."""
    rng = random.Random(node_rows)
    prints = set()
    for b in (0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(6))):
        for _ in range(60):
            x = b
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.choice([0, 1, 2, 30, 31, 62, 63, rng.randrange(64)])
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["root"] for r in S.components(S.fingerprint_edges(distinct, 2, node_rows)).collect()}
    want = brute_groups([(x, x & ((1 << 64) - 1)) for x in signed])
    assert {x: got.get(x, x) for x in signed} == want


def test_long_chains_are_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["root"] for r in S.components(chain).collect()} == {0}
    assert S.components(chain.limit(0)).count() == 0


def test_query_against_brute_force(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in df] + [(9001, None), (9002, ""), (9003, "one"), (9004, "ONE"), (9005, df[0]["text"])]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    got = {r["doc_id"]: r for r in S.near_groups(table).select("doc_id", S.hex_fingerprint(S.F.col("fp")).alias("h"), "component_id").collect()}
    prints = [(i, brute_print(t)) for i, t in rows]
    want = brute_groups(prints)
    assert {i: (r["h"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", want[i]) for i, p in prints}


def test_null_ids_and_very_long_texts(spark):
    rows = [(None, "a b c d", 1), (5, "a b c d", 1), (9, "a B c d", 1), (None, "zz yy xx ww", 1), (7, "word other thing " * 100_000, 1), (7, "word other thing " * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_groups(df).collect()), key=repr)
    assert got == sorted([(None, 5), (5, 5), (9, 5), (None, None), (7, 7), (7, 7)], key=repr)


def test_empty_table(spark):
    assert S.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similarity_links(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, families = [], 12
    for f in range(families):
        words = [word() for _ in range(300)]
        for k in range(4):  # copies with three words changed: a similarity of about 0.9
            w = list(words)
            for p in rng.sample(range(300), 3 if k else 0):
                w[p] = word()
            rows.append((f * 10 + k, " ".join(w)))
    rows += [(1000 + i, " ".join(word() for _ in range(200))) for i in range(50)]
    got = {r["doc_id"]: r["component_id"] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[f * 10 + k] == f * 10 for f in range(families) for k in range(4)) >= 46
    assert all(got[1000 + i] == 1000 + i for i in range(50))


@pytest.mark.parametrize("most", [250_000, 0])
def test_one_of_each_keeps_nulls_and_repeats_once(spark, monkeypatch, most):
    """With the keys broadcast, and with both sides shuffled."""
    monkeypatch.setattr("querywright.llm.common.BROADCAST_ROWS", most)
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, long), (2, long), (3, None), (None, "other words here and there again"), (4, "alone " + long[::-1]), (5, "twice the same row"), (5, "twice the same row")]
    kept = S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 1, 3, 4, 5]


def brute_similar(rows, similarity=0.8):
    """id -> smallest id reached over pairs of that similarity (and equal fingerprints are among them here)."""
    sets = {i: set(S.shingle_hashes(t, 5).tolist()) for i, t in rows}
    out = {}
    for i in sorted(sets):
        if i in out:
            continue
        group, front = {i}, [i]
        while front:
            x = front.pop()
            near = [j for j in sets if j not in group and len(sets[j] & sets[x]) >= similarity * len(sets[j] | sets[x])]
            group |= set(near)
            front += near
        out |= dict.fromkeys(group, i)
    return out


def edited(words, n, rng, word):
    """The words with n of them, far from one another, replaced."""
    w = list(words)
    for p in rng.sample(range(2, len(words) // 5), n):
        w[p * 5] = word()
    return w


def test_star_of_1000_variants(spark):
    """Each variant is close to the original alone."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    words = [word() for _ in range(300)]
    rows = [(i, " ".join(edited(words, 5, rng, word) if i != 500 else words)) for i in range(1001)]
    rows += [(2000 + i, " ".join(word() for _ in range(80))) for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_similar(rows)
    assert sum(c == 0 for c in got.values()) == 1001


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(8)
    usual = np.sort(rng.integers(0, 400, 60).astype(np.uint64))
    usual = np.unique(usual)
    place = rng.permutation(len(usual))
    for _ in range(3000):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 40)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 400, rng.integers(0, 4)).astype(np.uint64)]))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(S.prefix(a, 0.8, usual, place), S.prefix(b, 0.8, usual, place)))


@pytest.mark.parametrize("key_rows", [512, 3])
def test_pairs_that_no_sample_links_are_found(spark, monkeypatch, key_rows):
    """Without samples, the prefixes alone find all; keys of any size are split."""
    monkeypatch.setattr(S, "samples", lambda hashes: [])
    monkeypatch.setattr(S, "KEY_ROWS", key_rows)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    words = [word() for _ in range(200)]
    rows = [(i, " ".join(edited(words, rng.randint(2, 5), rng, word) if i else words)) for i in range(60)]
    rows += [(100 + i, " ".join([*words[:40], *(word() for _ in range(100))])) for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_similar(rows)


def test_texts_that_share_a_fingerprint_keep_their_own_shingles(spark, monkeypatch):
    monkeypatch.setattr(S, "fingerprint", lambda hashes: 0 if len(hashes) == 196 else 0xFFFF)
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    first, second = ([word() for _ in range(200)] for _ in range(2))
    rows = [(1, " ".join(first)), (2, " ".join(second)), (3, " ".join(second[:-1]))]
    got = {r["doc_id"]: r["component_id"] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1}
