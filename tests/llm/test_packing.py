import random
import zlib

import numpy as np
import pytest

from querywright.llm import packing

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("seed", range(8))
def test_plans_use_every_piece_once_within_the_cap(seed):
    rng = random.Random(seed)
    cap = rng.choice([8, 64, 2048])
    counts = np.zeros(cap + 1, dtype=np.int64)
    for _ in range(rng.randint(0, 3000)):
        counts[min(cap, max(1, int(rng.lognormvariate(np.log(cap / 4), 1))))] += rng.choice([1, 1, 1, 50])
    made = packing.plan(counts)
    used = np.zeros_like(counts)
    for lengths, times in made:
        assert sum(lengths) <= cap and times > 0
        np.add.at(used, lengths, times)
    assert (used == counts).all()
    total = int((counts * np.arange(cap + 1)).sum())
    if counts[1 : cap // 8].sum() > 100:
        assert sum(t for _, t in made) <= 1.01 * -(-total // cap) + 1


def test_two_fit_beats_greedy():
    counts = np.zeros(11, dtype=np.int64)
    counts[[6, 3, 2]] = 1, 1, 2  # greedy takes 6 + 3; 6 + 2 + 2 is full
    assert packing.plan(counts)[0] == ([6, 2, 2], 1)


def test_plan_of_many_pieces_is_short():
    counts = np.full(2049, 10**9, dtype=np.int64)
    counts[0] = 0
    assert len(packing.plan(counts)) < 20_000


def test_query(spark):
    library = tokenizers.Tokenizer.from_file(packing_path())
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "of", "naïve", "xylophone", "and"], k=rng.choice([0, 1, 10, 300, 5000]))) for _ in range(80)] + [None, "", "same", "same"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, piece string")
    rows = packing.best_two_fit(df, packing_path()).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            assert r["length"] == 2048 or k == 0
            at += r["length"]
        assert at == len(ids)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 1
    assert packing.best_two_fit(df.limit(0), packing_path()).count() == 0


def test_places_do_not_depend_on_the_plan_around(spark):
    """As the second side of a union, and with partitions put together, the same places; columns of these names are replaced."""
    rows = [(i, 0, 1 + i * 37 % 64, "x", 5) for i in range(300)] + [(None, 0, 10, "x", 5), (7, 0, 9, "again", 5), (7, 0, 9, "again", 5)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, sequence_id string, offset int").repartition(7)
    made = packing.pack(df, 64)
    other = made.limit(0).unionByName(spark.createDataFrame([(None, -1, None, None, None)] * 5, made.schema).repartition(3))
    for plan in (made, other.unionByName(made).filter("piece = 0"), made.coalesce(1), made.repartition(5)):
        got = plan.collect()
        assert sorted(r["length"] for r in got) == sorted(r[2] for r in rows)
        bins: dict = {}
        for r in got:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for found in bins.values():
            at = 0
            for offset, length in sorted(found):
                assert offset == at
                at += length
            assert at <= 64


def brute_best_two_fit(lengths, cap):
    """The method over single pieces: greedy, longest first; the smallest document goes back if two fit its gap more tightly."""
    left, bins = sorted(lengths, reverse=True), 0
    while left:
        found, gap = [left.pop(0)], cap
        gap -= found[0]
        for n in list(left):
            if n <= gap:
                left.remove(n)
                found.append(n)
                gap -= n
        if gap and len(found) > 1:
            least = found[-1]
            pool = sorted([*left, least])
            pairs = [(x + y, -x) for i, y in enumerate(pool) for x in pool[i + 1 :] if x + y <= gap + least]
            if pairs and max(pairs)[0] > least:
                x = -max(pairs)[1]
                y = max(pairs)[0] - x
                left.append(least)
                left.remove(x)
                left.remove(y)
                left.sort(reverse=True)
        bins += 1
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_as_short_as_the_method_over_single_pieces(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 64) for _ in range(rng.choice([5, 60, 250]))]
    counts = np.bincount(lengths, minlength=65).astype(np.int64)
    assert sum(t for _, t in packing.plan(counts)) <= brute_best_two_fit(lengths, 64) + 1


def packing_path():
    from querywright.llm.bpe import default_path

    return default_path()
