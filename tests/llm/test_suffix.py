import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from querywright.llm import suffix


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


def check(spark, texts, length=40, gram=12, **options):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, m string").repartition(4)
    got = suffix.removal_digests(df, length=length, gram=gram, **options).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts, length)


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array(seed):
    rng = random.Random(seed)
    s = np.array([rng.randint(1, rng.choice([1, 2, 5, 300])) for _ in range(rng.randint(1, 300))], dtype=np.int64)
    assert suffix.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("n", range(1, 9))
def test_suffix_array_of_short_and_equal_symbols(n):
    assert suffix.suffix_array(np.ones(n, dtype=np.int64)).tolist() == list(range(n))[::-1]


def test_suffix_array_of_large_symbols():
    s = np.random.default_rng(1).integers(1, 1 << 40, 500)
    assert suffix.suffix_array(s).tolist() == sorted(range(500), key=lambda i: s[i:].tolist())


def make(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    passage = [" ".join(word() for _ in range(rng.randint(4, 40))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        if rng.random() < 0.6:
            p = rng.choice(passage)
            parts.insert(rng.randint(0, 3), p[rng.randint(0, 20) :])
        out.append(" ".join(parts))
    return [*out, out[0], out[0], None, "", "short", "ab" * 200, "x" * 39, "x" * 40, "x" * 41, "q" * 39, "z" * 40, "yz" * 19 + "y"]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    check(spark, make(seed))


def test_salted_marks(spark):
    """A passage in many documents with different surroundings: its marks are dealt over salts, and names join them."""
    rng = random.Random(5)
    core = "".join(rng.choices("abcdefgh", k=70))
    texts = ["".join(rng.choices("abcdefgh", k=30)) + core[rng.randint(0, 10) :] + "".join(rng.choices("abcdefgh", k=30)) for _ in range(120)]
    check(spark, texts + make(7, 20), bucket=4)


def test_segments_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 256)
    check(spark, [*make(9, 20), "".join(random.Random(1).choices("ab", k=3000))])


def test_repeated_rows_and_null_ids(spark):
    text = "".join(random.Random(2).choices("abcdefgh", k=120))
    other = "".join(random.Random(3).choices("abcdefgh", k=120))
    df = spark.createDataFrame([(1, text), (1, text), (None, other), (None, other[:100]), (2, "".join(random.Random(4).choices("abcdefgh", k=90)))], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix.removal_digests(df, length=40, gram=12).collect())
    assert got == [(0, 100, 100), (0, 120, 100), (1, 120, 120), (1, 120, 120), (2, 90, 0)]


def test_empty_table_and_driver_rows(spark, data):
    assert suffix.removal_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    texts = [r["text"] for r in df.collect()]
    got = suffix.removal_digests(df).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts, 200)


def test_without_repeats_keeps_whole_characters(spark):
    shared = "é" * 30
    df = spark.createDataFrame([(1, "a" + shared + "b", "s"), (2, "cc" + shared + "d", "t"), (3, None, "u")], "doc_id long, text string, source string")
    got = [tuple(r) for r in suffix.without_repeats(df, length=40, gram=12).orderBy("doc_id").collect()]
    assert got == [(1, "ab", "s"), (2, "ccd", "t"), (3, None, "u")]
