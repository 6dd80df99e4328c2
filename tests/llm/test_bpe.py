import hashlib
import random

import numpy as np
import pytest

from querywright.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
POOL = [chr(c) for r in ((9, 14), (28, 33), (0x80, 0x300), (0x300, 0x530), (0x2000, 0x2070), (0x660, 0x670), (0x4E00, 0x4E40), (0x1D400, 0x1D420), (0x1F600, 0x1F640), (0x2150, 0x2190)) for c in range(*r)] + list(" '  abstrelvmd0129.,<|>_") * 20


@pytest.fixture(scope="module")
def path():
    return bpe.default_path()


@pytest.fixture(scope="module")
def library(path):
    return tokenizers.Tokenizer.from_file(path)


def texts(n, seed=0):
    rng = random.Random(seed)
    for _ in range(n):
        t = "".join(rng.choice(POOL) for _ in range(rng.randint(0, 40)))
        yield t + ("<|endoftext|>" + t[:5] if rng.random() < 0.1 else "")


def test_equals_the_library(path, library):
    found = list(texts(3000)) + ["a" * 3000, " " * 2000 + "x", "!?" * 1000, "é" * 300, None, "", "don't we'll"]
    e = bpe.Encoder(path, bpe.compile_lexicon([" the", "don", " a", "é" * 4, " the"], path))
    for t, ids in zip(found, e.encode(found), strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids.tolist() == want and e.decode(ids) == library.decode(want, skip_special_tokens=False) == (t or "")


def test_memo_may_be_emptied(path, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    e = bpe.Encoder(path)
    for t in texts(300, 5):
        assert e.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["nation", "station", "ration", "nations", "stations", "rations", "a", "an", ""]) if w}
    lex = bpe.Lexicon.mapped(bpe.Lexicon.build(words).to_bytes())
    found = lex.lookup(list(words))
    assert all(lex.sequence(i) == words[w] for w, i in zip(words, found.tolist(), strict=True))
    assert (lex.lookup([b"", b"nat", b"nationss", b"zzz", b"n"]) == -1).all()
    # Suffixes are shared: right languages differ, so states are as many as distinct right languages.
    suffixes = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:k] for k in range(len(w) + 1))}
    assert len(lex.first) - 1 == len(suffixes)
    empty = bpe.Lexicon.mapped(bpe.Lexicon.build({}).to_bytes())
    assert empty.lookup([b"a"]).tolist() == [-1]


def test_merging_in_bulk_equals_merging_alone(path):
    v = bpe.Vocabulary(path)
    rng = random.Random(2)
    words = [bytes(rng.choice(b" aeinrst\xc3\xa9") for _ in range(rng.randint(1, 48))) for _ in range(2000)]
    assert v.merge(words) == [v.merge_long(w) for w in words]


def test_joined_strings_in_blocks():
    table = bpe._strings([b"a", b"", b"ccc"])
    found = [np.array(x, dtype=np.uint32) for x in ([0, 2], [], [2] * 9, [1, 1], [0] * 3, [0, 1, 2] * 4)]
    want = [b"".join([b"a", b"", b"ccc"][i] for i in x.tolist()) for x in found]
    assert bpe._joined(found, *table, block=4) == bpe._joined(found, *table) == want and bpe._joined([], *table) == []


def test_frequent_words(spark):
    df = spark.createDataFrame([(1, "x x x y y z"), (2, None), (3, "x y")], "doc_id long, text string")
    assert bpe.frequent_words(df, max_words=2) == [" y"]  # of " x" and "x", which come as often, neither or both
    assert bpe.frequent_words(df, max_words=3) == [" x", " y", "x"]
    assert bpe.frequent_words(df.limit(0)) == []


def test_query(spark, path, library):
    rows = [*enumerate(texts(50, 9)), (50, None), (51, "word " * 20_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in bpe.encode_decode(df, path, bpe.lexicon_of(spark, df, path)).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), path, bpe.compile_lexicon([], path)).count() == 0
    assert np.all([len(r) == 4 for r in got.values()])
