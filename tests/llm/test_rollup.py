from concurrent.futures import ThreadPoolExecutor

import pytest

from querywright.llm import rollup
from querywright.llm.common import fresh_dir

CHANGE = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"


def totals(store):
    return {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()}


def test_signed_batches(spark):
    store = rollup.Rollup(spark, fresh_dir(spark, "rollup-test"))
    batch = lambda *rows: spark.createDataFrame(list(rows), CHANGE)
    assert store.commit("a", batch(("insert", "s", "en", "v1", 10, None), ("insert", "s", "en", "v1", 5, None), ("insert", None, None, "v1", None, None)))
    assert totals(store) == {("s", "en", "v1"): (2, 15), (None, None, "v1"): (1, 0)}
    assert store.commit("b", batch(("delete", "s", "en", "v1", 5, None), ("revise", "s", "en", "v1", 12, 10), ("delete", None, None, "v1", 0, None)))
    assert totals(store) == {("s", "en", "v1"): (1, 12)}
    assert not store.commit("a", batch(("insert", "s", "en", "v1", 10, None))) and totals(store) == {("s", "en", "v1"): (1, 12)}
    assert store.commit("empty", batch(("insert", "s", "en", "v1", 1, None)).limit(0)) and totals(store) == {("s", "en", "v1"): (1, 12)}


def test_unfinished_batches_do_not_count(spark):
    path = fresh_dir(spark, "rollup-test")
    store = rollup.Rollup(spark, path)
    store.commit("a", spark.createDataFrame([("insert", "s", "en", "v1", 10, None)], CHANGE))
    spark.createDataFrame([("s", "en", "v1", 9, 9)], rollup.DELTA).write.parquet(f"{path}/temporary/left-over")
    assert totals(store) == {("s", "en", "v1"): (1, 10)}


def test_writers_that_race_count_once(spark):
    """Each writer sees no committed attempt before it writes; one attempt counts afterwards."""
    path = fresh_dir(spark, "rollup-test")
    changes = spark.createDataFrame([("insert", "s", "en", "v1", 10, None)], CHANGE)

    class Late(rollup.Rollup):
        def committed(self, batch_id):
            return False

    assert rollup.Rollup(spark, path).commit("a/b c", changes)
    first = rollup.Rollup(spark, path)
    assert first.committed("a/b c") and not first.committed("a")
    for _ in range(3):
        Late(spark, path).commit("a/b c", changes)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: Late(spark, path).commit("c", changes), range(4)))
    assert totals(first) == {("s", "en", "v1"): (2, 20)}


def test_corpus_edge_rows(spark):
    """Null ids, sources and texts, ties of ids, clashing columns, an empty table and one very long text."""
    public = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rows = [(1, "a b", "s", "en"), (1, "a b", "s", "en"), (2, "a b", None, "en"), (None, "a b", "s", None), (None, None, "s", "en"), (3, None, "s", "en"), (4, "", "s", "en"), (5, "word " * 200_000, "s", "en")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, lang string, n_tokens long")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in rollup.corpus_rollup(df, public, fresh_dir(spark, "rollup-test")).collect()}
    assert got[("s", "en", "words-1")] == (5, 2 + 2 + 0 + 0 + 200_000) and got[("s", None, "words-1")] == (1, 2)
    assert (None, "en", "words-1") not in got and got[("s", "en", "bpe50k-1")][0] == 5
    assert rollup.corpus_rollup(df.limit(0), public, fresh_dir(spark, "rollup-test")).count() == 0


def test_corpus(spark, data):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(public)
    df = spark.read.parquet(f"{data}/documents.parquet")
    df = df.unionByName(df.limit(3).withColumn("doc_id", df["doc_id"] + 10_000)).unionByName(df.limit(1).selectExpr("doc_id + 20000 AS doc_id", "CAST(NULL AS string) AS text", "lang", "CAST(NULL AS string) AS source", "n_chars"))
    want: dict = {}
    seen = set()
    for r in df.orderBy("doc_id").collect():
        t = r["text"] or ""
        if t in seen:
            continue
        seen.add(t)
        for version, n in (("words-1", len(t.encode().split())), ("bpe50k-1", len(library.encode(t, add_special_tokens=False).ids) + 1)):
            k = (r["source"], r["lang"], version)
            a, b = want.get(k, (0, 0))
            want[k] = (a + 1, b + n)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in rollup.corpus_rollup(df, public, fresh_dir(spark, "rollup-test")).collect()}
    assert got == want
