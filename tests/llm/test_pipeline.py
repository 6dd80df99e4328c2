import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark):
    base = "\n".join(f"Line {i} says that number {i * 17} follows number {i * 5}." for i in range(40))
    other = "\n".join(f"Row {i} holds {i * 31} apples and {i * 3} pears of kind {i * i}." for i in range(40))
    shared = " ".join(f"shared{i}" for i in range(60))
    rows = [
        (0, base, "en"), (1, base, "en"), (2, base.replace("number 17 ", "count 17 "), None), (3, None, "en"), (4, "12 34", "en"), (5, "", None),
        (6, other + " " + shared, "en"), (7, shared + " unlike anything else in here at all, mail a@b.co or call +1 415 555 2671", "en"), (8, "short clean text", "en"), (9, "short clean text", "en"),
    ]
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)


def test_stages(spark, tmp_path):
    df, kept = docs(spark), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        df = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(sorted(r["doc_id"] for r in df.select("doc_id").distinct().collect()))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if i == 2:
            texts = {r["doc_id"]: r["text"] for r in df.collect()}
            assert "shared30" not in texts[6] and "shared30" not in texts[7] and "unlike anything" in texts[7] and texts[8] == "short clean text"
        if i == 3:
            assert "<EMAIL>" in {r["doc_id"]: r["text"] for r in df.collect()}[7]
            assert all(r["n_chars"] == len(r["text"]) for r in df.collect())
    assert kept[0] == [0, 1, 2, 6, 7, 8, 9] and kept[1] == [0, 6, 7, 8] and kept[2:] == [[0, 6, 7, 8]] * 3


def test_run_on_driver_rows(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    used: dict = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert rows and all(sum(n for _, n in x) <= 2048 for x in used.values())


def test_run_over_odd_rows(spark, tmp_path):
    """Null ids, repeated rows, a very long text and columns that clash with the stages' own names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [(None, "a row without an id that says little", "en"), (1, "the same row twice over", "en"), (1, "the same row twice over", "en"), (2, long, None), (3, None, None), (4, "one more text of a few words", "en")]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or ""), 7, "x") for i, t, lang in rows], SCHEMA + ", piece int, _th string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] for r in got}, key=repr) == [1, 2, 4, None]
    assert len({r["piece"] for r in got if r["doc_id"] == 2}) > 20 and sum(r["doc_id"] == 1 for r in got) == 1


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
