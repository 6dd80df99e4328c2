import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from querywright.llm import langid


def samples(n, seed=0):
    rng = random.Random(seed)
    parts = {"xx": ["ka", "lo", "mi", "tu", "re"], "yy": ["brü", "sch", "ein", "ung", "ach"], "zz": ["éau", "que", "ois", "ent", "ère"]}
    make = lambda lang, k: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(k))
    return [(i, make(lang := rng.choice(list(parts)), rng.randint(20, 200)), lang) for i in range(n)], make


def test_held_out_accuracy_and_edges(spark):
    rows, _ = samples(400)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(df.filter(~langid.held_out()), docs_per_lang=60)
    edges = [(1000, None, None), (1001, "", "xx"), (1002, "12 34 !?", "xx"), (1003, "KALOMI TURE KALO", None), (1004, "ka" * 30_000, None)]
    got = {r["doc_id"]: r for r in langid.identify(df.select("doc_id", "text").unionAll(spark.createDataFrame(edges, "doc_id long, text string, lang string").select("doc_id", "text")), model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows]) > 0.99
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002)) and got[1003]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_mixtures_are_found(spark):
    rows, make = samples(300)
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = make("xx", 150) + " " + make("yy", 50)
    (found,) = model.mixtures([mixed])
    assert [x for x, _ in found] == ["xx", "yy"] and abs(found[0][1] - 0.75) < 0.1
    assert [len(m) for m in model.mixtures([make("zz", 100), "éau"])] == [1, 1]


def brute_mixture(model, text):
    """The method word by word: EM over each nested set of languages, taken while the penalised likelihood grows."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    n = len(model.langs)
    if not words:
        return []
    rows = []
    for w in words:
        logs = [0.0] * n
        for t in langid.trigrams([w])[0]:
            logs = [a + float(b) * langid.POWER for a, b in zip(logs, model.logp[t], strict=True)]
        rows.append([math.exp(max(x - max(logs), -50.0)) for x in logs])

    def em(allowed):
        pi = [1 / len(allowed) if j in allowed else 0.0 for j in range(n)]
        for _ in range(langid.ROUNDS):
            new = [0.0] * n
            for r in rows:
                mix = sum(p * x for p, x in zip(pi, r, strict=True))
                new = [a + p * x / mix / len(rows) for a, p, x in zip(new, pi, r, strict=True)]
            pi = new
        return pi, sum(math.log(sum(p * x for p, x in zip(pi, r, strict=True))) for r in rows)

    single = [sum(math.log(r[j]) for r in rows) for j in range(n)]
    first = single.index(max(single))
    best, value = [float(j == first) for j in range(n)], max(single)
    full = em(set(range(n)))[0]
    order = sorted(range(n), key=lambda j: -full[j])
    for k in range(2, n + 1):
        pi, score = em(set(order[:k]))
        if score <= value + langid.PENALTY * math.log1p(len(rows)):
            break
        best, value = pi, score
    return [(model.langs[j], best[j]) for j in sorted(range(n), key=lambda j: -best[j]) if best[j] > 0]


def test_mixtures_against_brute_force(spark):
    """Texts of one, two and three languages, short ones, ties of equal words and texts without a language."""
    rows, make = samples(300)
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [make(a, i) + " " + make(b, j) + " " + make(c, k) for a, b, c in (("xx", "yy", "zz"), ("zz", "xx", "xx"), ("yy", "yy", "yy")) for i, j, k in ((1, 0, 0), (2, 1, 0), (20, 5, 0), (60, 20, 9), (9, 9, 9), (150, 3, 2))]
    texts += ["", "12", "ka", "ka ka ka brü brü brü", None, "q", *[t for _, t, _ in rows[:20]]]
    for t, got in zip(texts, model.mixtures(texts), strict=True):
        want = brute_mixture(model, t or "")
        assert [x for x, _ in got] == [x for x, _ in want] and all(abs(p - q) < 1e-6 for (_, p), (_, q) in zip(got, want, strict=True)), t


def test_empty_and_repeated_rows(spark):
    rows, _ = samples(120)
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(None, rows[0][1]), (1, rows[0][1]), (1, rows[0][1])], "doc_id long, text string")
    got = langid.identify(df, model).collect()
    assert len(got) == 3 and len({tuple(r)[1:] for r in got}) == 1
    assert langid.identify(df.limit(0), model).count() == 0 and langid.with_language(df.limit(0), model).columns == ["doc_id", "text", "lang_pred"]


def test_result_does_not_depend_on_neighbours(spark):
    rows, make = samples(200)
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [t for _, t, _ in rows]
    assert model.mixtures(texts)[7] == model.mixtures([texts[7]])[0] == model.mixtures(texts[::-1])[-8]


def test_nothing_to_learn_from(spark):
    model = langid.fit(spark.createDataFrame([(1, "a", None), (2, None, "xx")], "doc_id long, text string, lang string"))
    assert langid.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first()["lang_pred"] == "und"
    assert langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string")).langs == []


def test_fit_ignores_partitioning(spark):
    df = spark.createDataFrame(samples(200)[0], "doc_id long, text string, lang string")
    a, b = langid.fit(df.repartition(1), docs_per_lang=20), langid.fit(df.repartition(7), docs_per_lang=20)
    assert a.langs == b.langs and np.array_equal(a.logp, b.logp)


def test_driver_rows(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(df.filter(~langid.held_out()))
    got = langid.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").filter(langid.held_out()).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got if r["lang"]]) > 0.97


def test_small_shares_of_long_texts_are_found(spark):
    """The penalised likelihood alone decides, whatever the share."""
    rows, make = samples(300)
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    (found,) = model.mixtures([make("xx", 60_000) + " " + make("yy", 300)])
    assert [x for x, _ in found] == ["xx", "yy"] and abs(found[1][1] - 0.005) < 0.002
    assert [len(m) for m in model.mixtures([make("xx", 60_000)])] == [1]
