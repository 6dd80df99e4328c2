import re
from collections import Counter

from pyspark.sql import functions as F

from querywright.llm.quality import quality_rules


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


CLEAN = "\n".join(f"Sentence number {i} tells of thing {i * 7} and place {i * 13}." for i in range(12))
TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c", "a a a a", "x y z\n\nx y z\nx y z \r\nq", "é ü ß 𝒳 b\x0bc\x0cd\x1ce", "#*$%&|<> ### |", CLEAN,
    CLEAN + "\nhome | about | shop | news | contact\nAll rights reserved.", "\n".join(["home | about | shop | news | contact"] * 30),
    "word " * 3000, " ".join(str(i) for i in range(60_000)), "\n".join("THIS!! IS!! LOUD!! LINE!! NUMBER!! " + chr(65 + i) for i in range(20)),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality_rules(df).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t), i
    assert got[9]["kept"] and got[9]["n_lines_removed"] == 0
    assert got[10]["kept"] and got[10]["n_lines_removed"] == 2 and got[10]["cleaned"] == CLEAN
    assert not got[11]["kept"] and not got[14]["kept"] and not got[0]["kept"]


def test_lines_of_other_languages(spark):
    lines = ["Start » Laden » Bücher » Romane", "Accueil • Boutique • Presse • Contact", "Inicio · Tienda · Prensa · Contacto", "TODOS LOS DERECHOS RESERVADOS", "© 2020 Tous droits réservés", "Mehr in der Datenschutzerklärung"]
    good = ["L'heure est venue · il part.", "Ein Satz » mit Zeichen « endet hier."]
    df = spark.createDataFrame([(None, "\n".join([CLEAN, *lines, *good]))], "doc_id long, text string")
    (r,) = quality_rules(df).collect()
    assert r["kept"] and r["n_lines_removed"] == len(lines) and r["cleaned"] == "\n".join([CLEAN, *good])


def test_driver_rows(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    for r, t in zip(quality_rules(df).orderBy("doc_id").collect(), df.orderBy("doc_id").collect(), strict=True):
        assert tuple(r)[1:7] == base(t["text"])


def test_no_shuffle_and_no_python(spark, data):
    plan = quality_rules(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
