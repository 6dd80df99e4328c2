"""Line-first quality rules, made of DataFrame functions only.

Each line is judged by itself (navigation, symbol noise, shouting, boilerplate, missing punctuation); lines that
fail are removed; a document that loses more than `max_loss` of its characters, or that fails the base rules, is
rejected. One narrow pass: no shuffle, no Python.

Repeated three-word windows are found by sorting, in O(n log n): a window's key is 33 bits of its hash over its
position, so that a sort of plain longs brings equal windows together; the few neighbours that agree are sorted
again by the words themselves, which makes the count exact.

Defined results: null and empty texts have no words, counts of zero, base_failed true and kept false. Repeated rows
give repeated results, a null id is an id like any other, and an empty table gives no rows. Other columns of the input are
ignored, whatever they are called. A text that loses exactly `max_loss` of its characters is kept.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
POSITION_BITS = 31
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "enable javascript", "lorem ipsum", "click here", "subscribe to our", "sign up for", "log in to", "copyright (c)",
    "licensed under the", "spdx-license-identifier", "without warranties or conditions", "permission is hereby granted",
    "alle rechte vorbehalten", "datenschutzerklärung", "allgemeine geschäftsbedingungen", "verwendet cookies", "hier klicken",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "utilise des cookies", "cliquez ici",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "utiliza cookies", "haga clic aquí",
)
#: What separates the entries of a menu or a path of pages, beside the symbols.
ARROWS = "»›•·→"


def hints(text: Column) -> Column:
    """What a whole text must hold for some rules to be worth asking of its lines."""
    low = F.lower(text)
    has = lambda phrases, t: reduce(or_, [F.contains(t, F.lit(p)) for p in phrases])
    return F.struct(
        text.rlike(f"[{SYMBOLS}]").alias("symbols"),
        has(ARROWS, text).alias("arrows"),
        F.contains(text, F.lit("!!")).alias("shouts"),
        has(BOILERPLATE, low).alias("boiler"),
    )


def line_fails(line: Column, hint: Column) -> Column:
    """Whether one line is navigation, symbol noise, shouting, boilerplate, or long with no punctuation at all. hint: what
    its text holds; rules that cannot apply are not asked."""
    count = lambda x: (F.length(line) - F.length(F.replace(line, F.lit(x)))) / len(x)
    symbols = (count("|") >= 4) | (F.regexp_count(line, F.lit(f"[{SYMBOLS}]")) * 10 > F.length(F.translate(line, " \t\x0b\x0c\r", "")))
    arrows = F.regexp_count(line, F.lit(f"[{ARROWS}]")) >= 3
    shouting = (count("!!") >= 3) & (F.length(F.regexp_replace(line, r"\p{Lu}+", "")) * 2 < F.length(line))
    boiler = F.lower(line).rlike("|".join(x.replace("(", "\\(").replace(")", "\\)") for x in BOILERPLATE))
    unpunctuated = ~line.rlike(r"[.,;:!?…。！？]") & (F.size(F.array_remove(F.split(line, f"{BLANK}+"), "")) >= 25)
    return (hint.symbols & symbols) | (hint.arrows & arrows) | (hint.shouts & shouting) | (hint.boiler & boiler) | unpunctuated


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_loss: float = 0.5, min_words: int = 50) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed,
    cleaned (the text without its failing lines)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    split = base.select("doc_id", "_t", hints(F.col("_t")).alias("_h"), F.array_remove(F.split("_t", f"{BLANK}+"), "").alias("_w"), F.split("_t", "\n").alias("_l"))
    n = F.size("_w")
    mask = (1 << POSITION_BITS) - 1

    def packed(x: Column, i: Column) -> Column:
        h = F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2))
        return h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))

    keys = F.when(n >= 3, F.sort_array(F.transform(F.slice("_w", 1, F.greatest(n - 2, F.lit(1))), packed)))
    keyed = split.select("doc_id", "_t", "_h", "_w", "_l", keys.alias("_k"))

    def near(x: Column, i: Column) -> Column:
        same = lambda j: F.shiftright(F.get("_k", j), POSITION_BITS) == F.shiftright(x, POSITION_BITS)
        return same(i - 1) | same(i + 1)

    def window(x: Column) -> Column:
        i = x.bitwiseAND(F.lit(mask)).cast("int")
        return F.struct(F.get("_w", i).alias("a"), F.get("_w", i + 1).alias("b"), F.get("_w", i + 2).alias("c"), i.alias("i"))

    maybe = keyed.select("doc_id", "_t", "_h", "_w", "_l", F.sort_array(F.transform(F.filter("_k", near), window)).alias("_e"))

    def twice(x: Column, i: Column) -> Column:
        def same(j: Column) -> Column:
            y = F.get("_e", j)
            return (y.a == x.a) & (y.b == x.b) & (y.c == x.c)

        return same(i - 1) | same(i + 1)

    places = maybe.select("doc_id", "_t", "_h", "_w", "_l", F.sort_array(F.transform(F.filter("_e", twice), lambda x: x.i)).alias("_q"))
    gaps = F.transform("_q", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_q", i + 1) - x, F.lit(3))).cast("long"))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))
    solid = F.filter("_l", lambda x: x.rlike(WORD))
    counted = places.select(
        "doc_id", "_t",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        solid.alias("_s"),
        covered.alias("n_repeat_words"),
        F.filter("_l", lambda x: ~line_fails(x, F.col("_h"))).alias("_good"),
        F.size("_l").alias("_lines"),
    )
    last = counted.select(
        "doc_id", "_t", "n_words", "word_chars", "n_symbols",
        (F.size("_s") - F.size(F.array_distinct("_s"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.array_join("_good", "\n").alias("cleaned"),
        (F.col("_lines") - F.size("_good")).cast("long").alias("n_lines_removed"),
    )
    rest = F.length(F.translate("cleaned", " \t\n\x0b\x0c\r", ""))
    enough = (F.col("n_lines_removed") == 0) | (rest >= (1 - max_loss) * F.col("word_chars"))
    return last.withColumn("kept", ~F.col("base_failed") & enough).drop("_t")
