import hashlib
import random
import re

import pytest

from querywright.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(t):
    out = {}
    for kind, p in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]
            if ok():
                out[kind].append(m.span())
    return out


@pytest.mark.parametrize("letters", ["ab@.+-1 2(@4)9._%é\n", "4111 -.+10", "0.25@a-+"])
def test_base_spans_equal_the_patterns(letters):
    rng = random.Random(letters)
    for _ in range(8000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == brute(t), t


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("mail jane at example dot co dot uk now", "email", "jane at example dot co dot uk"),
        ("x jоhn＠exаmple．com y", "email", "jоhn＠exаmple．com"),
        ("b​ob@ex​ample.com", "email", "b​ob@ex​ample.com"),
        ("b​ob@ample.com", "email", None),
        ("write to john%40example.com now", "email", "john%40example.com"),
        ("write to a&#64;b&#46;org now", "email", "a&#64;b&#46;org"),
        ("write to john_at_example_dot_com now", "email", "john_at_example_dot_com"),
        ("call plus four one five five five five two six seven one.", "phone", "plus four one five five five five two six seven one"),
        ("ip one nine two dot one six eight dot one dot one ok", "ip", "one nine two dot one six eight dot one dot one"),
        ("host １９２．１６８．０．１ ok", "ip", "１９２．１６８．０．１"),
        ("pay 4111 1111 1111 llll now", "card", "4111 1111 1111 llll"),
        ("pay vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "card", "vier" + " eins" * 15),
    ],
)
def test_disguises(text, kind, span):
    base, more = pii.all_spans(text)
    if span is None:
        assert base[kind] and not more[kind]
        return
    assert not base[kind] and [text[a:b] for a, b in more[kind]] == [span]
    assert pii.redacted(text) == text.replace(span, f"<{kind.upper()}>")


def test_transducers_take_the_longest_rule_and_whole_words():
    t = pii.Transducer({"one": "1", "oneone": "11", "eight": "8"}, words=True)
    assert t.edits("Oneone one_EIGHT stone onex", 0, 27) == [(0, 6, "11"), (7, 10, "1"), (11, 16, "8")]
    assert pii._VALUES.edits("x19two", 0, 6) == [(1, 2, "1"), (2, 3, "9"), (3, 6, "2")]


def test_prefilters_lose_nothing(monkeypatch):
    """The texts that are passed by are those whose patterns find nothing."""
    rng = random.Random(11)
    parts = ["one", " two", "three-", " four", "five ", " six", "seven", "eight", " nine", " zero", " dot ", " [dot] ", " punto ", "192", "168", "0", "1", ".", "[.]", " ( . ) ", "x.y", "a.1", "1.b", "@", " @ ", " at ", " [at] ", "john", "com", "&#64;", "%40", "_at_", "_dot_", "+1", "plus ", "O0Il", "é", "а", "\u200b", "\xa0", "\n", "_.", "9.9.9.9", "eight.eight.8.8", "ex%2ecom"]
    made = ["".join(rng.choices(parts, k=rng.randint(2, 25))) for _ in range(6000)]
    got = [pii.hidden_spans(t, pii.base_spans(t)) for t in made]

    class All:
        def __init__(self, t):
            self.digits = self.mail = self.dots = True

    monkeypatch.setattr(pii, "Triggers", All)
    monkeypatch.setattr(pii, "_strange", lambda t: any(ord(c) in pii._KNOWN for c in t))
    assert got == [pii.hidden_spans(t, pii.base_spans(t)) for t in made] and sum(any(x.values()) for x in got) > 500


@pytest.mark.parametrize("text", ["Meet at noon dot", "one two three", "see you at home. The dot is red", "look at example.com", "на 12 дней", "version 1.2.3", "at a dot b", "look_at_me.py", "5%405.2", "see x [at] y [dot] 5", "the one at the top dot"])
def test_clean_texts_stay(text):
    assert pii.redacted(text) == text


def test_runs_are_linear():
    for t in ("1" * 200_000, "a" * 200_000, "a." * 100_000, "1." * 100_000, "+1 " * 60_000, "@a" * 100_000, "one " * 50_000, "[at] " * 40_000):
        pii.all_spans(t)


def test_query(spark):
    texts = [None, "", "a@b.co and 10.0.0.1", "x [at] y [dot] zz", "a@b.co and 10.0.0.1", "+1 (415) 555-2671 4111 1111 1111 1111"]
    rows = pii.find_pii(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        want = brute(t or "")
        line = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS] and r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
    assert rows[3]["spans"] == "email:0:17" and rows[3]["n_added"] == 1 and rows[2]["spans"] == "email:0:6,ip:11:19"
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_redact_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "to a@b.co", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in pii.redact(df).orderBy("doc_id").collect()] == [(1, "to <EMAIL>", "s"), (2, None, None)]


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("host one two seven dot zero dot zero dot one ok", "one two seven dot zero dot zero dot one"),
        ("dns eight dot eight dot eight dot eight.", "eight dot eight dot eight dot eight"),
        ("to 192[.]168[.]0[.]1 now", "192[.]168[.]0[.]1"),
        ("to 192.168[.]0.1 now", "192.168[.]0.1"),
        ("to 192 ( dot ) 168 {.} 0 <punto> 1 now", "192 ( dot ) 168 {.} 0 <punto> 1"),
        ("to 192 dot 168 dot 0 dot 1 now", "192 dot 168 dot 0 dot 1"),
        ("to 192 dot 168 dot zero dot one now", "192 dot 168 dot zero dot one"),
        ("to 10&#46;0&#x2e;0&period;1 now", "10&#46;0&#x2e;0&period;1"),
        ("to 10%2e0%2E0_dot_1 now", "10%2e0%2E0_dot_1"),
        ("to eins null Punkt null Punkt null Punkt eins", "eins null Punkt null Punkt null Punkt eins"),
        ("room nine 192 dot 168 dot 0 dot 1 now", "192 dot 168 dot 0 dot 1"),
        ("9 dot 999 dot 1 dot 2 dot 3 dot 4 now", "1 dot 2 dot 3 dot 4"),
    ],
)
def test_disguised_ips(text, span):
    base, more = pii.all_spans(text)
    assert not base["ip"] and [text[a:b] for a, b in more["ip"]] == [span]
    assert pii.redacted(text) == text.replace(span, "<IP>")


@pytest.mark.parametrize("text", ["192[.]168[.]0", "300 dot 1 dot 1 dot 1", "1 dot 2 dot 3", "the point is: one. Two. Three. Four.", "1. 2. 3. 4.", "one of nine points"])
def test_no_ips(text):
    assert pii.redacted(text) == text


def test_disguised_ips_are_linear():
    for t in ("one dot " * 25_000, "1 " * 100_000 + "dot", "dot" + "1[" * 100_000, "dot 1" + " " * 200_000, "one\n" * 50_000 + " dot ", "999 dot " * 25_000):
        pii.all_spans(t)


@pytest.mark.parametrize(("text", "span"), [("write to john @ example.com", "john @ example.com"), ("to john@ example.com now", "john@ example.com"), ("to john @example.com now", "john @example.com")])
def test_spaced_at_signs(text, span):
    assert pii.redacted(text) == text.replace(span, "<EMAIL>")


def test_prefilter_of_mails_loses_nothing(monkeypatch):
    parts = ["john", "example", "com", "@", " ", "\t", ".", "[at]", "(dot)", "[.]", " at ", " dot ", " arroba ", "&#64;", "&#46;", "%40", "%2E", "_at_", "_dot_", "{ @ }", " punto "]
    rng = random.Random(12)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(3, 9))) for _ in range(40_000)]
    got = [pii._mail_edits(t) for t in texts]
    monkeypatch.setattr(pii, "_HINT", re.compile(""))
    assert sum(map(bool, got)) > 100 and got == [pii._mail_edits(t) for t in texts]
