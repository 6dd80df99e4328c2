"""Personal data: emails, IPv4 addresses, payment cards and phone numbers, plain or disguised.

Plain matches come from the base patterns. For disguised ones, transducers rewrite the text and keep, for each
character of the rewritten text, the range of source characters that it stands for: homoglyphs become ASCII, zero-width
characters go, "[at]" and "dot" become signs, spelled digits become digits. The same detectors then run on the rewritten
text and their spans are mapped back. A found span is added where it overlaps no span of its kind.

A transducer is an automaton over folded characters whose final states have an output. Its rules are ambiguous in plain prose
("at", "one", "point"), so it runs inside guards alone: patterns of what surrounds a disguised address or number.

Every step is linear in the text: runs are found from their rarest character, and no pattern can backtrack across a run.
Defined results: null and empty texts have no spans; offsets count code points; repeated rows give repeated results; null
ids are ids like any other; an empty table gives no rows. Of added spans that overlap one of their kind, the one that is
there first stays. Only the id and the text are read, whatever the other columns are called.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querywright.llm.common import map_chunks, with_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(t: str) -> list[Span]:
    out, last = [], 0
    if "@" not in t:
        return out
    for m in _DOMAIN.finditer(t):
        a = at = m.start()
        while a > last and t[a - 1] in _LOCAL:
            a -= 1
        if a < at:
            out.append((a, last := m.end()))
    return out


def ips(t: str) -> list[Span]:
    small = lambda x: len(x := x.lstrip("0")) < 4 and int(x or "0") < 256
    return [m.span() for m in _IP.finditer(t) if all(map(small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(t: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(t: str) -> list[Span]:
    if "+" not in t:
        return []
    return [m.span() for m in _PHONE.finditer(t) if 8 <= sum(map(str.isdigit, m[0])) <= 15]


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(t: str) -> dict[str, list[Span]]:
    return {k: f(t) for k, f in FINDERS.items()}


# Characters that look like ASCII ones, in pairs.
_LOOKALIKE = "аaеeоoрpсcуyхxіiјjѕsһhԁdԛqԝwгrАAВBЕEКKМMНHОOРPСCТTХXІIЅSοoνvαaρpιiΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX․.。.｡.﹒.﹫@‐-‑-–-—-−-﹢+➕+"
HOMOGLYPHS = {ord(a): b for a, b in zip(_LOOKALIKE[::2], _LOOKALIKE[1::2], strict=True)}
HOMOGLYPHS |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}  # full-width forms
HOMOGLYPHS |= {z + i: str(i) for z in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}  # other digits
HOMOGLYPHS |= {z + i: chr(c + i) for z in (0x1D400, 0x1D5A0, 0x1D5D4, 0x1D670) for c, z in ((65, z), (97, z + 26)) for i in range(26)}  # mathematical letters
HOMOGLYPHS |= {c: " " for c in (0xA0, 0x2007, 0x2009, 0x202F, 0x3000)}
ZERO_WIDTH = "­​‌‍⁠﻿"
#: All strange characters are among these; Western texts have few of them, so one fast search passes most texts by.
_FOREIGN = re.compile("[\xa0\xad\u0100-\U0010ffff]")
_KNOWN = frozenset(HOMOGLYPHS) | frozenset(map(ord, ZERO_WIDTH))
_ZERO = re.compile(f"[{ZERO_WIDTH}]")

# The digits' names in four languages.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGITS = {w: str(i) for words in DIGIT_WORDS for i, w in enumerate(words.split())} | {"oh": "0"}
_W = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_SIGN = r"(?:\s*[\[({<]\s*(?:dot|punkt|point|punto)\s*[\])}>]\s*|\s+(?:dot|punkt|point|punto)\s+)"
#: Seven or more digits, at least the first of them spelled, with an optional plus before and dots between.
_RUN = re.compile(rf"(?i)(?<!\w)(?:(?:plus\s+)|\+\s*)?{_W}(?:(?:{_SIGN}|[\s,.-]{{1,3}})(?:{_W}(?!\w)|[0-9]+)){{3,}}(?!\w)")
#: name [at] host [dot] tld, and name at host dot tld; the two signs may be disguised in different ways.
_AT = r"(?:[ \t]*[\[({<][ \t]*(?:at|@|arroba|ät)[ \t]*[\])}>][ \t]*|[ \t]+(?:at|arroba)[ \t]+|[ \t]?@[ \t]?|&#64;|&#x40;|&commat;|%40|_at_)"
_DOT = r"(?:[ \t]*[\[({<][ \t]*(?:dot|\.|punkt|point|punto)[ \t]*[\])}>][ \t]*|[ \t]+(?:dot|punkt|point|punto)[ \t]+|&#46;|&#x2e;|&period;|%2e|_dot_|\.)"
_MAIL_AT = re.compile(rf"(?i){_AT}")
_MAIL_HOST = re.compile(rf"(?i){_AT}(?=[A-Za-z0-9-]+{_DOT}[A-Za-z0-9-]+)((?:[A-Za-z0-9-]+{_DOT})+)[A-Za-z0-9-]+")
_DOTS = re.compile(rf"(?i){_DOT}")
_LOCAL_DOT = re.compile(r"(?i)(?:[ \t]*[\[({<][ \t]*(?:dot|\.|punkt|point|punto)[ \t]*[\])}>][ \t]*|[ \t]+dot[ \t]+)$")
_HINT = re.compile(r"(?i)[\[({<]\s*(?:at|@|arroba|ät|dot|\.|punkt|point|punto)\s*[\])}>]|\s(?:dot|punkt|point|punto)\s|&#(?:64|46|x40|x2e);|&(?:commat|period);|%40|%2e|_(?:at|dot)_|[ \t]@|@[ \t]")
#: Four groups of digits, numerals or spelled digits, with three signs between, disguised or not.
_IP_SIGN = r"(?:\s*+[\[({<]\s*+(?:dot|\.|punkt|point|punto)\s*+[\])}>]\s*+|\s++(?:dot|punkt|point|punto)\s++|&#46;|&#x2e;|&period;|%2e|_dot_|\.)"
_IP_GROUP = rf"((?:{_W}(?![^\W_])|[0-9]++)(?:[\s-]{{1,3}}(?:{_W}(?![^\W_])|[0-9](?![0-9]))){{0,7}})"
_IP_RUN = re.compile(rf"(?i)(?<![^\W_]){_IP_GROUP}{_IP_SIGN}{_IP_GROUP}{_IP_SIGN}{_IP_GROUP}{_IP_SIGN}{_IP_GROUP}")
_IP_WORDS = ("dot", "punkt", "point", "punto", "&#46;", "&#x2e;", "&period;", "%2e")
#: What a disguised address must end with.
_TLD = re.compile(r"\.[A-Za-z]{2,}\Z")
_SLIPS = str.maketrans("OoIl", "0011")
_SLIPPED = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl](?:[ -]?[0-9OoIl]){15,18}(?![A-Za-z0-9])")


class Transducer:
    """A trie over lower-case characters whose final states have an output. Of the rules that match at a place the longest is
    applied; what no rule reads is copied. words: rules apply to whole words (underscores part words) alone."""

    def __init__(self, rules: dict[str, str], words: bool = False):
        self.words = words
        self.arcs: list[dict[str, int]] = [{}]
        self.output: list[str | None] = [None]
        for key, new in rules.items():
            state = 0
            for c in key:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.output.append(None)
                state = self.arcs[state][c]
            self.output[state] = new

    def edits(self, t: str, begin: int, end: int) -> list[tuple[int, int, str]]:
        """The ranges of a part of the text that rules read, in order, and what they write."""
        out, i = [], begin
        while i < end:
            state, j, found = 0, i, None
            if not self.words or i == begin or not t[i - 1].isalpha():
                while j < end and (state := self.arcs[state].get(t[j].lower(), -1)) >= 0:
                    j += 1
                    if self.output[state] is not None and (not self.words or j == end or not t[j].isalpha()):
                        found = (i, j, self.output[state])
            if found:
                out.append(found)
            i = found[1] if found else i + 1
        return out


#: Spelled digits, signs in words and the plus; and single characters that a run of digits has between its parts.
_NUMBERS = Transducer(DIGITS | dict.fromkeys(("dot", "punkt", "point", "punto"), ".") | {"plus": "+"}, words=True)
_VALUES = Transducer(DIGITS | {str(i): str(i) for i in range(10)})
_SIGNS = Transducer(dict.fromkeys(("dot", ".", "punkt", "point", "punto", "&#46;", "&#x2e;", "&period;", "%2e", "_dot_"), ".") | dict.fromkeys(("at", "@", "arroba", "ät", "&#64;", "&#x40;", "&commat;", "%40", "_at_"), "@"))


def _sign(t: str, a: int, b: int) -> tuple[int, int, str]:
    """A disguised sign as one edit: what stands around the sign itself (blanks, brackets) belongs to it."""
    return a, b, _SIGNS.edits(t, a, b)[0][2]


def _automaton() -> ahocorasick.Automaton:
    """The words that disguises are made of, for one pass over a text: digits' names with their sizes, 0 for signs in words."""
    out = ahocorasick.Automaton()
    for w in DIGITS:
        out.add_word(w, len(w))
    for w in _IP_WORDS:
        out.add_word(w, 0)
    out.make_automaton()
    return out


_TRIGGERS = _automaton()


class Triggers:
    """Which disguises a text can hold, told without running their patterns: whether it has four digits' names as words, a
    sign in words, a dot between letters or letters and digits or in brackets, or what at signs' disguises need."""

    def __init__(self, t: str):
        low = t.lower()
        digits, signs, n = 0, False, len(low)
        for end, size in _TRIGGERS.iter(low):
            if not size:
                signs = True
            elif (end + 1 == n or not low[end + 1].isalnum()) and (end < size or not low[end - size].isalnum()):
                digits += 1
        self.digits = digits >= 4
        self.mail = signs or any(c in t for c in "[({<&%@") or "_at_" in low or "_dot_" in low
        self.dots = signs or _odd_dot(t)


def _odd_dot(t: str) -> bool:
    """Whether a dot stands alone in brackets, between a letter and a word, or between a digit and a letter."""
    i, n = t.find("."), len(t)
    letter = lambda c: c.isalnum() and not c.isdecimal()
    while i >= 0:
        before, after = t[i - 1] if i else " ", t[i + 1] if i + 1 < n else " "
        if letter(before) and (after == "_" or after.isalnum()) or before.isdecimal() and letter(after):
            return True
        if (before in "[({<" or before.isspace()) and (after in "])}>" or after.isspace()):
            a, b = i - 1, i + 1
            while a >= 0 and t[a].isspace():
                a -= 1
            while b < n and t[b].isspace():
                b += 1
            if a >= 0 and b < n and t[a] in "[({<" and t[b] in "])}>":
                return True
        i = t.find(".", i + 1)
    return False


def _strange(t: str) -> bool:
    """Whether a text has a character that is rewritten."""
    return not t.isascii() and _FOREIGN.search(t) is not None and not _KNOWN.isdisjoint(map(ord, set(t)))


class Rewriting:
    """A rewritten text and the source range of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.begin: list[int] | range = range(len(text))
        self.end: list[int] | range = range(1, len(text) + 1)

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces ranges of the rewritten text, given in order; each new character stands for its whole range."""
        if not edits:
            return
        parts, begin, end, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            begin += self.begin[at:a]
            end += self.end[at:a]
            begin += [self.begin[a]] * len(new)
            end += [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join(parts) + self.text[at:]
        self.begin = begin + list(self.begin[at:])
        self.end = end + list(self.end[at:])

    def source(self, span: Span) -> Span:
        return self.begin[span[0]], self.end[span[1] - 1]


def _disguised_ips(t: str) -> list[Span]:
    """Addresses with a spelled digit or a disguised dot; digits before the first group or after the last that make it too
    large do not belong to it."""
    out, at = [], 0
    while m := _IP_RUN.search(t, at):
        groups = [_joined_digits(t, _VALUES.edits(t, *m.span(i))) for i in (1, 2, 3, 4)]
        value = lambda g: "".join(x for _, _, x in g)
        small = lambda g: bool(ips(f"0.0.0.{value(g)}"))
        while len(groups[0]) > 1 and not small(groups[0]):
            del groups[0][0]
        while len(groups[3]) > 1 and not small(groups[3]):
            del groups[3][-1]
        if all(map(small, groups)):
            a, b = groups[0][0][0], groups[3][-1][1]
            if t[a:b] != ".".join(map(value, groups)):
                out.append((a, b))
            at = b
        else:
            at = m.end(1)
    return out


def _joined_digits(t: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits whose numerals that stand together are one."""
    out: list[tuple[int, int, str]] = []
    for a, b, x in found:
        if out and out[-1][1] == a and t[a].isdigit() and t[a - 1].isdigit():
            out[-1] = (out[-1][0], b, out[-1][2] + x)
        else:
            out.append((a, b, x))
    return out


def _digit_edits(t: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _RUN.finditer(t):
        words = _NUMBERS.edits(t, m.start(), m.end())
        spelled, numerals = sum(x.isdigit() for _, _, x in words), sum(c in "0123456789" for c in m[0])
        if spelled < 4 or spelled + numerals < 7:
            continue
        at = m.start()
        for a, b, x in [*words, (m.end(), m.end(), "")]:
            out += _between(t, at, a)
            if b > a:
                out.append((a, b, x))
            at = b
    return out


def _between(t: str, a: int, b: int) -> list[tuple[int, int, str]]:
    """Edits of what stands between the words of a run: numerals and plus signs stay, a dot alone stays, all else goes."""
    out = []
    while a < b:
        if t[a] in "0123456789+":
            out.append((a, a + 1, t[a]))
            a += 1
            continue
        end = a
        while end < b and t[end] not in "0123456789+":
            end += 1
        out.append((a, end, "." if t[a:end] == "." else ""))
        a = end
    return out


def _mail_edits(t: str) -> list[tuple[int, int, str]]:
    if not _HINT.search(t):
        return []
    out: list[tuple[int, int, str]] = []
    last = 0
    for m in _MAIL_HOST.finditer(t):
        at = _MAIL_AT.match(t, m.start())
        a = m.start()
        local: list[tuple[int, int, str]] = []
        while a > last and t[a - 1] in _LOCAL:
            a -= 1
        if a == m.start():
            continue
        disguised = at[0] != "@"
        plain_at = not re.search(r"[\[({<@&%]", at[0])
        while d := _LOCAL_DOT.search(t, max(last, a - 12), a):
            b = d.start()
            while b > last and t[b - 1] in _LOCAL:
                b -= 1
            if b == d.start():
                break
            local.insert(0, _sign(t, d.start(), d.end()))
            a = b
        dots = [_sign(t, x.start(), x.end()) for x in _DOTS.finditer(t, at.end(), m.end()) if x[0] != "."]
        if plain_at and not dots:  # "at" as a plain word needs a disguised dot too
            continue
        if disguised or dots or local:
            out += local + ([_sign(t, m.start(), at.end())] if disguised else []) + dots
        last = m.end()
    return out


def hidden_spans(t: str, known: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans of disguised identifiers that overlap no known one of their kind."""
    r, changed = Rewriting(t), False
    if _strange(t):
        r.text = t.translate(HOMOGLYPHS)  # one character for one
        r.apply([(m.start(), m.end(), "") for m in _ZERO.finditer(r.text)])
        changed = True
    can = Triggers(r.text)
    addresses = [r.source(x) for x in _disguised_ips(r.text)] if can.dots else []
    for edits, possible in ((_digit_edits, can.digits), (_mail_edits, can.mail)):
        if possible and (made := edits(r.text)):
            r.apply(made)
            changed = True
    if slips := [m for m in _SLIPPED.finditer(r.text) if sum(map(str.isdigit, m[0])) >= 10 and not m[0].replace(" ", "").replace("-", "").isdigit()]:
        r.apply([(i, i + 1, r.text[i].translate(_SLIPS)) for m in slips for i in range(m.start(), m.end()) if r.text[i] in "OoIl"])
        changed = True
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    begins = [a for a, _ in known["ip"]]
    out["ip"] = [(a, b) for a, b in addresses if not (i := bisect.bisect_left(begins, b)) or known["ip"][i - 1][1] <= a]
    if not changed:
        return out
    for kind, find in FINDERS.items():
        taken = sorted(known[kind] + out[kind])
        starts = [a for a, _ in taken]
        for span in find(r.text):
            if kind == "email" and not _TLD.search(r.text, *span):
                continue
            a, b = r.source(span)
            i = bisect.bisect_left(starts, b)
            if i == 0 or taken[i - 1][1] <= a:
                out[kind].append((a, b))
    return out


def all_spans(t: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, added spans) by kind."""
    base = base_spans(t or "")
    return base, hidden_spans(t or "", base)


def line(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def redacted(t: str | None) -> str | None:
    """The text with each span replaced by its kind; overlapping spans become one."""
    if not t:
        return t
    base, more = all_spans(t)
    found = sorted((a, b, k) for k in KINDS for a, b in (*base[k], *more[k]))
    if not found:
        return t
    parts, at = [], 0
    for a, b, k in found:
        if a >= at:
            parts += [t[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join(parts) + t[at:]


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base spans by kind, digest of the base spans, all spans, number of added ones."""

    def work(ids: list, texts: list) -> dict:
        out: dict[str, list] = {"doc_id": ids, **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": [], "n_added": []}
        for t in texts:
            base, more = all_spans(t)
            for k in KINDS:
                out[f"n_{k}"].append(len(base[k]))
            out["base_sha256"].append(hashlib.sha256(line(base).encode()).hexdigest())
            out["spans"].append(line({k: base[k] + more[k] for k in KINDS}))
            out["n_added"].append(sum(map(len, more.values())))
        return out

    kind = dict(df.dtypes)[id_col]
    return map_chunks(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work, StructType.fromDDL(f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns, the text with its personal data replaced."""
    return with_columns(df, [text_col], lambda texts: {text_col: [redacted(t) for t in texts]}, {text_col: "string"})
