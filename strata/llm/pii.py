"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, local parsers expand and validate around them.

One pass of the automaton over a text yields at-signs, plus signs, schemes, digits and the words that announce an
identifier. Each kind of finding has a parser that starts from its anchors only, walks outward over the characters the
kind allows, validates (ranges, digit counts, Luhn, mod 97) and never looks at text without an anchor. Parsers of one kind
don't overlap: an expansion stops where the previous finding of that kind ended.

Spans are counted in code points, ends exclusive. Base kinds: email, ip, card, phone. Further kinds of this method: login
(user and password in a URL), ssn, iban and account, each behind its cue.

Defined cases: a null text is empty and gives no spans; an empty table gives no rows; repeated rows give equal rows; the
work is linear in the text, so long texts need no cut.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_kind, documents, map_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "ssn", "iban", "account")
#: Words that announce an identifier; they count in lower, upper and title case.
CUES = {"ssn": ("ssn", "social security"), "iban": ("iban",), "account": ("account", "acct")}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE_TAIL = re.compile(r"[ ().0-9-]*[0-9]")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+")
_SSN = re.compile(r"[\s:#=]{0,3}(?:no|number)?[\s.:#=]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_IBAN = re.compile(r"[\s:#=]{0,3}([A-Z]{2}[0-9]{2})")
_IBAN_TAIL = re.compile(r"(?: ?[A-Z0-9])*")
#: Number of characters of an account number in the format of the IBAN registry, by country.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
_IBAN_LENGTH = {country: n for n, countries in IBAN_LENGTHS.items() for country in countries.split()}
_ACCOUNT = re.compile(r"\s?(?:no|nr|number)?[\s.:#=]{0,3}([0-9]{8,17})(?![0-9])")
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        a = ahocorasick.Automaton()
        for c in "0123456789":
            a.add_word(c, "digit")
        for kind, words in {"email": "@", "phone": "+", "login": ("://",), **CUES}.items():
            for w in {cased for w in words for cased in (w, w.upper(), w.title(), w.capitalize())}:
                a.add_word(w, kind)
        a.make_automaton()
        _automaton = a
    return _automaton


def digit_runs(digits: list[int]) -> list[tuple[int, int]]:
    runs, start, last = [], None, None
    for p in digits:
        if start is None:
            start = p
        elif p != last + 1:
            runs.append((start, last + 1))
            start = p
        last = p
    if start is not None:
        runs.append((start, last + 1))
    return runs


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str, at_signs: list[int]):
    done = 0
    for p in at_signs:
        start = p
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < p and (m := _DOMAIN.match(text, p + 1)):
            done = m.end()
            yield start, done


def addresses(text: str, runs: list[tuple[int, int]]):
    i = 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(a[1] + 1 == b[0] and text[a[1]] == "." for a, b in zip(four, four[1:])):
            parts = [text[a:b].lstrip("0") for a, b in four]
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
                yield four[0][0], four[3][1]
            i += 4
        else:
            i += 1


def cards(text: str, runs: list[tuple[int, int]]):
    i = 0
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and runs[j][1] + 1 == runs[j + 1][0] and text[runs[j][1]] in " -":
            j += 1
        n = sum(b - a for a, b in runs[i : j + 1])
        if 13 <= n <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            yield runs[i][0], runs[j][1]
        i = j + 1


def phones(text: str, pluses: list[int]):
    for p in pluses:
        if p + 1 < len(text) and text[p + 1] in "0123456789" and (m := _PHONE_TAIL.match(text, p + 2)) and m.end() - m.start() >= 2:
            if 9 <= sum(c in "0123456789" for c in text[p : m.end()]) <= 15:
                yield p, m.end()


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def iban_end(text: str, start: int) -> int | None:
    """Where the account number ends that starts there: its country says how long it is, no letter or digit may follow directly,
    and its check digits must be right.
    """
    left, at = _IBAN_LENGTH.get(text[start : start + 2], 0), start
    end = _IBAN_TAIL.match(text, start).end()
    while left and at < end:
        left -= text[at] != " "
        at += 1
    if left or at == start or text[at : at + 1].isalnum() or not mod97(text[start:at].replace(" ", "")):
        return None
    return at


def behind_cue(text: str, kind: str, ends: list[int]):
    """Findings of the method's own kinds; ends are where the cue ends."""
    pattern, group = {"login": (_LOGIN, 0), "ssn": (_SSN, 1), "iban": (_IBAN, 1), "account": (_ACCOUNT, 1)}[kind]
    done = 0
    for p in ends:
        if p >= done and (m := pattern.match(text, p)):
            a, b = m.span(group)
            if kind == "ssn" and (text[a : a + 3] in ("000", "666") or text[a] == "9"):
                continue
            if kind == "iban":
                b = iban_end(text, a)
                if b is None:
                    continue
            done = b
            yield a, b


def find_spans(text: str) -> list[str]:
    """kind:start:end of each finding, by kind as in KINDS, then start."""
    hits: dict[str, list[int]] = {}
    for end, kind in automaton().iter(text):
        hits.setdefault(kind, []).append(end)
    if not hits:
        return []
    runs = digit_runs(hits.get("digit", []))
    found = {"email": emails(text, hits.get("email", [])), "ip": addresses(text, runs), "card": cards(text, runs), "phone": phones(text, hits.get("phone", []))}
    for kind in KINDS[len(BASE) :]:
        found[kind] = sorted(set(behind_cue(text, kind, [e + 1 for e in hits.get(kind, [])])))
    return [f"{kind}:{a}:{b}" for kind in KINDS for a, b in found[kind]]


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, found array<string> of kind:start:end."""
    return map_texts(docs, lambda text: (find_spans(text),), "found array<string>")


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id, redacted: the text with each finding replaced by its kind in brackets."""

    def redact(text: str) -> tuple[str]:
        spans = sorted((int(a), -int(b), kind) for kind, a, b in (s.split(":") for s in find_spans(text)))
        out, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                out += [text[at:a], f"[{kind}]"]
            at = max(at, -b)
        return ("".join(out) + text[at:],)

    return map_texts(docs, redact, "redacted string")


def op2_pii_anchors(spark, sf_dir):
    found = pii_spans(documents(spark, sf_dir))
    count = [count_kind("found", k).alias(f"n_{k}") for k in BASE]
    base = F.filter("found", lambda s: F.substring_index(s, ":", 1).isin(*BASE))
    return found.select("doc_id", *count, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join("found", ",").alias("spans"))
