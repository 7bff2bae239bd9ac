"""Personal data, secrets and licences against plain regular expressions; edge cases of every operator's input."""

import base64
import gzip
import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import licences, pii, queries, secrets

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_pii(x):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [f"email:{m.start()}:{m.end()}" for m in EMAIL.finditer(x)]
    out += [f"ip:{m.start()}:{m.end()}" for m in IP.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in CARD.finditer(x) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [f"phone:{m.start()}:{m.end()}" for m in PHONE.finditer(x) if 9 <= len(digits(m)) <= 15]


def plain_secrets(x):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(x) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
    return [s for _, _, s in sorted(found)]


def base(spans, kinds):
    return [s for s in spans if s.split(":")[0] in kinds]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789" * 3 + ".- ()+@ab%é𝟘", max_size=80))
def test_pii_base(x):
    assert base(pii.find_spans(x), pii.BASE) == plain_pii(x)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWD", "token", "api_key", "apiKey", "=", ":", " ", "\"", "'", "abc", "Abc123/+x", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "ſ", "é", "\n"]), max_size=12))
def test_secrets_base(parts):
    x = "".join(parts)
    assert base([f"{k}:{a}:{b}" for a, b, k in secrets.find_secrets(x)], secrets.BASE) == plain_secrets(x)


def test_pii_own_kinds():
    x = "ssn: 123-45-6789, IBAN GB82 WEST 1234 5698 7654 32 and ftp://bob:pw@host.example account no. 12345678; ssn 000-12-3456"
    assert [s.split(":")[0] for s in pii.find_spans(x)] == ["email", "login", "ssn", "iban", "account"]


def test_account_numbers_end_where_their_country_says():
    for true, tail in (("GB82 WEST 1234 5698 7654 32", " AND more"), ("DE89370400440532013000", "."), ("NO9386011117947", " x")):
        x = f"Iban: {true}{tail}"
        assert [s for s in pii.find_spans(x) if s.startswith("iban")] == [f"iban:6:{6 + len(true)}"]
    r = random.Random(5)
    wrong = ["iban " + "".join(r.choice("0123456789") for _ in range(34)) for _ in range(300)] + [f"iban GB{r.randrange(10**20):020d}" for _ in range(1000)]
    assert sum("iban:" in ",".join(pii.find_spans(x)) for x in wrong) <= 25
    assert "iban:" not in ",".join(pii.find_spans("iban DE893704004405320130001"))
    assert pii.find_spans("IBAN GB82 WEST 1234 5698 7654 33") == []


@pytest.mark.parametrize("wrap", [
    lambda b: base64.b64encode(b).decode(),
    lambda b: base64.b64encode(zlib.compress(b)).decode(),
    lambda b: base64.b64encode(gzip.compress(b)).decode(),
    lambda b: "".join(f"%{c:02x}" for c in b),
    lambda b: "".join(f"\\u{c:04x}" for c in b),
    lambda b: "".join(f"%{c:02x}" for c in base64.b64encode(base64.b64encode(b))),
])
def test_wrapped_secrets_are_mapped_to_their_part(wrap):
    part = wrap(b"password=hunter2hunter2")
    x = f"é before {part} after"
    found = [f for f in secrets.find_secrets(x) if f[2] == "decoded_assign"]
    assert found == [(9, 9 + len(part), "decoded_assign")]
    assert secrets.redact(x) == "é before [SECRET] after"


def test_secrets_in_layers_that_occur_twice():
    b64 = lambda x: base64.b64encode(x.encode()).decode()
    secret = b64("password=hunter2hunter2")
    for first, second in [(b64(secret),) * 2, (b64("id=1 " + secret), b64("id=2 " + secret)), (b64(b64(secret)), secret)]:
        x = f"{first} or {second}"
        assert secrets.find_secrets(x) == [(0, len(first), "decoded_assign"), (len(x) - len(second), len(x), "decoded_assign")]
        assert secrets.redact(x) == "[SECRET] or [SECRET]"


NOISE = bytes(random.Random(5).choices(b"ghijklmnopqrstuvwxyz ", k=3000))
SECRET = b"password=hunter2hunter2"


def wrapped(data, width=76):
    x = base64.b64encode(data).decode()
    return "\n".join(x[i : i + width] for i in range(0, len(x), width))


@pytest.mark.parametrize("part", [
    wrapped(b"x" * 45 + SECRET),
    wrapped(gzip.compress(NOISE + SECRET)).replace("\n", "\r\n  "),
    base64.b64encode(gzip.compress(b"first member") + gzip.compress(b"second " + SECRET)).decode(),
    base64.b64encode(gzip.compress(b"split pass") + gzip.compress(SECRET[4:])).decode(),
    base64.b64encode(gzip.compress(b"zy " * 22_000_000 + SECRET)).decode(),
    *(f"/{'v' * n}/" + base64.b64encode(data).decode() for n in range(1, 5) for data in (SECRET, gzip.compress(SECRET))),
    "a-b_c+" + base64.b64encode(SECRET).decode(),
    "%E9t%E9%20" + "".join(f"%{c:02x}" for c in SECRET),
    base64.b64encode(b"\xe9t\xe9 \x00\x01" + SECRET + b"\xff").decode(),
])
def test_whole_parts_are_decoded(part):
    x = f"before: {part} after"
    assert (8, 8 + len(part), "decoded_assign") in secrets.find_secrets(x)
    assert secrets.redact(x) == "before: [SECRET] after"


def test_clean_encoded_data_has_no_findings():
    r = random.Random(6)
    assert secrets.find_secrets(" ".join([base64.b64encode(r.randbytes(20_000)).decode(), wrapped(gzip.compress(NOISE)), "/usr/share/implementations\nof"])) == []


def test_cycles_and_bombs_end():
    part = base64.b64encode(zlib.compress(b"zy " * 2_000_000)).decode()
    assert secrets.find_secrets(part) == []
    assert secrets.find_secrets("%25" * 50 + "41") == []


def test_redact_leaves_clean_text():
    assert secrets.redact("nothing here, token of love") == "nothing here, token of love"
    assert secrets.redact("a token=abcdefgh b password: 'zzzzzzz' c") == "a [SECRET] b [SECRET]' c"


def plain_places(x):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x))
    return len(w), sorted((i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("under the MIT license Apache version 2 cc by nc licensed xx 0 this work is é".split()), max_size=60))
def test_licence_places(words):
    x = " ".join(words)
    w = licences.split_words(x)
    assert (len(w), sorted(licences.walk(w)[0])) == plain_places(x)


def test_matching_statistics_against_all_runs():
    """The longest run ending at each word, by brute force; kept runs are those that the next word doesn't lengthen."""
    r = random.Random(2)
    known = {tuple(t.split()[i:j]) for t in [*licences.TEMPLATES.values(), *(t for own in licences.NOTICES.values() for t in own), *licences.PHRASES] for i in range(len(t.split())) for j in range(i + 1, len(t.split()) + 1)}
    for _ in range(200):
        w = []
        for _ in range(5):
            t = r.choice(list(licences.TEMPLATES.values())).split()
            a = r.randrange(len(t))
            w += t[a : a + r.randrange(1, 9)] + ["zzz"] * (r.random() < 0.2)
        longest = [max((n for n in range(1, e + 1) if tuple(w[e - n : e]) in known), default=0) for e in range(len(w) + 1)] + [0]
        want = {(e - n, n) for e, n in enumerate(longest[:-1]) if n >= licences.MIN_RUN and longest[e + 1] != n + 1}
        assert {(i, n) for i, n, _ in licences.walk(licences.split_words(" ".join(w)))[1]} == want


def test_chain_covers_a_template_with_changes():
    t = licences.TEMPLATES["bsd"].split()
    x = "start " + " ".join(t[:8] + ["changed"] + t[9:]) + " end"
    found = licences.chain(licences.walk(licences.split_words(x))[1])
    assert any(k == "bsd" and a == 1 and b == 1 + len(t) for k, a, b, _ in found)
    assert licences.chain(licences.walk(licences.split_words("permission is hereby granted to leave"))[1]) == []


def test_versions_and_repeated_runs_of_licences():
    labels = lambda x: [k for k, *_ in licences.chain(licences.walk(licences.split_words(x))[1])]
    assert labels("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007") == ["lgpl-3"]
    assert labels("GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991 Copyright") == ["gpl-2"] and labels("general public license version 3") == []
    mpl = 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at x'
    assert labels(mpl) == ["mpl-1.1"]
    whole = licences.NOTICES["bsd"][0].split()  # "including but not limited to the ..." and others stand in it twice
    found = licences.chain(licences.walk(licences.split_words(" ".join(["x"] * 3 + whole + ["y"] * 3)))[1])
    assert found == [("bsd", 3, 3 + len(whole), 1.0)]
    torn = whole[:40] + ["changed"] * 3 + whole[43:90] + ["added"] * 4 + whole[90:]
    assert [(k, a, b) for k, a, b, _ in licences.chain(licences.walk(licences.split_words(" ".join(torn)))[1])] == [("bsd", 0, len(torn))]


ROWS = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "mail a@b.co token=abcdef under the MIT license", None), (3, "wört " * 50_000 + "a@b.co", "x")]


@pytest.mark.parametrize("name", ["op2_pii_anchors", "op4_licences_automaton", "op8_secrets_worklist"])
def test_odd_rows_and_columns(spark, tmp_path, name):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, spans string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == 5
    by_id = {r.doc_id: r for r in got}
    if name == "op2_pii_anchors":
        assert (by_id[1].n_email, by_id[None].spans, by_id[3].n_email) == (0, "email:5:11", 1)
        assert by_id[None].base_sha256 == hashlib.sha256(b"email:5:11").hexdigest() and by_id[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    elif name == "op4_licences_automaton":
        assert (by_id[1].n_words, by_id[1].labels, by_id[1].first_word, by_id[None].base_labels, by_id[None].first_word, by_id[None].score) == (0, "", None, "mit", 6, 1.0)
        assert by_id[3].n_words == 50_003
    else:
        assert (by_id[None].spans, by_id[None].n_assign, by_id[1].spans) == ("assign:12:24", 1, "")
    empty = str(tmp_path / "none")
    df.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_whole_table_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda spans: hashlib.sha256(",".join(spans).encode()).hexdigest()
    for r in queries.QUERIES["op2_pii_anchors"](spark, sf_dir).collect():
        spans = plain_pii(texts[r.doc_id])
        assert r.base_sha256 == sha(spans) and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in spans) for k in pii.BASE)
    for r in queries.QUERIES["op8_secrets_worklist"](spark, sf_dir).collect():
        spans = plain_secrets(texts[r.doc_id])
        assert r.base_sha256 == sha(spans) and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in secrets.BASE)
    for r in queries.QUERIES["op4_licences_automaton"](spark, sf_dir).collect():
        n, places = plain_places(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(sorted({k for _, k in places})))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))


def test_redacted(spark):
    df = spark.createDataFrame([(1, "write a@b.co or +1 (555) 010-9999 now")], "doc_id long, text string")
    assert pii.redacted(df).first().redacted == "write [email] or [phone] now"
