"""Cases that once went wrong: clashing columns, tied ids, damaged streams, secrets under escapes and other wrappings."""

import base64
import collections
import gzip
import html
import itertools
import json
import random
import zlib

import pytest

import corpus_pipeline
from strata.llm import media, mixing, near_dedup, secrets

# --- mixing and near-duplicates

CLASHING = "doc_id long, text string, source string, lang string, n_chars long, target long, source_size string, _key int, _hash string, _copy int, _rank int, _row string, row string, hash int, size int, copies int, _size int, whole string"


def clashing(spark):
    rows = [(i, f"word{i} " * (i % 7 + 1), "ab"[i % 2], "en", 1, 9, "x", 9, "h", 3, 4, "r", "w", 5, 6, 7, 8, "z") for i in range(60)]
    return spark.createDataFrame(rows, CLASHING)


def test_mixing_carries_any_columns(spark):
    docs = clashing(spark)
    got = corpus_pipeline.mix_sources(spark, docs, "")
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(tuple(r)[3:] == ("en", 1, 9, "x", 9, "h", 3, 4, "r", "w", 5, 6, 7, 8, "z") for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns.count("_size") == 1 and mixed.agg({"_copies": "sum"}).first()[0] == len(rows)


def test_near_dedup_carries_any_columns(spark):
    docs = clashing(spark).unionByName(clashing(spark))
    got = near_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    assert all(r["_row"] == "r" and r["_rank"] == 4 and r["whole"] == "z" for r in got.collect())


@pytest.mark.parametrize("sizes", [near_dedup.ALIGNED, (40, 60)])
def test_large_groups_are_compared_whole(spark, monkeypatch, sizes):
    """Texts of one template, some of them alike: all that share a sketch and align are of one class, in one block a group or in many."""
    r = random.Random(21)
    passage, rows = [f"p{i}" for i in range(150)], []
    for k in range(300):
        own = [f"w{r.randrange(10**6)}" for _ in range(50)]
        at = r.randrange(51)
        base = own[:at] + passage + own[at:]
        rows.append((len(rows), " ".join(base)))
        if k < 40:
            w = base[:]
            for i in r.sample(range(200), 36):
                w[i] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    words = [t.split() for _, t in rows]
    sketches = [near_dedup.order_minhash([w.encode() for w in t]) for t in words]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (sketches[a] == sketches[b]).any() and near_dedup.alike(rows[a][1], rows[b][1]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    monkeypatch.setattr(near_dedup, "COUNTED", sizes if sizes[0] < 100 else near_dedup.COUNTED)
    monkeypatch.setattr(near_dedup, "ALIGNED", sizes)
    got = {x.doc_id: x.class_id for x in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in got} and len(set(got.values())) <= 300


def test_mix_agrees_on_rows_of_one_id(spark):
    rng = random.Random(3)
    rows = [(7, "w " * rng.randrange(1, 22), "a") for _ in range(600)] + [(i, "w " * 5, "b") for i in range(200)]
    counts = []
    for n in (2, 5):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)
        counts.append(collections.Counter((r.doc_id, r._size, r._copies) for r in mixing.mix(docs).collect()))
    assert counts[0] == counts[1] and len({c for _, _, c in counts[0]}) > 1


# --- damaged streams


def test_damaged_streams_are_read(spark):
    rng = random.Random(7)
    whole = media.encode(media.payload_of("some text " * 300)[0])
    assert media.parse(whole)["payload"] is not None
    for _ in range(1500):
        data = bytearray(whole if rng.random() < 0.5 else whole[: rng.randrange(len(whole))])
        for _ in range(rng.randrange(6)):
            if data:
                data[rng.randrange(min(len(data), 80) if rng.random() < 0.5 else len(data))] = rng.choice([0, 255, rng.randrange(256)])
        got = media.parse(bytes(data))
        assert got["payload"] is None or bytes(data)
    at = whole.index(b"TXXX")
    assert media.parse(whole[: at + 10])["payload"] is None
    assert media.parse(whole.replace(b"payload\0", b"payload\0x", 1))["payload"] is None
    head = whole[whole.index(b"\xff\xfb" if b"\xff\xfb" in whole else b"\xff") :][:4]
    assert media.parse(head + bytes(32) + b"VBRI" + bytes(8))["payload"] is None
    note = b"payload\0" + b"9" * 5000 + b":0"
    frame = b"TXXX" + (len(note) + 1).to_bytes(4, "big") + b"\0\0\0" + note
    size = len(frame)
    assert media.parse(b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + frame)["payload"] is None


# --- secrets

NAME, VALUE = "password", "hunter2222"
PLAIN = f"{NAME}={VALUE}"
RAW = zlib.compressobj(wbits=-15)
RAW = RAW.compress(PLAIN.encode() * 3) + RAW.flush()


def narrow(data, width, end):
    x = base64.b64encode(data).decode()
    return end.join(x[i : i + width] for i in range(0, len(x), width))


LAYERS = {
    "json": ('{"', 'pass\\u0077ord": "hunter2222', '"}'),
    "percent": ("x ", f"pass%77ord = {VALUE}", ""),
    "percent twice": ("x ", f"pass%252577ord = {VALUE}", ""),
    "percent u": ("x ", f"%u0070assword={VALUE}", " y"),
    "long escape": ("é ", f"\\U00000070assword={VALUE}", " y"),
    "braces": ("", f"\\u{{70}}assword={VALUE}", " y"),
    "hex escape": ("", f"\\x70assword={VALUE}", " y"),
    "references": ("a &amp; b ", f"&#112;ass&#x77;ord&equals;{VALUE}", "&amp; c"),
    "utf-16": ("k: ", base64.b64encode(PLAIN.encode("utf-16-le")).decode(), " ."),
    "utf-16 big": ("k: ", base64.b64encode(PLAIN.encode("utf-16-be")).decode(), " ."),
    "deflate": ("k: ", base64.b64encode(RAW).decode(), " ."),
    "json lines": ('"', narrow(gzip.compress(PLAIN.encode() * 2), 40, "\\n"), '"'),
    "narrow": ("k: ", narrow(PLAIN.encode() * 3, 12, "\n"), " ."),
    "references in percent": ("q ", "".join(f"%{ord(c):02x}" for c in f"&#112;assword={VALUE}"), " y"),
}


@pytest.mark.parametrize("name", LAYERS)
def test_layers_are_found_and_removed(name):
    before, part, after = LAYERS[name]
    text = before + part + after
    found = [f for f in secrets.find_secrets(text) if f[2] == "decoded_assign"]
    assert found and all(len(before) <= a < b <= len(before) + len(part) for a, b, _ in found)
    left = secrets.redact(text)
    assert "[SECRET]" in left and VALUE not in left and left.startswith(before[:3]) and left.endswith(after)


def test_escaped_spans_are_exact():
    def written(c, way):
        return {0: c, 1: f"%{ord(c):02X}", 2: f"\\u{ord(c):04x}", 3: f"&#{ord(c)};", 4: f"\\x{ord(c):02x}"}[way]

    rng = random.Random(5)
    for _ in range(300):
        way = rng.randrange(1, 5)
        pick = [rng.choice([0, way]) for _ in PLAIN]
        part = "".join(written(c, w) for c, w in zip(PLAIN, pick))
        text = f"see this: {part} and go"
        found = {(a, b) for a, b, k in secrets.find_secrets(text) if k.endswith("assign")}
        assert (10, 10 + len(part)) in found, text


def test_brute_force_decoding():
    """Each wrapping of each wrapping: what a plain decoder of the same order reads is found."""
    wrap = {
        "b64": lambda t: base64.b64encode(t.encode()).decode(),
        "gzip": lambda t: base64.b64encode(gzip.compress(t.encode())).decode(),
        "percent": lambda t: "".join(f"%{b:02x}" for b in t.encode()),
        "json": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        "html": lambda t: "".join(f"&#{ord(c)};" for c in t),
        "html names": lambda t: html.escape(f'<a "{t}">'),
        "json text": lambda t: json.dumps({"k": t}),
        "utf16": lambda t: base64.b64encode(t.encode("utf-16-le")).decode(),
    }
    for ways in itertools.product(wrap, repeat=3):
        text = PLAIN
        for w in ways:
            text = wrap[w](text)
        kinds = {k for _, _, k in secrets.find_secrets(f"on {text} off")}
        assert kinds & {"assign", "decoded_assign"}, ways


def test_deep_percent_signs_are_one_layer():
    assert any(k == "decoded_assign" for _, _, k in secrets.find_secrets("on %" + "25" * 200_000 + "70assword=hunter2222 off"))
