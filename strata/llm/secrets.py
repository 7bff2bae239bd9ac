"""Secrets under encodings: a worklist of layers, each scanned and searched for parts to decode, until none is new.

The whole text is the first layer. A layer is scanned for secrets; then every part of it that looks percent-encoded,
backslash-u-encoded or base64 (of text in UTF-8 or UTF-16, or of zlib, gzip or bare deflate data, which is inflated) is decoded and becomes
a layer itself; and so does the whole layer with all its escapes of one kind (percent, backslash, HTML character references) resolved, so a secret
of which only some letters are escaped is found. In layers that come from the text by escapes alone each character
knows its place, so findings there are mapped exactly; what is found below a decoded part is mapped to that part. A layer is taken up once, however often it occurs, so cycles end; the kinds found in it are passed on to all layers
that it was decoded from, so every part of the original text that leads to a finding is reported with its kind.

Base kinds are looked for in the original text: assign, access, hex. Findings in decoded layers have the kinds
decoded_assign, decoded_access and decoded_hex. Spans are counted in code points, ends exclusive.

Base64 is tried at all four alignments, so it may follow on other characters of its alphabet; runs of it that go on from line to
line are also read joined. Packed data is found wherever it starts in decoded bytes, and inflated to its end, all gzip members
after each other, in windows of about ``WINDOW`` bytes that are scanned as they come, which bounds the memory of a task against
bombs. ``OVERLAP`` bytes stand in both of two windows: only a finding or an encoded part longer than that can be cut.
Bytes that aren't UTF-8 are replaced.

Defined cases: a null text is empty and has no spans; an empty table gives no rows; repeated rows give equal rows; parts
without readable characters are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import html
import itertools
import re
import zlib
from bisect import bisect_right
from urllib.parse import unquote_to_bytes

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_kind, documents, map_texts

BASE = ("assign", "access", "hex")
KINDS = (*BASE, *(f"decoded_{k}" for k in BASE))
WINDOW = 1 << 24
OVERLAP = 1 << 20
FED = 1 << 14
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# A match starts where its run of characters starts, so long runs are walked once.
_PERCENT = re.compile(r"(?<![A-Za-z0-9._~+/=:&?-])[A-Za-z0-9._~+/=:&?-]*(?:%[0-9A-Fa-f]{2}[A-Za-z0-9._~+/=:&?-]*)+")
_ESCAPED = re.compile(r"(?<![!-\[\]-~])[!-\[\]-~]*(?:\\u[0-9A-Fa-f]{4}[!-\[\]-~]*)+")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}+(?:[\x20\t]*\r?\n[\x20\t>]*[A-Za-z0-9+/_-]{16,}+)*+(?:[\x20\t]*\r?\n[\x20\t>]*[A-Za-z0-9+/_-]++)?={0,2}")
_NARROW = re.compile(r"[A-Za-z0-9+/_-]{4,15}+(?:[\x20\t]*\r?\n[\x20\t>]*[A-Za-z0-9+/_-]{4,15}+){2,}+={0,2}")
#: Escapes of one kind. Percent signs escaped again and again are resolved at once, so depth costs nothing.
_PERCENTS = re.compile(r"(?:%[89A-Fa-f][0-9A-Fa-f])+|%(?:25)*(?:u[0-9A-Fa-f]{4}|[0-7][0-9A-Fa-f])")
_AGAIN = re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})")
_BACKSLASHES = re.compile(r"""\\(?:u\{[0-9A-Fa-f]{1,6}\}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}|[nrt"'/\\])""")
_REFERENCES = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});")
_LETTERS = {"n": "\n", "r": "\r", "t": "\t"}
_UTF16 = (("utf-16-le", re.compile(rb"(?:[\t\n\r\x20-\x7E]\0){12}")), ("utf-16-be", re.compile(rb"(?:\0[\t\n\r\x20-\x7E]){12}")))
_BREAK = re.compile(r"[\x20\t\r\n>]+")
_READABLE = re.compile(rb"[\t\n\r\x20-\x7E]{12}")  # the shortest finding is token=abcdef, and whatever encodes one is longer
_PACKED = re.compile(rb"\x1F\x8B\x08|\x78[\x01\x5E\x9C\xDA]")


def scan(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the secrets that stand in a text as it is."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def _as_text(data: bytes) -> str | None:
    """The text of decoded bytes, what isn't UTF-8 replaced; None if nowhere enough readable characters for a secret follow each other."""
    return data.decode(errors="replace") if _READABLE.search(data) else None


def _members(data: bytes, at: int):
    """(next place, inflated bytes) piece by piece of the zlib stream or the gzip members that start at a place."""
    while _PACKED.match(data, at):
        z = zlib.decompressobj(47)
        while not z.eof:
            fed = data[at : at + FED]
            try:
                out = z.decompress(fed, WINDOW)
            except zlib.error:
                return
            if not fed and not out and not z.eof:
                return  # cut short
            at += len(fed) - len(z.unconsumed_tail) - len(z.unused_data)
            yield at, out
        while data[at : at + 1] == b"\0":
            at += 1


def _inflated(data: bytes):
    """Windows, OVERLAP bytes of which stand in the next one too, of what the packed streams in some bytes inflate to."""
    at = 0
    while m := _PACKED.search(data, at):
        at, window = m.start() + 1, b""
        for at, out in _members(data, m.start()):
            window += out
            if len(window) >= WINDOW:
                yield window
                window = window[-OVERLAP:]
        at = max(at, m.start() + 1)
        if window:
            yield window


def _bare(data: bytes):
    """The same windows of deflate data without a header. Bytes that aren't such data end soon, and what they gave until then is
    rarely readable; it is a layer then like any other.
    """
    z, window = zlib.decompressobj(-15), b""
    while data and not z.eof:
        try:
            window = window[-OVERLAP:] + z.decompress(data, WINDOW)
        except zlib.error:
            return
        data = z.unconsumed_tail
        if _READABLE.search(window):
            yield window


def _texts(data: bytes):
    for layer in itertools.chain((data,), _inflated(data)):
        if (plain := _as_text(layer)) is not None:
            yield plain
        for name, pattern in _UTF16:
            if m := pattern.search(layer):
                yield layer[m.start() % 2 :].decode(name, "replace")
    if not _READABLE.search(data):
        for layer in _bare(data):
            yield layer.decode(errors="replace")


def _base64_texts(run: str):
    """The texts of a run at each of the four places where its groups of four may start."""
    body = run.replace("-", "+").replace("_", "/")
    for shift in range(4):
        part = body[shift:]
        part = part[:-1] if len(part) % 4 == 1 else part
        yield from _texts(base64.b64decode(part + "=" * (-len(part) % 4)))


def _unescaped(part: str) -> str:
    units = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), part)
    return units.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def encoded_parts(text: str):
    """start, end, decoded text of the parts of a layer; a part may have several texts."""
    if "%" in text:
        for m in _PERCENT.finditer(text):
            for plain in _texts(unquote_to_bytes(_AGAIN.sub("%", m[0]))):
                yield m.start(), m.end(), plain
    if "\\u" in text:
        for m in _ESCAPED.finditer(text):
            yield m.start(), m.end(), _unescaped(m[0])
    for m in _BASE64.finditer(text):
        for plain in _base64_texts(m[0].rstrip("=")):
            yield m.start(), m.end(), plain
    for m in _WRAPPED.finditer(text) if "\n" in text else ():
        for plain in _base64_texts(_BREAK.sub("", m[0]).rstrip("=")) if "\n" in m[0] else ():
            yield m.start(), m.end(), plain
    for m in _NARROW.finditer(text) if "\n" in text else ():
        for plain in _base64_texts(_BREAK.sub("", m[0]).rstrip("=")):
            yield m.start(), m.end(), plain


def _percent(m: re.Match) -> str:
    part = m[0]
    if part[1] in "89abcdefABCDEF":
        return unquote_to_bytes(part).decode(errors="replace")
    return chr(int(part[part.rindex("u") + 1 :] if "u" in part else part[-2:], 16))


def _backslash(m: re.Match) -> str:
    if m[0][1] in "uUx":
        code = int(m[0][2:].strip("{}"), 16)
        return chr(code) if code <= 0x10FFFF else m[0]
    return _LETTERS.get(m[0][1], m[0][1])


_WHOLE = (("%", _PERCENTS, _percent), ("\\", _BACKSLASHES, _backslash), ("&", _REFERENCES, lambda m: html.unescape(m[0])))


def whole_layers(text: str):
    """(decoded text, place) for each kind of escape that a layer has; place(start, end) says where that span stands in the layer."""
    for mark, pattern, value in _WHOLE:
        if mark not in text:
            continue
        out, here, there, at, n = [], [0], [(0, 0)], 0, 0  # from each place on: what it comes from, and how long that is (0: letter by letter)
        for m in pattern.finditer(text):
            plain = value(m)
            out += [text[at : m.start()], plain]
            n += m.start() - at
            here += [n, n + len(plain)]
            there += [(m.start(), m.end() - m.start()), (m.end(), 0)]
            n, at = n + len(plain), m.end()
        if out:

            def place(start: int, end: int, here=here, there=there) -> tuple[int, int]:
                i, j = bisect_right(here, start) - 1, bisect_right(here, end - 1) - 1
                (a, size_a), (b, size_b) = there[i], there[j]
                return a + (0 if size_a else start - here[i]), b + (size_b or end - here[j])

            yield "".join([*out, text[at:]]), place


def _top_parts(text: str, found: set):
    """The encoded parts of the text and of what its escapes hide; findings of the latter go to ``found``."""
    yield from encoded_parts(text)
    work, seen = [(text, lambda a, b: (a, b))], {text}
    while work:
        layer, outer = work.pop()
        for plain, inner in whole_layers(layer):
            if plain in seen:
                continue
            seen.add(plain)
            place = lambda a, b, inner=inner, outer=outer: outer(*inner(a, b))
            for a, b, kind in scan(plain):
                x, y = place(a, b)
                if text[x:y] != plain[a:b]:
                    found.add((x, y, f"decoded_{kind}"))
            for a, b, part in encoded_parts(plain):
                yield *place(a, b), part
            work.append((plain, place))


def _inner_parts(text: str):
    yield from encoded_parts(text)
    for plain, _ in whole_layers(text):
        yield 0, len(text), plain


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of all findings, by start, then kind as in KINDS."""
    found = set(scan(text))
    kinds: dict[bytes, set[str]] = {}  # of each layer, by digest
    around: dict[bytes, set[bytes]] = {}  # the layers that a layer was decoded from
    spans, stack = [], [(None, _top_parts(text, found))]
    while stack:
        outer, parts = stack[-1]
        for a, b, plain in parts:
            layer = hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if outer is None:
                spans.append((a, b, layer))
            else:
                around.setdefault(layer, set()).add(outer)
            if layer not in kinds:
                kinds[layer] = {kind for _, _, kind in scan(plain)}
                stack.append((layer, _inner_parts(plain)))
                break
        else:
            stack.pop()
    work = [layer for layer, own in kinds.items() if own]
    while work:
        layer = work.pop()
        for outer in around.get(layer, ()):
            if not kinds[layer] <= kinds[outer]:
                kinds[outer] |= kinds[layer]
                work.append(outer)
    found.update((a, b, f"decoded_{kind}") for a, b, layer in spans for kind in kinds[layer])
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2]), f[1]))


def redact(text: str, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, b, _ in find_secrets(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, found array<string> of kind:start:end."""
    return map_texts(docs, lambda text: ([f"{k}:{a}:{b}" for a, b, k in find_secrets(text)],), "found array<string>")


def op8_secrets_worklist(spark, sf_dir):
    found = secret_spans(documents(spark, sf_dir))
    count = [count_kind("found", k).alias(f"n_{k}") for k in BASE]
    base = F.filter("found", lambda s: F.substring_index(s, ":", 1).isin(*BASE))
    return found.select("doc_id", *count, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join("found", ",").alias("spans"))
