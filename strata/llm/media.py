"""MPEG audio columns: write bytes as a layer III stream and read such streams frame by frame.

Reading: tags are skipped (ID3v2 in front, ID3v1 at the end), frame headers are resynchronised (at the start and after every
gap a header counts only if a frame of its kind after it, a tag or the end of the stream confirms it; one that isn't confirmed
elsewhere counts if it is of the same kind, with the right checksum, and no confirmed frame starts inside it), the 16-bit checksum over
header and side information of layer III is verified, a table of a variable bitrate (Xing, Info or VBRI) is parsed with its seek
points, and durations and frame offsets are exact: samples from the headers,
offsets from the bytes, both in whole numbers.

Writing: MPEG-1 layer III, mono, 48 kHz, with checksums. Every frame has empty granules (silence), so the rest of the frame
is ancillary data, which carries the payload losslessly. Frames take the largest size and the last one the smallest that
fits, so the bitrate varies and a table with 100 seek points stands in the first frame. An ID3v2.3 tag keeps the payload's
length and CRC-32.

Defined cases of the payload: UTF-8 of the text (null: empty), zero bytes up to a positive multiple of 64. Equal texts give
equal streams. An empty table gives no rows; repeated rows give equal rows; a stream without a valid frame has no frames, and
an unreadable payload is null; long texts only mean more frames.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, documents, id_and_text, ship, slices

#: Fixed values of the format: kbit/s by index for MPEG-1 layers I, II, III and MPEG-2 layers I, II and III; Hz by index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_SIDE_MONO = 17
_OVERHEAD = 4 + 2 + _SIDE_MONO
_TABLE_AT = 4 + _SIDE_MONO
UNIT = 64


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The format's checksum: polynomial 0x8005, most significant bit first."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


class Header:
    """The fields of a frame header, or ``ok`` False."""

    __slots__ = ("ok", "version", "layer", "checked", "rate", "size", "samples", "mono", "kbps")

    def __init__(self, head: bytes):
        bits = int.from_bytes(head, "big") if len(head) == 4 else 0
        self.version, layer, index, rate = bits >> 19 & 3, bits >> 17 & 3, bits >> 12 & 15, bits >> 10 & 3
        self.ok = bits >> 21 == 0x7FF and self.version != 1 and layer != 0 and 0 < index < 15 and rate != 3
        if self.ok:
            self.layer, first = 4 - layer, self.version == 3
            self.checked, self.mono, pad = not bits >> 16 & 1, bits >> 6 & 3 == 3, bits >> 9 & 1
            self.kbps = BITRATES[(1, self.layer) if first else (2, min(self.layer, 2))][index]
            self.rate = RATES[self.version][rate]
            self.samples = 384 if self.layer == 1 else 1152 if first or self.layer == 2 else 576
            self.size = (12000 * self.kbps // self.rate + pad) * 4 if self.layer == 1 else self.samples * 125 * self.kbps // self.rate + pad

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


def _head(index: int, checked: bool) -> bytes:
    return struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | (not checked) << 16 | index << 12 | 1 << 10 | 3 << 6)


_SIZES = [Header(_head(i, True)).size for i in range(1, 15)]
_FRONTS = []
for _i in range(1, 15):
    _h = _head(_i, True)
    _FRONTS.append(_h + struct.pack(">H", crc16(_h[2:] + bytes(_SIDE_MONO))) + bytes(_SIDE_MONO))


def payload_of(text: str) -> tuple[bytes, int]:
    data = text.encode()
    return data + bytes(-len(data) % UNIT if data else UNIT), len(data)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    frames, at, most = [], 0, _SIZES[-1] - _OVERHEAD
    while at < len(payload):
        left = len(payload) - at
        i = 13 if left >= most else next(i for i, s in enumerate(_SIZES) if s - _OVERHEAD >= left)
        room = _SIZES[i] - _OVERHEAD
        frames.append(_FRONTS[i] + payload[at : at + room].ljust(room, b"\0"))
        at += room
    note = f"payload\0{len(payload)}:{zlib.crc32(payload):08x}".encode("latin-1")
    frame = b"TXXX" + struct.pack(">IH", len(note) + 1, 0) + b"\0" + note
    tag = b"ID3\x03\0\0" + _synchsafe(len(frame)) + frame
    first = _head(3, False)
    size = Header(first).size
    total = size + sum(map(len, frames))
    toc = bytearray()
    ends = [size]
    for f in frames:
        ends.append(ends[-1] + len(f))
    for percent in range(100):
        toc.append(min(255, ends[percent * len(frames) // 100] * 256 // total))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(toc)
    return tag + (first + bytes(_SIDE_MONO) + table).ljust(size, b"\0") + b"".join(frames)


def _tags(data: bytes) -> tuple[int, int, dict[str, str], list[str]]:
    """Where the audio starts and ends, the user text fields, and the tags found."""
    start, end, fields, found = 0, len(data), {}, []
    while data[start : start + 3] == b"ID3" and start + 10 <= len(data):
        size = sum((b & 0x7F) << s for b, s in zip(data[start + 6 : start + 10], (21, 14, 7, 0)))
        found.append(f"id3v2.{data[start + 3]}")
        at, stop = start + 10, start + 10 + size
        while at + 10 <= stop and data[at : at + 4].strip(b"\0"):
            n = sum((b & 0x7F) << s for b, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0))) if data[start + 3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
            if data[at : at + 4] == b"TXXX" and n > 1 and data[at + 10 : at + 11] == b"\0":
                key, _, value = data[at + 11 : at + 10 + n].decode("latin-1").partition("\0")
                fields[key] = value
            at += 10 + n
        start = min(stop + 10 * (data[start + 5] >> 4 & 1), len(data))
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        found.append("id3v1")
        end -= 128
    return start, end, fields, found


def _confirmed(data: bytes, at: int, stop: int, end: int) -> bool:
    """Whether a frame is followed by the header of one with the same version, layer and rate, by a tag, or by the end."""
    if stop + 4 > end:
        return stop == end
    alike = data[stop] == 0xFF and (data[stop + 1] ^ data[at + 1]) & 0xFE == 0 and (data[stop + 2] ^ data[at + 2]) & 0x0C == 0
    return alike and Header(data[stop : stop + 4]).ok or data[stop : stop + 3] in (b"TAG", b"ID3")


def _likely(data: bytes, at: int, h: Header, last: Header, end: int) -> bool:
    """Whether an unconfirmed header right after a frame starts one: it is of the same kind, its checksum is right where it has
    one, and no confirmed frame starts inside what it claims.
    """
    stop = at + h.size
    if (h.version, h.layer, h.rate) != (last.version, last.layer, last.rate):
        return False
    if h.checked and h.layer == 3 and crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != int.from_bytes(data[at + 4 : at + 6], "big"):
        return False
    p = data.find(b"\xff", at + 1, stop)
    while p >= 0:
        inner = Header(data[p : p + 4])
        if inner.ok and p + inner.size <= end and _confirmed(data, p, p + inner.size, end):
            return False
        p = data.find(b"\xff", p + 1, stop)
    return True


def parse(data: bytes) -> dict:
    """Frames, offsets, checks, table, tags and, where the stream carries one, the payload."""
    start, end, fields, tags = _tags(data)
    at, offsets, body, lost, last = start, [], [], True, None
    out = {"samples": 0, "rate": 0, "good": 0, "bad": 0, "skipped": 0, "table_frames": None, "table_bytes": None, "seek": [], "seek_frames": 0, "kbps": [0, 0], "layer": 0, "version": 0}
    checks: dict[bytes, bool] = {}
    while at + 4 <= end:
        h = Header(data[at : at + 4])
        stop = at + h.size if h.ok else 0
        if not h.ok or stop > end or not _confirmed(data, at, stop, end) and (lost or not _likely(data, at, h, last, end)):
            lost = True
            again = data.find(b"\xff", at + 1, end)
            again = end if again < 0 else again
            out["skipped"] += again - at
            at = again
            continue
        lost, last = False, h
        xing = at + 4 + h.side
        if h.layer == 3 and not offsets and out["table_frames"] is None and data[xing : xing + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(data[xing + 4 : xing + 8], "big"), xing + 8
            for bit, key in ((1, "table_frames"), (2, "table_bytes")):
                if flags & bit:
                    out[key], p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4:
                # 256 parts of the stream's bytes, for each hundredth of its time.
                out["seek"] = [x * (out["table_bytes"] or end - at) // 256 + at for x in data[p : p + 100]]
            at = stop
            continue
        if h.layer == 3 and not offsets and out["table_frames"] is None and data[at + 36 : at + 40] == b"VBRI" and at + 62 <= end:
            out["table_bytes"], out["table_frames"], n, scale, size, step = struct.unpack(">IIHHHH", data[at + 46 : at + 62])
            sizes = [int.from_bytes(data[p : p + size], "big") * scale for p in range(at + 62, min(at + 62 + n * size, stop), size)] if size else []
            out["seek"] = [stop + sum(sizes[:i]) for i in range(len(sizes))]
            out["seek_frames"] = step
            at = stop
            continue
        if h.checked and h.layer == 3:
            covered = data[at + 2 : at + 4] + data[at + 4 : at + 6 + h.side]
            if covered not in checks:
                checks[covered] = crc16(covered[:2] + covered[4:]) == int.from_bytes(covered[2:4], "big")
            out["good" if checks[covered] else "bad"] += 1
        offsets.append(at)
        body.append(data[at + 4 + 2 * h.checked + h.side : stop] if h.layer == 3 else b"")
        out["samples"] += h.samples
        out["rate"], out["layer"], out["version"] = h.rate, h.layer, h.version
        out["kbps"] = [min(out["kbps"][0] or h.kbps, h.kbps), max(out["kbps"][1], h.kbps)]
        at = stop
    payload = None
    if "payload" in fields:
        n, _, crc = fields["payload"].partition(":")
        size = int(n) if re.fullmatch("[0-9]{1,18}", n) else -1
        joined = b"".join(body)[: max(size, 0)]
        payload = joined if len(joined) == size and f"{zlib.crc32(joined):08x}" == crc else None
    return out | {"offsets": offsets, "tags": tags, "payload": payload, "duration_us": out["samples"] * 1_000_000 // out["rate"] if out["rate"] else 0}


def _map(df: DataFrame, row, ddl: str) -> DataFrame:
    ship(df.sparkSession)
    schema = arrow_schema(ddl)

    def run(batches):
        for b in slices(batches, 64):
            rows = [row(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return df.mapInArrow(run, ddl)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the texts as MPEG audio streams."""

    def row(doc_id, text):
        payload, n = payload_of(text or "")
        return doc_id, n, encode(payload)

    return _map(id_and_text(docs), row, "doc_id long, n_bytes long, media binary")


MEDIA_COLUMNS = "doc_id long, n_bytes long, payload binary, samples long, rate int, duration_us long, frame_offsets array<int>, good_checks int, bad_checks int, skipped_bytes int, table_frames int, min_kbps int, max_kbps int, tags string"


def parse_media(media: DataFrame) -> DataFrame:
    """Everything that the stored streams say; duration is samples / rate, exactly, and the microseconds are cut off."""

    def row(doc_id, n, data):
        p = parse(data or b"")
        return doc_id, n, p["payload"], p["samples"], p["rate"], p["duration_us"], p["offsets"], p["good"], p["bad"], p["skipped"], p["table_frames"], *p["kbps"], ",".join(p["tags"])

    return _map(media.select("doc_id", "n_bytes", "media"), row, MEDIA_COLUMNS)


DIGEST_COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, frame_offsets array<int>"


def media_digests(media: DataFrame) -> DataFrame:
    """parse_media with digests in place of the bytes, so that these needn't travel back. What can't be read of a damaged stream
    (payload, first and last frame) is null or a dash.
    """

    def row(doc_id, n, data):
        data = data or b""
        p = parse(data)
        got = p["payload"]
        own = (None, None, None) if got is None else (len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-UNIT:]))
        first, last = (p["offsets"][0], p["offsets"][-1]) if p["offsets"] else ("-", "-")
        table = "none" if p["table_frames"] is None else f"vbr{p['table_frames']}"
        feature = f"mpeg{p['version']}.{p['layer']};{p['rate']}Hz;{p['kbps'][0]}-{p['kbps'][1]}kbps;frames={len(p['offsets'])};samples={p['samples']};us={p['duration_us']};crc={p['good']}/{p['bad']};skipped={p['skipped']};{table};{'+'.join(p['tags'])};first={first};last={last}"
        return doc_id, n, *own, len(data), hashlib.sha256(data).hexdigest(), feature, p["duration_us"], p["offsets"]

    return _map(media.select("doc_id", "n_bytes", "media"), row, DIGEST_COLUMNS)


def op3_mpeg_audio(spark, sf_dir):
    """The streams are a binary column between two steps: one writes them, the next knows only their bytes."""
    return media_digests(encode_media(documents(spark, sf_dir)))
