"""MPEG audio: exact round trip, resynchronisation, checks, tables."""

import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import media


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=3000))
def test_round_trip(text):
    payload, n = media.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:n].decode() == text and not payload[n:].strip(b"\0")
    p = media.parse(media.encode(payload))
    assert p["payload"] == payload and p["bad"] == 0 and p["skipped"] == 0
    assert len(p["offsets"]) == p["good"] == p["table_frames"] and p["duration_us"] == len(p["offsets"]) * 24_000


def test_offsets_and_table_are_exact():
    data = media.encode(bytes(range(1, 250)) * 40)
    p = media.parse(data)
    assert all(media.Header(data[o : o + 4]).ok for o in p["offsets"])
    last = p["offsets"][-1]
    assert last + media.Header(data[last : last + 4]).size == len(data)
    start = data.index(b"Xing") - media._TABLE_AT
    assert p["table_bytes"] == len(data) - start and p["kbps"] == [224, 320]


def test_resynchronises_over_junk():
    data = media.encode(b"y" * 5000)
    clean = media.parse(data)
    at = clean["offsets"][2]
    torn = data[:at] + b"\xff\xe0junk\xff\xff\x00" + data[at:]
    p = media.parse(torn)
    assert len(p["offsets"]) == len(clean["offsets"]) and p["skipped"] == 9 and p["payload"] == clean["payload"]
    front = media.parse(b"noise\xff\xfb" * 3 + data[media.parse(data)["offsets"][0] :])
    assert len(front["offsets"]) == len(clean["offsets"]) and front["payload"] is None


def test_chance_headers_are_no_frames():
    data = media.encode(b"y" * 5000)
    clean = media.parse(data)
    at = clean["offsets"][2]
    for head in (data[at : at + 4], bytes.fromhex("fffb9064"), bytes.fromhex("fff38064")):
        p = media.parse(data[:at] + head + b"j" * 400 + data[at:])
        assert len(p["offsets"]) == len(clean["offsets"]) and p["skipped"] == 404 and p["payload"] == clean["payload"]


def test_seek_tables():
    data = media.encode(bytes(range(1, 250)) * 400)
    p = media.parse(data)
    assert len(p["seek"]) == 100
    for percent, place in enumerate(p["seek"]):  # a point is a 256th of the stream before the frame at that share of the time, at most
        real = p["offsets"][percent * len(p["offsets"]) // 100]
        assert 0 <= real - place <= p["table_bytes"] / 256 + 1
    frames = data[p["offsets"][0] :]
    head = data[p["offsets"][0] : p["offsets"][0] + 4]
    sizes = [b - a for a, b in zip(p["offsets"], [*p["offsets"][1:], len(data)])]
    table = b"VBRI" + bytes(6) + len(frames).to_bytes(4, "big") + len(sizes).to_bytes(4, "big") + b"".join(n.to_bytes(2, "big") for n in (len(sizes), 1, 2, 1)) + b"".join(n.to_bytes(2, "big") for n in sizes)
    first = (head + bytes(32) + table).ljust(media.Header(head).size, b"\0")
    q = media.parse(first + frames)
    assert (q["table_frames"], q["table_bytes"], q["seek_frames"]) == (len(sizes), len(frames), 1) and q["seek"] == q["offsets"]


def test_digests_of_damaged_streams(spark):
    good = media.encode(b"q" * 64)
    rows = [(1, 5, None), (2, 5, bytearray(b"no frame")), (3, 5, bytearray(good[:-30])), (4, 5, bytearray(good))]
    got = {r.doc_id: r for r in media.media_digests(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert [got[i].payload_sha256 is None for i in (1, 2, 3, 4)] == [True, True, True, False] and got[2].feature.endswith("first=-;last=-")


def test_checksums_catch_damage():
    data = bytearray(media.encode(b"z" * 4000))
    at = media.parse(bytes(data))["offsets"][1]
    data[at + 10] ^= 1
    p = media.parse(bytes(data))
    assert (p["bad"], p["good"]) == (1, p["table_frames"] - 1)
    data = bytearray(media.encode(b"z" * 4000))
    data[at + 200] ^= 1
    assert media.parse(bytes(data))["payload"] is None  # the payload's own checksum


def test_other_streams():
    assert media.parse(b"")["offsets"] == [] and media.parse(b"\xff" * 500)["payload"] is None
    h = media.Header(bytes.fromhex("fffb9064"))
    assert (h.kbps, h.rate, h.size, h.samples, h.side) == (128, 44100, 417, 1152, 32)
    two = media.Header(bytes.fromhex("fff38064"))
    assert (two.version, two.layer, two.rate, two.samples, two.size) == (2, 3, 22050, 576, 208)
    assert media.parse(media.encode(b"q" * 64) + b"TAG" + bytes(125))["tags"] == ["id3v2.3", "id3v1"]
    assert media.crc16(b"123456789") == 0xAEE7


def test_query(spark, sf_dir, tmp_path):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = media.op3_mpeg_audio(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        payload, n = media.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "é" * 200_000, None)], "doc_id long, text string, media long").write.parquet(f"{tmp_path}/documents.parquet")
    odd = media.op3_mpeg_audio(spark, str(tmp_path)).collect()
    assert sorted(r.payload_bytes for r in odd) == [64, 64, 64, 400_000] and len({r.media_sha256 for r in odd}) == 2
    parsed = media.parse_media(media.encode_media(spark.read.parquet(f"{tmp_path}/documents.parquet"))).where("doc_id IS NULL").first()
    assert parsed.payload[:4].decode() == "éé" and parsed.samples == 1152 * len(parsed.frame_offsets)
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert media.op3_mpeg_audio(spark, f"{tmp_path}/e").count() == 0
