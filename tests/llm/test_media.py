from __future__ import annotations

import gzip
import hashlib
import io
import struct
import wave
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import media as m


def png() -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02\x44\x01\0\x3b"
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0\xff\xda\0\x08\x01\x01\0\0\x3f\0\x12\x34\xff\0\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nstartxref\n9\n%%EOF"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
OGG = b"OggS\0\x04" + bytes(20) + b"\x01\x03abc"
MP4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 12, b"mdat") + b"data"
FLAC = b"fLaC\x80\0\0\x22" + bytes(34) + b"\xff\xf8"
SOME = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "application/pdf": PDF, "image/bmp": BMP, "application/zip": zipped(), "application/gzip": gzip.compress(b"x" * 50), "audio/ogg": OGG, "video/mp4": MP4, "audio/flac": FLAC, "audio/wav": m.stored(b"\x80" * 64)}


@pytest.mark.parametrize("kind", SOME)
def test_each_format(kind):
    value = SOME[kind]
    assert m.corrected(m.sniff(value), "text/plain") == kind
    assert m.sniff(value)[0].length == len(value)
    inner = [x for x in m.sniff(b"some prose " + value) if x.kind == kind]
    assert inner and inner[0].start == 11 and inner[0].length == len(value)


@pytest.mark.parametrize("kind", set(SOME) - {"audio/flac", "application/pdf"})
def test_broken_structure_is_refused(kind):
    assert not [x for x in m.sniff(SOME[kind][: len(SOME[kind]) * 2 // 3]) if x.kind == kind]


def crc(data: bytes, bits: int, poly: int) -> int:
    """Bit by bit, as the formats define it."""
    out = 0
    for x in data:
        out ^= x << (bits - 8)
        for _ in range(8):
            out = (out << 1 ^ poly if out >> (bits - 1) else out << 1) & ((1 << bits) - 1)
    return out


def flac(frames: int = 3, total: bool = True) -> bytes:
    info = struct.pack(">HH", 192, 192) + bytes(6) + (((16_000 << 44) | (15 << 36) | (192 * frames if total else 0))).to_bytes(8, "big") + bytes(16)
    out = b"fLaC\x80\0\0\x22" + info
    for i in range(frames):
        head = bytes([0xFF, 0xF8, 0x10, 0x08, i])
        frame = head + bytes([crc(head, 8, 0x07)]) + b"\0\x12\x34"
        out += frame + crc(frame, 16, 0x8005).to_bytes(2, "big")
    return out


def page(kind: int, serial: int, body: bytes) -> bytes:
    out = bytearray(b"OggS\0" + bytes([kind]) + bytes(8) + struct.pack("<III", serial, 0, 0) + bytes([1, len(body)]) + body)
    out[22:26] = struct.pack("<I", crc(bytes(out), 32, 0x04C11DB7))
    return bytes(out)


def test_flac_ends_where_its_samples_do():
    for made in (flac(), flac(1)):
        assert [x.length for x in m.sniff(made + b" and prose that follows") if x.kind == "audio/flac"] == [len(made)]
    assert m.sniff(flac()[:42] + b" a header and prose, but no frame") == []
    bad = bytearray(flac())
    bad[-1] ^= 1
    assert m.sniff(bytes(bad) + b" prose") == []


def test_ogg_streams_side_by_side_and_chained():
    side = page(2, 1, b"a") + page(2, 2, b"b") + page(0, 1, b"c") + page(4, 2, b"d") + page(4, 1, b"e")
    chained = side + page(2, 3, b"f") + page(4, 3, b"g")
    assert [tuple(x) for x in m.sniff(b"xx" + chained + b"prose")] == [("audio/ogg", 2, len(chained))]
    bad = bytearray(side)
    bad[28] ^= 1
    assert not [x for x in m.sniff(bytes(bad)) if x.start == 0]
    assert m.sniff(page(2, 1, b"a") + page(0, 1, b"c") * 50) == []


def test_pdf_up_to_its_last_revision():
    body = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nstartxref\n9\n%%EOF"
    update = b"\n2 0 obj\n<<>>\nendobj\nstartxref\n" + str(len(body) + 1).encode() + b"\n%%EOF"
    two = body + update
    assert [tuple(x) for x in m.sniff(two + b" prose " + body)] == [("application/pdf", 0, len(two)), ("application/pdf", len(two) + 7, len(body))]
    assert m.sniff(b"%PDF-1.4 prose\nstartxref\n3\n%%EOF") == []


def test_large_boxes_and_many_headers():
    ftyp = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0)
    assert m.sniff(ftyp + struct.pack(">I4sQ", 1, b"mdat", 20) + b"data")[0].length == 36
    assert m.sniff(ftyp + struct.pack(">I4s", 0, b"mdat") + b"to the end")[0].length == 34
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(2000):
            z.writestr(f"{i}", "x")
    assert [tuple(x) for x in m.sniff(out.getvalue())] == [("application/zip", 0, len(out.getvalue()))]


def test_damaged_png_and_words_that_look_like_magic():
    bad = bytearray(png())
    bad[20] ^= 1
    assert m.sniff(bytes(bad)) == []
    assert m.sniff(b"BM RIFF PK\x03\x04 fLaC OggS ftyp GIF89a %PDF- \xff\xd8\xff") == []
    assert m.sniff(None) == [] and m.sniff(b"") == []
    assert m.corrected([], None) == m.UNKNOWN


def test_carving_in_a_column(spark):
    rows = [(1, png() + b"tail" + GIF, "image/jpeg"), (2, b"plain", "text/plain"), (3, None, None), (4, zipped(), "application/octet-stream")]
    df = spark.createDataFrame(rows, "doc_id long, value binary, declared string")
    got = {r.doc_id: r for r in m.media_column(df, "value", "declared").collect()}
    assert got[1].media_type == "image/png" and [bytes(x["bytes"]) for x in got[1].embedded] == [GIF]
    assert got[2].media_type == "text/plain" and got[3].media_type == m.UNKNOWN and got[4].media_type == "application/zip"


def test_round_trip(documents, rows):
    got = {r.doc_id: r for r in m.round_trip(documents).collect()}
    assert len(got) == len(rows)
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = m.stored(payload)
        with wave.open(io.BytesIO(stored)) as w:
            assert w.readframes(w.getnframes()) == payload and w.getsampwidth() == 1
        assert (g.media_bytes, g.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert g.feature.startswith("audio/wav;")


def test_odd_rows(crowded, odd, empty):
    got = m.round_trip(crowded).collect()
    assert len(got) == odd.count() and m.round_trip(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[1].payload_bytes == by[2].payload_bytes == 64 and by[1].media_sha256 == by[2].media_sha256
    assert m.samples(m.stored(b"abc")) == b"abc"
    assert m.round_trip(odd.where(F.col("doc_id") == 6)).select("feature").distinct().count() == 1
