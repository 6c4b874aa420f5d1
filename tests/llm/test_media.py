import hashlib
import io
import struct
import wave
import zlib

import pytest

from kinweave.llm import media

GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\1\1\0\0\1\0\1\0\0" + b"\xff\xda\x00\x04ab" + b"data\xff\x00more\xff\xd0x\xff\xd9"
AU = b".snd" + struct.pack(">5I", 24, 4, 2, 8000, 1) + b"abcd"


@pytest.mark.parametrize("choice", range(4))
def test_round_trip(choice):
    for text in [b"", b"a", b"x" * 192, bytes(range(256)) * 3, b"BM RIFF P5\n GIF89a .snd \x89PNG\r\n\x1a\n" * 40]:
        payload = media.payload_of(text)
        assert len(payload) % 192 == 0 and payload and payload.rstrip(b" ") == text.rstrip(b" ")
        blob = media.encode(payload, choice)
        items = media.sniff(blob)
        assert (items[0].start, items[0].end) == (0, len(blob))
        assert media.read_samples(blob, items[0]) == payload


def test_carving_and_damage():
    wav = media.encode(b"s" * 192, 0)
    png = media.encode(b"p" * 192, 3)
    parts = [b"junk BM RIFF....WAVE P5\nx", GIF, b"..", JPEG, b"\xff\xd8\xff", wav, png, AU, b"tail"]
    blob, want, at = b"".join(parts), [], 0
    for part in parts:
        if part in (GIF, JPEG, wav, png, AU):
            want.append((at, at + len(part)))
        at += len(part)
    assert [(i.start, i.end) for i in media.sniff(blob)] == want
    assert [i.kind for i in media.sniff(blob)] == ["image/gif", "image/jpeg", "audio/wav", "image/png", "audio/basic"]
    for good in (GIF, JPEG, wav, png, AU):
        assert media.sniff(good[:-1]) == []
    broken = bytearray(png)
    broken[40] ^= 1
    assert media.sniff(bytes(broken)) == []
    held = media.encode(media.payload_of(GIF), 2)  # inside an item that covers the blob
    assert [i.kind for i in media.sniff(held)] == ["image/x-portable-graymap", "image/gif"]


def plain_samples(blob):
    """Samples of a stored payload, read without the module under test."""
    if blob[:4] == b"RIFF":
        with wave.open(io.BytesIO(blob)) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
            return w.readframes(w.getnframes())
    if blob[:2] == b"BM":
        return blob[int.from_bytes(blob[10:14], "little"):]
    if blob[:2] == b"P5":
        return blob.split(b"\n", 3)[3]
    at, data = 8, b""
    while at < len(blob):
        size = int.from_bytes(blob[at:at + 4], "big")
        data += blob[at + 8:at + 8 + size] if blob[at + 4:at + 8] == b"IDAT" else b""
        at += size + 12
    raw = zlib.decompress(data)
    return b"".join(raw[i + 1:i + 193] for i in range(0, len(raw), 193))


def test_features_by_plain_loops(spark):
    texts = [None, "", "a", "é" * 300, "some words " * 70, "zz\n" * 500, "x" * 192, "payload 7", "payload 8", "payload 9"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    stored = {r.doc_id: bytes(r.media) for r in media.store_payloads(df).collect()}
    kinds = set()
    for r in media.digest_media(media.store_payloads(df)).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        assert plain_samples(stored[r.doc_id]) == payload
        steps = sum(abs(a - b) for a, b in zip(payload, payload[1:]))
        want = f"sum={sum(payload)};squares={sum(b * b for b in payload)};steps={steps};distinct={len(set(payload))}"
        assert r.feature == f"type={r.media_type};{want}" and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        kinds.add(r.media_type)
    assert len(kinds) > 2


def test_columns(spark):
    docs = [(1, "abc", 0), (2, None, 0), (3, "", 0), (4, "é" * 96, 0), (5, "abc", 0), (5, "abc", 0), (6, "w " * 50000, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, media int").repartition(3)
    rows = media.digest_media(media.store_payloads(df)).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 5, 5, 6]
    by = {r.doc_id: r for r in rows}
    for doc_id, text, _ in docs:
        data, r = (text or "").encode(), by[doc_id]
        payload = media.payload_of(data)
        blob = media.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(payload), len(blob))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(blob).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_type != "application/octet-stream"
    assert by[1][1:] == by[5][1:] and by[2][1:] == by[3][1:]
    assert media.digest_media(media.store_payloads(df.limit(0))).count() == 0
    column = spark.createDataFrame([(1, bytearray(GIF), "image/png"), (2, None, "x"), (3, bytearray(b"text"), "text/plain"), (4, bytearray(b"-" + AU), None)], "k long, b binary, d string")
    got = {r.key: (r.media_type, [(i.kind, i.start, i.length, bytes(i.content)) for i in r["items"]]) for r in media.scan_media(column, "k", "b", "d").collect()}
    assert got == {1: ("image/gif", []), 2: (None, []), 3: ("text/plain", []), 4: (None, [("audio/basic", 1, len(AU), AU)])}
