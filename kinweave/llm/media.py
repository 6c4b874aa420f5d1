"""Media columns: types by signature, structure by validation, embedded media by carving.

An Aho-Corasick automaton locates the magic bytes of every known format in one
pass over a blob. A validator per format then walks the structure from each hit
(chunk lengths and checksums, segment markers, header sizes) and tells where
the item ends, or that there is none. The item at offset 0 that covers the blob
corrects the declared type; other valid items are carved with their places.

``store_payloads`` turns texts into such a column: a payload of 8-bit samples
in one of four lossless containers, chosen by the payload's checksum.
``read_samples`` reads the payload back from the stored bytes.

Defined cases: a null blob has no type and no items; a null or empty text has
a payload of 192 spaces; blobs without a valid item keep their declared type;
repeated rows give repeated result rows; extra columns are unused.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.arrow import slices
from kinweave.sources.shared import materialize

ROW = 192

# Magic bytes of each format, from their public specifications.
SIGNATURES = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
    b"RIFF": "riff",
    b"P5\n": "image/x-portable-graymap",
    b".snd": "audio/basic",
}
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


class Item(NamedTuple):
    """A valid media item: its type and the bytes it covers."""

    kind: str
    start: int
    end: int


def _png(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, p)
        end = p + 12 + size
        if end > len(b) or first != (name == b"IHDR") or first and size != 13:
            return None
        if zlib.crc32(b[p + 4:end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if name == b"IEND":
            return end
        p, first = end, False
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags, p = b[at + 10], at + 13
    p += 3 << ((flags & 7) + 1) if flags & 128 else 0
    images = 0
    while p < len(b):
        mark = b[p]
        if mark == 0x3B:
            return p + 1 if images else None
        if mark == 0x21:
            p += 2
        elif mark == 0x2C and p + 10 < len(b):
            flags, images = b[p + 9], images + 1
            p += 10 + (3 << ((flags & 7) + 1) if flags & 128 else 0) + 1
        else:
            return None
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p, scans = at + 2, 0
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        if mark == 0xFF:
            p += 1
            continue
        if mark in (0x00, 0x01, 0xD8) or 0xD0 <= mark <= 0xD7:
            return None
        size = struct.unpack_from(">H", b, p + 2)[0]
        p += 2 + size
        if size < 2 or p > len(b):
            return None
        if mark == 0xDA:  # coded data runs to the next marker that is neither stuffed nor a restart
            scans += 1
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0xD9:
                    return p + 2
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, reserved, data, header, width, height, planes, depth, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if reserved or header not in (40, 52, 56, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    row = (width * depth + 31) // 32 * 4
    if at + size > len(b) or data < 14 + header or packed not in (0, 3) or data + row * abs(height) > size:
        return None
    return at + size


def _riff(b: bytes, at: int) -> int | None:
    if at + 12 > len(b) or b[at + 8:at + 12] not in RIFF_TYPES:
        return None
    end, p = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12
    if end > len(b):
        return None
    while p + 8 <= end:
        p += 8 + (struct.unpack_from("<I", b, p + 4)[0] + 1 & ~1)
    return end if p == end else None


def _pgm(b: bytes, at: int) -> int | None:
    fields, p = [], at + 2
    while len(fields) < 3:
        start = p = p + 1
        while p < len(b) and p < start + 10 and 48 <= b[p] <= 57:
            p += 1
        if p == start or p >= len(b) or b[p] not in b" \n\t\r":
            return None
        fields.append(int(b[start:p]))
    width, height, top = fields
    end = p + 1 + width * height * (1 if top < 256 else 2)
    return end if width and height and 0 < top < 65536 and end <= len(b) else None


def _au(b: bytes, at: int) -> int | None:
    if at + 24 > len(b):
        return None
    head, size, coding, rate, channels = struct.unpack_from(">5I", b, at + 4)
    end = at + head + size
    return end if head >= 24 and 1 <= coding <= 27 and 0 < rate <= 768_000 and 0 < channels <= 64 and end <= len(b) else None


_VALIDATORS = {"image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "riff": _riff, "image/x-portable-graymap": _pgm, "audio/basic": _au}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for magic, kind in SIGNATURES.items():
        built.add_word(magic.decode("latin-1"), (len(magic), kind))
    built.make_automaton()
    return built


def sniff(blob: bytes) -> list[Item]:
    """Valid items of ``blob`` by place; inside an item only the one that covers the whole blob is searched."""
    found, free = [], 0
    for last, (size, kind) in _automaton().iter(blob.decode("latin-1")):
        at = last + 1 - size
        if at < free:
            continue
        end = _VALIDATORS[kind](blob, at)
        if end is not None:
            found.append(Item(RIFF_TYPES[blob[at + 8:at + 12]] if kind == "riff" else kind, at, end))
            free = 0 if (at, end) == (0, len(blob)) else end
    return found


def corrected_type(blob: bytes, declared: str | None, items: list[Item]) -> str | None:
    """The type of the item that starts the blob, else the declared one."""
    return items[0].kind if items and items[0].start == 0 else declared


def payload_of(text: bytes) -> bytes:
    """``text`` and spaces up to a positive multiple of 192 bytes."""
    return text + b" " * (-len(text) % ROW or (0 if text else ROW))


def encode(payload: bytes, choice: int | None = None) -> bytes:
    """A lossless container of 8-bit samples; by default chosen by the payload's checksum."""
    n, rows = len(payload), len(payload) // ROW
    choice = zlib.crc32(payload) % 4 if choice is None else choice
    if choice == 0:
        return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload
    if choice == 1:  # 64 pixels of 24 bits a row; a negative height keeps rows in order
        return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + n, 0, 54, 40, ROW // 3, -rows, 1, 24, 0, n, 2835, 2835, 0, 0) + payload
    if choice == 2:
        return b"P5\n%d %d\n255\n" % (ROW, rows) + payload
    raw = np.zeros((rows, ROW + 1), dtype=np.uint8)  # filter byte 0 leads each row
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(raw.tobytes(), 1)), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)


def read_samples(blob: bytes, item: Item) -> bytes:
    """The samples of an item written by ``encode``, in order."""
    b = blob[item.start:item.end]
    if item.kind == "audio/wav":
        p = 12
        while b[p:p + 4] != b"data":
            p += 8 + (struct.unpack_from("<I", b, p + 4)[0] + 1 & ~1)
        return b[p + 8:p + 8 + struct.unpack_from("<I", b, p + 4)[0]]
    if item.kind == "image/bmp":
        return b[struct.unpack_from("<I", b, 10)[0]:]
    if item.kind == "image/x-portable-graymap":
        return b[b.index(b"\n255\n") + 5:]
    if item.kind == "image/png":
        p, data, width = 8, [], 0
        while p < len(b):
            size, name = struct.unpack_from(">I4s", b, p)
            if name == b"IHDR":
                width = struct.unpack_from(">I", b, p + 8)[0]
            elif name == b"IDAT":
                data.append(b[p + 8:p + 8 + size])
            p += 12 + size
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
        if raw[:, 0].any():
            raise ValueError("only unfiltered rows are read")
        return raw[:, 1:].tobytes()
    raise ValueError(f"no reader for {item.kind}")


def sample_features(samples: bytes) -> str:
    """Sum, sum of squares, steps between neighbours, and distinct values of the samples."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256).astype(np.int64)
    value = np.arange(256)
    steps = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    return f"sum={int(counts @ value)};squares={int(counts @ value**2)};steps={steps};distinct={int((counts > 0).sum())}"


def _store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            texts = [t.as_py() or b"" for t in part.column(1)]
            media = pa.array([encode(payload_of(t)) for t in texts], pa.binary())
            sizes = pa.array([len(t) for t in texts], pa.int64())
            kinds = pa.array(["application/octet-stream"] * len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, media, kinds], ["doc_id", "n_bytes", "media", "declared_type"])


def store_payloads(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, declared_type): each whole text as a media column of undeclared kind."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return plain.mapInArrow(_store_batches, "doc_id long, n_bytes long, media binary, declared_type string")


def _sniff_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "media_type", "items"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("content", pa.binary())]))
    for batch in batches:
        for part in slices(batch, 1):
            types, items = [], []
            for blob, declared in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                found = sniff(blob) if blob else []
                types.append(corrected_type(blob, declared, found) if blob is not None else None)
                items.append([{"kind": i.kind, "start": i.start, "length": i.end - i.start, "content": blob[i.start:i.end]} for i in found if (i.start, i.end) != (0, len(blob))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(types, pa.string()), pa.array(items, kind)], names)


def scan_media(df: DataFrame, key: str, media: str, declared: str) -> DataFrame:
    """(key, media_type, items): corrected type and carved items (kind, start, length, content) of a binary column."""
    plain = df.select(F.col(key).cast("long").alias("key"), F.col(media).alias("media"), F.col(declared).cast("string").alias("declared"))
    return plain.mapInArrow(_sniff_batches, "key long, media_type string, items array<struct<kind:string,start:long,length:long,content:binary>>")


_DIGEST = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "n_embedded"]


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for part in slices(batch, 2):
            rows = []
            for doc, n, blob, declared in zip(*(part.column(i).to_pylist() for i in range(4))):
                items = sniff(blob)
                kind = corrected_type(blob, declared, items)
                samples = read_samples(blob, items[0])
                rows.append((
                    doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]),
                    len(blob), hashlib.sha256(blob).hexdigest(), f"type={kind};{sample_features(samples)}", kind, len(items) - 1,
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _DIGEST)


def digest_media(stored: DataFrame) -> DataFrame:
    """Sizes, checksums, type and features of stored payloads, from the bytes read back."""
    stored = materialize(stored, "media")  # the table is written, then read
    return stored.mapInArrow(_digest_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, n_embedded long")
