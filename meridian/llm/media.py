"""Media columns with signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over the
bytes. A validator of the format then walks the structure from there and gives the true
length or none, so stray magic bytes in text or noise count for nothing. What starts at
offset 0 and fills the bytes corrects the declared type; what lies elsewhere is carved.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from meridian.llm.text import append_columns, utf8

#: Samples of a stored text fill blocks of this many bytes.
BLOCK = 64


def _png(b: bytes, at: int) -> int | None:
    i = at + 8
    while i + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, i)
        end = i + 12 + size
        if end > len(b) or (i == at + 8) != (kind == b"IHDR") or crc32(b[i + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end - at
        i = end
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    i, frames = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), 0

    def blocks(i: int) -> int | None:
        while i < len(b):
            if not b[i]:
                return i + 1
            i += b[i] + 1
        return None

    while i is not None and i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at if frames else None
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            local, frames = b[i + 9], frames + 1
            i = blocks(i + 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1)
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    i, frame = at + 2, False
    while i + 4 <= len(b):
        if b[i] != 0xFF:
            return None
        if b[i + 1] == 0xFF:  # markers may be filled up
            i += 1
            continue
        kind = b[i + 1]
        if kind == 0xD9:
            return i + 2 - at if frame else None
        if kind == 0xD8:  # another image begins
            return None
        size = struct.unpack_from(">H", b, i + 2)[0]
        if size < 2 or not (0xC0 <= kind <= 0xFE):
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        i += 2 + size
        if kind == 0xDA:  # coded data goes on to the next marker that is neither stuffing nor a restart
            while True:
                i = b.find(b"\xff", i)
                if i < 0 or i + 1 >= len(b):
                    return None
                if b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7:
                    i += 2
                elif b[i + 1] == 0xFF:
                    i += 1
                else:
                    break
    return i + 2 - at if frame and b[i : i + 2] == b"\xff\xd9" else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, zero, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or header not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    return size if 14 + header <= offset and offset + rows <= size <= len(b) - at else None


def _riff(form: bytes, first: tuple[bytes, ...]) -> Callable[[bytes, int], int | None]:
    def check(b: bytes, at: int) -> int | None:
        if at + 20 > len(b) or b[at + 8 : at + 12] != form or b[at + 12 : at + 16] not in first:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        i = at + 12
        while i + 8 <= end <= len(b):
            i += 8 + (size := struct.unpack_from("<I", b, i + 4)[0]) + (size & 1)
        return end - at if i == end <= len(b) else None

    return check


_TURNED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def ogg_checksum(page: bytes) -> int:
    """The checksum of a page whose own field is zero: that of zlib on bytes turned about, without its inversions."""
    return int(f"{crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _ogg(b: bytes, at: int) -> int | None:
    i = at
    while i + 27 <= len(b) and b[i : i + 5] == b"OggS\0":
        flags, n = b[i + 5], b[i + 26]
        body = i + 27 + n
        end = body + sum(b[i + 27 : body])
        if end > len(b) or (i == at) != bool(flags & 2):
            return None
        if ogg_checksum(b[i : i + 22] + bytes(4) + b[i + 26 : end]) != struct.unpack_from("<I", b, i + 22)[0]:
            return None
        if flags & 4:
            return end - at
        i = end
    return None


def _pdf(b: bytes, at: int) -> int | None:
    """Up to the last end mark before another file begins, as updates add marks of their own, with the line end after it."""
    head = b[at + 5 : at + 8]
    if not (len(head) == 3 and head[:1].isdigit() and head[1:2] == b"." and head[2:].isdigit()):
        return None
    limit = b.find(b"%PDF-", at + 5)
    limit = len(b) if limit < 0 else limit
    end = b.rfind(b"%%EOF", at, limit)
    if end < 0 or b.find(b"startxref", at, end) < 0:
        return None
    end += 5
    while end < limit and b[end : end + 1] in (b"\r", b"\n"):
        end += 1
    return end - at


#: Type, magic bytes, validator.
FORMATS: list[tuple[str, bytes, Callable[[bytes, int], int | None]]] = [
    ("image/png", b"\x89PNG\r\n\x1a\n", _png),
    ("image/gif", b"GIF87a", _gif),
    ("image/gif", b"GIF89a", _gif),
    ("image/jpeg", b"\xff\xd8\xff", _jpeg),
    ("image/bmp", b"BM", _bmp),
    ("audio/wav", b"RIFF", _riff(b"WAVE", (b"fmt ", b"JUNK", b"bext"))),
    ("image/webp", b"RIFF", _riff(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))),
    ("audio/ogg", b"OggS", _ogg),
    ("application/pdf", b"%PDF-", _pdf),
]


@lru_cache(1)
def _automaton():
    import ahocorasick

    found: dict[bytes, list[int]] = {}
    for k, (_, magic, _) in enumerate(FORMATS):
        found.setdefault(magic, []).append(k)
    a = ahocorasick.Automaton()
    for magic, of in found.items():
        a.add_word(magic.decode("latin-1"), (len(magic), of))
    a.make_automaton()
    return a


def sniff(b: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the valid media in `b`, outermost only, in order."""
    out: list[tuple[int, int, str]] = []
    free = 0
    for end, (size, of) in _automaton().iter(b.decode("latin-1")):
        at = end + 1 - size
        if at < free:
            continue  # within media already found
        for k in of:
            length = FORMATS[k][2](b, at)
            if length:
                out.append((at, length, FORMATS[k][0]))
                free = at + length
                break
    return out


def classify(b: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The type of media that fills `b`, else application/octet-stream, and what else is in it."""
    found = sniff(b)
    if found and found[0][:2] == (0, len(b)):
        return found[0][2], found[1:]
    return "application/octet-stream", found


def store(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as the 8-bit mono samples of a WAV file."""
    n = len(payload)
    data = payload + b"\0" * (n & 1)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + data


def samples(stored: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    i = 12
    while i + 8 <= len(stored):
        kind, size = struct.unpack_from("<4sI", stored, i)
        if kind == b"data":
            return stored[i + 8 : i + 8 + size]
        i += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def heard(p: bytes) -> list[str]:
    """Number, mean in thousandths, crossings of the mean and a checksum of the histogram of 8-bit samples."""
    x = np.frombuffer(p, np.uint8)
    counts = np.bincount(x, minlength=256)
    above = x.astype(np.int64) * len(x) > counts @ np.arange(256)
    return [str(len(x)), str(int(1000 * (counts @ np.arange(256)) // max(1, len(x)))), str(int((above[1:] != above[:-1]).sum())), f"{crc32(counts.astype('<i8').tobytes()):08x}"]


def store_texts(docs: DataFrame) -> DataFrame:
    """`docs` with n_bytes and media: the UTF-8 text, zero-filled to a positive multiple of 64, as a WAV file.

    A null text is stored like an empty one. Columns named like an added one are replaced,
    repeated rows give repeated results and an empty table an empty one.
    """

    def run(texts: list[str | None]) -> dict[str, list]:
        raw = utf8(texts)
        media = [store(b + b"\0" * (-len(b) % BLOCK if b else BLOCK)) for b in raw]
        return {"n_bytes": list(map(len, raw)), "media": media}

    return append_columns(docs, ["text"], run, "n_bytes long, media binary")


def sniff_media(df: DataFrame, media: str = "media", declared: str | None = None) -> DataFrame:
    """`df` with type, corrected and carved (array of offset, length, type) of its media column.

    type is that of valid media which fills the bytes from offset 0 on, else
    application/octet-stream. corrected tells whether it differs from the `declared`
    column; without one, or where it is null, nothing is corrected. Null or empty bytes
    are application/octet-stream with nothing carved. Columns named like an added one are
    replaced. An empty table gives an empty result.
    """

    def run(blobs: list[bytes | None], said: list[str | None] | None = None) -> dict[str, list]:
        out: dict[str, list] = {"type": [], "corrected": [], "carved": []}
        for b, d in zip(blobs, said or [None] * len(blobs)):
            kind, carved = classify(b or b"")
            out["type"].append(kind)
            out["corrected"].append(d is not None and d != kind)
            out["carved"].append([{"offset": o, "length": n, "type": t} for o, n, t in carved])
        return out

    added = "type string, corrected boolean, carved array<struct<offset:long,length:long,type:string>>"
    return append_columns(df, [media, *([declared] if declared else [])], run, added)


def stored_digests(docs: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """`docs` with figures of its texts stored by store_texts, sniffed, and read back, in one pass over each text.

    n_bytes, payload_bytes, payload_sha256 and tail_crc32 (last 64) are of the text and of the
    samples read back, media_bytes and media_sha256 of the stored file. feature names its type, whether that
    corrects the declared one, the media carved from the file and found among the samples, and of the
    samples the number, the mean in thousandths, how often they cross it, and a checksum of their
    histogram. A null text counts as an empty one; repeated rows get equal results; columns named like
    an added one are replaced. An empty table gives an empty result.
    """

    def run(texts: list[str | None]) -> dict[str, list]:
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        out: dict[str, list] = {k: [] for k in names}
        for raw in utf8(texts):
            b = store(raw + b"\0" * (-len(raw) % BLOCK if raw else BLOCK))
            kind, carved = classify(b)
            p = samples(b)
            said = "corrected" if kind != declared else "as declared"
            spans = [",".join(f"{o}:{n}:{t}" for o, n, t in found) for found in (carved, sniff(p))]
            feature = "|".join([kind, said, *spans, *heard(p)])
            row = (len(raw), len(p), sha256(p).hexdigest(), crc32(p[-BLOCK:]), len(b), sha256(b).hexdigest(), feature)
            for k, v in zip(names, row):
                out[k].append(v)
        return out

    added = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return append_columns(docs, ["text"], run, added)
