"""Media columns: signature sniffing.

One Aho-Corasick automaton finds every magic number in a value in a single pass. A validator for each format then reads
the structure from there - chunk walks, checksums, declared sizes - and gives the length of the media or nothing. A
valid medium at the start decides the value's type, whatever was declared; valid media behind it are carved out from left
to right: what lies inside a medium belongs to it. A magic number without a valid structure behind it counts for nothing. A
FLAC stream has no length of its own: it lasts until the value ends.

Validators walk chains of blocks. What a chain that begins at some place comes to is remembered for the value, as are places
of end marks, and places inside an accepted medium aren't looked at, so that values full of magic numbers take linear time.

Values are taken row by row, so rows may be spread in any way; nothing is shuffled. Memory is bounded by an Arrow batch and
one value. Nulls, ties, empties: a null or empty value has the type application/octet-stream (null: null) and no media. Equal
values give equal results. A declared type is only compared, never trusted. An empty table gives an empty table. Extra
columns aren't read, whatever their names; carried ones must not be called media_type, type_corrected or carved.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

UNKNOWN = "application/octet-stream"
UNIT = 576


class Value:
    """The bytes of a value, with what validators have found out about them."""

    def __init__(self, b: bytes):
        self.b = b
        self.known: dict[Hashable, object] = {}

    def places(self, pattern: bytes) -> list[int]:
        """Where a regular expression matches, in order."""
        if pattern not in self.known:
            self.known[pattern] = [m.start() for m in re.finditer(pattern, self.b, re.S)]
        return self.known[pattern]

    def after(self, pattern: bytes, at: int) -> int:
        """The first match from a place on, -1 if there is none."""
        own = self.places(pattern)
        i = bisect_left(own, at)
        return own[i] if i < len(own) else -1

    def walk(self, kind: str, at: int, step: Callable[[bytes, int], tuple[int | None, int]]) -> tuple[int, int]:
        """Follow a chain of blocks: (its end, or 0 if it breaks; the marks of its blocks, ored).

        step gives (next place, mark), next place None where the chain breaks, and the place negated where it is complete.
        """
        trail, end, marks = [], 0, 0
        while True:
            if (kind, at) in self.known:
                end, marks = self.known[kind, at]
                break
            following, mark = step(self.b, at)
            trail.append((at, mark))
            if following is None:
                break
            if following < 0:
                end = -following
                break
            at = following
        for place, mark in reversed(trail):
            marks |= mark
            self.known[kind, place] = (end, marks)
        return end, marks

    @cached_property
    def zip_ends(self) -> dict[int, int]:
        """Start to end of the ZIP archives whose end records fit: the directory stands right before its end record."""
        out: dict[int, int] = {}
        for at in self.places(rb"PK\x05\x06"):
            if at + 22 > len(self.b):
                continue
            disk, _, here, entries, size, offset, note = struct.unpack_from("<HHHHIIH", self.b, at + 4)
            start, directory, end = at - size - offset, at - size, at + 22 + note
            if disk or here != entries or start < 0 or end > len(self.b):
                continue
            if not entries or self.b[directory : directory + 4] == b"PK\x01\x02":
                out[start] = end
        return out


def _riff(v: Value, at: int, form: bytes, first: tuple[bytes, ...], needed: bytes) -> int | None:
    """RIFF: the chunks fill the declared size; the first is one of some, and another is there."""
    b = v.b
    if len(b) < at + 20 or b[at + 8 : at + 12] != form or b[at + 12 : at + 16] not in first:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    pos, seen = at + 12, False
    while pos + 8 <= end:
        name, size = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        if name == b"fmt " and size < 16 or not all(32 <= x < 127 for x in name):
            return None
        seen = seen or name == needed or name == b"LIST" and b[pos + 8 : pos + 12] == needed
        pos += 8 + size + size % 2
    return end - at if pos == end and seen else None


def _wav(v: Value, at: int) -> int | None:
    """A format chunk comes before the data; other chunks may stand before it."""
    b = v.b
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    pos, seen = at + 12, set()
    while pos + 8 <= end:
        name, size = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        if name == b"fmt " and size < 16 or name == b"data" and b"fmt " not in seen:
            return None
        seen.add(name)
        pos += 8 + size + size % 2
    return end - at if pos == end and b"data" in seen else None


def _webp(v: Value, at: int) -> int | None:
    simple = v.b[at + 12 : at + 16]
    return _riff(v, at, b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"), simple if simple != b"VP8X" else b"VP8 ") or _riff(v, at, b"WEBP", (b"VP8X",), b"VP8L") or _riff(v, at, b"WEBP", (b"VP8X",), b"ANMF")


def _avi(v: Value, at: int) -> int | None:
    """A header list first, and a list of the movie's data."""
    return _riff(v, at, b"AVI ", (b"LIST",), b"movi") if v.b[at + 20 : at + 24] == b"hdrl" else None


def _png(v: Value, at: int) -> int | None:
    """Chunks with right checksums from IHDR to IEND."""
    if v.b[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        return None

    def step(b: bytes, pos: int) -> tuple[int | None, int]:
        if pos + 12 > len(b):
            return None, 0
        size, name = struct.unpack_from(">I", b, pos)[0], b[pos + 4 : pos + 8]
        end = pos + 12 + size
        if end > len(b) or not name.isalpha() or zlib.crc32(memoryview(b)[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None, 0
        return (-end if name == b"IEND" else end), 0

    end, _ = v.walk("png", at + 8, step)
    return end - at if end else None


def _gif(v: Value, at: int) -> int | None:
    """Screen descriptor, then extension and image blocks down to the trailer, at least one image."""
    b = v.b
    if len(b) < at + 13:
        return None

    def parts(b: bytes, pos: int) -> tuple[int | None, int]:
        """Sub-blocks down to the empty one."""
        if pos >= len(b):
            return None, 0
        return (pos + 1 + b[pos], 0) if b[pos] else (-(pos + 1), 0)

    def step(b: bytes, pos: int) -> tuple[int | None, int]:
        if pos >= len(b):
            return None, 0
        kind, image = b[pos], 0
        if kind == 0x3B:
            return -(pos + 1), 0
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 < len(b):
            image = 1
            pos += 10 + (3 << ((b[pos + 9] & 7) + 1) if b[pos + 9] & 0x80 else 0) + 1
        else:
            return None, 0
        end, _ = v.walk("gif-parts", pos, parts)
        return (end or None), image

    flags = b[at + 10]
    end, images = v.walk("gif", at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), step)
    return end - at if end and images else None


def _jpeg(v: Value, at: int) -> int | None:
    """Marker segments with their lengths; after a scan, entropy-coded bytes up to the next marker; down to EOI."""

    def step(b: bytes, pos: int) -> tuple[int | None, int]:
        if pos + 1 >= len(b) or b[pos] != 0xFF:
            return None, 0
        kind = b[pos + 1]
        if kind == 0xFF:  # a fill byte
            return pos + 1, 0
        if kind == 0xD9:
            return -(pos + 2), 0
        if pos + 4 > len(b) or not (0xC0 <= kind <= 0xCF or 0xDA <= kind <= 0xEF or kind == 0xFE):
            return None, 0
        size = struct.unpack_from(">H", b, pos + 2)[0]
        if size < 2 or pos + 2 + size > len(b):
            return None, 0
        frame = int(0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC))
        pos += 2 + size
        if kind == 0xDA:
            pos = v.after(rb"\xff[^\x00\xd0-\xd7\xff]", pos)
        return (pos if pos >= 0 else None), frame

    end, frames = v.walk("jpeg", at + 2, step)
    return end - at if end and frames else None


def _bmp(v: Value, at: int) -> int | None:
    """File size, header size and rows agree (uncompressed)."""
    b = v.b
    if len(b) < at + 54:
        return None
    size, reserved, start, head, w, h, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if reserved or head not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or packed or w <= 0 or not h:
        return None
    rows = (w * bits + 31) // 32 * 4 * abs(h)
    return size if start >= 14 + head and size == start + rows and at + size <= len(b) else None


def _au(v: Value, at: int) -> int | None:
    """Sun audio: header and data sizes, a known encoding."""
    b = v.b
    if len(b) < at + 24:
        return None
    start, size, kind, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    ok = start >= 24 and 1 <= kind <= 7 and 0 < rate < 1 << 20 and 0 < channels <= 16 and at + start + size <= len(b)
    return start + size if ok else None


def _pgm(v: Value, at: int) -> int | None:
    """Binary greymap: width, height, at most 255 levels, then a byte a pixel."""
    head = re.compile(rb"P5\s{1,9}(\d{1,6})\s{1,9}(\d{1,6})\s{1,9}(\d{1,3})\s").match(v.b, at)
    if not head or not 0 < int(head[3]) < 256 or not int(head[1]) * int(head[2]):
        return None
    end = head.end() + int(head[1]) * int(head[2])
    return end - at if end <= len(v.b) else None


def _ogg(v: Value, at: int) -> int | None:
    """Pages of one stream from its first to its last, numbered without a gap."""
    b, pos, turn, serial = v.b, at, 0, None
    while pos + 27 <= len(b) and b[pos : pos + 5] == b"OggS\0":
        flags, number, page = b[pos + 5], struct.unpack_from("<I", b, pos + 14)[0], struct.unpack_from("<I", b, pos + 18)[0]
        serial = number if serial is None else serial
        if number != serial or page != turn or (turn == 0) != bool(flags & 2):
            return None
        end = pos + 27 + b[pos + 26] + sum(b[pos + 27 : pos + 27 + b[pos + 26]])
        if end > len(b):
            return None
        pos, turn = end, turn + 1
        if flags & 4:
            return pos - at
    return None


def _pdf(v: Value, at: int) -> int | None:
    """A version, and a cross-reference start before the last end mark."""
    if not re.compile(rb"%PDF-[12]\.\d").match(v.b, at):
        return None
    ends, starts = v.places(rb"%%EOF"), v.places(rb"startxref")
    if not ends or ends[-1] <= at:
        return None
    last = bisect_left(starts, ends[-1])
    return ends[-1] + 5 - at if last and starts[last - 1] > at else None


def _gzip(v: Value, at: int) -> int | None:
    """One member: a header, deflated bytes, their checksum and size."""
    b, pos = v.b, at + 10
    if pos > len(b) or b[at + 3] & 0xE0:
        return None
    flags = b[at + 3]
    if flags & 4:
        pos += 2 + (struct.unpack_from("<H", b, pos)[0] if pos + 2 <= len(b) else len(b))
    for flag in (8, 16):  # name and comment end with a zero
        if flags & flag:
            pos = v.after(rb"\x00", pos) + 1
            if not pos:
                return None
    pos += 2 if flags & 2 else 0
    end = _inflated(v, pos)
    return end - at if end else None


def _inflated(v: Value, start: int) -> int:
    """The end of deflated bytes with their checksum and size, 0 if they are broken."""
    key = ("deflate", start)
    if key not in v.known:
        unpack, pos, check, size, view = zlib.decompressobj(-15), start, 0, 0, memoryview(v.b)
        try:
            while pos < len(v.b) and not unpack.eof:
                part = view[pos : pos + (1 << 16)]
                pos += len(part)
                out = unpack.decompress(part, 1 << 20)
                while True:
                    check, size = zlib.crc32(out, check), size + len(out)
                    if unpack.eof or not unpack.unconsumed_tail:
                        break
                    out = unpack.decompress(unpack.unconsumed_tail, 1 << 20)
        except zlib.error:
            pass
        end = pos - len(unpack.unused_data) + 8
        whole = unpack.eof and end <= len(v.b) and struct.unpack_from("<II", v.b, end - 8) == (check, size & 0xFFFFFFFF)
        v.known[key] = end if whole else 0
    return v.known[key]


def _zip(v: Value, at: int) -> int | None:
    """A directory whose end record says that the archive begins here."""
    end = v.zip_ends.get(at)
    return end - at if end else None


# Boxes that stand at the top of a file, fixed values
BOXES = {b"ftyp", b"styp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"udta", b"meta", b"uuid", b"sidx", b"ssix", b"pdin", b"emsg", b"prft"}


def _mp4(v: Value, at: int) -> int | None:
    """A file type box, then boxes with their sizes as long as they are known ones; a movie or fragment is among them."""
    if len(v.b) < at + 16 or not 16 <= struct.unpack_from(">I", v.b, at)[0] <= 1024 or not all(32 <= x < 127 for x in v.b[at + 8 : at + 12]):
        return None

    def step(b: bytes, pos: int) -> tuple[int | None, int]:
        name = b[pos + 4 : pos + 8]
        if pos + 8 > len(b) or name not in BOXES:
            return -pos, 0
        size = struct.unpack_from(">I", b, pos)[0]
        if size == 1 and pos + 16 <= len(b):
            size = struct.unpack_from(">Q", b, pos + 8)[0]
        end = pos + size if size else len(b)
        if size and size < 8 or end > len(b):
            return None, 0
        return end, int(name in (b"moov", b"moof"))

    end, movie = v.walk("mp4", at, step)
    return end - at if end and movie else None


def _flac(v: Value, at: int) -> int | None:
    """Metadata blocks, stream information first, up to the last one, then a frame; it lasts until the value ends."""
    if v.b[at + 4] & 0x7F if at + 42 <= len(v.b) else True:
        return None
    if v.b[at + 5 : at + 8] != b"\0\0\x22":
        return None

    def step(b: bytes, pos: int) -> tuple[int | None, int]:
        if pos + 4 > len(b) or b[pos] & 0x7F > 6:
            return None, 0
        end = pos + 4 + int.from_bytes(b[pos + 1 : pos + 4], "big")
        if not b[pos] & 0x80:
            return end, 0
        return (len(b) and -len(b) if b[end : end + 1] == b"\xff" and b[end + 1 : end + 2] in (b"\xf8", b"\xf9") else None), 0

    end, _ = v.walk("flac", at + 4, step)
    return end - at if end else None


@dataclass(frozen=True)
class Format:
    magic: bytes
    mime: str
    check: Callable[[Value, int], int | None]
    offset: int = 0  # where in the medium the magic number stands


# Signatures, fixed values
FORMATS = (
    Format(b"RIFF", "audio/wav", _wav),
    Format(b"WEBP", "image/webp", _webp, 8),
    Format(b"AVI LIST", "video/x-msvideo", _avi, 8),
    Format(b"\x89PNG\r\n\x1a\n", "image/png", _png),
    Format(b"GIF87a", "image/gif", _gif),
    Format(b"GIF89a", "image/gif", _gif),
    Format(b"\xff\xd8\xff", "image/jpeg", _jpeg),
    Format(b"BM", "image/bmp", _bmp),
    Format(b".snd", "audio/basic", _au),
    Format(b"P5", "image/x-portable-graymap", _pgm),
    Format(b"OggS\0", "audio/ogg", _ogg),
    Format(b"fLaC", "audio/flac", _flac),
    Format(b"%PDF-", "application/pdf", _pdf),
    Format(b"\x1f\x8b\x08", "application/gzip", _gzip),
    Format(b"PK\x03\x04", "application/zip", _zip),
    Format(b"PK\x05\x06", "application/zip", _zip),
    Format(b"ftyp", "video/mp4", _mp4, 4),
)


@cache
def automaton() -> ahocorasick.Automaton:
    """All magic numbers; bytes are taken as the characters of the same number."""
    out = ahocorasick.Automaton()
    for i, f in enumerate(FORMATS):
        out.add_word(f.magic.decode("latin-1"), i)
    out.make_automaton()
    return out


REACH = 16  # no magic number ends further behind its medium's start
BLOCK = 1 << 16  # hits held at once


def found_media(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of each valid medium from left to right, none overlapping; of two with one start the longer."""
    value, out, end, n = Value(data), [], 0, len(FORMATS)
    checks = [f.check for f in FORMATS]
    backs = [len(f.magic) + f.offset - 1 for f in FORMATS]

    def settle(hits: list[int]) -> None:
        """Hits are place * n + format, in order."""
        nonlocal end
        at, best = -1, None
        for hit in hits:
            if hit // n != at:
                if best:
                    out.append(best)
                    end, best = at + best[1], None
                at = hit // n
            if at >= end:
                length = checks[hit % n](value, at)
                if length and (best is None or length > best[1]):
                    best = (at, length, FORMATS[hit % n].mime)
        if best:
            out.append(best)
            end = at + best[1]

    waiting, most = [], 1  # the first hits are looked at early: a medium that is the whole value ends the search
    for last, i in automaton().iter(data.decode("latin-1")):
        if len(waiting) >= most:
            waiting.sort()
            k = bisect_left(waiting, (last - REACH) * n)  # later hits may still begin before the others
            settle(waiting[:k])
            waiting, most = waiting[k:], max(min(2 * most, BLOCK), 2 * (len(waiting) - k))
            if end >= len(data):
                return out
        at = last - backs[i]
        if at >= end:
            waiting.append(at * n + i)
    settle(sorted(waiting))
    return out


MEDIA = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("sha256", pa.string())]))


def _sniffed(n_carry: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, carved = [], []
            for value in batch.column(n_carry - 1):
                data = value.as_py()
                media = found_media(data or b"")
                starts = bool(media) and not media[0][0]
                types.append(None if data is None else media[0][2] if starts else UNKNOWN)
                carved.append([{"offset": a, "length": n, "type": m, "sha256": hashlib.sha256(data[a : a + n]).hexdigest()} for a, n, m in media[starts:]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(types, pa.string()), pa.array(carved, MEDIA)], names=[*batch.schema.names, "_t", "_m"])

    return run


def sniff(df: DataFrame, media_col: str = "media", declared_col: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns and the value, with media_type (what its bytes are), type_corrected (whether that differs from
    the declared type) and carved: array<struct<offset, length, type, sha256>> of media behind the start."""
    shared.small_batches(df.sparkSession)
    cols = [*carry, *([declared_col] if declared_col else []), media_col]
    rows = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    schema = ", ".join([*(f"_c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(cols)), "_t string, _m array<struct<offset: bigint, length: bigint, type: string, sha256: string>>"])
    out = rows.mapInArrow(_sniffed(len(cols)), schema)
    fixed = F.coalesce(F.col("_t") != F.col(f"_c{len(cols) - 2}"), F.col("_t").isNotNull()) if declared_col else F.lit(False)
    named = [F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)]
    return out.select(*named, F.col("_t").alias("media_type"), fixed.alias("type_corrected"), F.col("_m").alias("carved"))


def padded(data: bytes) -> bytes:
    """data and bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def wav_of(samples: bytes, rate: int = 8000) -> bytes:
    """Unsigned 8-bit mono PCM."""
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples_of(media: bytes) -> bytes:
    """The samples of a valid WAV."""
    if not _wav(Value(media), 0):
        raise ValueError("not a valid WAV")
    pos = 12
    while True:
        name, size = media[pos : pos + 4], struct.unpack_from("<I", media, pos + 4)[0]
        if name == b"data":
            return media[pos + 8 : pos + 8 + size]
        pos += 8 + size + size % 2


def feature_of(samples: bytes) -> str:
    """Loudness and crossings of 8-bit samples, in exact integers where possible."""
    x = np.frombuffer(samples, np.uint8)
    total, squares = int(x.sum(dtype=np.int64)), int(np.dot(x.astype(np.int64) - 128, x.astype(np.int64) - 128))
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    return f"wav8;n={len(x)};mean={total / len(x):.6f};rms={(squares / len(x)) ** 0.5:.6f};min={int(x.min())};max={int(x.max())};crossings={crossings}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as written WAV values: doc_id, n_bytes, declared, media. The declared type is wrong on purpose: none is known."""
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([UNKNOWN] * len(raw)), pa.array([wav_of(padded(r)) for r in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "declared", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return shared.write(rows.mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary"), "media")


def wav_features(sniffed: DataFrame) -> DataFrame:
    """For rows sniffed as WAV: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; else nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, media in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if kind != "audio/wav":
                    rows.append((None,) * 6)
                    continue
                own = samples_of(media)
                rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(own)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return sniffed.select("doc_id", "n_bytes", "media_type", "media").mapInArrow(run, schema)
