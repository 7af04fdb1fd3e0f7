"""Operator 4: media columns by signature sniffing.

An Aho-Corasick automaton finds all magic bytes of a value in one pass; at each place
the format's validator checks structure and lengths and says how long the media is.
What starts at byte 0 and validates is the value's type, whatever was declared; the rest is
embedded media, which can be carved out. Text payloads are stored losslessly as 8-bit
mono PCM in WAV.

End marks are looked up in a list of their places that a value makes once, and chains of segments that led nowhere
are not walked again, so that long values full of magic bytes cost little more than their length. A gzip stream is not
looked for inside one that was found.

Null and empty values have no type and hold nothing. An empty table gives an empty result. Columns of df that
are named like a result are replaced; all others stay.
"""

from __future__ import annotations

import bisect
import functools
import re
import struct
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Magic bytes by type.
MAGIC = {
    "wav": b"RIFF",
    "png": b"\x89PNG\r\n\x1a\n",
    "gif": b"GIF8",
    "jpeg": b"\xff\xd8\xff",
    "bmp": b"BM",
    "pdf": b"%PDF-",
    "zip": b"PK\x03\x04",
    "gzip": b"\x1f\x8b\x08",
}
#: Other names of types in declarations.
NAMES = {"jpg": "jpeg", "wave": "wav", "x-wav": "wav", "gz": "gzip", "x-gzip": "gzip", "x-bmp": "bmp"}
UNIT = 64
HEAD = 44


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    pad = len(payload) % 2
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * pad


def wav_payload(media: bytes, at: int = 0) -> tuple[int, int] | None:
    """Where the samples of a WAV at the place are, and how many bytes."""
    if media[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
    if end > len(media):
        return None
    here, described = at + 12, False
    while here + 8 <= end:
        n = int.from_bytes(media[here + 4 : here + 8], "little")
        if here + 8 + n > end:
            return None
        if media[here : here + 4] == b"fmt ":
            described = n >= 16
        elif media[here : here + 4] == b"data" and described:
            return here + 8, n
        here += 8 + n + n % 2
    return None


class _Value:
    """The bytes, where marks stand in them, and places from which a chain of segments leads nowhere."""

    __slots__ = ("b", "dead", "done", "marks")

    def __init__(self, b: bytes):
        self.b, self.marks, self.dead, self.done = b, {}, set(), 0

    def after(self, mark: bytes, at: int) -> int:
        """The first place of the mark from `at` on, or -1."""
        if mark not in self.marks:
            self.marks[mark] = [m.start() for m in re.finditer(re.escape(mark), self.b)]
        i = bisect.bisect_left(self.marks[mark], at)
        return self.marks[mark][i] if i < len(self.marks[mark]) else -1

    def chain(self, kind: str, at: int, first: int, step) -> int:
        """Length from `at` to where the segments from `first` on end. step(place) is the next place; below 0: minus the end; None: no segment."""
        seen, here = [], first
        while here is not None and here >= 0 and (kind, here) not in self.dead:
            seen.append((kind, here))
            here = step(here)
        if here is not None and here < 0:
            return -here - at
        self.dead.update(seen)
        return 0


def _wav(v: _Value, at: int) -> int:
    return 8 + int.from_bytes(v.b[at + 4 : at + 8], "little") if wav_payload(v.b, at) else 0


def _png(v: _Value, at: int) -> int:
    b = v.b
    if b[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return 0

    def step(here: int) -> int | None:
        n, kind = int.from_bytes(b[here : here + 4], "big"), b[here + 4 : here + 8]
        end = here + 12 + n
        if end > len(b) or zlib.crc32(memoryview(b)[here + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        return -end if kind == b"IEND" else end

    return v.chain("png", at, at + 8, step)


def _gif(v: _Value, at: int) -> int:
    b = v.b
    if b[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(b):
        return 0
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def step(here: int) -> int | None:
        kind = b[here : here + 1]
        if kind == b";":
            return -here - 1
        if kind == b"!":
            here += 2
        elif kind == b"," and here + 10 <= len(b):
            here += 11 + table(b[here + 9])
        else:
            return None
        while here < len(b) and b[here]:
            here += b[here] + 1
        return here + 1

    return v.chain("gif", at, at + 13 + table(b[at + 10]), step)


def _jpeg(v: _Value, at: int) -> int:
    b = v.b

    def step(here: int, framed: bool) -> int | None:
        if here + 4 > len(b) or b[here] != 0xFF or not 0xC0 <= b[here + 1] <= 0xFE:
            return None
        if b[here + 1] == 0xDA:
            end = v.after(b"\xff\xd9", here) if framed else -1
            return -end - 2 if end >= 0 else None
        return here + 2 + int.from_bytes(b[here + 2 : here + 4], "big")

    # the frame header may come at any place before the scan: two chains, without it and with it
    here, seen = at + 2, []
    while here + 4 <= len(b) and b[here] == 0xFF and b[here + 1] not in (0xC0, 0xC1, 0xC2, 0xDA) and ("jpeg", here) not in v.dead:
        seen.append(("jpeg", here))
        here = step(here, False)
        if here is None:
            break
    if here is not None and here + 4 <= len(b) and b[here] == 0xFF and b[here + 1] in (0xC0, 0xC1, 0xC2):
        found = v.chain("jpeg framed", at, here, lambda x: step(x, True))
        if found:
            return found
    v.dead.update(seen)
    return 0


def _bmp(v: _Value, at: int) -> int:
    if at + 26 > len(v.b):
        return 0
    size, reserved, pixels, head = struct.unpack_from("<IIII", v.b, at + 2)
    return size if reserved == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= pixels <= size <= len(v.b) - at else 0


def _pdf(v: _Value, at: int) -> int:
    if not v.b[at + 5 : at + 6].isdigit():
        return 0
    end = v.after(b"%%EOF", at)
    return end + 5 - at if 0 <= v.after(b"startxref", at) < end else 0


def _zip(v: _Value, at: int) -> int:
    tail = v.after(b"PK\x05\x06", at)
    if tail < 0 or tail + 22 > len(v.b):
        return 0
    size, offset, note = struct.unpack_from("<IIH", v.b, tail + 12)
    return tail + 22 + note - at if at + offset + size == tail and tail + 22 + note <= len(v.b) else 0


def _gzip(v: _Value, at: int) -> int:
    if at < v.done:
        return 0
    d, here, body = zlib.decompressobj(31), at, memoryview(v.b)
    try:
        while here < len(body) and not d.eof:
            rest = body[here : here + (1 << 16)]
            here += len(rest)
            while len(rest) and not d.eof:
                d.decompress(rest, 1 << 20)
                rest = d.unconsumed_tail
    except zlib.error:
        return 0
    if not d.eof:
        return 0
    v.done = here - len(d.unused_data)
    return v.done - at


VALID = {"wav": _wav, "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "pdf": _pdf, "zip": _zip, "gzip": _gzip}


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, magic in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (kind, len(magic)))
    a.make_automaton()
    return a


def find_media(value: bytes | None) -> list[tuple[str, int, int]]:
    """(type, offset, length) of all that validates, in order of offset."""
    if not value:
        return []
    out, v = [], _Value(value)
    for end, (kind, n) in _automaton().iter(value.decode("latin-1")):
        at = end + 1 - n
        length = VALID[kind](v, at)
        if length:
            out.append((kind, at, length))
    return sorted(out, key=lambda x: (x[1], x[0]))


def _sniffed(column: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
    return pa.array([[dict(zip(("kind", "offset", "length"), x, strict=True)) for x in find_media(v.as_py())] for v in column], kind)


def sniff(value: Column | str) -> Column:
    """All media in a binary value: array of (kind, offset, length)."""
    return F.arrow_udf(_sniffed, "array<struct<kind:string,offset:long,length:long>>")(value)


def correct_types(df: DataFrame, value: str, declared: str, found: str = "media", out: str = "media_type") -> DataFrame:
    """Adds what is found in the value and its type: the validated one, else null; `declared` stays for comparison in `<out>_wrong`."""
    df = df.withColumn(found, sniff(F.col(f"`{value}`")))
    top = F.get(F.filter(F.col(f"`{found}`"), lambda m: m["offset"] == 0), 0)
    name = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{declared}`").cast("string"), F.lit("")), r"([^/.]*)$", 1))
    known = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    said = F.coalesce(F.try_element_at(known, name), name)
    return df.withColumn(out, top["kind"]).withColumn(f"{out}_wrong", F.col(f"`{out}`").isNotNull() & (F.col(f"`{out}`") != said))


def pieces(value: Column, found: Column) -> Column:
    """The media that lies inside a value after its first byte: array of kind, offset, length and bytes."""
    inner = F.filter(found, lambda m: m["offset"] > 0)
    return F.transform(inner, lambda m: F.struct(m["kind"].alias("kind"), m["offset"].alias("offset"), m["length"].alias("length"), F.substring(value, (m["offset"] + 1).cast("int"), m["length"].cast("int")).alias("bytes")))


def carve(df: DataFrame, value: str, found: str = "media") -> DataFrame:
    """A row for each piece that lies inside a value: df's columns, kind, offset, length and bytes."""
    one = df.withColumn("\u0001m", F.explode(pieces(F.col(f"`{value}`"), F.col(f"`{found}`"))))
    made = ("kind", "offset", "length", "bytes")
    return one.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *[F.col("\u0001m")[c].alias(c) for c in made])


def _stored(column: pa.Array) -> pa.Array:
    out = []
    for v in column:
        raw = (v.as_py() or "").encode()
        out.append(to_wav(raw + b"\0" * (-len(raw) % UNIT if raw else UNIT)))
    return pa.array(out, pa.binary())


def store(text: Column | str) -> Column:
    """The text's UTF-8, padded with zeros to a positive multiple of 64 bytes, as a WAV."""
    return F.arrow_udf(_stored, "binary")(text)


_FOUND = "payload binary, feature string"


def _reread(column: pa.Array) -> pa.Array:
    payload, feature = [], []
    for v in column:
        media = v.as_py()
        found = find_media(media)
        top = next((x for x in found if x[:2] == ("wav", 0)), None)
        span = wav_payload(media) if top else None
        payload.append(media[span[0] : span[0] + span[1]] if span else None)
        feature.append(";".join(f"{k}@{at}+{n}" for k, at, n in found))
    return pa.StructArray.from_arrays([pa.array(payload, pa.binary()), pa.array(feature, pa.string())], names=["payload", "feature"])


def reread(media: Column | str) -> Column:
    """Struct of the samples of a stored value, read back through the sniffer, and all that it found."""
    return F.arrow_udf(_reread, _FOUND)(media)
