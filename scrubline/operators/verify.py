"""A second opinion on cleaned payloads, written apart from the parsers that scan and strip.

It searches raw bytes for markers and walks the container by its own rules: a payload passes if no marker stands in it for
a reason, every part is one that a clean file may have, and the structure holds. Decoding pixels is not part of it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scrubline.functions import sniff
from scrubline.functions.names import fresh, others

#: Markers of provenance data, searched without regard to case. Fixed values.
MARKERS = (
    "c2pa", "jumb", "trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia", "digitalsourcetype", "openai", "chatgpt", "dall-e", "gemini", "imagen", "synthid",
    "midjourney", "stable diffusion", "comfyui", "parameters", "firefly", "AIGC", "xmpmeta", "Exif\0\0",
)
#: Four bytes can occur by chance in compressed data: these count where their surroundings explain them. Fixed values.
_EXPLAINED = {
    b"jumb": re.compile(rb"(?=jumb.{4}jumd)|(?<=\0..[\x08-\xff])(?=jumb)|(?<=\0.[\x01-\xff].)(?=jumb)|(?<=\0[\x01-\xff]..)(?=jumb)", re.DOTALL),
    b"c2pa": re.compile(rb"(?=c2pa\0\x11\0\x10)|(?<=[\x01\x03\x0b\x13\x1b])(?=c2pa\0)"),
    b"aigc": None,
}
_IN_TEXT = 8
#: Parts that a cleaned file may have. Fixed values.
ALLOWED = {
    "JPEG": frozenset("SOI EOI JFIF ICC Adobe Exif DQT DHT DAC DRI SOF SOS RST".split()),
    "PNG": frozenset("IHDR PLTE IDAT IEND tRNS cHRM gAMA sBIT sRGB bKGD hIST pHYs acTL fcTL fdAT cICP mDCV cLLI mDCv cLLi iCCP eXIf".split()),
    "WEBP": frozenset(("VP8X", "VP8 ", "VP8L", "ALPH", "ANIM", "ANMF", "ICCP", "EXIF")),
    "GIF": frozenset(("header", "frame", "control", "loop", "text", "profile", "end")),
    "MP4": frozenset("ftyp moov mdat free skip wide pdin styp sidx".split()),
    "MOV": frozenset("ftyp moov mdat free skip wide pnot".split()),
}
_ORIENTATION_TAGS, _DATE_TAGS = {0x0112, 0x8769}, {0x9003, 0x9011, 0x9000}


def marker_hits(data: bytes) -> list[dict]:
    """marker, count, real: how often each marker stands there, and how often for a reason."""
    low, out = data.lower(), []
    for marker in MARKERS:
        raw = marker.lower().encode("latin-1")
        places = [m.start() for m in re.finditer(b"(?=" + re.escape(raw) + b")", low)]
        if places:
            real = len(places)
            if raw in _EXPLAINED:
                explained = {m.start() for m in _EXPLAINED[raw].finditer(low)} if _EXPLAINED[raw] else set()
                text = {at for m in re.finditer(rb"[\x20-\x7e]{%d,}" % _IN_TEXT, low) for at in range(m.start(), m.end())} if len(low) < 1 << 16 else None
                real = sum(at in explained or _text_around(low, at, text) for at in places)
            out.append({"marker": marker.replace("\0", "\\0"), "count": len(places), "real": real})
    return out


def _text_around(data: bytes, at: int, text: set[int] | None) -> bool:
    if text is not None:
        return at in text
    near = data[max(0, at - _IN_TEXT) : at + 4 + _IN_TEXT]
    return any(m.start() <= at - max(0, at - _IN_TEXT) < m.end() for m in re.finditer(rb"[\x20-\x7e]{%d,}" % _IN_TEXT, near))


class _Damaged(Exception):
    pass


def _unsigned(data: bytes, at: int, size: int, order: str = "big") -> int:
    if at + size > len(data):
        raise _Damaged(f"ends at {len(data)} inside a number")
    return int.from_bytes(data[at : at + size], order)


def _jpeg(data: bytes) -> Iterator[tuple[str, bytes]]:
    yield "SOI", b""
    at = 2
    while True:
        if _unsigned(data, at, 1) != 0xFF:
            raise _Damaged(f"no marker at {at}")
        code = _unsigned(data, at + 1, 1)
        if code == 0xFF:
            at += 1
            continue
        if code == 0xD9:
            yield "EOI", b""
            if at + 2 < len(data):
                yield "after the end", data[at + 2 :]
            return
        if 0xD0 <= code <= 0xD7:
            yield "RST", b""
            at += 2
            continue
        size = _unsigned(data, at + 2, 2)
        if size < 2 or at + 2 + size > len(data):
            raise _Damaged(f"segment at {at} leaves the file")
        body = data[at + 4 : at + 2 + size]
        known = {0xDB: "DQT", 0xC4: "DHT", 0xCC: "DAC", 0xDD: "DRI", 0xDA: "SOS"}
        heads = {0xE0: (b"JFIF\0", "JFIF"), 0xE1: (b"Exif\0\0", "Exif"), 0xE2: (b"ICC_PROFILE\0", "ICC"), 0xEE: (b"Adobe", "Adobe")}
        if code in heads and body.startswith(heads[code][0]):
            yield heads[code][1], body
        elif 0xC0 <= code <= 0xCF and code not in known:
            yield "SOF", body
        else:
            yield known.get(code, f"marker {code:02x}"), body
        at += 2 + size
        if code == 0xDA:
            scan = re.compile(rb"\xff[^\0\xd0-\xd7\xff]", re.DOTALL).search(data, at)
            if not scan:
                raise _Damaged("no end marker")
            at = scan.start()


def _png(data: bytes) -> Iterator[tuple[str, bytes]]:
    at, name = 8, ""
    while name != "IEND":
        size, name = _unsigned(data, at, 4), data[at + 4 : at + 8].decode("latin-1")
        if zlib.crc32(data[at + 4 : at + 8 + size]) != _unsigned(data, at + 8 + size, 4):
            raise _Damaged(f"check sum of {name}")
        yield name, data[at + 8 : at + 8 + size]
        at += 12 + size
    if at < len(data):
        yield "after the end", data[at:]


def _webp(data: bytes) -> Iterator[tuple[str, bytes]]:
    stop = _unsigned(data, 4, 4, "little") + 8
    if stop > len(data):
        raise _Damaged("the outer size leaves the file")
    at = 12
    while at < stop:
        size = _unsigned(data, at + 4, 4, "little")
        if at + 8 + size > stop:
            raise _Damaged(f"chunk at {at} leaves the file")
        yield data[at : at + 4].decode("latin-1"), data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if stop < len(data):
        yield "after the end", data[stop:]


def _gif(data: bytes) -> Iterator[tuple[str, bytes]]:
    colours = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def blocks(at: int) -> int:
        while size := _unsigned(data, at, 1):
            at += 1 + size
        return at + 1

    at = 13 + colours(_unsigned(data, 10, 1))
    yield "header", data[:at]
    while (code := _unsigned(data, at, 1)) != 0x3B:
        if code == 0x2C:
            stop, name = blocks(at + 11 + colours(_unsigned(data, at + 9, 1))), "frame"
        elif code == 0x21:
            label, stop = _unsigned(data, at + 1, 1), blocks(at + 2)
            own = data[at + 3 : at + 14]
            name = {0xF9: "control", 0x01: "text", 0xFE: "comment"}.get(label, "extension")
            if label == 0xFF:
                name = "loop" if own in (b"NETSCAPE2.0", b"ANIMEXTS1.0") else "profile" if own.startswith(b"ICCRGBG1") else f"application {own.decode('latin-1')}"
        else:
            raise _Damaged(f"no block at {at}")
        yield name, data[at:stop]
        at = stop
    yield "end", b""
    if at + 1 < len(data):
        yield "after the end", data[at + 1 :]


def _boxes(data: bytes) -> Iterator[tuple[str, bytes]]:
    at = 0
    while at < len(data):
        size, name = _unsigned(data, at, 4), data[at + 4 : at + 8].decode("latin-1")
        size = _unsigned(data, at + 8, 8) if size == 1 else len(data) - at if size == 0 else size
        if size < 8 or at + size > len(data):
            raise _Damaged(f"box {name} at {at} leaves the file")
        yield name, b"" if name == "mdat" else data[at + 8 : at + size]
        at += size


_WALKS = {"JPEG": _jpeg, "PNG": _png, "WEBP": _webp, "GIF": _gif, "MP4": _boxes, "MOV": _boxes}


def orientation_only(exif: bytes) -> bool:
    """Whether an EXIF block holds no more than an orientation and a capture date."""
    tiff = exif[6:] if exif.startswith(b"Exif\0\0") else exif
    try:
        order = ">" if tiff[:2] == b"MM" else "<"
        todo, allowed = [struct.unpack_from(order + "I", tiff, 4)[0]], _ORIENTATION_TAGS
        while todo:
            at = todo.pop()
            for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
                tag, _, _, value = struct.unpack_from(order + "HHII", tiff, at + 2 + 12 * k)
                if tag not in allowed:
                    return False
                if tag == 0x8769:
                    todo.append(value)
            allowed = _DATE_TAGS
        return True
    except struct.error:
        return False


def check(data: bytes, fmt: str) -> dict:
    """format, parts, flagged, markers, error, passed of one payload."""
    parts, flagged, error, plain = [], [], None, True
    if fmt in _WALKS:
        try:
            for name, body in _WALKS[fmt](data):
                parts.append(name)
                if name in ("Exif", "eXIf", "EXIF") and not orientation_only(body):
                    plain = False
                    flagged.append(name)
                elif name not in ALLOWED[fmt]:
                    flagged.append(name)
        except _Damaged as e:
            error = str(e)
    else:
        error = "unknown container"
    markers = [m for m in marker_hits(data) if m["real"] and not (m["marker"] == "Exif\\0\\0" and plain)]
    return {"format": fmt, "parts": parts, "flagged": flagged, "markers": markers, "error": error, "passed": not (flagged or markers or error)}


VERDICT = "struct<format:string,parts:array<string>,flagged:array<string>,markers:array<struct<marker:string,count:int,real:int>>,error:string,passed:boolean>"
_VERDICT = pa.struct(
    [
        ("format", pa.string()), ("parts", pa.list_(pa.string())), ("flagged", pa.list_(pa.string())),
        ("markers", pa.list_(pa.struct([("marker", pa.string()), ("count", pa.int32()), ("real", pa.int32())]))), ("error", pa.string()), ("passed", pa.bool_()),
    ]
)


def verdict(content: Column, fmt: Column) -> Column:
    """VERDICT of each payload; null stays null."""

    @F.arrow_udf(VERDICT)
    def run(contents: pa.Array, formats: pa.Array) -> pa.Array:
        return pa.array([None if x is None else check(x, f) for x, f in zip(contents.to_pylist(), formats.to_pylist(), strict=True)], _VERDICT)

    return run(content, fmt)


def verify(df: DataFrame, content: str = "content", into: str = "verdict") -> DataFrame:
    """Adds a verdict to each payload; a column called like ``into`` is replaced."""
    (fmt,) = fresh(df, "format")
    found = df.withColumn(fmt, sniff.detect_format(F.col(content)))
    return found.select(*others(df, into), verdict(F.col(content), F.col(fmt)).alias(into))
