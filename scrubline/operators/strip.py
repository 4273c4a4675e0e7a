"""Lossless removal of metadata, with an audit of what went.

Image data is copied byte for byte. What stays of each container stands in its policy: a region is kept, dropped with
an audit row, or rewritten. What can't be stripped without re-encoding says why.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, functions as F

from scrubline.operators import containers as c
from scrubline.operators.exif import minimal_tiff, read_exif

CHUNK = 1 << 20
JPEG_TYPES = {"exif": "EXIF", "xmp": "XMP", "icc": "ICC", "mpf": "EXTRA_IMAGE", "jumbf": "C2PA", "iptc": "IPTC", "comment": "COMMENT", "thumbnail": "THUMBNAIL"}
PNG_TYPES = {"tEXt": "TEXT", "zTXt": "TEXT", "iTXt": "TEXT", "eXIf": "EXIF", "iCCP": "ICC", "caBX": "C2PA", "tIME": "TIMESTAMP"}
WEBP_TYPES = {"EXIF": "EXIF", "XMP ": "XMP", "ICCP": "ICC", "C2PA": "C2PA"}
GIF_TYPES = {"comment": "COMMENT", "xmp": "XMP", "icc": "ICC"}
TOP_KEEP = frozenset(("ftyp", "moov", "mdat"))
MOOV_DROP = frozenset(("udta", "meta", "free", "skip", "wide", "Xtra", "pnot"))
FRAGMENTS = frozenset(("moof", "mvex", "mfra", "sidx", "styp"))


@dataclass(frozen=True)
class StripOptions:
    """taken: capture time ``yyyy:MM:dd HH:mm:ss`` and offset ``+hh:mm`` to write back."""

    keep_icc: bool = True
    keep_orientation: bool = True
    taken: tuple[str, str] | None = None


@dataclass
class Output:
    options: StripOptions
    parts: list[bytes] = field(default_factory=list)
    removed: list[tuple[str, str, int]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def drop(self, kind: str, location: str, size: int) -> None:
        self.removed.append((kind, location, size))

    def tiff(self, payloads: Iterable[bytes]) -> bytes | None:
        """The minimal block to write back for the first EXIF payload, or None if there is nothing to say."""
        o = self.options
        turned = next((read_exif(p).orientation for p in payloads), 1) if o.keep_orientation else 1
        if not 2 <= turned <= 8 and not o.taken:
            return None
        if 2 <= turned <= 8:
            self.notes.append(f"kept_orientation={turned}")
        return minimal_tiff(turned, o.taken)


def _jpeg(b: bytes, out: Output) -> None:
    layout = c.jpeg_layout(b)
    if not layout.some("scan"):
        raise c.Unsupported("no image data")
    tiff = out.tiff(b[r.low : r.high] for r in layout.some("exif"))
    segment = lambda marker, payload: b"\xff" + bytes([marker]) + struct.pack(">H", len(payload) + 2) + payload
    pending = [segment(0xE1, b"Exif\0\0" + tiff)] if tiff else []
    out.parts.append(b[:2])
    seen_jfif = False
    for r in layout.regions:
        if r.kind == "jfif" and not seen_jfif:
            seen_jfif = True
            if c.jfif_has_thumbnail(b, r):
                out.parts.append(segment(0xE0, b[r.low : r.low + 12] + b"\0\0"))
                out.drop("THUMBNAIL", "APP0 (JFIF)", r.high - r.low - 14)
            else:
                out.parts.append(b[r.start : r.stop])
            out.parts += pending
            pending = []
            continue
        if r.kind == "jfif":
            out.drop("UNKNOWN", "APP0 (JFIF, duplicate)", r.stop - r.start)
        elif r.kind == "adobe":
            out.parts += [*pending, segment(0xEE, b[r.low : r.low + c.ADOBE_BYTES])]
            pending = []
            if r.high - r.low > c.ADOBE_BYTES:
                out.drop("UNKNOWN", "APP14 (Adobe, extra data)", r.high - r.low - c.ADOBE_BYTES)
        elif r.kind in ("core", "scan", "eoi") or r.kind == "icc" and out.options.keep_icc:
            out.parts += [*pending, b[r.start : r.stop]]
            pending = []
        else:
            out.drop(JPEG_TYPES.get(r.kind, "UNKNOWN"), "APP2 (ICC)" if r.kind == "icc" else r.label, r.stop - r.start)
    if not layout.complete:
        out.parts.append(b"\xff\xd9")
        out.notes.append("added_end_marker")
    if layout.end < len(b):
        out.drop("TRAILER", "after_eoi", len(b) - layout.end)
        if layout.some("mpf"):
            out.notes.append("dropped_extra_images")


def _png(b: bytes, out: Output) -> None:
    layout = c.png_layout(b)
    odd = next((r.kind for r in layout.regions if not r.kind[0].islower() and r.kind not in c.PNG_KEEP), None)
    if odd:
        raise c.Unsupported(f"unknown critical chunk {odd}")
    tiff = out.tiff(b[r.low : r.high] for r in layout.some("eXIf"))
    out.parts.append(c.PNG_MAGIC)
    for r in layout.regions:
        if r.kind in c.PNG_KEEP or r.kind == "iCCP" and out.options.keep_icc:
            out.parts.append(b[r.start : r.stop])
        else:
            out.drop(PNG_TYPES.get(r.kind, "UNKNOWN"), r.kind, r.stop - r.start)
        if r.kind == "IHDR" and tiff:
            body = b"eXIf" + tiff
            out.parts.append(struct.pack(">I", len(tiff)) + body + struct.pack(">I", zlib.crc32(body)))
    if layout.end < len(b):
        out.drop("TRAILER", "after_iend", len(b) - layout.end)


def _webp(b: bytes, out: Output) -> None:
    layout = c.webp_layout(b)
    extended = layout.regions[0].kind == "VP8X"
    tiff = out.tiff(b[r.low : r.high] for r in layout.some("EXIF")) if extended else None
    icc = out.options.keep_icc and extended
    body: list[bytes] = []
    for r in layout.regions:
        keep = extended or r.kind != "VP8X" if r.kind in c.WEBP_KEEP else icc and r.kind == "ICCP"
        if not keep:
            out.drop(WEBP_TYPES.get(r.kind, "UNKNOWN"), r.label, r.stop - r.start)
            continue
        chunk = b[r.start : r.stop]
        if r.kind == "VP8X":
            flags = chunk[8] & ~(c.WEBP_ICC | c.WEBP_EXIF | c.WEBP_XMP) | (c.WEBP_ICC if icc and layout.some("ICCP") else 0) | (c.WEBP_EXIF if tiff else 0)
            chunk = chunk[:8] + bytes([flags]) + chunk[9:]
        elif (r.stop - r.low) % 2:
            chunk += b"\0"  # an odd chunk that ended with the file
        body.append(chunk)
    if tiff:
        body.append(b"EXIF" + struct.pack("<I", len(tiff)) + tiff + b"\0" * (len(tiff) % 2))
    if layout.end < len(b):
        out.drop("TRAILER", "after_riff", len(b) - layout.end)
    out.parts += [b"RIFF" + struct.pack("<I", sum(map(len, body)) + 4) + b"WEBP", *body]


def _gif(b: bytes, out: Output) -> None:
    layout = c.gif_layout(b)
    if not layout.some("image"):
        raise c.Unsupported("no frames")
    for r in layout.regions:
        if r.kind in ("header", "image", "control", "plain_text", "loop", "end") or r.kind == "icc" and out.options.keep_icc:
            out.parts.append(b[r.start : r.stop])
        else:
            out.drop(GIF_TYPES.get(r.kind, "UNKNOWN"), f"ext:{r.label}", r.stop - r.start)
    if not layout.complete:
        out.parts.append(b"\x3b")
        out.notes.append("added_trailer")
    if layout.end < len(b):
        out.drop("TRAILER", "after_trailer", len(b) - layout.end)


# -- video ------------------------------------------------------------------------------------------------------------


def _box_type(b: c.Box) -> str:
    return {c.C2PA_UUID: "C2PA", c.XMP_UUID: "XMP"}.get(b.user) or ("CONTAINER_META" if b.name in ("meta", "udta") else "UNKNOWN")


def _rebuild(data: bytes, box: c.Box, path: str, depth: int, drop: Callable, patch: Callable[[bytes, bool], bytes]) -> bytes:
    """A container box without what must go; chunk offset tables pass through patch."""
    if depth > c.MAX_DEPTH:
        raise c.Unsupported("nested too deeply")
    parts = []
    for k in c.inner(data, box):
        where = f"{path}/{k.name}"
        if k.name == "mvex":
            raise c.Unsupported("fragmented MP4")
        if k.name in MOOV_DROP or k.name[0] == "?" or k.name == "uuid" and not (box.name == "trak" and k.user == c.SPHERICAL_UUID):
            drop("C2PA" if k.user == c.C2PA_UUID else "UNKNOWN" if k.name == "uuid" else "CONTAINER_META", where, k.size)
        elif k.name in c.CONTAINERS:
            parts.append(_rebuild(data, k, where, depth + 1, drop, patch))
        elif k.name in ("stco", "co64"):
            wide = k.name == "co64"
            n = c.number(data, k.low + 4, ">I")
            stop = k.low + 8 + n * (8 if wide else 4)
            if stop > k.stop:
                raise c.Malformed(f"bad {k.name} count")
            parts.append(data[k.start : k.low + 8] + patch(data[k.low + 8 : stop], wide) + data[stop : k.stop])
        else:
            parts.append(data[k.start : k.stop])
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + data[box.start + 4 : box.start + 8] + body


def strip_video(f: BinaryIO, size: int, write: Callable[[bytes], object], options: StripOptions = StripOptions()) -> Output:
    """Streams an MP4 or MOV without its metadata; samples are copied and chunk offsets follow them."""
    out = Output(options)
    try:
        top = c.boxes(f, 0, size, True)
        if any(b.name in FRAGMENTS for b in top):
            raise c.Unsupported("fragmented MP4")
        moovs, mdats = [b for b in top if b.name == "moov"], [b for b in top if b.name == "mdat"]
        if len(moovs) != 1 or not mdats or moovs[0].size > c.MAX_MOOV:
            raise c.Unsupported("no single moov" if len(moovs) != 1 else "no mdat" if not mdats else "moov too large")
        for b in top:
            if b.name not in TOP_KEEP:
                out.drop(_box_type(b), b.name, b.size)
        data = c.read_at(f, moovs[0].start, moovs[0].size)
        roots = c.inner(data)
        if len(roots) != 1:
            raise c.Unsupported("damaged moov")
        kept = [b for b in top if b.name in TOP_KEEP]
        # chunk tables keep their size, so the new moov's length is known before its offsets are
        trial = _rebuild(data, roots[0], "moov", 0, out.drop, lambda table, wide: table)
        moved, at = [], 0
        for b in kept:
            if b.name == "mdat":
                moved.append((b.low, b.stop, at - b.start))
            at += len(trial) if b is moovs[0] else b.size

        def patch(table: bytes, wide: bool) -> bytes:
            code = ">%dQ" % (len(table) // 8) if wide else ">%dI" % (len(table) // 4)
            new = []
            for old in struct.unpack(code, table):
                shift = next((s for low, stop, s in moved if low <= old <= stop), None)
                if shift is None:
                    raise c.Unsupported("chunk offset outside mdat")
                new.append(old + shift)
            return struct.pack(code, *new)

        moov = _rebuild(data, roots[0], "moov", 0, lambda *_: None, patch)
    except (c.Malformed, struct.error) as e:
        raise c.Unsupported(f"damaged container: {e}") from e
    for b in kept:
        if b is moovs[0]:
            write(moov)
            continue
        for low in range(b.start, b.stop, CHUNK):
            write(c.read_at(f, low, min(CHUNK, b.stop - low)))
    out.notes.append("samples_unchanged")
    return out


# -- columns ----------------------------------------------------------------------------------------------------------

_IMAGES = {"JPEG": _jpeg, "PNG": _png, "WEBP": _webp, "GIF": _gif}
_OUTCOME = pa.struct(
    [
        ("status", pa.string()), ("data", pa.binary()), ("removed", pa.list_(pa.struct([("type", pa.string()), ("location", pa.string()), ("bytes", pa.int64())]))),
        ("notes", pa.list_(pa.string())), ("reason", pa.string()),
    ]
)
OUTCOME = "struct<status:string,data:binary,removed:array<struct<type:string,location:string,bytes:bigint>>,notes:array<string>,reason:string>"


def strip_bytes(b: bytes, fmt: str, options: StripOptions = StripOptions()) -> dict:
    """OUTCOME of one payload: stripped, or unsupported with the reason."""
    out = Output(options)
    try:
        if fmt in ("MP4", "MOV"):
            buffer = io.BytesIO()
            out = strip_video(io.BytesIO(b), len(b), buffer.write, options)
            out.parts = [buffer.getvalue()]
        elif fmt in _IMAGES:
            _IMAGES[fmt](b, out)
        else:
            raise c.Unsupported("needs_remux" if fmt == "MATROSKA" else "needs_reencode")
    except (c.Malformed, c.Unsupported, struct.error, IndexError) as e:
        return {"status": "unsupported", "data": None, "removed": [], "notes": [], "reason": f"{fmt}: {e}"}
    if options.taken and fmt in ("JPEG", "PNG", "WEBP"):
        out.notes.append(f"kept_capture_date={options.taken[0]}")
    removed = [{"type": t, "location": w, "bytes": n} for t, w, n in out.removed]
    return {"status": "stripped", "data": b"".join(out.parts), "removed": removed, "notes": out.notes, "reason": None}


def strip_rows(contents: list[bytes | None], formats: list[str | None], options: StripOptions = StripOptions()) -> pa.Array:
    return pa.array([None if x is None else strip_bytes(x, g, options) for x, g in zip(contents, formats, strict=True)], _OUTCOME)


def strip_content(content: Column, fmt: Column, options: StripOptions = StripOptions()) -> Column:
    """OUTCOME of in-row payloads; null stays null."""

    @F.arrow_udf(OUTCOME)
    def run(contents: pa.Array, formats: pa.Array) -> pa.Array:
        return strip_rows(contents.to_pylist(), formats.to_pylist(), options)

    return run.asNondeterministic()(content, fmt)
