"""Metadata blocks of media payloads: one row per file with its blocks, parsed in Arrow batches.

Each block carries the text that vocabularies are matched against, so everything after this step is Catalyst.
A payload that can't be parsed is searched as raw bytes and says so in ``parse_error``; no payload fails a job.
"""

from __future__ import annotations

import io
import os
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scrubline.functions import sniff
from scrubline.operators import containers as c
from scrubline.operators.exif import read_exif

# -- fixed values: limits and tokens ------------------------------------------------------------------------------------

TEXT_LIMIT, INFLATE_LIMIT, MIN_RUN = 4 << 20, 16 << 20, 6
RAW_WINDOW, XMP_WINDOW, TAIL_WINDOW, HEAD_TEXT = 256 << 10, 8 << 20, 8 << 20, 1 << 20
MAX_IMAGE = 256 << 20
STRONG_TOKENS = (
    "trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia", "c2pa.actions", "c2pa.claim", "c2pa.signature", "contentauth", "urn:c2pa",
    "urn:uuid:c2pa", "Content Credentials",
)
SILENT_BOXES = frozenset("ftyp moov mdat free skip wide pdin styp sidx moof mfra emsg prft".split())
JPEG_BLOCKS = {
    "exif": ("EXIF", " (EXIF)"), "xmp": ("XMP", " (XMP)"), "icc": ("ICC", ""), "mpf": ("EXTRA_IMAGE", " (MPF)"), "jumbf": ("C2PA", " (JUMBF)"),
    "iptc": ("IPTC", " (IPTC)"), "comment": ("COMMENT", ""), "thumbnail": ("THUMBNAIL", ""), "other": ("UNKNOWN", ""),
}
PNG_BLOCKS = {"eXIf": ("EXIF", "eXIf"), "iCCP": ("ICC", "iCCP"), "caBX": ("C2PA", "caBX (C2PA)"), "tIME": ("TIMESTAMP", "tIME")}
WEBP_BLOCKS = {"EXIF": "EXIF", "XMP ": "XMP", "ICCP": "ICC", "C2PA": "C2PA"}

_RUN = re.compile(rb"(?:[\x20-\x7e\t\n\r]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_WIDE_RUN = re.compile(rb"(?:[\x20-\x7e]\0){%d,}" % MIN_RUN)


def strings(data: bytes) -> str:
    """Printable runs of at least six bytes, one a line; a run that may start with a CBOR text header is also given
    without it; then runs of two-byte ASCII."""
    data = data[:TEXT_LIMIT]
    out = []
    for m in _RUN.finditer(data):
        if len(m[0]) >= MIN_RUN:
            text = m[0].decode("utf-8", "replace")
            out += [text, text[1:]] if 0x61 <= m[0][0] <= 0x77 else [text]
    out += [m[0][::2].decode("ascii") for m in _WIDE_RUN.finditer(data)]
    return "".join(x + "\n" for x in out)


def loose(data: bytes) -> str:
    text = data.decode("utf-8", "replace")
    return (data.decode("latin-1") if "�" in text else text).rstrip("\0")


def has_jumbf(data: bytes) -> bool:
    at = data.find(b"jumb")
    return at >= 0 and data.find(b"c2pa", at) >= 0


def inflate(data: bytes) -> bytes | None:
    """zlib data as far as it goes, up to a limit; None where it isn't any."""
    try:
        return zlib.decompressobj().decompress(data, INFLATE_LIMIT)
    except zlib.error:
        return None


def token_windows(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(token, first place, what stands around it) of each strong token."""
    for token in STRONG_TOKENS:
        at = data.find(token.encode())
        if at >= 0:
            yield token, at, data[max(0, at - 512) : at + 4096]


def find_tokens(content: Column) -> Column:
    """array<struct<token, at, context>>: token_windows of each payload, context being the window's length."""

    @F.arrow_udf("array<struct<token:string,at:bigint,context:bigint>>")
    def run(contents: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("token", pa.string()), ("at", pa.int64()), ("context", pa.int64())]))
        rows = [None if x is None else [{"token": t, "at": at, "context": len(w)} for t, at, w in token_windows(x)] for x in contents.to_pylist()]
        return pa.array(rows, kind)

    return run(content)


class Blocks(list):
    """The blocks of one file in order."""

    def put(self, kind: str, location: str, data: bytes = b"", key: str = "", text: str | None = None) -> None:
        row = {"type": kind, "location": location, "key": key, "bytes": len(data), "text": text, "jumbf": False, "exif": None}
        if kind in ("C2PA", "IPTC", "EXTRA_IMAGE", "CONTAINER_META"):
            row["text"] = strings(data)
        elif kind in ("TRAILER", "UNKNOWN"):
            row |= {"text": strings(data), "jumbf": has_jumbf(data)}
        elif kind == "XMP":
            row["text"] = data.decode("utf-8", "replace")
        elif kind in ("COMMENT", "TEXT"):
            row["text"] = loose(data)
        elif kind == "EXIF":
            e = read_exif(data)
            row["text"] = "\n".join(e.texts) + "\n" + strings(data)
            row["exif"] = {k: e.fields.get(k) for k in ("make", "model", "software", "taken")} | {
                "orientation": e.orientation, "gps": e.gps, "thumbnail": e.thumbnail, "entries": e.entries, "minimal": e.minimal,
            }
        self.append(row)

    def tokens(self, data: bytes, location: str = "file") -> None:
        for token, _, window in token_windows(data):
            self.put("TOKEN", location, key=token, text=strings(window))

    def raw(self, data: bytes) -> None:
        """What can be found without knowing the container."""
        at = data.find(b"<x:xmpmeta")
        while at >= 0:
            close = data.find(b"</x:xmpmeta>", at, at + XMP_WINDOW)
            stop = close + 12 if close >= 0 else min(len(data), at + RAW_WINDOW)
            self.put("XMP", "XMP", data[at:stop])
            at = data.find(b"<x:xmpmeta", stop)
        for m in re.finditer(rb"Exif\0\0(?=II|MM)", data):
            self.put("EXIF", "EXIF", data[m.start() : m.start() + RAW_WINDOW])
        at = data.find(b"jumb")  # the first one only
        if at >= 0 and has_jumbf(window := data[max(0, at - 16) : at + RAW_WINDOW]):
            self.put("C2PA", "JUMBF", window)
        self.tokens(data)


def _jpeg(b: bytes, out: Blocks) -> dict:
    layout = c.jpeg_layout(b)
    for r in layout.regions:
        if r.kind in JPEG_BLOCKS:
            kind, suffix = JPEG_BLOCKS[r.kind]
            out.put(kind, r.label + suffix, b[r.low : r.high])
    if any(c.jfif_has_thumbnail(b, r) for r in layout.some("jfif")):
        out.put("THUMBNAIL", "APP0 (JFIF)")
    if layout.end < len(b):
        out.put("TRAILER", "after_eoi", b[layout.end :])
    return {}


def _png_text(kind: str, data: bytes, out: Blocks) -> None:
    raw_key, nul, rest = data.partition(b"\0")
    if not nul:
        out.put("TEXT", kind, data)
        return
    if kind == "zTXt":
        rest = inflate(rest[1:]) or b""
    elif kind == "iTXt":
        packed, body = rest[:1] == b"\1", rest[2:]
        for _ in range(2):  # language and translated key
            body = body.partition(b"\0")[2]
        rest = (inflate(body) or b"") if packed else body
    key = raw_key.decode("latin-1")
    out.put("XMP" if key == "XML:com.adobe.xmp" else "TEXT", f"{kind}:{key}", rest, key)


def _png(b: bytes, out: Blocks) -> dict:
    layout = c.png_layout(b)
    alpha = False
    for r in layout.regions:
        data = b[r.low : r.high]
        if r.kind in ("tEXt", "zTXt", "iTXt"):
            _png_text(r.kind, data, out)
        elif r.kind in PNG_BLOCKS:
            out.put(*PNG_BLOCKS[r.kind], data)
        elif r.kind not in c.PNG_KEEP:
            out.put("UNKNOWN", r.kind, data)
        elif r.kind == "IHDR" and len(data) >= 10:
            alpha = data[9] in (4, 6)
        elif r.kind == "tRNS":
            alpha = True
    if layout.end < len(b):
        out.put("TRAILER", "after_iend", b[layout.end :])
    return {"animated": bool(layout.some("acTL")), "has_alpha": alpha, "lossless": True}


def _webp(b: bytes, out: Blocks) -> dict:
    layout = c.webp_layout(b)
    flags = 0
    for r in layout.regions:
        data = b[r.low : r.high]
        if r.kind == "VP8X":
            flags = data[0] if data else 0
        elif r.kind not in c.WEBP_KEEP:
            out.put(WEBP_BLOCKS.get(r.kind, "UNKNOWN"), r.label, data)
    if layout.end < len(b):
        out.put("TRAILER", "after_riff", b[layout.end :])
    exact = layout.some("VP8L")
    alpha_bit = bool(exact) and exact[0].high - exact[0].low >= 5 and c.number(b, exact[0].low + 1, "<I") >> 28 & 1 == 1
    return {
        "animated": bool(flags & c.WEBP_ANIMATION or layout.some("ANMF")),
        "has_alpha": bool(flags & c.WEBP_ALPHA or layout.some("ALPH") or alpha_bit),
        "lossless": bool(exact) and not layout.some("VP8 "),
    }


def _gif(b: bytes, out: Blocks) -> dict:
    layout = c.gif_layout(b)
    for r in layout.regions:
        raw = b[r.start : r.stop]
        if r.kind == "comment":
            out.put("COMMENT", f"ext:{r.label}", c.gif_data(b, r))
        elif r.kind in ("xmp", "icc"):
            out.put(r.kind.upper(), f"ext:{r.label}", raw)
        elif r.kind in ("app", "unknown"):
            out.put("C2PA" if has_jumbf(raw) else "UNKNOWN", f"ext:{r.label}", raw)
    if layout.end < len(b):
        out.put("TRAILER", "after_trailer", b[layout.end :])
    return {"animated": len(layout.some("image")) > 1, "lossless": True}


def _uuid(user: bytes, payload: bytes, location: str, out: Blocks) -> None:
    kind, suffix = {c.C2PA_UUID: ("C2PA", " (C2PA)"), c.XMP_UUID: ("XMP", " (XMP)")}.get(user, ("UNKNOWN", ""))
    out.put(kind, location + suffix, payload)


def _moov(data: bytes, out: Blocks) -> None:
    """Depth first with a stack of its own, so hostile nesting can't exhaust Python's."""
    try:
        roots = c.inner(data)
    except c.Malformed:
        out.put("TEXT_ONLY", "moov", text=strings(data))
        return
    todo = [(b, "moov", 0) for b in roots[:1]]
    while todo:
        box, path, depth = todo.pop()
        if box.name in c.CONTAINERS:
            if depth > c.MAX_DEPTH:
                out.put("TOO_DEEP", path)
                continue
            try:
                kids = c.inner(data, box)
            except c.Malformed:
                continue
            if box.name == "trak" and _handler(data, kids) in ("meta", "mdta"):
                out.put("METADATA_TRACK", path)
            todo += [(k, f"{path}/{k.name}", depth + 1) for k in reversed(kids)]
        elif depth:
            payload = data[box.low : min(box.stop, box.low + c.MAX_BLOCK)]
            if box.name in ("udta", "meta") or box.name[0] == "?":
                out.put("CONTAINER_META", path, payload)
            elif box.name == "uuid" and box.user != c.SPHERICAL_UUID:
                _uuid(box.user, payload, path, out)


def _handler(data: bytes, kids: list[c.Box]) -> str | None:
    try:
        for mdia in [k for k in kids if k.name == "mdia"][:1]:
            for h in [k for k in c.inner(data, mdia) if k.name == "hdlr"][:1]:
                return c.fourcc(data, h.low + 8)
    except c.Malformed:
        pass
    return None


def _bmff(f: BinaryIO, size: int, image: bool, out: Blocks) -> None:
    for b in c.boxes(f, 0, size, True):
        if b.name == "moov":
            if b.size <= c.MAX_MOOV:
                _moov(c.read_at(f, b.start, b.size), out)
            continue
        blank = b.name in ("free", "skip")
        if b.name in SILENT_BOXES and not blank:
            continue
        limit = c.MAX_MOOV if b.name == "meta" else c.MAX_BLOCK if b.name == "uuid" or blank else 64 << 10
        if blank and not 0 < b.stop - b.low <= limit:
            continue
        low = b.start if b.name == "meta" else b.low
        data = c.read_at(f, low, min(b.stop - low, limit))
        if b.name == "uuid":
            _uuid(b.user, data, "uuid", out)
        elif b.name == "meta" and image:
            out.put("TEXT_ONLY", "meta", text=strings(data))
            if has_jumbf(data):
                out.put("C2PA_ITEM", "meta")
        elif b.name == "meta":
            out.put("CONTAINER_META", "meta", data)
        elif not blank or data.strip(b"\0") and strings(data).strip():
            out.put("UNKNOWN", b.name, data)
    if image and size <= MAX_IMAGE:
        out.raw(c.read_at(f, 0, size))


_PARSERS = {"JPEG": _jpeg, "PNG": _png, "WEBP": _webp, "GIF": _gif}
_BMFF = {"HEIF": True, "AVIF": True, "MP4": False, "MOV": False}


def parse(fmt: str, f: BinaryIO, size: int) -> tuple[Blocks, dict, str | None]:
    """(blocks, traits, parse error) of a seekable payload of a known format."""
    out, traits, error = Blocks(), {}, None
    try:
        if fmt in _BMFF and not (_BMFF[fmt] and size > MAX_IMAGE):  # a picture that is too large has its ends searched
            _bmff(f, size, _BMFF[fmt], out)
            return out, traits, None
        if fmt == "MATROSKA" or size > MAX_IMAGE:
            head = c.read_at(f, 0, min(size, TAIL_WINDOW))
            out.tokens(head)
            out.put("TEXT_ONLY", "header", text=strings(head[:HEAD_TEXT]))
            if size > TAIL_WINDOW:
                out.tokens(c.read_at(f, size - TAIL_WINDOW, TAIL_WINDOW))
            return out, traits, None
        data = c.read_at(f, 0, size)
        if fmt in _PARSERS:
            traits = _PARSERS[fmt](data, out)
        elif fmt == "TIFF":
            out.put("EXIF", "TIFF IFD", data[:TEXT_LIMIT])
            out.raw(data)
        else:
            out.raw(data)
    except c.Malformed as e:
        out, error = Blocks(), str(e)
        if size <= c.MAX_MOOV or fmt not in _BMFF:
            out.raw(c.read_at(f, 0, size))
    return out, traits, error


_BLOCK = pa.struct(
    [
        ("type", pa.string()), ("location", pa.string()), ("key", pa.string()), ("bytes", pa.int64()), ("text", pa.string()), ("jumbf", pa.bool_()),
        ("exif", pa.struct([("make", pa.string()), ("model", pa.string()), ("software", pa.string()), ("taken", pa.string()), ("orientation", pa.int32()), ("gps", pa.bool_()), ("thumbnail", pa.bool_()), ("entries", pa.int32()), ("minimal", pa.bool_())])),
    ]
)
_PARSED = pa.struct([("blocks", pa.list_(_BLOCK)), ("animated", pa.bool_()), ("has_alpha", pa.bool_()), ("lossless", pa.bool_()), ("parse_error", pa.string())])
BLOCK = (
    "struct<type:string,location:string,key:string,bytes:bigint,text:string,jumbf:boolean,"
    "exif:struct<make:string,model:string,software:string,taken:string,orientation:int,gps:boolean,thumbnail:boolean,entries:int,minimal:boolean>>"
)
PARSED = f"struct<blocks:array<{BLOCK}>,animated:boolean,has_alpha:boolean,lossless:boolean,parse_error:string>"


def _row(fmt: str, f: BinaryIO, size: int) -> dict:
    blocks, traits, error = parse(fmt, f, size)
    return {"blocks": list(blocks), "animated": False, "has_alpha": False, "lossless": False, "parse_error": error} | traits


def parse_rows(contents: list[bytes | None], formats: list[str | None]) -> pa.Array:
    return pa.array([None if x is None else _row(g, io.BytesIO(x), len(x)) for x, g in zip(contents, formats, strict=True)], _PARSED)


def parse_content(content: Column, fmt: Column) -> Column:
    """PARSED of in-row payloads; null stays null."""

    @F.arrow_udf(PARSED)
    def run(contents: pa.Array, formats: pa.Array) -> pa.Array:
        return parse_rows(contents.to_pylist(), formats.to_pylist())

    return run.asNondeterministic()(content, fmt)


def parse_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Path mode: (path, format, parsed) by seeking in local or mounted files, so large videos never become a cell."""
    schema = pa.schema([("path", pa.string()), ("format", pa.string()), ("parsed", _PARSED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                with open(name.removeprefix("file:"), "rb") as f:
                    size = os.fstat(f.fileno()).st_size
                    fmt = detect(f.read(sniff.HEAD_BYTES))
                    rows.append({"path": name, "format": fmt, "parsed": _row(fmt, f, size)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select(path).mapInArrow(run, f"path string, format string, parsed {PARSED}")


_MAGIC = (
    (0, (b"\xff\xd8\xff",), "JPEG"), (0, (b"\x89PNG\r\n\x1a\n",), "PNG"), (0, (b"GIF87a", b"GIF89a"), "GIF"), (0, (b"II*\0", b"MM\0*"), "TIFF"),
    (0, (b"\xff\x0a",), "JXL"), (4, (b"JXL ",), "JXL"), (0, (b"\x1a\x45\xdf\xa3",), "MATROSKA"), (4, (b"moov", b"mdat", b"wide", b"free"), "MOV"),
)


def detect(head: bytes) -> str:
    """As sniff.detect_format, for path mode."""
    if len(head) < 12:
        return "UNKNOWN"
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "WEBP"
    if head[:2] == b"BM" and len(head) > 26:
        return "BMP"
    if head[4:8] == b"ftyp":
        major, stop = c.fourcc(head, 8), max(8, min(c.number(head, 0, ">I"), len(head)))
        brands = {c.fourcc(head, p) for p in range(16, stop - 3, 4)}
        if major in sniff.AVIF_BRANDS or major in sniff.HEIF_BRANDS and brands & set(sniff.AVIF_BRANDS):
            return "AVIF"
        return "HEIF" if major in sniff.HEIF_BRANDS else "MOV" if major == "qt  " else "MP4"
    return next((name for at, magics, name in _MAGIC if head.startswith(magics, at)), "UNKNOWN")
