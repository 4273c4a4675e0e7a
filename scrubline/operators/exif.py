"""EXIF: what a TIFF block says about orientation and identity, and the smallest block worth writing back."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from scrubline.operators.containers import Malformed, number

#: tag -> field for text values; the others by name. Fixed values.
TEXT_TAGS = {0x010E: "description", 0x010F: "make", 0x0110: "model", 0x0131: "software", 0x013B: "artist", 0x9003: "taken"}
ORIENTATION, EXIF_IFD, GPS_IFD, USER_COMMENT, XP_COMMENT, TAKEN, TAKEN_OFFSET = 0x0112, 0x8769, 0x8825, 0x9286, 0x9C9C, 0x9003, 0x9011
MINIMAL_TAGS = frozenset((ORIENTATION, EXIF_IFD, TAKEN, TAKEN_OFFSET))
MAX_ENTRIES, MAX_TEXT, MAX_COMMENT = 1000, 4096, 65536


@dataclass
class Exif:
    orientation: int = 1
    fields: dict[str, str] = field(default_factory=dict)
    gps: bool = False
    thumbnail: bool = False
    entries: int = 0
    tags: set[int] = field(default_factory=set)

    @property
    def texts(self) -> list[str]:
        return [self.fields[k] for k in ("make", "model", "software", "artist", "description", "comment") if k in self.fields]

    @property
    def minimal(self) -> bool:
        """Holds nothing but what a strip may have written back."""
        return self.tags <= MINIMAL_TAGS and not self.gps and not self.texts and not self.thumbnail and self.entries == len(self.tags)


def _clean(raw: bytes, encoding: str) -> str | None:
    text = raw.decode(encoding, "replace").rstrip("\0 ")
    return text if text.strip() else None


class _Reader:
    def __init__(self, data: bytes):
        self.d, self.out, self.seen = data, Exif(), set()
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if not self.order:
            raise Malformed("no TIFF header")

    def num(self, at: int, code: str) -> int:
        if at < 0:
            raise Malformed("offset before the block")
        return number(self.d, at, self.order + code)

    def value(self, entry: int, size: int) -> bytes | None:
        at = entry + 8 if size <= 4 else self.num(entry + 8, "I")
        return self.d[at : at + size] if at + size <= len(self.d) else None

    def entry(self, at: int, root: bool) -> None:
        tag, kind, n = self.num(at, "H"), self.num(at + 2, "H"), self.num(at + 4, "I")
        e = self.out
        e.entries += 1
        e.tags.add(tag)
        if tag in TEXT_TAGS:
            raw = self.value(at, n) if kind == 2 and 0 < n <= MAX_TEXT else None
            self.put(TEXT_TAGS[tag], raw, "utf-8")
        elif tag == ORIENTATION and root and kind == 3:
            e.orientation = self.num(at + 8, "H")
        elif tag == USER_COMMENT:
            raw = self.value(at, n) if 8 < n <= MAX_COMMENT else None
            wide = raw is not None and re.sub(rb"[^\x20-\x7e]", b"?", raw[:8]).rstrip(b"? ") == b"UNICODE"
            self.put("comment", raw and raw[8:], ("utf-16-le" if self.order == "<" else "utf-16-be") if wide else "utf-8")
        elif tag == XP_COMMENT and "comment" not in e.fields:
            self.put("comment", self.value(at, n) if 0 < n <= MAX_COMMENT else None, "utf-16-le")
        elif tag == GPS_IFD:
            e.gps = True
        elif tag == EXIF_IFD and root:
            self.directory(self.num(at + 8, "I"), False)

    def put(self, name: str, raw: bytes | None, encoding: str) -> None:
        text = _clean(raw, encoding) if raw is not None else None
        if text is None:
            self.out.fields.pop(name, None)
        else:
            self.out.fields[name] = text

    def directory(self, at: int, root: bool) -> int:
        """Reads a directory and gives the offset of the next one."""
        if at <= 0 or at + 2 > len(self.d) or at in self.seen:
            return 0
        self.seen.add(at)
        n = self.num(at, "H")
        if n > MAX_ENTRIES:
            return 0
        for k in range(n):
            if at + 14 + 12 * k > len(self.d):
                return 0
            self.entry(at + 2 + 12 * k, root)
        after = at + 2 + 12 * n
        return self.num(after, "I") if after + 4 <= len(self.d) else 0


def read_exif(payload: bytes) -> Exif:
    """Of a JPEG APP1 payload or a bare TIFF block; broken blocks give an empty summary."""
    data = payload[6:] if payload.startswith(b"Exif\0\0") else payload
    try:
        reader = _Reader(data)
        following = reader.directory(reader.num(4, "I"), True)
        reader.out.thumbnail = 0 < following < len(data)
        return reader.out
    except Malformed:
        return Exif()


def minimal_tiff(orientation: int, taken: tuple[str, str] | None) -> bytes:
    """Big-endian block of the orientation (if 2 to 8) and the capture time with its offset, each if given."""
    own = [(ORIENTATION, 3, 1, struct.pack(">HH", orientation, 0))] if 2 <= orientation <= 8 else []
    base = 8 + 2 + 12 * (len(own) + (taken is not None)) + 4
    if taken:
        own.append((EXIF_IFD, 4, 1, struct.pack(">I", base)))
    pack = lambda entries: struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHI", *x[:3]) + x[3] for x in entries) + bytes(4)
    out = b"MM\0*" + struct.pack(">I", 8) + pack(own)
    if taken:
        values = base + 2 + 24 + 4
        out += pack([(TAKEN, 2, 20, struct.pack(">I", values)), (TAKEN_OFFSET, 2, 7, struct.pack(">I", values + 20))])
        out += taken[0].encode("latin-1") + b"\0" + taken[1].encode("latin-1") + b"\0"
    return out
