"""An independent check of stripped payloads: walks containers by its own rules and searches raw bytes for markers."""

from __future__ import annotations

import re
import struct

MARKERS = (b"c2pa", b"jumb", b"Exif\0\0II", b"http://ns.adobe.com/xap", b"<x:xmpmeta", b"midjourney", b"openai", b"Firefly", b"trainedAlgorithmicMedia", b"parameters\0", b"kling", b"Photoshop 3.0")
SHORT = (b"sora", b"aigc")


def marker_hits(data: bytes) -> list[bytes]:
    """Long markers anywhere; short ones only as words among printable characters, since they occur by chance."""
    return [m for m in MARKERS if m in data] + [m for m in SHORT if re.search(rb"(?<![\x21-\x7e])" + m + rb"(?![\x21-\x7e])", data)]


def structure(fmt: str, data: bytes) -> list[str]:
    """Names of the parts in order; raises on a structural error."""
    out = []
    if fmt == "JPEG":
        assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"
        at = 2
        while data[at + 1] != 0xDA:
            assert data[at] == 0xFF
            size = struct.unpack_from(">H", data, at + 2)[0]
            out.append(f"{data[at + 1]:02x}:" + data[at + 4 : at + 8].decode("latin-1"))
            at += 2 + size
        return [*out, "da"]
    if fmt == "PNG":
        import zlib

        at = 8
        while at < len(data):
            size = struct.unpack_from(">I", data, at)[0]
            body = data[at + 4 : at + 8 + size]
            assert struct.unpack_from(">I", data, at + 8 + size)[0] == zlib.crc32(body)
            out.append(body[:4].decode())
            at += 12 + size
        assert out[-1] == "IEND" and at == len(data)
    elif fmt == "WEBP":
        assert struct.unpack_from("<I", data, 4)[0] + 8 == len(data)
        at = 12
        while at < len(data):
            size = struct.unpack_from("<I", data, at + 4)[0]
            out.append(data[at : at + 4].decode())
            at += 8 + size + size % 2
        assert at == len(data)
    elif fmt in ("MP4", "MOV"):
        at = 0
        while at < len(data):
            size = struct.unpack_from(">I", data, at)[0]
            assert 8 <= size <= len(data) - at
            out.append(data[at + 4 : at + 8].decode())
            at += size
    elif fmt == "GIF":
        assert data[:4] == b"GIF8" and data[-1:] == b"\x3b"
    return out
