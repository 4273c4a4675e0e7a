"""Synthetic media payloads for the queries and tests: hand-assembled structures, no decodable pixels."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession

from scrubline.operators import containers as c

XMP = (
    b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:Description xmp:CreatorTool="Adobe Firefly" exif:GPSLatitude="1,2N" '
    b'Iptc4xmpExt:DigitalSourceType="http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia"/></x:xmpmeta>'
)
JUMBF = b"\0\0\0\x30jumb\0\0\0\x20jumdc2pa\0\x11\0\x10\x80\0\0\xaa\0\x38\x9b\x71\x03c2pa\0mopenai chatgpt claim"
ENTROPY = bytes(range(1, 200)) + b"\xff\x00" + b"\xff\xd0" + bytes(range(1, 90))


def tiff(orientation: int = 6, software: str = "midjourney v6", gps: bool = True, make: str = "ACME", order: str = ">") -> bytes:
    """A TIFF block with a few ASCII tags."""
    entries, extra = [], b""
    texts = [(0x010F, make), (0x0131, software)]
    count = 1 + len(texts) + gps
    base = 8 + 2 + 12 * count + 4
    for tag, text in texts:
        raw = text.encode() + b"\0"
        entries.append(struct.pack(order + "HHII", tag, 2, len(raw), base + len(extra)) if len(raw) > 4 else struct.pack(order + "HHI", tag, 2, len(raw)) + raw.ljust(4, b"\0"))
        extra += raw if len(raw) > 4 else b""
    entries.insert(1, struct.pack(order + "HHIHH", 0x0112, 3, 1, orientation, 0))
    if gps:
        entries.append(struct.pack(order + "HHII", 0x8825, 4, 1, 0))
    head = (b"MM\0*" if order == ">" else b"II*\0") + struct.pack(order + "I", 8)
    return head + struct.pack(order + "H", count) + b"".join(entries) + struct.pack(order + "I", 0) + extra


def segment(marker: int, payload: bytes) -> bytes:
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(payload) + 2) + payload


def jpeg(*extra: bytes, end: bytes = b"\xff\xd9", trailer: bytes = b"") -> bytes:
    return b"".join(
        [b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), *extra, segment(0xDB, bytes(65)), segment(0xC0, bytes(15)), segment(0xDA, bytes(10)), ENTROPY, end, trailer]
    )


def jpeg_rich() -> bytes:
    return jpeg(
        segment(0xE1, b"Exif\0\0" + tiff()), segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + XMP), segment(0xE2, b"ICC_PROFILE\0\1\1profile"),
        segment(0xEB, JUMBF), segment(0xED, b"Photoshop 3.0\0caption by someone"), segment(0xFE, b"made with ai by DALL-E"), segment(0xEE, b"Adobe\0d\0\0\0\0\1more"),
        segment(0xE5, b"unknown app data"), trailer=b"trailing jumb and c2pa data",
    )


def chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png(*extra: bytes, trailer: bytes = b"") -> bytes:
    return b"".join([c.PNG_MAGIC, chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 6, 0, 0, 0)), *extra, chunk(b"IDAT", zlib.compress(bytes(264))), chunk(b"IEND", b""), trailer])


def png_rich() -> bytes:
    return png(
        chunk(b"tEXt", b"parameters\0a cat, Steps: 20, Sampler: Euler a, CFG scale: 7"), chunk(b"zTXt", b"Comment\0\0" + zlib.compress(b"negative prompt: blurry")),
        chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + XMP), chunk(b"iTXt", b"note\0\1\0en\0n\0" + zlib.compress(b"packed text")), chunk(b"eXIf", tiff(3)),
        chunk(b"caBX", JUMBF), chunk(b"tIME", bytes(7)), chunk(b"iCCP", b"p\0\0" + zlib.compress(b"icc")), chunk(b"xxAa", b"private chunk"), trailer=b"after the end",
    )


def riff(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def webp(*chunks: bytes, trailer: bytes = b"") -> bytes:
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body + trailer


def webp_rich() -> bytes:
    return webp(
        riff(b"VP8X", bytes([0x2C]) + bytes(9)), riff(b"ICCP", b"profile!"), riff(b"VP8L", b"\x2f" + bytes([1, 2, 3, 0x10]) + b"pixel"), riff(b"EXIF", tiff(8, order="<")),
        riff(b"XMP ", XMP), riff(b"C2PA", JUMBF), trailer=b"tail",
    )


def gif(*extensions: bytes, trailer: bytes = b"") -> bytes:
    image = b"\x2c" + struct.pack("<HHHHB", 0, 0, 4, 4, 0) + b"\x02\x03abc\0"
    return b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0x80, 0, 0) + bytes(6) + b"".join(extensions) + b"\x21\xf9\x04\0\0\0\0\0" + image + b"\x3b" + trailer


def gif_rich() -> bytes:
    comment = b"\x21\xfe\x0dmidjourney v5\0"
    loop = b"\x21\xff\x0bNETSCAPE2.0\x03\1\0\0\0"
    xmp = b"\x21\xff\x0bXMP DataXMP" + bytes([len(XMP)]) + XMP + b"\0" if len(XMP) < 256 else b"\x21\xff\x0bXMP DataXMP\x05hello\0"
    return gif(comment, loop, xmp, trailer=b"more")


def box(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + name + body


def mp4(wide: bool = False, first: bool = True, extra: tuple[bytes, ...] = (), shift: int = 0, brand: bytes = b"isom", two: bool = False) -> bytes:
    """moov with one video track of two chunks per mdat; the chunk offsets are right unless shifted."""
    samples = [b"SAMPLE-ONE......", b"SAMPLE-TWO......"]
    mdats = [box(b"mdat", *samples)] * (2 if two else 1)

    def moov(offsets: list[int]) -> bytes:
        code = ">%dQ" if wide else ">%dI"
        table = box(b"co64" if wide else b"stco", bytes(4), struct.pack(">I", len(offsets)), struct.pack(code % len(offsets), *offsets))
        stbl = box(b"stbl", box(b"stsd", bytes(16)), table)
        handler = box(b"hdlr", bytes(8), b"vide", bytes(12))
        trak = box(b"trak", box(b"tkhd", bytes(20)), box(b"mdia", handler, box(b"minf", stbl)), box(b"uuid", c.SPHERICAL_UUID, b"<spherical/>"))
        udta = box(b"udta", box(b"\xa9xyz", b"+48.8577+002.295/"), box(b"\xa9too", b"made with kling aigc"))
        return box(b"moov", box(b"mvhd", bytes(100)), trak, udta, box(b"meta", bytes(4), b"com.openai.sora generated"), box(b"free", bytes(8)))

    ftyp = box(b"ftyp", brand, bytes(4), b"mp42")
    top = [ftyp, *extra]
    size = len(moov([0] * 2 * len(mdats)))
    at = sum(map(len, top)) + (size if first else 0)
    offsets = []
    for m in mdats:
        offsets += [at + 8 + shift, at + 8 + len(samples[0]) + shift]
        at += len(m)
    return b"".join([*top, moov(offsets), *mdats] if first else [*top, *mdats, moov(offsets)])


def mp4_rich() -> bytes:
    return mp4(extra=(box(b"uuid", c.C2PA_UUID, JUMBF), box(b"uuid", c.XMP_UUID, XMP), box(b"free", b"text in free box")))


def nested(depth: int) -> bytes:
    data = b""
    for _ in range(depth):
        data = struct.pack(">I", len(data) + 8) + b"trak" + data
    return box(b"ftyp", b"isom", bytes(4)) + box(b"moov", data) + box(b"mdat", b"x" * 8)


def matroska() -> bytes:
    return b"\x1a\x45\xdf\xa3" + bytes(20) + b"WritingApp runway gen-3 c2pa.claim"


def samples() -> dict[str, bytes]:
    return {
        "jpeg_rich": jpeg_rich(), "jpeg_plain": jpeg(), "jpeg_truncated": jpeg(segment(0xFE, b"cut"), end=b""), "jpeg_broken": b"\xff\xd8\xff\xe1\xff\xff" + XMP,
        "png_rich": png_rich(), "png_plain": png(), "png_critical": png(chunk(b"XXxx", b"?")), "png_broken": png_rich()[:60],
        "webp_rich": webp_rich(), "webp_simple": webp(riff(b"VP8 ", b"0123456789"), riff(b"C2PA", JUMBF)), "gif_rich": gif_rich(), "gif_broken": gif_rich()[:20],
        "mp4_rich": mp4_rich(), "mp4_tail": mp4(wide=True, first=False, two=True), "mov": mp4(brand=b"qt  "), "mp4_bad_offset": mp4(shift=10**6),
        "mp4_fragmented": mp4(extra=(box(b"moof", bytes(8)),)), "mp4_nested": nested(40), "heic": box(b"ftyp", b"heic", bytes(4), b"mif1") + box(b"meta", JUMBF) + box(b"mdat", b"Exif\0\0" + tiff()),
        "avif": box(b"ftyp", b"mif1", bytes(4), b"avif") + box(b"mdat", bytes(8)), "tiff": tiff(order="<"), "bmp": b"BM" + bytes(40), "jxl": b"\xff\x0a" + bytes(20), "matroska": matroska(),
        "text": b"just some plain text, nothing else", "short": b"tiny", "empty": b"",
    }


def sample_files(spark: SparkSession) -> DataFrame:
    """(path, length, content), the shape of the binaryFile source."""
    return spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in samples().items()], "path string, length long, content binary")
