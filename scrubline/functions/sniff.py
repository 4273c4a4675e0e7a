"""Container format detection and byte helpers, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: format, kind, MIME type, extension, can be stripped losslessly. Fixed values.
FORMATS = (
    ("JPEG", "IMAGE", "image/jpeg", "jpg", True),
    ("PNG", "IMAGE", "image/png", "png", True),
    ("WEBP", "IMAGE", "image/webp", "webp", True),
    ("GIF", "IMAGE", "image/gif", "gif", True),
    ("HEIF", "IMAGE", "image/heif", "heic", False),
    ("AVIF", "IMAGE", "image/avif", "avif", False),
    ("TIFF", "IMAGE", "image/tiff", "tif", False),
    ("BMP", "IMAGE", "image/bmp", "bmp", False),
    ("JXL", "IMAGE", "image/jxl", "jxl", False),
    ("MP4", "VIDEO", "video/mp4", "mp4", True),
    ("MOV", "VIDEO", "video/quicktime", "mov", True),
    ("MATROSKA", "VIDEO", "video/webm", "webm", False),
    ("UNKNOWN", "UNKNOWN", "application/octet-stream", "bin", False),
)
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs", "mif1", "msf1", "mif2")
AVIF_BRANDS = ("avif", "avis")
HEAD_BYTES = 256


def formats(spark: SparkSession) -> DataFrame:
    """The dimension of formats (13 rows)."""
    return spark.createDataFrame(list(FORMATS), "format string, kind string, mime_type string, extension string, lossless_strip boolean")


def _at(head: Column, position: int, literal: bytes) -> Column:
    return F.substring(head, position + 1, len(literal)) == F.lit(bytearray(literal))


def printable(head: Column) -> Column:
    """Bytes as text, one character each, ``?`` for what isn't printable ASCII."""
    return F.regexp_replace(F.decode(head, "ISO-8859-1"), "(?s)[^\\x20-\\x7E]", "?")


def u32be(data: Column, position: int) -> Column:
    return F.conv(F.hex(F.substring(data, position + 1, 4)), 16, 10).cast("long")


def detect_format(content: Column) -> Column:
    """The format's name by magic bytes in the head; under 12 bytes UNKNOWN."""
    head = F.substring(content, 1, HEAD_BYTES)
    text = printable(head)
    major = F.substring(text, 9, 4)
    box = F.greatest(F.lit(8).cast("long"), F.least(u32be(head, 0), F.length(head).cast("long"))).cast("int")
    others = F.when(box >= 20, F.transform(F.sequence(F.lit(17), box - 3, F.lit(4)), lambda p: F.substring(text, p, F.lit(4)))).otherwise(F.array().cast("array<string>"))
    has_avif = F.arrays_overlap(others, F.array(*map(F.lit, AVIF_BRANDS)))
    brand = (
        F.when(major.isin(*AVIF_BRANDS), "AVIF")
        .when(major.isin(*HEIF_BRANDS), F.when(has_avif, "AVIF").otherwise("HEIF"))
        .when(major == "qt  ", "MOV")
        .otherwise("MP4")
    )
    found = (
        F.when(F.length(head) < 12, "UNKNOWN")
        .when(_at(head, 0, b"\xff\xd8\xff"), "JPEG")
        .when(_at(head, 0, b"\x89PNG\r\n\x1a\n"), "PNG")
        .when(_at(head, 0, b"RIFF") & _at(head, 8, b"WEBP"), "WEBP")
        .when(_at(head, 0, b"GIF87a") | _at(head, 0, b"GIF89a"), "GIF")
        .when(_at(head, 0, b"II*\0") | _at(head, 0, b"MM\0*"), "TIFF")
        .when(_at(head, 0, b"BM") & (F.length(head) > 26), "BMP")
        .when(_at(head, 0, b"\xff\x0a") | _at(head, 4, b"JXL "), "JXL")
        .when(_at(head, 0, b"\x1a\x45\xdf\xa3"), "MATROSKA")
        .when(_at(head, 4, b"ftyp"), brand)
        .when(_at(head, 4, b"moov") | _at(head, 4, b"mdat") | _at(head, 4, b"wide") | _at(head, 4, b"free"), "MOV")
        .otherwise("UNKNOWN")
    )
    return F.when(content.isNotNull(), found)


def from_mime(mime: Column) -> Column:
    """The format of a MIME type, in any case; null if there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for name, _, m, *_ in FORMATS for x in (m, name)]), F.lower(mime))


def resolve_format(content: Column, mime: Column) -> Column:
    """By magic bytes, else by MIME type, else UNKNOWN."""
    sniffed = detect_format(content)
    return F.when(sniffed != "UNKNOWN", sniffed).otherwise(F.coalesce(from_mime(mime), F.lit("UNKNOWN")))


def decode_loose(data: Column) -> Column:
    """UTF-8 if valid, else Latin-1; NULs at the end go."""
    text = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.decode(data, "ISO-8859-1"))
    return F.rtrim(text, F.lit("\0"))


def contains_jumbf(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1").rlike("(?s)jumb.*c2pa")
