"""Scan and strip queries over payloads that are assembled from the rows of ``pages`` in both engines.

Only containers without check sums can be assembled in SQL. Payloads are hexadecimal strings there, binaries here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scrubline.operators import findings, verify
from scrubline.plans import media
from scrubline.plans.queries import _table, query


def _raw(data: str) -> Column:
    return F.unhex(F.lit(data))


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _big(n: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))


def _little(n: Column) -> Column:
    return F.concat(*[_big(F.shiftright(n.cast("int"), 8 * i).bitwiseAND(F.lit(255)), 1) for i in range(4)])


_LITTLE_SQL = "printf('%02X%02X%02X%02X', {n} % 256, ({n} // 256) % 256, ({n} // 65536) % 256, {n} // 16777216)"
_SHORT_SQL = "CASE WHEN length(s) > 140 THEN substring(s, 1, 137) || '…' ELSE s END"

# -- JPEG: comment, an application segment of unknown kind, tables, scan, bytes behind the end -------------------------------

_TABLES = "FFDB0043" + "00" * 65 + "FFC00011" + "00" * 15 + "FFDA000C" + "00" * 10 + "414243FF00FFD0444546" + "FFD9"
_JPEG_SQL = f"""j AS (SELECT page_id, 'note ' || url AS note, html FROM pages), p AS (SELECT page_id, note, html, 'FFD8FFFE' || printf('%04X', strlen(note) + 2) || hex(encode(note))
  || CASE WHEN page_id % 2 = 0 THEN 'FFE5000B70726976617465217E' ELSE '' END || '{_TABLES}' || CASE WHEN page_id % 3 = 0 THEN hex(encode(html)) ELSE '' END AS payload FROM j)"""


def _jpegs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, note = F.col("page_id"), _bytes(F.concat(F.lit("note "), F.col("url")))
    payload = F.concat(
        _raw("FFD8FFFE"), _big(F.octet_length(note) + 2, 2), note, F.when(k % 2 == 0, _raw("FFE5000B70726976617465217E")).otherwise(_raw("")), _raw(_TABLES),
        F.when(k % 3 == 0, _bytes(F.col("html"))).otherwise(_raw("")),
    )
    return _table(spark, sf_dir, "pages").select("page_id", payload.alias("content"))


@query(
    f"""WITH {_JPEG_SQL}, f AS (SELECT page_id, 0 AS seq, 'COMMENT' AS kind, 'COM' AS location, trim(regexp_replace(note, '\\s+', ' ', 'g')) AS s FROM p
UNION ALL SELECT page_id, 1, 'UNKNOWN_BLOCK', 'APP5', '9 bytes' FROM p WHERE page_id % 2 = 0
UNION ALL SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END, 'TRAILING_DATA', 'after_eoi', strlen(html) || ' bytes after the end of the image' FROM p WHERE page_id % 3 = 0)
SELECT page_id, CAST(seq AS INTEGER) AS seq, kind, 'PRIVACY' AS severity, location, {_SHORT_SQL} AS detail FROM f"""
)
def jpeg_findings(spark, sf_dir):
    """What a scan finds in a JPEG: its comment, unknown application data and bytes behind the end."""
    return findings.explode_findings(findings.scan(_jpegs(spark, sf_dir)), ["page_id"])


@query(
    f"""SELECT page_id, 'JPEG' AS format, 'CLEAN' AS status, md5(unhex('FFD8' || '{_TABLES}')) AS digest, CAST(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS removed FROM pages"""
)
def jpeg_stripped(spark, sf_dir):
    """What remains of it: tables and scan, byte for byte."""
    c = media.clean_media(_jpegs(spark, sf_dir))
    return c.select("page_id", "format", "status", F.md5("outcome.data").alias("digest"), F.size("outcome.removed").alias("removed"))


@query(
    f"""WITH {_JPEG_SQL} SELECT page_id, CAST(0 AS INTEGER) AS seq, 'COMMENT' AS type, 'COM' AS location, CAST(strlen(note) + 4 AS BIGINT) AS bytes FROM p
UNION ALL SELECT page_id, 1, 'UNKNOWN', 'APP5', 13 FROM p WHERE page_id % 2 = 0
UNION ALL SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END, 'TRAILER', 'after_eoi', strlen(html) FROM p WHERE page_id % 3 = 0"""
)
def jpeg_removed(spark, sf_dir):
    """The audit of what went."""
    return media.removed_audit(media.clean_media(_jpegs(spark, sf_dir)), ["page_id"])


# -- GIF: comment extension, a loop, one frame, bytes behind the end ------------------------------------------------------

_GIF_HEAD = "474946383961" + "0400040080" + "0000" + "00" * 6
_GIF_LOOP = "21FF0B4E45545343415045322E300301000000"
_GIF_IMAGE = "21F9040000000000" + "2C" + "0000000004000400" + "00" + "0203616263" + "00" + "3B"


def _gifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, note = F.col("page_id"), _bytes(F.substring("url", 1, 200))
    payload = F.concat(
        _raw(_GIF_HEAD), _raw("21FE"), _big(F.octet_length(note), 1), note, _raw("00"), F.when(k % 2 == 0, _raw(_GIF_LOOP)).otherwise(_raw("")), _raw(_GIF_IMAGE),
        F.when(k % 5 == 0, _bytes(F.col("html"))).otherwise(_raw("")),
    )
    return _table(spark, sf_dir, "pages").select("page_id", payload.alias("content"))


@query(
    f"""WITH f AS (SELECT page_id, 0 AS seq, 'COMMENT' AS kind, 'ext:Comment' AS location, trim(substring(url, 1, 200)) AS s FROM pages
UNION ALL SELECT page_id, 1, 'TRAILING_DATA', 'after_trailer', strlen(html) || ' bytes after the end of the image' FROM pages WHERE page_id % 5 = 0)
SELECT page_id, CAST(seq AS INTEGER) AS seq, kind, 'PRIVACY' AS severity, location, {_SHORT_SQL} AS detail FROM f"""
)
def gif_findings(spark, sf_dir):
    return findings.explode_findings(findings.scan(_gifs(spark, sf_dir)), ["page_id"])


@query(
    f"""SELECT page_id, 'GIF' AS format, 'CLEAN' AS status, md5(unhex('{_GIF_HEAD}' || CASE WHEN page_id % 2 = 0 THEN '{_GIF_LOOP}' ELSE '' END || '{_GIF_IMAGE}')) AS digest,
  CAST(CASE WHEN page_id % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS removed, CAST(strlen(substring(url, 1, 200)) + 4 + CASE WHEN page_id % 5 = 0 THEN strlen(html) ELSE 0 END AS BIGINT) AS bytes FROM pages"""
)
def gif_stripped(spark, sf_dir):
    """The loop and the frames stay, comments and what follows the end go."""
    c = media.clean_media(_gifs(spark, sf_dir))
    gone = F.aggregate("outcome.removed", F.lit(0).cast("long"), lambda a, r: a + r["bytes"])
    return c.select("page_id", "format", "status", F.md5("outcome.data").alias("digest"), F.size("outcome.removed").alias("removed"), gone.alias("bytes"))


# -- WebP: extended header, lossless image, XMP packet, an unknown chunk --------------------------------------------------

_VP8L = "5650384C" + "0A000000" + "2F01020310" + "706978656C"
_VP8X = "56503858" + "0A000000" + "{flags}" + "00" * 9
_XMP_SQL = "hex(encode('<x:xmpmeta><rdf:Description CreatorTool=\"Tool ' || page_id || '\"/></x:xmpmeta>'))"
_WEBP_SQL = f"""x AS (SELECT page_id, {_XMP_SQL} AS xmp, hex(encode(url)) AS note FROM pages),
b AS (SELECT page_id, length(note) // 2 AS notes, length(xmp) // 2 AS xmps, xmp, note FROM x)"""


def _chunk(name: str, data: Column) -> Column:
    n = F.octet_length(data)
    return F.concat(_raw(name), _little(n), data, F.when(n % 2 == 1, _raw("00")).otherwise(_raw("")))


def _webps(spark: SparkSession, sf_dir: str) -> DataFrame:
    xmp = _bytes(F.concat(F.lit('<x:xmpmeta><rdf:Description CreatorTool="Tool '), F.col("page_id").cast("string"), F.lit('"/></x:xmpmeta>')))
    body = F.concat(_raw("57454250"), _raw(_VP8X.format(flags="04")), _raw(_VP8L), _chunk("584D5020", xmp), _chunk("6E6F7465", _bytes(F.col("url"))))
    rows = _table(spark, sf_dir, "pages").select("page_id", body.alias("body"))
    return rows.select("page_id", F.concat(_raw("52494646"), _little(F.octet_length("body")), F.col("body")).alias("content"))


@query(
    f"""WITH {_WEBP_SQL}
SELECT page_id, CAST(0 AS INTEGER) AS seq, 'XMP' AS kind, 'PRIVACY' AS severity, 'XMP' AS location, 'CreatorTool: Tool ' || page_id AS detail FROM b
UNION ALL SELECT page_id, 1, 'UNKNOWN_BLOCK', 'PRIVACY', 'note', notes || ' bytes' FROM b"""
)
def webp_findings(spark, sf_dir):
    return findings.explode_findings(findings.scan(_webps(spark, sf_dir)), ["page_id"])


@query(
    f"""WITH {_WEBP_SQL}, k AS (SELECT page_id, '57454250' || '{_VP8X.format(flags="00")}' || '{_VP8L}' AS kept, xmps + xmps % 2 + 8 AS xmp_bytes, notes + notes % 2 + 8 AS note_bytes FROM b)
SELECT page_id, 'WEBP' AS format, 'CLEAN' AS status, md5(unhex('52494646' || {_LITTLE_SQL.format(n="(length(kept) // 2)")} || kept)) AS digest, CAST(xmp_bytes + note_bytes AS BIGINT) AS bytes FROM k"""
)
def webp_stripped(spark, sf_dir):
    """The header loses its flag for XMP, and the outer size is that of what remains."""
    c = media.clean_media(_webps(spark, sf_dir))
    gone = F.aggregate("outcome.removed", F.lit(0).cast("long"), lambda a, r: a + r["bytes"])
    return c.select("page_id", "format", "status", F.md5("outcome.data").alias("digest"), gone.alias("bytes"))


# -- second opinion ---------------------------------------------------------------------------------------------------


@query(
    """SELECT page_id, false AS passed_before, 'marker fe' || CASE WHEN page_id % 2 = 0 THEN ',marker e5' ELSE '' END || CASE WHEN page_id % 3 = 0 THEN ',after the end' ELSE '' END AS flagged_before,
  true AS passed_after, 'SOI,DQT,SOF,SOS,EOI' AS parts_after FROM pages"""
)
def verified(spark, sf_dir):
    """The verifier before and after a JPEG is stripped."""
    before = verify.verify(_jpegs(spark, sf_dir), "content", "before_verdict")
    cleaned = media.clean_media(before)
    after = verify.verify(cleaned.select("page_id", "before_verdict", F.col("outcome.data").alias("data")), "data", "after_verdict")
    return after.select(
        "page_id", F.col("before_verdict.passed").alias("passed_before"), F.array_join("before_verdict.flagged", ",").alias("flagged_before"),
        F.col("after_verdict.passed").alias("passed_after"), F.array_join("after_verdict.parts", ",").alias("parts_after"),
    )
