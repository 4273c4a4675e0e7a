import io
import random

import pytest
from pyspark.sql import functions as F

from scrubline.functions import sniff
from scrubline.operators import blocks, containers as c, findings
from scrubline.operators.exif import minimal_tiff, read_exif
from scrubline.operators.strip import StripOptions, strip_bytes, strip_video
from scrubline.plans import media, samples as s

FORMATS = {
    "jpeg": "JPEG", "png": "PNG", "webp": "WEBP", "gif": "GIF", "mp4": "MP4", "mov": "MOV", "heic": "HEIF", "avif": "AVIF", "tiff": "TIFF", "bmp": "BMP", "jxl": "JXL",
    "matroska": "MATROSKA", "text": "UNKNOWN", "short": "UNKNOWN", "empty": "UNKNOWN",
}


@pytest.fixture(scope="module")
def cleaned(spark):
    return {r.path: r for r in media.clean_media(s.sample_files(spark)).collect()}


def kinds(report):
    return [f.kind for f in report.findings]


def test_format_detection_native_and_in_path_mode(spark):
    got = s.sample_files(spark).select("path", sniff.detect_format(F.col("content")).alias("f")).collect()
    for r in got:
        assert r.f == FORMATS[r.path.split("_")[0]], r.path
        assert blocks.detect(s.samples()[r.path][:256]) == r.f


def test_rich_jpeg_findings(cleaned):
    r = cleaned["jpeg_rich"].before
    assert set(kinds(r)) == {"EXIF", "GPS", "CAMERA", "XMP", "ICC_PROFILE", "C2PA", "IPTC", "COMMENT", "UNKNOWN_BLOCK", "TRAILING_DATA", "AI_GENERATOR", "AI_SOURCE_TYPE"}
    assert r.orientation == 6 and r.parse_error is None
    assert {f.detail for f in r.findings if f.kind == "AI_GENERATOR"} == {"Midjourney", "Adobe Firefly", "OpenAI / ChatGPT", "AI-created label"}
    assert [f.detail for f in r.findings if f.kind == "AI_SOURCE_TYPE"] == ["trainedAlgorithmicMedia"]
    assert "CreatorTool: Adobe Firefly" in [f.detail for f in r.findings]


def test_rich_png_and_webp_and_gif_findings(cleaned):
    r = cleaned["png_rich"].before
    assert {"AI_PARAMETERS", "XMP", "EXIF", "C2PA", "TIMESTAMP", "ICC_PROFILE", "UNKNOWN_BLOCK", "TRAILING_DATA", "TEXT"} <= set(kinds(r))
    assert "note: packed text" in [f.detail for f in r.findings] and r.has_alpha and r.lossless and not r.animated
    r = cleaned["webp_rich"].before
    assert {"EXIF", "XMP", "C2PA", "ICC_PROFILE", "TRAILING_DATA"} <= set(kinds(r)) and r.orientation == 8 and r.has_alpha and r.lossless
    r = cleaned["gif_rich"].before
    assert {"COMMENT", "XMP", "TRAILING_DATA", "AI_GENERATOR"} <= set(kinds(r)) and not r.animated


def test_video_findings(cleaned):
    r = cleaned["mp4_rich"].before
    assert {"C2PA", "XMP", "CONTAINER_METADATA", "GPS", "UNKNOWN_BLOCK", "AI_GENERATOR"} <= set(kinds(r))
    assert {"Kling / Hailuo / AIGC label", "OpenAI / ChatGPT"} <= {f.detail for f in r.findings}
    assert kinds(cleaned["matroska"].before)[:1] == ["C2PA"] and "Runway / Luma / Pika" in {f.detail for f in cleaned["matroska"].before.findings}
    assert "C2PA" in kinds(cleaned["heic"].before) and "EXIF" in kinds(cleaned["heic"].before)


def test_malformed_is_data(cleaned):
    assert cleaned["jpeg_broken"].before.parse_error and "XMP" in kinds(cleaned["jpeg_broken"].before)
    for name in ("jpeg_broken", "png_broken", "png_critical", "gif_broken", "mp4_bad_offset", "mp4_fragmented", "mp4_nested", "heic", "tiff", "matroska", "text", "empty"):
        assert cleaned[name].status == "UNSUPPORTED" and cleaned[name].outcome.reason, name


def test_stripped_payloads_rescan_clean(cleaned):
    for name in ("jpeg_rich", "jpeg_plain", "jpeg_truncated", "png_rich", "png_plain", "webp_rich", "webp_simple", "gif_rich", "mp4_rich", "mp4_tail", "mov"):
        assert cleaned[name].status == "CLEAN", (name, cleaned[name].after)
    assert kinds(cleaned["jpeg_rich"].after) == ["ORIENTATION", "ICC_PROFILE"] and cleaned["jpeg_rich"].after.orientation == 6
    assert set(kinds(cleaned["png_rich"].after)) == {"ORIENTATION", "ICC_PROFILE"} and cleaned["png_rich"].after.orientation == 3
    assert cleaned["jpeg_truncated"].outcome.notes == ["added_end_marker"]


def test_image_data_is_untouched_and_removal_is_audited(cleaned):
    out = bytes(cleaned["jpeg_rich"].outcome.data)
    assert s.ENTROPY in out and b"Firefly" not in out and b"c2pa" not in out and out.endswith(b"\xff\xd9")
    removed = [(r.type, r.location) for r in cleaned["jpeg_rich"].outcome.removed]
    assert removed == [("EXIF", "APP1"), ("XMP", "APP1"), ("C2PA", "APP11"), ("IPTC", "APP13"), ("COMMENT", "COM"), ("UNKNOWN", "APP14 (Adobe, extra data)"), ("UNKNOWN", "APP5"), ("TRAILER", "after_eoi")]
    same = bytes(cleaned["png_plain"].outcome.data)
    assert same == s.png() and cleaned["png_plain"].outcome.removed == []
    assert bytes(cleaned["jpeg_plain"].outcome.data) == s.jpeg()


def test_options(spark):
    out = strip_bytes(s.jpeg_rich(), "JPEG", StripOptions(keep_icc=False, keep_orientation=False))
    assert b"ICC_PROFILE" not in out["data"] and b"Exif" not in out["data"]
    for fmt, data in (("JPEG", s.jpeg_rich()), ("PNG", s.png_rich()), ("WEBP", s.webp_rich())):
        out = strip_bytes(data, fmt, StripOptions(taken=("2024:05:06 07:08:09", "+04:00")))
        parsed, _, error = blocks.parse(fmt, io.BytesIO(out["data"]), len(out["data"]))
        exif = [b["exif"] for b in parsed if b["type"] == "EXIF"]
        assert error is None and exif[0]["taken"] == "2024:05:06 07:08:09" and exif[0]["minimal"]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("two", [False, True])
def test_chunk_offsets_follow_their_samples(wide, first, two):
    data = s.mp4(wide=wide, first=first, two=two, extra=(s.box(b"free", bytes(100)), s.box(b"uuid", c.C2PA_UUID, s.JUMBF)))
    buffer = io.BytesIO()
    strip_video(io.BytesIO(data), len(data), buffer.write)
    out = buffer.getvalue()
    moov = next(b for b in c.inner(out) if b.name == "moov")
    body = out[moov.start : moov.stop]
    name = b"co64" if wide else b"stco"
    at = body.index(name)
    n = int.from_bytes(body[at + 8 : at + 12], "big")
    size = 8 if wide else 4
    offsets = [int.from_bytes(body[at + 12 + i * size : at + 12 + (i + 1) * size], "big") for i in range(n)]
    assert [out[o : o + 10] for o in offsets] == [b"SAMPLE-ONE", b"SAMPLE-TWO"] * (2 if two else 1)
    assert b"spherical" in out and b"openai" not in out and b"kling" not in out


def test_deep_nesting_ends():
    data = s.nested(20_000)
    parsed, _, error = blocks.parse("MP4", io.BytesIO(data), len(data))
    assert error is None and [b["type"] for b in parsed] == ["TOO_DEEP"]
    assert strip_bytes(data, "MP4")["status"] == "unsupported"


def test_mutations_never_raise_and_strips_rescan_clean(spark):
    rng = random.Random(20260917)
    rows = []
    for name, data in s.samples().items():
        for k in range(25):
            b = bytearray(data)
            for _ in range(rng.randint(1, 6)):
                if b:
                    i = rng.randrange(len(b))
                    how = rng.randrange(3)
                    if how == 0:
                        b[i] = rng.randrange(256)
                    elif how == 1:
                        del b[i : i + rng.randint(1, 9)]
                    else:
                        b[i:i] = bytes(rng.randrange(256) for _ in range(rng.randint(1, 9)))
            rows.append((f"{name}{k}", b))
    got = media.clean_media(spark.createDataFrame(rows, "path string, content binary")).select("path", "status", "after").collect()
    assert len(got) == len(rows) > 500
    assert {r.status for r in got} <= {"CLEAN", "UNSUPPORTED"}, [(r.path, r.after) for r in got if r.status == "RESIDUAL"][:3]


def test_exif_round_trip_and_comments():
    e = read_exif(minimal_tiff(5, ("2020:01:02 03:04:05", "-03:30")))
    assert e.orientation == 5 and e.fields["taken"] == "2020:01:02 03:04:05" and e.minimal
    assert read_exif(b"garbage") == read_exif(b"") and read_exif(b"MM\0*\0\0\0\x08\xff\xff").entries == 0
    assert read_exif(b"Exif\0\0" + s.tiff()).fields == {"make": "ACME", "software": "midjourney v6"}


def test_string_extraction():
    assert blocks.strings(b"\0short\0longer run\0") == "longer run\nonger run\n"
    assert blocks.strings("é".encode() * 3 + b"\xff") == "ééé\n"
    assert blocks.strings(b"h\0e\0l\0l\0o\0!\0") == "hello!\n"
    assert blocks.loose(b"caf\xe9\0\0") == "café" and blocks.has_jumbf(b"xjumbxc2pa") and not blocks.has_jumbf(b"c2pa jumb")


def test_null_payloads_and_gate(spark):
    df = spark.createDataFrame([("a", None), ("b", bytearray(s.png())), ("c", bytearray(b"tiny"))], "path string, content binary")
    done = media.clean_media(df)
    ok, rest = media.publish_gate(done)
    assert [r.path for r in ok.collect()] == ["b"] and sorted(r.path for r in rest.collect()) == ["a", "c"]
    assert {r.path: r.before for r in done.collect()}["a"] is None
    assert media.clean_media(df.limit(0)).count() == 0


def test_dedup_details_and_severity(spark, cleaned):
    rows = findings.explode_findings(findings.scan(s.sample_files(spark)), ["path"])
    assert rows.where("severity is null").count() == 0 and rows.where("length(detail) > 140").count() == 0
    assert rows.groupBy("path", "kind", "location", "detail").count().where("count > 1").count() == 0
    assert rows.where("kind = 'AI_GENERATOR'").groupBy("path", "detail").count().where("count > 1").count() == 0
    assert findings.finding_kinds(spark).count() == 21 and sniff.formats(spark).count() == 13


def test_path_mode_equals_cell_mode(spark, tmp_path):
    for name, data in s.samples().items():
        (tmp_path / name).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    by_cell = {r.path: r.report for r in findings.scan(files).select("path", "report").collect()}
    by_path = blocks.parse_files(files).select("path", findings.report_of(F.col("format"), F.col("parsed")).alias("report")).collect()
    assert {r.path: r.report for r in by_path} == by_cell


def test_columns_of_a_caller_stay(spark):
    from scrubline.operators import findings
    from scrubline.plans import media, samples

    df = samples.sample_files(spark).where("path IN ('jpeg_rich', 'gif_rich')").selectExpr("path", "content", "'mine' AS format", "1 AS _format", "2 AS _parsed", "3 AS _data", "4 AS _payload", "'s' AS status")
    got = media.clean_media(df)
    assert got.columns == ["path", "content", "_format", "_parsed", "_data", "_payload", "format", "before", "outcome", "after", "status"]
    rows = {r.path: r for r in got.collect()}
    assert rows["jpeg_rich"].format == "JPEG" and rows["gif_rich"].status == "CLEAN" and (rows["gif_rich"]._format, rows["gif_rich"]._parsed, rows["gif_rich"]._data, rows["gif_rich"]._payload) == (1, 2, 3, 4)
    assert findings.scan(df).select("format", "_format", "_parsed").distinct().collect() == [("mine", 1, 2)]


def test_findings_are_kept_once_in_order(spark):
    import random

    from pyspark.sql import functions as F
    from scrubline.operators import findings

    rng = random.Random(2)
    rows, expected = [], {}
    for file in range(20):
        seen, found = set(), []
        for seq in range(rng.choice([0, 1, 5, 60])):
            kind, place, detail = rng.choice(["C2PA", "AI_GENERATOR", "TEXT"]), rng.choice("xyz"), rng.choice(["p", "q", None])
            found.append((kind, place, detail))
            rows.append((file, seq, kind, place, detail))
            value = (kind, "" if kind == "AI_GENERATOR" else place, detail)
            if value not in seen:
                seen.add(value)
                expected.setdefault(file, []).append((seq, kind, place, detail))
    df = spark.createDataFrame(rows, "file int, seq int, kind string, location string, detail string")
    flat = sorted((r.file, r.seq, r.kind, r.location, r.detail) for r in findings.once_a_file(df, ["file"]).collect())
    assert flat == sorted((f, *v) for f, vs in expected.items() for v in vs)
    lists = df.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "location", "detail"))).alias("found"))
    got = lists.select("file", findings.once(F.transform("found", lambda x: F.struct(x["kind"], x["location"], x["detail"]))).alias("found"))
    assert {r.file: [tuple(x) for x in r.found] for r in got.collect()} == {f: [v[1:] for v in vs] for f, vs in expected.items()}


def test_formats_are_told_alike_in_both_modes(spark):
    import random

    from pyspark.sql import functions as F
    from scrubline.functions import sniff
    from scrubline.operators import blocks
    from scrubline.plans import samples

    rng = random.Random(8)
    heads = [v[:300] for v in samples.samples().values()]
    for v in list(heads):
        for _ in range(6):
            b = bytearray(v[: rng.randint(0, 60)])
            for _ in range(rng.randint(0, 2)):
                if b:
                    b[rng.randrange(min(len(b), 24))] = rng.choice(b"ftypavifheicmif1MRIFWEBPGBM8\0\xff")
            heads.append(bytes(b))
    got = spark.createDataFrame([(bytearray(b),) for b in heads], "b binary").select("b", sniff.detect_format(F.col("b")).alias("f")).collect()
    assert [r.f for r in got] == [blocks.detect(bytes(r.b)[: sniff.HEAD_BYTES]) for r in got]
