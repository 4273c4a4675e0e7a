from scrubline.operators.blocks import detect
from scrubline.operators import verify
from scrubline.operators.strip import StripOptions, strip_bytes
from scrubline.plans import samples

from .verifier import marker_hits, structure

KEEP = {
    "JPEG": ("db", "c0", "e0:JFIF", "e1:Exif", "e2:ICC_", "ee:Adob", "da"), "PNG": ("IHDR", "IDAT", "IEND", "eXIf", "iCCP"), "WEBP": ("VP8X", "VP8 ", "VP8L", "ICCP", "EXIF"),
    "MP4": ("ftyp", "moov", "mdat"), "MOV": ("ftyp", "moov", "mdat"), "GIF": (),
}


def test_stripped_payloads_pass_an_independent_check():
    n = 0
    for name, data in samples.samples().items():
        fmt = detect(data[:256])
        out = strip_bytes(data, fmt)
        if out["status"] == "stripped":
            n += 1
            assert not marker_hits(out["data"]), name
            assert all(p.startswith(KEEP[fmt]) for p in structure(fmt, out["data"])), name
    assert n >= 11
    assert {b"c2pa", b"jumb", b"midjourney", b"Firefly"} <= set(marker_hits(samples.jpeg_rich()))


def test_the_operator_tells_stripped_payloads_from_others(spark):
    n = 0
    for name, data in samples.samples().items():
        fmt = detect(data[:256])
        out = strip_bytes(data, fmt, StripOptions(keep_icc=False))
        if out["status"] == "stripped":
            n += 1
            r = verify.check(out["data"], fmt)
            assert r["passed"], (name, r)
            if name.endswith("_rich"):
                assert not verify.check(data, fmt)["passed"] and verify.check(data, fmt)["markers"], name
    assert n >= 11
    df = spark.createDataFrame([(bytearray(samples.png_rich()), 1, "x"), (None, 2, "y")], "content binary, _format int, verdict string")
    got = verify.verify(df).collect()
    assert [(r._format, r.verdict and r.verdict.passed) for r in got] == [(1, False), (2, None)]
    assert "trainedAlgorithmicMedia" in {m.marker for m in got[0].verdict.markers}


def test_short_markers_need_a_reason():
    noise = bytes(range(128, 256))
    real = lambda data: {m["marker"]: m["real"] for m in verify.marker_hits(data)}
    assert real(noise + b"c2pa" + noise) == {"c2pa": 0}
    assert real(noise + b"c2pa\0\x11\0\x10" + noise) == {"c2pa": 1}
    assert real(noise + b"has aigc inside" + noise) == {"AIGC": 1}
    assert real(noise + b"\0\0\0\x30jumb\xff\xff\xff\xffjumd" + noise)["jumb"] == 1
    assert real(noise * 600 + b"jumb" + noise) == {"jumb": 0}
    assert not verify.check(samples.png_rich()[:-30], "PNG")["passed"] and verify.check(b"x" * 50, "UNKNOWN")["error"]
