"""Findings: what blocks say, natively.

All vocabularies are literals in Catalyst expressions. A file's findings are deduplicated inside its row, so a scan is
one pass without shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scrubline.functions import sniff
from scrubline.functions.let import let, present
from scrubline.functions.names import fresh, others
from scrubline.operators.blocks import STRONG_TOKENS, parse_content

# -- fixed values: vocabularies that results depend on --------------------------------------------------------------------

#: kind, severity; severities rank AI, PRIVACY, INFO.
KINDS = (
    ("C2PA", "AI"), ("AI_SOURCE_TYPE", "AI"), ("AI_GENERATOR", "AI"), ("AI_PARAMETERS", "AI"), ("GPS", "PRIVACY"), ("CAMERA", "PRIVACY"), ("EXIF", "PRIVACY"),
    ("XMP", "PRIVACY"), ("IPTC", "PRIVACY"), ("THUMBNAIL", "PRIVACY"), ("COMMENT", "PRIVACY"), ("TEXT", "PRIVACY"), ("CONTAINER_METADATA", "PRIVACY"),
    ("TRAILING_DATA", "PRIVACY"), ("UNKNOWN_BLOCK", "PRIVACY"), ("EXTRA_IMAGE", "INFO"), ("METADATA_TRACK", "INFO"), ("ICC_PROFILE", "INFO"),
    ("ORIENTATION", "INFO"), ("CAPTURE_DATE", "INFO"), ("TIMESTAMP", "INFO"),
)
SEVERITIES = ("AI", "PRIVACY", "INFO")
MAY_REMAIN = ("ICC_PROFILE", "ORIENTATION", "CAPTURE_DATE", "METADATA_TRACK")
SOURCE_TYPES = ("compositeWithTrainedAlgorithmicMedia", "trainedAlgorithmicMedia", "algorithmicallyEnhanced", "compositeSynthetic", "algorithmicMedia", "dataDrivenMedia")
GENERATORS = (
    ("OpenAI / ChatGPT", "\\bopenai\\b|chatgpt|dall[-·.\\s]?e|gpt-image|gpt-4o|\\bsora\\b"),
    ("Google Gemini / Imagen", "\\bgemini\\b|google imagen|\\bimagen[\\s-]?[234]\\b|nano[\\s_-]?banana|google ai|synthid|google veo|\\bveo[\\s-]?[23]\\b|google deepmind|made with google"),
    ("Google Photos (AI)", "magic editor|magic eraser|edited with google ai"),
    ("Adobe Firefly", "firefly|generative fill|generative expand|adobe gen"),
    ("Microsoft Designer / Copilot", "bing image creator|microsoft designer|\\bcopilot\\b|azure openai"),
    ("Midjourney", "midjourney"),
    ("Stable Diffusion", "stable[\\s_-]?diffusion|stability\\.?ai|\\bsdxl\\b|automatic1111|negative prompt:|sampler:\\s|cfg scale:"),
    ("ComfyUI", "comfyui|\"class_type\"|ksampler"),
    ("InvokeAI / Fooocus / NovelAI", "invokeai|sd-metadata|fooocus|novelai|\\bnai diffusion\\b"),
    ("Flux / Black Forest Labs", "black forest labs|\\bflux\\.?1\\b|flux[\\s._-]?(?:pro|dev|schnell|kontext)"),
    ("Meta AI", "meta ai|imagine with meta|\\bemu edit\\b"),
    ("xAI Grok", "\\bgrok\\b|\\bx\\.ai\\b|grok imagine|grok-\\d"),
    ("Leonardo / Ideogram / Recraft", "leonardo\\.?ai|ideogram|recraft"),
    ("Runway / Luma / Pika", "runwayml|\\brunway\\b|luma ai|dream machine|pika labs|\\bpika\\b"),
    ("Kling / Hailuo / AIGC label", "\\bkling\\b|kuaishou|hailuo|minimax|jimeng|doubao|seedream|seedance|bytedance|tongyi|wanx|qwen|hunyuan|\\baigc\\b|contentproducer|contentpropagator|produceid"),
    ("Apple Image Playground", "image playground|apple intelligence|genmoji"),
    ("Samsung Galaxy AI", "galaxy ai|generative edit|sketch to image"),
    ("Other AI editors", "canva ai|magic media|krea\\.ai|playground ai|freepik ai|picsart ai|lensa ai|remini|faceapp|topaz (?:photo|gigapixel|labs)|luminar neo|photoroom"),
    ("AI-created label", "\\bai[\\s-]generated\\b|generated (?:by|with) ai\\b|made with ai\\b|created with ai\\b"),
)
PARAMETER_KEYS = (
    "parameters", "prompt", "workflow", "dream", "sd-metadata", "invokeai_metadata", "invokeai_graph", "generation_data", "negative_prompt", "aigc",
    "fooocus_scheme", "ai_metadata",
)
PARAMETER_TEXT = "(?i)(negative prompt:|steps:\\s*\\d+.*sampler:|\"class_type\"|\"sampler_name\"|\\baigc\\b)"
CREATOR_TOOL = "CreatorTool(?:=\"([^\"]*)\"|>([^<]*)<)"
PROVENANCE = "dcterms:provenance(?:=\"|>)([^\"<]*)"
XMP_GPS = "exif:GPS(?:Latitude|Longitude)"
QUICKTIME_GPS = "[\\x{A9}\\x{FFFD}]xyz|com\\.apple\\.quicktime\\.location\\.ISO6709|[+-]\\d{1,2}\\.\\d+[+-]\\d{1,3}\\.\\d+"


def finding_kinds(spark: SparkSession) -> DataFrame:
    """The dimension of finding kinds (21 rows)."""
    rows = [(k, s, SEVERITIES.index(s), k in MAY_REMAIN) for k, s in KINDS]
    return spark.createDataFrame(rows, "kind string, severity string, severity_rank int, may_remain boolean")


def severity(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS for x in kv]), kind)


#: Literals of which each generator's matches hold one, in lower case; a cheap search for them comes before the pattern.
GENERATOR_NEEDS = (
    ("openai", "chatgpt", "dall", "gpt-image", "gpt-4o", "sora"), ("gemini", "imagen", "nano", "google", "synthid", "veo"), ("magic", "google ai"), ("firefly", "generative", "adobe gen"),
    ("bing image", "microsoft designer", "copilot", "azure openai"), ("midjourney",), ("stable", "stability", "sdxl", "automatic1111", "negative prompt:", "sampler:", "cfg scale:"),
    ("comfyui", "class_type", "ksampler"), ("invokeai", "sd-metadata", "fooocus", "novelai", "nai diffusion"), ("black forest", "flux"), ("meta ai", "imagine with", "emu edit"), ("grok", "x.ai"),
    ("leonardo", "ideogram", "recraft"), ("runway", "luma ai", "dream machine", "pika"),
    ("kling", "kuaishou", "hailuo", "minimax", "jimeng", "doubao", "seedream", "seedance", "bytedance", "tongyi", "wanx", "qwen", "hunyuan", "aigc", "contentpro", "produceid"),
    ("image playground", "apple intelligence", "genmoji"), ("galaxy ai", "generative edit", "sketch to image"),
    ("canva ai", "magic media", "krea.ai", "playground ai", "freepik ai", "picsart ai", "lensa ai", "remini", "faceapp", "topaz", "luminar neo", "photoroom"),
    ("ai-generated", "ai generated", "ai\ngenerated", "ai\tgenerated", "ai\rgenerated", "ai\x0bgenerated", "ai\x0cgenerated", "by ai", "with ai"),
)


def _folded(text: Column) -> Column:
    """Lower case, with the one letter whose lower case isn't what patterns compare it with."""
    return F.translate(F.lower(text), "\u017f", "s")


def source_types(text: Column) -> Column:
    """IPTC terms for synthetic media, not preceded by a letter."""
    named = lambda low: F.array(*[F.when(low.contains(t.lower()) & text.rlike(f"(?iu)(?<![A-Za-z]){t}"), F.lit(t)) for t in SOURCE_TYPES])
    return let(_folded(text), lambda low: F.filter(named(low), lambda x: x.isNotNull()))


def generators(text: Column) -> Column:
    """Names of generators, in the vocabulary's order."""
    named = lambda low: F.array(*[F.when(present(low, needs) & text.rlike(f"(?iu)(?:{p})"), F.lit(n)) for (n, p), needs in zip(GENERATORS, GENERATOR_NEEDS, strict=True)])
    return let(_folded(text), lambda low: F.filter(named(low), lambda x: x.isNotNull()))


def is_parameters(key: Column, text: Column) -> Column:
    return F.lower(key).isin(*PARAMETER_KEYS) | text.rlike(PARAMETER_TEXT)


def creator_tool(xmp: Column) -> Column:
    found = F.concat(F.regexp_extract(xmp, CREATOR_TOOL, 1), F.regexp_extract(xmp, CREATOR_TOOL, 2))
    return F.when(xmp.rlike(CREATOR_TOOL), found)


def shorten(detail: Column) -> Column:
    one = F.trim(F.regexp_replace(detail, "\\s+", " "))
    return F.when(F.length(one) > 140, F.concat(F.substring(one, 1, 137), F.lit("…"))).otherwise(one)


def container_summary(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 2)
    return F.array_join(F.slice(lines, 1, 4), " · ")


def _of(kind: str, detail: Column | str | None = None) -> Column:
    d = F.lit(None).cast("string") if detail is None else F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(kind).alias("kind"), shorten(d).alias("detail"))


def _list(*entries: Column) -> Column:
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def _exif(b: Column) -> Column:
    e = b["exif"]
    minimal = _list(
        F.when(e["orientation"].between(2, 8), _of("ORIENTATION", F.concat(F.lit("orientation "), e["orientation"].cast("string")))),
        F.when(e["taken"].isNotNull(), _of("CAPTURE_DATE", e["taken"])),
    )
    full = _list(
        _of("EXIF", F.concat(e["entries"].cast("string"), F.lit(" tags"), F.coalesce(F.concat(F.lit(", Software: "), e["software"]), F.lit("")))),
        F.when(e["gps"], _of("GPS", "capture position")),
        F.when(e["make"].isNotNull() | e["model"].isNotNull(), _of("CAMERA", F.concat_ws(" ", e["make"], e["model"]))),
        F.when(e["thumbnail"], _of("THUMBNAIL", "thumbnail in EXIF")),
        F.when(e["taken"].isNotNull(), _of("TIMESTAMP", e["taken"])),
    )
    return F.when(e["minimal"], minimal).otherwise(full)


def block_findings(b: Column) -> Column:
    """array<struct<kind, detail>> of one block, its own facts first."""
    kind, text = b["type"], F.coalesce(b["text"], F.lit(""))
    kib = F.concat((F.floor(b["bytes"] / 1024) + 1).cast("string"), F.lit(" KiB"))
    size = F.concat(b["bytes"].cast("string"), F.lit(" bytes"))
    key = F.coalesce(b["key"], F.lit(""))
    keyed = F.when(key != "", F.concat(key, F.lit(": "), text)).otherwise(text)
    names_c2pa = key.isin(*[t for t in STRONG_TOKENS if "c2pa" in t or t.startswith("Content") or t == "contentauth"])
    own = (
        F.when(kind == "C2PA", _list(_of("C2PA", F.concat(F.lit("Content Credentials ("), kib, F.lit(")")))))
        .when(kind == "EXIF", _exif(b))
        .when(
            kind == "XMP",
            _list(
                _of("XMP", F.concat(F.lit("CreatorTool: "), creator_tool(text))),
                F.when(text.rlike(XMP_GPS), _of("GPS", "XMP")),
                F.when(text.rlike(PROVENANCE), _of("C2PA", F.concat(F.lit("remote manifest: "), F.regexp_extract(text, PROVENANCE, 1)))),
            ),
        )
        .when(kind == "IPTC", _list(_of("IPTC")))
        .when(kind == "ICC", _list(_of("ICC_PROFILE")))
        .when(kind == "COMMENT", _list(_of("COMMENT", text)))
        .when(kind == "TEXT", _list(F.when(is_parameters(key, text), _of("AI_PARAMETERS", keyed)).otherwise(_of("TEXT", keyed))))
        .when(kind == "EXTRA_IMAGE", _list(_of("EXTRA_IMAGE", kib)))
        .when(kind == "THUMBNAIL", _list(_of("THUMBNAIL")))
        .when(kind == "TRAILER", _list(_of("TRAILING_DATA", F.concat(size, F.lit(" after the end of the image")))))
        .when(kind == "CONTAINER_META", _list(_of("CONTAINER_METADATA", container_summary(text)), F.when(text.rlike(QUICKTIME_GPS), _of("GPS"))))
        .when(kind == "TIMESTAMP", _list(_of("TIMESTAMP")))
        .when(kind == "UNKNOWN", _list(_of("UNKNOWN_BLOCK", size)))
        .when(kind == "TOKEN", _list(F.when(names_c2pa, _of("C2PA", key))))
        .when(kind == "C2PA_ITEM", _list(_of("C2PA", "JUMBF item")))
        .when(kind == "METADATA_TRACK", _list(_of("METADATA_TRACK", "metadata track")))
        .when(kind == "TOO_DEEP", _list(_of("UNKNOWN_BLOCK", "nested too deeply")))
        .otherwise(F.array().cast("array<struct<kind:string,detail:string>>"))
    )
    searched = ~kind.eqNullSafe("EXIF") | ~F.coalesce(b["exif"]["minimal"], F.lit(False))
    after = _list(
        F.when((kind == "TEXT") & text.rlike(XMP_GPS), _of("GPS")),
        F.when(kind.isin("TRAILER", "UNKNOWN") & b["jumbf"], _of("C2PA", F.when(kind == "TRAILER", "JUMBF in trailing data").otherwise("JUMBF"))),
    )
    named = F.when(
        searched & (text != ""),
        F.concat(
            F.transform(source_types(text), lambda d: F.struct(F.lit("AI_SOURCE_TYPE").alias("kind"), d.alias("detail"))),
            F.transform(generators(text), lambda d: F.struct(F.lit("AI_GENERATOR").alias("kind"), d.alias("detail"))),
        ),
    ).otherwise(F.array().cast("array<struct<kind:string,detail:string>>"))
    return F.concat(own, named, after)


def file_findings(blocks: Column) -> Column:
    """array<struct<kind, location, detail>>: vocabulary hits once a file by name, others once by value, first ones stay."""
    every = F.flatten(
        F.transform(blocks, lambda b: F.transform(block_findings(b), lambda x: F.struct(x["kind"].alias("kind"), b["location"].alias("location"), x["detail"].alias("detail"))))
    )
    return once(every)


def _value(kind: Column, location: Column, detail: Column) -> list[Column]:
    """What makes findings the same: vocabulary hits are by name, wherever they stand."""
    return [kind.alias("kind"), F.when(kind.isin("AI_SOURCE_TYPE", "AI_GENERATOR"), F.lit("")).otherwise(location).alias("place"), F.coalesce(detail, F.lit("\0")).alias("detail")]


def once(found: Column) -> Column:
    """The first of equal findings of one file, in order. Sorting twice keeps it from growing with the square of them."""
    named = F.transform(found, lambda x, i: F.struct(F.struct(*_value(x["kind"], x["location"], x["detail"])).alias("value"), i.alias("i"), x.alias("x")))
    first = lambda s: F.filter(s, lambda e, j: (j == 0) | ~e["value"].eqNullSafe(F.try_element_at(s, F.greatest(j, F.lit(1)))["value"]))
    return let(F.array_sort(named), lambda s: F.transform(F.array_sort(F.transform(first(s), lambda e: F.struct(e["i"], e["x"]))), lambda e: e["x"]))


def once_a_file(found: DataFrame, keys: list[str]) -> DataFrame:
    """The same over a table (keys, seq, kind, location, detail): no file's findings are gathered in one row."""
    kind, place, detail = fresh(found, "kind", "place", "detail")
    values = [c.alias(n) for c, n in zip(_value(F.col("kind"), F.col("location"), F.col("detail")), (kind, place, detail), strict=True)]
    rest = F.struct("seq", *[F.col(f"`{c}`") for c in found.columns if c not in keys and c != "seq"])
    first = found.select(*keys, *values, rest.alias(place + "rest")).groupBy(*keys, kind, place, detail).agg(F.min(place + "rest").alias("first"))
    return first.select(*keys, "first.*").select(found.columns)


def report_columns(report: Column) -> dict[str, Column]:
    """Facts derived from a report's findings."""
    found = report["findings"]
    any_of = lambda *kinds: F.exists(found, lambda x: x["kind"].isin(*kinds))
    return {
        "has_ai": any_of(*[k for k, s in KINDS if s == "AI"]),
        "has_gps": any_of("GPS"),
        "generators": F.array_distinct(F.transform(F.filter(found, lambda x: (x["kind"] == "AI_GENERATOR") & x["detail"].isNotNull()), lambda x: x["detail"])),
        "is_clean": F.forall(found, lambda x: x["kind"].isin(*MAY_REMAIN)),
        "is_clean_without_icc": F.forall(found, lambda x: x["kind"].isin(*[k for k in MAY_REMAIN if k != "ICC_PROFILE"])),
    }


def report_of(fmt: Column, parsed: Column) -> Column:
    """struct<format, findings, orientation, animated, has_alpha, lossless, parse_error> of parsed blocks."""
    turned = F.filter(parsed["blocks"], lambda b: b["exif"]["orientation"].between(2, 8))
    report = F.struct(
        fmt.alias("format"),
        file_findings(parsed["blocks"]).alias("findings"),
        F.coalesce(F.try_element_at(turned, F.lit(-1))["exif"]["orientation"], F.lit(1)).alias("orientation"),
        *[parsed[k].alias(k) for k in ("animated", "has_alpha", "lossless", "parse_error")],
    )
    return F.when(parsed.isNotNull(), report)


def scan(df: DataFrame, content: str = "content", into: str = "report") -> DataFrame:
    """Adds a report to each payload; a null payload has a null report. A column called like ``into`` is replaced."""
    fmt, parsed = fresh(df, "format", "parsed")
    work = df.withColumn(fmt, sniff.detect_format(F.col(content)))
    work = work.withColumn(parsed, parse_content(F.col(content), F.col(fmt)))
    return work.select(*others(df, into), report_of(F.col(fmt), F.col(parsed)).alias(into))


def explode_findings(reports: DataFrame, keys: list[str], report: str = "report") -> DataFrame:
    """keys, seq, kind, severity, location, detail: one row a finding."""
    rows = reports.select(*keys, F.posexplode(f"{report}.findings").alias("seq", "f"))
    return rows.select(*keys, "seq", "f.kind", severity(F.col("f.kind")).alias("severity"), "f.location", "f.detail")
