"""Text cleaning of a DataFrame column.

Native stages do all of the work on texts without hidden characters; only texts that hold a hazard, or that may not
be in composed form, are sent to the Arrow function, the others send null. Null texts stay null.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from scrubline.functions import hidden, markdown, text as T
from scrubline.functions.names import fresh, others
from scrubline.functions.text import TextOptions


@lru_cache(maxsize=1)
def uncomposed_pattern() -> str:
    """Characters without which a text is in composed form: those that change alone, and those that join what is before."""
    odd = set()
    for cp in range(0x300, 0x110000):
        c = chr(cp)
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        parts = unicodedata.decomposition(c)
        if unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c:
            odd.add(cp)
        if parts and parts[0] != "<" and " " in parts:
            odd.add(int(parts.split()[1], 16))
    odd |= set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # Hangul vowels and finals
    ranges: list[list[int]] = []
    for cp in sorted(x for x in odd if x >= 0x300):
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def _merge(entries: list[Column]) -> Column:
    """A map of the positive counts; entries: arrays of struct<issue, n>, an issue in one of them at most."""
    return F.map_from_entries(F.filter(F.concat(*entries), lambda e: e["n"] > 0))


def _listed(state: Column, issues: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("issue"), state[i].cast("int").alias("n")) for i in issues]) if issues else F.array().cast("array<struct<issue:string,n:int>>")


def clean_text(df: DataFrame, column: str = "text", options: TextOptions = TextOptions(), into: str = "cleaned") -> DataFrame:
    """Adds ``into``: struct<text, counts map<string,int>, code_points map<int,int>, total, changed, hidden>. All columns stay,
    whatever their names; one that is called like ``into`` is replaced."""
    o = options
    a, m, p, t, w, c, h = fresh(df, *"amptwch")
    rules = T.artifact_rules(o)
    first = T.apply_rules(T.normalize_newlines(F.col(column)), rules) if rules else F.struct(T.normalize_newlines(F.col(column)).alias("text"))
    work = df.withColumn(a, first)
    work = work.withColumn(m, markdown.strip_markdown(F.col(f"{a}.text")) if o.strip_markdown else F.struct(F.col(f"{a}.text").alias("text"), F.lit(0).alias("MARKDOWN")))
    typed = T.typography_rules(o)
    issues = list(dict.fromkeys(r.issue for r in typed))
    plain = F.col(f"{m}.text")
    hazard = plain.rlike(T.beyond_latin("|".join([T.HAZARD, uncomposed_pattern(), *([T.FANCY] if o.fancy else [])])))
    work = work.withColumn(p, hidden.character_pass(o)(F.when(hazard, plain)))
    native = T.apply_rules(plain, typed) if typed else F.struct(plain.alias("text"))
    work = work.withColumn(t, F.when(F.col(p).isNull(), native))
    work = work.withColumn(w, T.whitespace(F.coalesce(F.col(f"{p}.text"), F.col(f"{t}.text")), o))
    none = F.array().cast("array<struct<issue:string,n:int>>")
    counts = _merge(
        [
            _listed(F.col(a), list(dict.fromkeys(r.issue for r in rules))),
            _listed(F.col(m), ["MARKDOWN"]),
            F.coalesce(F.col(f"{p}.counts"), none),
            F.when(F.col(p).isNull(), _listed(F.col(t), issues)).otherwise(none),
            _listed(F.col(w), ["WHITESPACE"]),
        ]
    )
    points = F.coalesce(F.map_from_entries(F.transform(f"{p}.points", lambda e: F.struct(e["cp"], e["n"]))), F.map_from_entries(F.array().cast("array<struct<cp:int,n:int>>")))
    work = work.withColumn(c, counts).withColumn(h, points)
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda a, x: a + x)
    result = F.struct(
        F.col(f"{w}.text").alias("text"),
        F.col(c).alias("counts"),
        F.col(h).alias("code_points"),
        total(F.col(c)).alias("total"),
        (total(F.col(c)) > 0).alias("changed"),
        total(F.map_filter(c, lambda k, v: k.isin(*T.HIDDEN_ISSUES))).alias("hidden"),
    )
    return work.select(*others(df, into), F.when(F.col(column).isNotNull(), result).alias(into))


def summary(cleaned: Column) -> Column:
    """One line: ``INVISIBLE: 3, WHITESPACE: 1`` by name, or ``clean``."""
    parts = F.transform(F.array_sort(F.map_entries(cleaned["counts"])), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(F.lit("clean"))


#: Short names of hidden characters in previews. Fixed values.
SHORT_NAMES = {
    0x200B: "ZWSP", 0x200C: "ZWNJ", 0x200D: "ZWJ", 0x2060: "WJ", 0xFEFF: "BOM", 0xAD: "SHY", 0xA0: "NBSP", 0x202F: "NNBSP", 0x200E: "LRM", 0x200F: "RLM",
}


def highlight(df: DataFrame, column: str = "text", into: str = "preview", limit: int = 6000) -> DataFrame:
    """Adds a preview: the first ``limit`` characters with hidden ones shown as ``⟨NAME⟩``."""
    head, spans = fresh(df, "head", "spans")
    names = F.create_map(*[F.lit(x) for kv in SHORT_NAMES.items() for x in kv])
    shown = lambda h: F.concat(F.lit("⟨"), F.coalesce(F.try_element_at(names, h["code_point"]), F.concat(F.lit("U+"), F.lpad(F.hex(h["code_point"]), 4, "0"))), F.lit("⟩"))
    made = F.aggregate(
        F.col(spans),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, h: F.struct(F.concat(s["out"], F.substring(F.col(head), s["at"], h["cp_start"] + 1 - s["at"]), shown(h)).alias("out"), (h["cp_start"] + 2).alias("at")),
        lambda s: F.concat(s["out"], F.substring(F.col(head), s["at"], F.lit(limit))),
    )
    cut = F.substring(F.col(column), 1, limit)
    return df.withColumn(head, cut).withColumn(spans, hidden.find_hidden(F.col(head))).select(*others(df, into), made.alias(into))
