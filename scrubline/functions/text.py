"""Native text rules: newlines, chatbot artifacts, typography, context-free hidden characters, white space.

All of it is java.util.regex inside Catalyst. Patterns are literals, so each is compiled once a task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, functions as F

from scrubline.functions.let import Rule, let, rewrite

# -- fixed values: vocabularies and patterns that results depend on -----------------------------------------------------

ISSUES = (
    "INVISIBLE", "BIDI", "TAG_CHARS", "VARIATION_SELECTORS", "SPECIAL_SPACES", "CONTROL", "PRIVATE_USE",
    "AI_CITATIONS", "TRACKING", "CITATION_NUMBERS", "MARKDOWN", "DASHES", "QUOTES", "ELLIPSIS", "FANCY_LETTERS", "WHITESPACE",
)
HIDDEN_ISSUES = ISSUES[:7]

TURN_KINDS = "search|news|view|fetch|file|image|product|forecast|finance|sports|time|calc|academia|reddit|youtube|video|map|place"
TURN_PREFIXES = "cite|filecite|navlist|image_group|entity|product_entity|genui|video_group|forecast|finance|sports|schedule"
CITATIONS = (
    "[ \\t]*\\x{E200}[^\\x{E201}\\n]{0,400}\\x{E201}",
    f"[ \\t]*(?:{TURN_PREFIXES})?(?:turn\\d+(?:{TURN_KINDS})\\d+(?:L\\d+-L\\d+)?)+",
    "[ \\t]*\\x{3010}\\d+(?::\\d+)?\\x{2020}[^\\x{3011}\\n]{0,200}\\x{3011}",
    "\\[\\^\\d{1,3}\\^\\]",
)
CITATION_NUMBERS = "(?<=\\S)(?:\\[(?:\\d{1,3}|(?:web|x_post|post|source|news|cite|ref):\\s?\\d{1,3})\\])+"
REFERRERS = (
    "chatgpt\\.com|chat\\.openai\\.com|openai(?:\\.com)?|perplexity(?:\\.ai)?|copilot\\.com|copilot|bing\\.com/chat|chat\\.deepseek\\.com|deepseek|"
    "gemini(?:\\.google\\.com)?|bard|claude(?:\\.ai)?|anthropic|grok(?:\\.com)?|x\\.ai|you\\.com|phind(?:\\.com)?|mistral(?:\\.ai)?|chat\\.mistral\\.ai|"
    "meta\\.ai|poe(?:\\.com)?|kimi(?:\\.ai)?|chat\\.qwen\\.ai|qwen"
)
TRACKED = f"(?:utm_source=(?:{REFERRERS})(?:%2F|/)?|form=MG0AV3|ref=(?:chatgpt|perplexity|copilot|gemini|claude))"
#: A tracked parameter before another one keeps its lead; the unmatched group of the second form appends nothing.
TRACKING = f"(?iu)([?&]){TRACKED}&|[?&]{TRACKED}(?=[#\\s)\\]>\"'.,;!]|$)"

SPECIAL_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
LINE_SEPARATORS = "\u2028\u2029"
DASHES = "\u2010\u2011\u2012\u2013\u2212\ufe58\ufe63\uff0d"
LONG_DASHES = "\u2014\u2015\u2e3a\u2e3b"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f\u2033\u301d\u301e\uff02"
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b\u2032\uff07"
ELLIPSIS = "\u2026"

CONTROL = "[\\p{Cc}&&[^\\n\\t]]"
EMBEDDINGS = "[\\x{202A}-\\x{202E}]"
ALWAYS_INVISIBLE = (
    "[\\x{AD}\\x{34F}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180E}\\x{200B}\\x{2060}-\\x{2065}\\x{206A}-\\x{206F}\\x{3164}\\x{FEFF}\\x{FFA0}"
    "\\x{FFF0}-\\x{FFFC}\\x{1D173}-\\x{1D17A}]"
)
RESERVED_IGNORABLE = "[\\x{E0000}\\x{E0002}-\\x{E001F}\\x{E0080}-\\x{E00FF}\\x{E01F0}-\\x{E0FFF}]"
NONCHARACTERS = "[\\x{FDD0}-\\x{FDEF}" + "".join(f"\\x{{{p:X}FFFE}}\\x{{{p:X}FFFF}}" for p in range(1, 17)) + "\\x{FFFE}\\x{FFFF}]"
PRIVATE_USE = "\\p{Co}"
#: Whether a text can hold a removable or replaceable hidden character (also true for some that stay).
HAZARD = (
    "[\\x{0}-\\x{8}\\x{B}-\\x{1F}\\x{7F}-\\x{A0}\\x{AD}\\x{34F}\\x{115F}\\x{1160}\\x{1680}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{2000}-\\x{200F}"
    "\\x{2028}-\\x{202F}\\x{205F}-\\x{206F}\\x{3000}\\x{3164}\\x{FDD0}-\\x{FDEF}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FFA0}\\x{FFF0}-\\x{FFFC}"
    "\\x{E0000}-\\x{E0FFF}]|\\p{Cf}|\\p{Co}|\\p{Cn}"
)
#: Beyond printable ASCII and plain Latin letters.
UNUSUAL = "[^\\x{9}\\x{A}\\x{20}-\\x{7E}\\x{A1}-\\x{AC}\\x{AE}-\\x{2FF}]"
#: Hidden characters whose fate depends on neighbours or on the whole text.
CONTEXTUAL = (
    "[\\x{200C}-\\x{200F}\\x{61C}\\x{2066}-\\x{2069}\\x{600}-\\x{605}\\x{6DD}\\x{70F}\\x{890}\\x{891}\\x{8E2}\\x{110BD}\\x{110CD}\\x{180B}-\\x{180D}"
    "\\x{180F}\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}\\x{E0001}\\x{E0020}-\\x{E007F}\\x{13430}-\\x{1343F}\\x{1BCA0}-\\x{1BCA3}]"
)
FANCY = "[\\x{1D400}-\\x{1D7FF}\\x{FF01}-\\x{FF5E}\\x{2460}-\\x{24FF}\\x{1F130}-\\x{1F169}\\x{FB00}-\\x{FB06}]"
#: Below U+0300 every text is in composed form.
MAY_COMPOSE = "[^\\x{0}-\\x{2FF}]"

# -- options ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TextOptions:
    """What to clean; part of the plan, not of the rows."""

    remove_invisible: bool = True
    normalize_spaces: bool = True
    remove_ai_artifacts: bool = True
    remove_tracking: bool = True
    remove_citation_numbers: bool = False
    strip_markdown: bool = False
    dashes: bool = False
    quotes: bool = False
    ellipsis: bool = False
    fancy: bool = False
    trim_lines: bool = True
    collapse_blank_lines: bool = False

    @staticmethod
    def everything() -> TextOptions:
        return TextOptions(**{f.name: True for f in fields(TextOptions)})


# -- rules ------------------------------------------------------------------------------------------------------------


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def artifact_rules(o: TextOptions) -> list[Rule]:
    rules = [Rule("AI_CITATIONS", p, "", (needed,)) for p, needed in zip(CITATIONS, ("\ue200", "turn", "\u3010", "[^"), strict=True)] if o.remove_ai_artifacts else []
    rules += [Rule("TRACKING", TRACKING, "$1", ("?", "&"))] if o.remove_tracking else []
    return rules + ([Rule("CITATION_NUMBERS", CITATION_NUMBERS, "", ("[",))] if o.remove_citation_numbers else [])


def typography_rules(o: TextOptions) -> list[Rule]:
    """Exact wherever no hidden character or fancy letter stands beside a long dash."""
    rules = []
    if o.dashes:
        long = _class(LONG_DASHES)
        rules += [
            Rule("DASHES", _class(DASHES), "-", tuple(DASHES)),
            Rule("DASHES", f"{long}(?<=[\\p{{L}}\\p{{Nd}}]{long})(?=[\\p{{L}}\\p{{Nd}}])", " - ", tuple(LONG_DASHES)),
            Rule("DASHES", long, "-", tuple(LONG_DASHES)),
        ]
    if o.quotes:
        rules += [Rule("QUOTES", _class(DOUBLE_QUOTES), '"', tuple(DOUBLE_QUOTES)), Rule("QUOTES", _class(SINGLE_QUOTES), "'", tuple(SINGLE_QUOTES))]
    return rules + ([Rule("ELLIPSIS", ELLIPSIS, "...", (ELLIPSIS,))] if o.ellipsis else [])


def beyond_latin(pattern: str) -> str:
    """The pattern, tried only where an unusual character stands: a class of few ranges settles all others."""
    return f"(?={UNUSUAL})(?:{pattern})"


def has_hazard(text: Column) -> Column:
    """Whether a text can hold a hidden character."""
    return text.rlike(beyond_latin(HAZARD))


#: Hidden characters that go whatever stands around them; the rest of the format characters needs its context.
CONTEXT_FREE = {
    "CONTROL": CONTROL,
    "BIDI": EMBEDDINGS,
    "INVISIBLE": f"{ALWAYS_INVISIBLE}|{RESERVED_IGNORABLE}|{NONCHARACTERS}",
    "PRIVATE_USE": PRIVATE_USE,
}


def strip_context_free(text: Column) -> Column:
    """struct<text, counts>. One search collects the characters in question; the few of them are told apart by issue, and
    one translation drops or replaces them all."""
    spaces = SPECIAL_SPACES + LINE_SEPARATORS
    plain = " " * len(SPECIAL_SPACES) + "\n" * len(LINE_SEPARATORS)
    kinds = CONTEXT_FREE | {"SPECIAL_SPACES": _class(spaces)}
    found = F.regexp_extract_all(text, F.lit("(" + beyond_latin("|".join(kinds.values())) + ")"), 1)

    def of(hits: Column) -> Column:
        counts = [F.size(F.filter(hits, _matches(p))).alias(i) for i, p in kinds.items()]
        listed = F.array_join(F.array_distinct(F.filter(hits, lambda c: ~c.rlike(kinds["SPECIAL_SPACES"]))), "")
        done = F.call_function("translate", text, F.concat(F.lit(spaces), listed), F.lit(plain))
        return F.struct(F.when(F.size(hits) > 0, done).otherwise(text).alias("text"), *counts)

    return let(found, of)


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda c: c.rlike(pattern)


def apply_rules(text: Column, rules: list[Rule]) -> Column:
    """struct<text, one count per issue that occurs in rules>."""
    return rewrite(text, rules, list(dict.fromkeys(r.issue for r in rules)))


def remove_citations(text: Column) -> Column:
    return apply_rules(text, artifact_rules(TextOptions(remove_tracking=False)))


def remove_tracking(text: Column) -> Column:
    return apply_rules(text, artifact_rules(TextOptions(remove_ai_artifacts=False)))


def remove_citation_numbers(text: Column) -> Column:
    return apply_rules(text, artifact_rules(TextOptions(remove_ai_artifacts=False, remove_tracking=False, remove_citation_numbers=True)))


def whitespace(text: Column, o: TextOptions) -> Column:
    """struct<text, WHITESPACE>: blanks at line ends, outer blank space, runs of empty lines."""
    state = F.struct(text.alias("text"), F.lit(0).alias("WHITESPACE"))
    if o.trim_lines:
        # a line ends before any of Java's line terminators
        state = let(state, lambda s: rewrite(s["text"], [Rule("WHITESPACE", "(?m)[ \\t]+$", "", (" \n", "\t", " \r", " \u0085", " \u2028", " \u2029"))], ["WHITESPACE"]))
        state = let(
            state,
            lambda s: let(
                F.trim(s["text"], F.lit("\n \t")),
                lambda t: F.struct(t.alias("text"), (s["WHITESPACE"] + F.when(t == s["text"], 0).otherwise(1)).alias("WHITESPACE")),
            ),
        )
    if o.collapse_blank_lines:
        state = let(state, lambda s: F.struct(F.regexp_replace(s["text"], "\n{3,}", "\n\n").alias("text"), (s["WHITESPACE"] + F.regexp_count(s["text"], F.lit("\n{3,}"))).alias("WHITESPACE")))
    return state


def describe(code_point: Column) -> Column:
    """``U+XXXX NAME`` by the JVM's own character names."""
    name = F.coalesce(F.reflect(F.lit("java.lang.Character"), F.lit("getName"), code_point.cast("int")), F.lit("UNASSIGNED"))
    return F.concat(F.lit("U+"), F.when(code_point < 4096, F.lpad(F.hex(code_point), 4, "0")).otherwise(F.hex(code_point)), F.lit(" "), name)


def code_points(text: Column) -> Column:
    """The code points of a text as integers."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int"))
