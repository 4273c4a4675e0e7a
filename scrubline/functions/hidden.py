"""The character pass: hidden characters whose fate depends on their neighbours.

Only texts that hold a hazard come here (the plan sends null for all others). A scanner jumps from one character of
interest to the next and copies what lies between; a table maps each such character to its rule. "Before" is what has
been written last, "after" is the next character of the input, so the rules see removals to the left only.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F

from scrubline.functions import text as T
from scrubline.functions.text import TextOptions

MAX_PASSES = 4

# -- fixed values: script groups and emoji ranges ---------------------------------------------------------------------

SIMPLE_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Common", "Inherited", "Han", "Hiragana", "Katakana", "Hangul", "Armenian", "Georgian", "Unknown")
SELECTOR_SCRIPTS = ("Han", "Myanmar", "Phags_Pa", "Manichaean", "Mongolian", "Egyptian_Hieroglyphs")
EMOJI_RANGES = (
    (0x1F000, 0x1FAFF), (0x2600, 0x27BF), (0x2300, 0x23FF), (0x2B00, 0x2BFF), (0x2190, 0x21FF), (0x2900, 0x297F), (0x25A0, 0x25FF), (0xE0020, 0xE007F),
    (0xFE0F, 0xFE0F), (0x20E3, 0x20E3), (0xA9, 0xA9), (0xAE, 0xAE), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139),
    (0x24C2, 0x24C2), (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299),
)
NOT_EMOJI_BASE = ((0xFE0F, 0xFE0F), (0x20E3, 0x20E3), (0x1F3FB, 0x1F3FF), (0xE0020, 0xE007F))
PREPENDED = (0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)
FLAG = "\U0001f3f4[\U000e0030-\U000e0039\U000e0061-\U000e007a]{1,7}\U000e007f"


def _any(ranges) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


def _scripts(names) -> str:
    return "".join(f"\\p{{Script={n}}}" for n in names)


def _test(pattern: str):
    """A cached predicate on one character; the empty string stands for a missing neighbour and fails."""
    compiled = regex.compile(pattern)
    return lru_cache(maxsize=65_536)(lambda c: bool(c) and compiled.fullmatch(c) is not None)


emoji_like = _test(f"[{_any(EMOJI_RANGES)}]")
emoji_base = _test(f"(?![{_any(NOT_EMOJI_BASE)}])[{_any(EMOJI_RANGES)}]")
joining = _test(f"(?![{_scripts(SIMPLE_SCRIPTS)}])[\\p{{L}}\\p{{Mn}}\\p{{Mc}}]")
han = _test("\\p{Script=Han}")
mongolian = _test("\\p{Script=Mongolian}")
egyptian = _test("\\p{Script=Egyptian_Hieroglyphs}")
duployan = _test("\\p{Script=Duployan}")
selector = _test("[\ufe00-\ufe0f\U000e0100-\U000e01ef]")
styled = _test(f"[{_any(EMOJI_RANGES)}#*0-9\\p{{So}}\\p{{Sm}}]")
varied = _test(f"[{_scripts(SELECTOR_SCRIPTS)}\\p{{Sm}}]")
alphanumeric = _test("[\\p{L}\\p{Nd}]")


def _rtl(text: str) -> bool:
    return not text.isascii() and any(unicodedata.bidirectional(c) in ("R", "AL") for c in set(text))


# each rule: (before, after, text has right-to-left letters) -> keep?
_NEVER = lambda before, after, rtl: False
_IF_RTL = lambda before, after, rtl: rtl


def _selector_rule(allowed):
    return lambda before, after, rtl: bool(before) and not selector(before) and before != "\u200d" and allowed(before)


@lru_cache(maxsize=65_536)
def rule_of(c: str):
    """(issue, rule) of a character that may have to go, or None."""
    cp, category = ord(c), unicodedata.category(c)
    if c in "\n\t":
        return None
    if category == "Cc":
        return "CONTROL", _NEVER
    if 0xE0020 <= cp <= 0xE007F or cp == 0xE0001:
        return "TAG_CHARS", _NEVER
    if 0xFE00 <= cp <= 0xFE0F:
        return "VARIATION_SELECTORS", _selector_rule(styled if cp >= 0xFE0E else varied)
    if 0xE0100 <= cp <= 0xE01EF:
        return "VARIATION_SELECTORS", _selector_rule(han)
    if cp == 0x200D:
        return "INVISIBLE", lambda before, after, rtl: (emoji_like(before) and emoji_base(after)) or (joining(before) and joining(after))
    if cp == 0x200C:
        return "INVISIBLE", lambda before, after, rtl: joining(before) and joining(after)
    if cp in (0x200E, 0x200F, 0x61C) or 0x2066 <= cp <= 0x2069:
        return "BIDI", _IF_RTL
    if 0x202A <= cp <= 0x202E:
        return "BIDI", _NEVER
    if cp in PREPENDED:
        return "INVISIBLE", _IF_RTL
    for low, high, script in ((0x180B, 0x180D, mongolian), (0x180F, 0x180F, mongolian), (0x13430, 0x1343F, egyptian), (0x1BCA0, 0x1BCA3, duployan)):
        if low <= cp <= high:
            return "INVISIBLE", lambda before, after, rtl, script=script: script(before)
    if _ALWAYS.match(c):
        return "INVISIBLE", _NEVER
    return ("PRIVATE_USE", _NEVER) if category == "Co" else ("INVISIBLE", _NEVER) if category == "Cf" else None


def _python(pattern: str) -> str:
    return regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: regex.escape(chr(int(m[1], 16)), special_only=True) if int(m[1], 16) > 32 else f"\\x{int(m[1], 16):02x}", pattern)


_ALWAYS = regex.compile("|".join(_python(p) for p in (T.ALWAYS_INVISIBLE, T.RESERVED_IGNORABLE, T.NONCHARACTERS)))


class CharacterPass:
    """One set of options."""

    def __init__(self, o: TextOptions):
        self.o = o
        parts = [FLAG] if o.remove_invisible else []
        if o.remove_invisible:
            parts += [_ALWAYS.pattern, "[\\p{Cc}\\p{Cf}\\p{Co}\ufe00-\ufe0f\u180b-\u180f\U00013430-\U0001343f\U0001bca0-\U0001bca3\U000e0000-\U000e0fff\u0600-\u0605\u06dd\u070f\u0890\u0891\u08e2]"]
        self.swaps: dict[str, tuple[str, str, bool]] = {}
        if o.normalize_spaces:
            self.swaps |= dict.fromkeys(T.SPECIAL_SPACES, (" ", "SPECIAL_SPACES", True)) | dict.fromkeys(T.LINE_SEPARATORS, ("\n", "SPECIAL_SPACES", True))
        if o.dashes:
            self.swaps |= dict.fromkeys(T.DASHES, ("-", "DASHES", False)) | dict.fromkeys(T.LONG_DASHES, ("", "DASHES", False))
        if o.quotes:
            self.swaps |= dict.fromkeys(T.DOUBLE_QUOTES, ('"', "QUOTES", False)) | dict.fromkeys(T.SINGLE_QUOTES, ("'", "QUOTES", False))
        if o.ellipsis:
            self.swaps[T.ELLIPSIS] = ("...", "ELLIPSIS", False)
        if self.swaps:
            parts.append("[" + "".join(regex.escape(c, special_only=False) for c in self.swaps) + "]")
        if o.fancy:
            parts.append(_python(T.FANCY))
        self.scanner = regex.compile("|".join(parts)) if parts else None
        self.fancy = regex.compile(_python(T.FANCY))

    def _decide(self, c: str, before: str, after: str, rtl: bool) -> tuple[str | None, str, bool]:
        """(what to write instead or None to keep, issue, hidden?)"""
        if self.o.remove_invisible and (rule := rule_of(c)) and not rule[1](before, after, rtl):
            return "", rule[0], True
        if swap := self.swaps.get(c):
            new, issue, hidden = swap
            if c in T.LONG_DASHES:
                new = " - " if alphanumeric(before) and alphanumeric(after) else "-"
            return new, issue, hidden
        if self.o.fancy and self.fancy.match(c) and after != "\ufe0f":
            plain = unicodedata.normalize("NFKC", c)
            if plain and plain != c:
                return plain, "FANCY_LETTERS", False
        return None, "", False

    def once(self, text: str, counts: Counter, points: Counter, found: list | None = None) -> str:
        if self.scanner is None:
            return text
        rtl, out, at, last = _rtl(text), [], 0, ""
        for m in self.scanner.finditer(text):
            start, end = m.span()
            if start > at:
                out.append(text[at:start])
                last = text[start - 1]
            at = end
            c = m[0]
            new, issue, hidden = (None, "", False) if len(c) > 1 else self._decide(c, last, text[end : end + 1], rtl)
            if new is None:
                out.append(c)
                last = c[-1]
                continue
            if new:
                out.append(new)
                last = new[-1]
            counts[issue] += 1
            if hidden:
                points[ord(c)] += 1
                if found is not None:
                    found.append((start, ord(c), issue))
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str) -> tuple[str, Counter, Counter]:
        """Passes until nothing hidden is removed, then the composed form."""
        counts: Counter = Counter()
        points: Counter = Counter()
        for _ in range(MAX_PASSES):
            seen = points.total()
            text = self.once(text, counts, points)
            if points.total() == seen:
                break
        return unicodedata.normalize("NFC", text), counts, points


PASSED = "struct<text:string,counts:array<struct<issue:string,n:int>>,points:array<struct<cp:int,n:int>>>"
_PASSED = pa.struct([("text", pa.string()), ("counts", pa.list_(pa.struct([("issue", pa.string()), ("n", pa.int32())]))), ("points", pa.list_(pa.struct([("cp", pa.int32()), ("n", pa.int32())])))])
FOUND = "array<struct<cp_start:int,start:int,end:int,code_point:int,issue:string>>"
_FOUND = pa.list_(pa.struct([("cp_start", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code_point", pa.int32()), ("issue", pa.string())]))


def character_pass(o: TextOptions):
    """Arrow function text -> PASSED; null stays null."""

    @F.arrow_udf(PASSED)
    def run(texts: pa.Array) -> pa.Array:
        own, out = CharacterPass(o), []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            new, counts, points = own(t)
            out.append({"text": new, "counts": [{"issue": k, "n": n} for k, n in counts.items()], "points": [{"cp": k, "n": n} for k, n in points.items()]})
        return pa.array(out, _PASSED)

    return run.asNondeterministic()  # keeps filters from copying the call into expressions that can't evaluate it


def find_hidden(text: Column) -> Column:
    """array<struct>: hidden characters of the raw text by one pass with the default options. start and end are UTF-16
    offsets, cp_start counts code points."""

    @F.arrow_udf(FOUND)
    def run(texts: pa.Array) -> pa.Array:
        own, out = CharacterPass(TextOptions()), []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            found: list = []
            own.once(t, Counter(), Counter(), found)
            rows, at, units = [], 0, 0
            for start, cp, issue in found:
                units += len(t[at:start]) + sum(c > "\uffff" for c in t[at:start])
                at = start
                rows.append({"cp_start": start, "start": units, "end": units + 1 + (cp > 0xFFFF), "code_point": cp, "issue": issue})
            out.append(rows)
        return pa.array(out, _FOUND)

    return F.coalesce(run.asNondeterministic()(F.when(T.has_hazard(text), text)), F.when(text.isNotNull(), F.array().cast(FOUND)))
