"""Markdown to plain text, natively.

Splitting a text at its fence lines leaves segments that are outside and inside a fence by turns, so no state is carried
from line to line. Lines outside fences pass a chain of rules, each with its count.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scrubline.functions.let import let, present

# -- fixed values: patterns that results depend on ----------------------------------------------------------------------

FENCE = "\\n[ \\t\\x0B\\f\\r]{0,3}(?:```|~~~)[^\\n\\r\\x{85}\\x{2028}\\x{2029}]*(?=\\n|\\z)"
RULE = "^\\s{0,3}([-*_])(?:\\s*\\1){2,}\\s*\\z"
HEADING = "^\\s{0,3}#{1,6}\\s+(.*?)(?:\\s+#+)?\\s*\\z"
UNDERLINE = "^\\s{0,3}(=+|-+)\\s*\\z"
QUOTE = "^\\s{0,3}>\\s?"
TASK_OPEN, TASK_DONE = "^(\\s*)[-*+]\\s+\\[ \\]\\s+", "^(\\s*)[-*+]\\s+\\[[xX]\\]\\s+"
BULLET = "^(\\s*)[-*+]\\s+"
TABLE_SEPARATOR = "^\\s*\\|?\\s*:?-{3,}:?\\s*(?:\\|\\s*:?-{3,}:?\\s*)*\\|?\\s*\\z"
TABLE_ROW = "^\\s*\\|(.*)\\|\\s*\\z"
_TITLE = "(?:\\s+\"[^\"]*\")?\\)"
INLINE = (
    ("!\\[([^\\]]*)\\]\\(([^)\\s]+)" + _TITLE, ""),
    ("\\[([^\\]]+)\\]\\((?!#|\\1" + _TITLE + ")([^)\\s]+)" + _TITLE, "$1 ($2)"),
    ("\\[([^\\]]+)\\]\\((?:\\1|#[^)\\s]*)" + _TITLE, "$1"),
    ("<(https?://[^>\\s]+)>", "$1"),
    ("``\\s?([^`\\n]+?)\\s?``", "$1"),
    ("`([^`\\n]+)`", "$1"),
    ("(\\*\\*\\*|___)(?=\\S)(.+?)(?<=\\S)\\1", "$2"),
    ("(\\*\\*|__)(?=\\S)(.+?)(?<=\\S)\\1", "$2"),
    ("(?<![\\w*])\\*(?=[^\\s*])(.+?)(?<=[^\\s*])\\*(?![\\w*])", "$1"),
    ("(?<![\\w_])_(?=[^\\s_])(.+?)(?<=[^\\s_])_(?![\\w_])", "$1"),
    ("~~(?=\\S)(.+?)(?<=\\S)~~", "$1"),
    ("\\\\([\\\\`*_{}\\[\\]()#+\\-.!>~|])", "$1"),
)
INLINE_NEEDS = (("![",), ("](",), ("](",), ("<http",), ("``",), ("`",), ("***", "___"), ("**", "__"), ("*",), ("_",), ("~~",), ("\\",))
#: A line without any of these characters has no rule of its own but a setext underline's.
MARKS = "[#>*+|_=~`<\\[\\]\\\\-]"
BLANK_ENDS = "^[\\s\\p{Z}]+|[\\s\\p{Z}]+\\z"
TEXT_CHARACTER = "[^\\s\\p{Z}\\x{1C}-\\x{1F}]"


def _state(line: Column, n: Column) -> Column:
    return F.struct(line.alias("line"), n.alias("n"))


def _when(state: Column, pattern: str, new) -> Column:
    """One change of the whole line where the pattern is found."""
    return let(state, lambda s: F.when(s["line"].rlike(pattern), _state(new(s["line"]), s["n"] + 1)).otherwise(_state(s["line"], s["n"])))


def _all(state: Column, pattern: str, replacement: str, needs: tuple[str, ...]) -> Column:
    """A change for each match, where the literal that each match starts with is present."""

    def apply(s: Column) -> Column:
        done = _state(F.regexp_replace(s["line"], F.lit(pattern), F.lit(replacement)), s["n"] + F.regexp_count(s["line"], F.lit(pattern)))
        return F.when(present(s["line"], needs), done).otherwise(s)

    return let(state, apply)


def table_cells(line: Column) -> Column:
    cells = F.split(F.regexp_extract(line, TABLE_ROW, 1), "\\|", -1)
    return F.array_join(F.transform(cells, lambda c: F.regexp_replace(c, BLANK_ENDS, "")), " | ")


def inline(state: Column) -> Column:
    for (pattern, replacement), needs in zip(INLINE, INLINE_NEEDS, strict=True):
        state = _all(state, pattern, replacement, needs)
    return state


def clean_line(line: Column, before: Column) -> Column:
    """struct<line, n>; line is null where the whole line goes. before: the line before it, null for the first one."""
    gone = (
        line.rlike(RULE)
        | line.rlike(TABLE_SEPARATOR)
        | (line.rlike(UNDERLINE) & F.coalesce(before.rlike(TEXT_CHARACTER), F.lit(False)) & (F.length(F.regexp_replace(line, BLANK_ENDS, "")) >= 3))
    )
    state = _state(line, F.lit(0))
    state = _when(state, HEADING, lambda x: F.regexp_replace(x, HEADING, "$1"))
    state = _when(state, QUOTE, lambda x: F.regexp_replace(x, QUOTE, ""))
    marked = lambda x: (
        F.when(x.rlike(TASK_OPEN), F.regexp_replace(x, TASK_OPEN, "$1☐ "))
        .when(x.rlike(TASK_DONE), F.regexp_replace(x, TASK_DONE, "$1☑ "))
        .otherwise(F.regexp_replace(x, BULLET, "$1• "))
    )
    state = _when(state, BULLET, marked)
    state = _when(state, TABLE_ROW, table_cells)
    marked_line = F.when(gone, _state(F.lit(None).cast("string"), F.lit(1))).otherwise(inline(state))
    return F.when(line.rlike(MARKS), marked_line).otherwise(_state(line, F.lit(0)))


def strip_markdown(text: Column) -> Column:
    """struct<text, MARKDOWN>."""
    segments = F.split(F.concat(F.lit("\n"), text), FENCE, -1)

    def segment(s: Column, k: Column) -> Column:
        lines = F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(F.substring(s, F.lit(2), F.length(s)), "\n", -1))
        raw = lambda: F.transform(lines, lambda x: _state(x, F.lit(0)))
        first = F.when(k > 0, F.lit("```"))
        done = let(lines, lambda own: F.transform(own, lambda x, j: clean_line(x, F.when(j > 0, F.try_element_at(own, F.greatest(j, F.lit(1)))).otherwise(first))))
        return F.when(k % 2 == 1, raw()).otherwise(done)

    cleaned = let(segments, lambda own: F.struct(F.flatten(F.transform(own, segment)).alias("lines"), (F.size(own) - 1).alias("fences")))
    return let(
        cleaned,
        lambda c: F.struct(
            F.array_join(F.transform(F.filter(c["lines"], lambda x: x["line"].isNotNull()), lambda x: x["line"]), "\n").alias("text"),
            (c["fences"] + F.aggregate(c["lines"], F.lit(0), lambda a, x: a + x["n"])).alias("MARKDOWN"),
        ),
    )
