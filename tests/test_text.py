import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from scrubline.functions import hidden, markdown, text as T
from scrubline.functions.text import TextOptions
from scrubline.operators.sanitize import clean_text, highlight, summary

D = TextOptions()
FAMILY = "👨\u200d👩\u200d👧 ❤\ufe0f\u200d🔥 1\ufe0f⃣ 🏴\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f 🏳\ufe0f\u200d🌈 👍🏽"
CASES = [
    ("zero width", D, "a\u200bb\u200cc\u2060d\ufeff", "abcd", {"INVISIBLE": 4}),
    ("spaces", D, "12\u202f000\u00a0km", "12 000 km", {"SPECIAL_SPACES": 2}),
    ("emoji stay", D, FAMILY, FAMILY, {}),
    ("latin joiner", D, "a\u200db", "ab", {"INVISIBLE": 1}),
    ("persian joiner stays", D, "می\u200cخواهم", "می\u200cخواهم", {}),
    ("tags", D, "x\U000e0068\U000e0069\U000e0001y", "xy", {"TAG_CHARS": 3}),
    ("long fake flag", D, "\U0001f3f4" + "\U000e0061" * 8 + "\U000e007f", "\U0001f3f4", {"TAG_CHARS": 9}),
    ("selector on a letter", D, "a\ufe0f", "a", {"VARIATION_SELECTORS": 1}),
    ("doubled selector", D, "❤\ufe0f\ufe0f", "❤\ufe0f", {"VARIATION_SELECTORS": 1}),
    ("han variant stays", D, "葛\U000e0100", "葛\U000e0100", {}),
    ("override", D, "\u202eabc", "abc", {"BIDI": 1}),
    ("isolate without rtl", D, "a\u2067b\u2069", "ab", {"BIDI": 2}),
    ("isolate with rtl stays", D, "a\u2067שלום\u2069", "a\u2067שלום\u2069", {}),
    ("soft hyphen, filler, control, private, noncharacter", D, "a\u00adb\u3164c\x07d\ue123e\ufffef", "abcdef", {"INVISIBLE": 3, "CONTROL": 1, "PRIVATE_USE": 1}),
    ("private citation", D, "See \ue200cite\ue202turn0search0\ue201.", "See.", {"AI_CITATIONS": 1}),
    ("bare turns", D, "See citeturn0search0turn1news2.", "See.", {"AI_CITATIONS": 1}),
    ("file search", D, "Fact【4:0†source】", "Fact", {"AI_CITATIONS": 1}),
    ("footnote keeps its blank", D, "x [^12^]y", "x y", {"AI_CITATIONS": 1}),
    ("only parameter", D, "https://a.b/?utm_source=chatgpt.com", "https://a.b/", {"TRACKING": 1}),
    ("first parameter", D, "https://a.b/?utm_source=chatgpt.com&x=1", "https://a.b/?x=1", {"TRACKING": 1}),
    ("last parameter", D, "(https://a.b/?x=1&utm_source=openai)", "(https://a.b/?x=1)", {"TRACKING": 1}),
    ("adjacent parameters", D, "?utm_source=chatgpt.com&ref=claude&z=1", "?ref=claude&z=1", {"TRACKING": 1}),
    ("bing form", D, "?form=MG0AV3#t", "#t", {"TRACKING": 1}),
    ("newsletter stays", D, "?utm_source=newsletter", "?utm_source=newsletter", {}),
    ("numbers off", D, "a[1][2]", "a[1][2]", {}),
    ("numbers on", TextOptions(remove_citation_numbers=True), "a[1][2] b[web:3] [4]", "a b [4]", {"CITATION_NUMBERS": 2}),
    ("dashes", TextOptions(dashes=True), "a—b c — d–e", "a - b c - d-e", {"DASHES": 3}),
    ("dash beside a removed character", TextOptions(dashes=True), "a\u200b—b", "a - b", {"DASHES": 1, "INVISIBLE": 1}),
    ("quotes and ellipsis", TextOptions(quotes=True, ellipsis=True), "“q” ‘s’ … «g»", "\"q\" 's' ... «g»", {"QUOTES": 4, "ELLIPSIS": 1}),
    ("typography off", D, "a—b “q” …", "a—b “q” …", {}),
    ("fancy", TextOptions(fancy=True), "𝐁𝐨𝐥𝐝 ｆｕｌｌ ⓒ №", "Bold full c №", {"FANCY_LETTERS": 9}),
    ("composed without count", D, "и\u0306", "й", {}),
    ("line ends", D, "a\r\nb\rc", "a\nb\nc", {}),
    ("separators", D, "a\u2028b\u2029c", "a\nb\nc", {"SPECIAL_SPACES": 2}),
    ("white space", TextOptions(collapse_blank_lines=True), "a  \nb\t\n\n\n\nc \n", "a\nb\n\nc", {"WHITESPACE": 5}),
    ("plain", D, "Привет «мир» 😀 tab\tx", "Привет «мир» 😀 tab\tx", {}),
    ("interleaved", D, "👨\u200d\u200b👩", "👨👩", {"INVISIBLE": 2}),
    ("empty", D, "", "", {}),
    ("arabic mark", D, "\u0600a", "a", {"INVISIBLE": 1}),
    ("mongolian selector", D, "a\u180b ᠠ\u180b", "a ᠠ\u180b", {"INVISIBLE": 1}),
]


@pytest.mark.parametrize("options", list(dict.fromkeys(c[1] for c in CASES)), ids=lambda o: str(hash(o))[-4:])
def test_literal_cases(spark, options):
    own = [c for c in CASES if c[1] == options]
    df = spark.createDataFrame([(c[0], c[2], 1) for c in own], "name string, text string, counts int")
    got = {r.name: r.cleaned for r in clean_text(df, options=options).collect()}
    for name, _, _, text, counts in own:
        assert (got[name].text, got[name].counts) == (text, counts), name
        assert got[name].changed == bool(counts) and got[name].total == sum(counts.values())


def test_null_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1), ("a\u200b", 2)], "text string, cleaned_id int")
    assert [r.cleaned.text if r.cleaned else None for r in clean_text(df).orderBy("cleaned_id").collect()] == [None, "a"]
    assert clean_text(df.limit(0)).count() == 0


MD = [
    ("# Title #", "Title", 1), ("> quote", "quote", 1), ("- item", "• item", 1), ("  * [x] done", "  ☑ done", 1), ("- [ ] todo", "☐ todo", 1), ("a\n---\nb", "a\nb", 1),
    ("Head\n====\nx", "Head\nx", 1), ("\n====", "\n====", 0), ("***", "", 1), ("| a | b |\n|---|:---:|\n|c|d|", "a | b\nc | d", 3), ("![i](x.png \"t\")z", "z", 1), ("[l](http://u)", "l (http://u)", 1),
    ("[http://u](http://u) [m](#m)", "http://u m", 2), ("<https://e.x/a>", "https://e.x/a", 1), ("`c` ``d``", "c d", 2), ("***a*** **b** __c__ *d* _e_", "a b c d e", 5), ("snake_case_x 2*3*4", "snake_case_x 2*3*4", 0),
    ("~~f~~", "f", 1), ("\\*x\\_", "*x_", 2), ("```py\n**raw**\n```\n**b**", "**raw**\nb", 3), ("~~~\nopen **x**", "open **x**", 1), ("```\na\n```\n----", "a", 3), ("plain text", "plain text", 0), ("", "", 0),
]


def test_markdown(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(MD)], "i int, t string")
    got = {r.i: (r.c.text, r.c.MARKDOWN) for r in df.select("i", markdown.strip_markdown(F.col("t")).alias("c")).collect()}
    for i, (t, text, n) in enumerate(MD):
        assert got[i] == (text, n), t


def test_find_hidden_is_one_raw_pass_with_utf16_offsets(spark):
    df = spark.createDataFrame([(1, "a\r\nb😀\u200b\ue200"), (2, "clean"), (3, None)], "i int, t string")
    got = {r.i: r.h for r in df.select("i", hidden.find_hidden(F.col("t")).alias("h")).collect()}
    assert [tuple(h) for h in got[1]] == [(1, 1, 2, 13, "CONTROL"), (5, 6, 7, 0x200B, "INVISIBLE"), (6, 7, 8, 0xE200, "PRIVATE_USE")]
    assert got[2] == [] and got[3] is None


def test_native_tier_equals_the_character_pass(spark):
    rng = random.Random(20260917)
    free = "\u200b\u2060\ufeff\u00ad\u202a\x07\x1b\ue000\ufdd0\U000e0002\u00a0\u2009\u3000abc xyz\n\té"
    texts = ["".join(rng.choice(free) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", T.strip_context_free(F.col("t")).alias("c")).collect()}
    own = hidden.CharacterPass(D)
    for i, t in enumerate(texts):
        text, counts, _ = own(t)
        assert unicodedata.normalize("NFC", got[i].text) == text
        assert {k: got[i][k] for k in counts} == counts


def _fuzz(rng):
    pools = [
        lambda: rng.randrange(32, 127), lambda: rng.randrange(0x200B, 0x2070), lambda: rng.randrange(0xE0000, 0xE0200), lambda: rng.randrange(0x1F300, 0x1FAFF),
        lambda: rng.choice([0x200D, 0xFE0F, 0x1F3F4, 0xE007F, 0x915, 0x94D, 0x627, 0x5D0, 0x180B, 0x1820]), lambda: rng.choice([c for c in (rng.randrange(0x110000),) if not 0xD800 <= c <= 0xDFFF] or [65]),
    ]
    return "".join(chr(rng.choice(pools)()) for _ in range(rng.randrange(200)))


def test_a_second_clean_finds_nothing_hidden(spark):
    rng = random.Random(20260917)
    df = spark.createDataFrame([(i, _fuzz(rng)) for i in range(300)], "i int, text string")
    once = clean_text(df).select("i", F.col("cleaned.text").alias("text"))
    assert clean_text(once).where("cleaned.hidden > 0").count() == 0


def test_guard_covers_every_hidden_code_point(spark):
    own = hidden.CharacterPass(D)
    rows = [(cp,) for cp in range(0x110000) if not 0xD800 <= cp <= 0xDFFF and own.scanner.fullmatch(chr(cp)) and own._decide(chr(cp), "", "", False)[0] is not None]
    df = spark.createDataFrame([(cp, chr(cp)) for (cp,) in rows], "cp int, t string")
    assert len(rows) > 1000 and df.where(~T.has_hazard(F.col("t"))).count() == 0


def test_summary_preview_and_names(spark):
    df = spark.createDataFrame([("a\u200bb\u00a0c ",)], "text string")
    assert clean_text(df).select(summary(F.col("cleaned"))).first()[0] == "INVISIBLE: 1, SPECIAL_SPACES: 1, WHITESPACE: 1"
    assert highlight(df).first().preview == "a⟨ZWSP⟩b⟨NBSP⟩c "
    assert df.select(T.describe(F.lit(0x200B))).first()[0] == "U+200B ZERO WIDTH SPACE"


def test_clean_texts_never_reach_python(spark):
    plan = clean_text(spark.createDataFrame([("a",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan


def test_work_columns_clash_with_none(spark):
    rows = [("a​b", 1, 2, 3, 4, 5, 6, 7, 8, 9, 0)]
    df = spark.createDataFrame(rows, "text string, _a int, _m int, _p int, _t int, _w int, _C int, _h int, __a int, _head int, _spans int")
    got = clean_text(df)
    assert got.columns == [*df.columns, "cleaned"] and tuple(got.first())[:11] == rows[0] and got.first().cleaned.text == "ab"
    shown = highlight(df)
    assert shown.columns == [*df.columns, "preview"] and tuple(shown.first())[:11] == rows[0] and shown.first().preview == "a⟨ZWSP⟩b"
    again = clean_text(got, into="cleaned")
    assert again.columns == got.columns and again.first().cleaned.total == 1
