import math
import random
import re
from collections import Counter

import sentencepiece

from scrubline.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = qr.production_rules()
DOCS = "text string, doc_id long, lang string, kept string, n_words string"


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen = set()
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def texts():
    rng = random.Random(5)
    vocabulary = ["and", "the", "é", "ßun", "#x", "a|b", "<p>", "longerword", "日本", "x"]
    out = ["", None, " \n\t ", "one", "a\nb\na\n\n a\na", "w " * 500, "\x00odd\x0bwords\x1cjoined\u00a0here\u2028too " * 9]
    for n in (7, 8, 9, 19, 20, 21, 60, 300, 40000):
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(n)))
    clean = " ".join("".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(500))
    falling_back = " ".join(rng.choice(["\U000103a0\U000103b1", "word", "ꙮꙮ", "🂡x", "\u0f00a"]) for _ in range(90))
    return [*out, falling_back, "".join(rng.choice("abcdefgh  \n") for _ in range(3_000_000)), clean, clean + " " + clean]


def test_base_columns_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    rows += rows[3:5]
    df = spark.createDataFrame([(t, i, "en", "x", "y") for i, t in rows], DOCS)
    got = sorted(tuple(r)[:7] for r in qr.measure(df, RULES).collect())
    assert got == sorted((i, *brute(t)) for i, t in rows)


def test_fertility_equals_brute_force():
    model = sentencepiece.SentencePieceProcessor(model_file=RULES.model_path)
    judge = qr.Judge(RULES)
    for text in texts():
        ids = [i for w in WORD.findall(text or "") for i in model.encode(w)]
        got = judge((text or "").encode(), "en")
        assert got["n_tokens"] == len(ids)
        if ids:
            entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values())
            assert math.isclose(got["token_entropy"], entropy, abs_tol=1e-9)
            assert math.isclose(got["byte_share"], sum(map(model.is_byte, ids)) / len(ids))
            assert math.isclose(got["chars_per_token"], sum(map(len, WORD.findall(text))) / len(ids))


def test_byte_fallback_is_measured_and_judged():
    judge = qr.Judge(RULES)
    r = judge(texts()[-4].encode(), "en")
    assert r["byte_share"] > 0.3 and r["rejected_by"] in ("fertility", "byte_fallback")
    wide = qr.Rules(RULES.model_path, {"en": qr.Band((0.1, 9), 0.02, 0)})
    assert qr.Judge(wide)(texts()[-4].encode(), "en")["rejected_by"] == "byte_fallback"


def test_bands_are_those_that_calibration_measures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1")
    assert qr.calibrate(docs, good, RULES) == RULES.languages
    assert qr.calibrate(docs, good.limit(0), RULES) == {}


def test_verdicts():
    judge = qr.Judge(RULES)
    rng = random.Random(1)
    few = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "zeta"]
    assert judge(" ".join(rng.choice(few) for _ in range(400)).encode(), "en")["rejected_by"] == "entropy"
    assert judge(("\U000103a0\U000103b1 " * 30 + " ".join(str(i) for i in range(60))).encode(), "en")["kept"] is False
    assert judge(None, None)["rejected_by"] == "base"
    assert qr.main_script("привет hi") == "cyrillic" and qr.main_script("漢字 a") == "han" and qr.main_script("été") == "latin"


def test_keep_hands_on_all_columns_and_empty_tables_work(spark):
    clean = texts()[-2]
    df = spark.createDataFrame([(clean, 1, None, "k", "n"), ("short", 2, "en", None, None), (None, 3, "xx", "", ""), (clean, 1, "zz", "k", "n")], DOCS)
    got = qr.keep(df, RULES)
    assert got.columns == df.columns and [r.doc_id for r in got.collect()] == [1, 1]
    assert qr.keep(df.limit(0), RULES).count() == 0 and qr.measure(df.limit(0), RULES).count() == 0
