import re

from pyspark.sql import functions as F

from scrubline.llm import decontam as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "text string, doc_id long, item_id int, n_words string"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def brute(docs, items):
    out = {}
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in [0] if 0 < len(w) <= 13 else range(len(w) - 12) if w else []:
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i) if i is not None else "null")
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, ids = set(), set()
        for win, owners in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= owners
        out[d] = (len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


ITEMS = [
    (1, " ".join(f"w{i}" for i in range(20))),
    (2, "Short É item"),
    (3, None),
    (4, "..."),
    (None, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17"),
    (10, "short é Item"),
    (5, "w w w w w w w w w w w w w w"),
]
TEXTS = [
    "x W1 w2, w3 w4-w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 y" + " pad" * 400,
    "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12",
    "short É item; SHORT É ITEM short É",
    "short é item",
    "", None, "w " * 30, " ".join(f"w{i}" for i in range(20)), "ß short É itemx",
    "long " * 50000 + " ".join(f"w{i}" for i in range(20)),
]


def frames(spark, items):
    docs = list(enumerate(TEXTS))
    return docs, spark.createDataFrame([(t, i, 7, "x") for i, t in docs], DOCS), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark):
    docs, d, b = frames(spark, ITEMS)
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.c) for r in dc.find_contamination(d, b).withColumn("c", dc.is_contaminated()).collect()}
    assert got == brute(docs, ITEMS)


def test_more_groups_than_one_give_the_same(spark):
    _, d, b = frames(spark, ITEMS)
    cols = ["doc_id", "n_words", "n_hit", "item_ids", "spans"]
    one = sorted(map(tuple, dc.find_contamination(d, b).select(cols).collect()))
    assert one == sorted(map(tuple, dc.find_contamination(d, b, 60).select(cols).collect()))
    assert sorted(r.doc_id for r in dc.drop_contaminated(d, b).collect()) == sorted(r.doc_id for r in dc.drop_contaminated(d, b, 60).collect())


def test_groups_judge_rows_with_null_and_repeated_ids_one_by_one(spark):
    _, _, b = frames(spark, ITEMS)
    d = spark.createDataFrame([(t, i, 7, "x") for t in TEXTS for i in (None, 1)] + [(TEXTS[3], 1, 7, "x")], DOCS)
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    cols = ["doc_id", "n_words", "n_hit", "item_ids", "spans"]
    one = key(dc.find_contamination(d, b).select(cols).collect())
    assert one == key(dc.find_contamination(d, b, 60).select(cols).collect())
    kept = key(dc.drop_contaminated(d, b).collect())
    assert 0 < len(kept) < d.count() and kept == key(dc.drop_contaminated(d, b, 60).collect())


def test_spans_are_offsets_in_the_original(spark):
    d = spark.createDataFrame([("é! Short  É\nitem. ", 1)], "text string, doc_id long")
    b = spark.createDataFrame([(2, "short É item")], "item_id long, text string")
    r = dc.find_contamination(d, b).first()
    assert [("é! Short  É\nitem. ")[s.start : s.end] for s in r.spans] == ["Short  É\nitem"]


def test_empty_tables_and_filter(spark):
    _, d, b = frames(spark, ITEMS)
    assert dc.find_contamination(d.limit(0), b).count() == 0
    assert dc.find_contamination(d, b.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    kept = dc.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, v in brute(list(enumerate(TEXTS)), ITEMS).items() if not v[3]}


def test_long_items_are_cut_without_losing_a_window(spark):
    rng = __import__("random").Random(6)
    words = [f"v{rng.randrange(400)}" for _ in range(900)]
    items = [(1, " ".join(words)), (2, "Tiny  one"), (None, " ".join(words[100:130])), (3, "x" * 300), (4, None)]
    docs = [(i, "p " * 9 + " ".join(words[a : a + n]) + " q" * 9) for i, (a, n) in enumerate([(0, 13), (5, 12), (300, 200), (0, 900), (887, 13), (110, 40)])] + [(9, "tiny one"), (10, "x" * 300)]
    d = spark.createDataFrame([(t, i, 7, "x") for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "item_ids", "spans"]
    one = sorted(map(tuple, dc.find_contamination(d, b).select(cols).collect()))
    for most in (40, 200, 1000):
        assert sorted(map(tuple, dc.find_contamination(d, b, most).select(cols).collect())) == one
