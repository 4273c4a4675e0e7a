import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrubline.llm import common, minhash as mh, simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_keep(rows):
    """Indexes of the rows of (doc_id, text) that stay, by trying all pairs; rows without doc_id are not among them."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups.setdefault(find(i), []).append(d)
    return sorted(min(v) for v in groups.values())


def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(30, 400))]
        texts.append(base)
        for _ in range(rng.randint(0, 4)):  # similarities on both sides of the bound
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    crowd = [word() for _ in range(200)]
    for _ in range(50):
        copy = list(crowd)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["", None, " ", "one two", "ONE  two", "one"]
    rng.shuffle(texts)
    return [(i * 7 % 1000, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("cell_limit", [2, 16, 10**6])
def test_equals_brute_force_jaccard(spark, cell_limit):
    rows = corpus()
    df = spark.createDataFrame([(t, d, "x") for d, t in rows], "text string, doc_id long, source string")
    got = mh.keep_one(df, cell_limit=cell_limit)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == brute_keep(rows)


def test_the_stage_drops_documents_of_similarity_four_fifths(spark):
    words = [f"w{i}" for i in range(204)]
    near, far = list(words), list(words)
    for i in range(20, 140, 30):
        near[i] = "n"  # 4 words, 20 of 200 shingles: 180 of 220
    for i in range(20, 170, 30):
        far[i] = "f"  # 5 words, 25 of 200 shingles: 175 of 225
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (None, " ".join(words)), (1, " ".join(words)), (1, "another text")]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = sorted((r.doc_id or 0, len(r.text)) for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == sorted([(0, len(rows[0][1])), (1, len(rows[0][1])), (3, len(rows[2][1])), (1, len("another text"))])


def test_the_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == brute_keep(rows)
    assert mh.keep_one(docs.limit(0)).count() == 0


def test_columns_of_any_name_are_handed_on(spark):
    rows = [(1, "a b c d e f", 7, 8, "x", None), (2, "A b c d e f", 9, 8, "y", "n"), (3, None, 1, 1, None, None), (4, "", 2, 2, None, None), (5, "other", 3, 3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int, _node int, _keys string, `a.doc` string")
    for got in (mh.keep_one(df), simhash.keep_one(df)):
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect())) == [rows[0], rows[2], rows[4]]


def test_a_crowd_gives_links_and_no_pairs(spark, monkeypatch):
    """Copies at many distances of one text, and crowds inside the crowd; blocks are small, so that there are many."""
    monkeypatch.setattr(mh, "BLOCK", 16)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    bases = [base, *([word() if rng.random() < 0.05 else w for w in base] for _ in range(4))]
    rows = []
    for i in range(400):
        copy = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            copy[rng.randrange(len(copy))] = word()
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in mh.keep_one(df, cell_limit=8).collect()) == brute_keep(rows)


def test_counts_of_blocks_equal_sets():
    rng = random.Random(4)
    pools = [list(range(30)), list(range(20, 4000))]
    some = lambda: np.unique(np.array(rng.sample(pools[0], rng.randint(0, 25)) + rng.sample(pools[1], rng.randint(0, 40)), np.uint64))
    left, right = [some() for _ in range(40)], [some() for _ in range(30)] + [np.zeros(0, np.uint64)]
    for a, b in ((left, right), (left, []), ([], right)):
        assert mh.shared_counts(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


def test_the_grid_of_fingerprints_gives_candidates_and_the_similarity_decides(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(4000)] for _ in range(4)]
    texts = [" ".join(w) for b in base for w in (b, [*b, "end"], [*b, "end", "two"])] + ["p q r s t u v", " ".join(word() for _ in range(90))]
    texts = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "_row long, text binary")
    made = common.materialize(texts.mapInArrow(functools.partial(mh._nodes, size=5), "_row long, _node long, _keys array<long>, _print long"), "rows")
    bare = common.materialize(made.withColumn("_keys", F.array().cast("array<long>")), "rows")  # no bands
    node = {r._row: r._node for r in bare.collect()}
    found = {r.node: r.component for r in mh._joined(bare, texts, 5, 0.8, 16).collect()}
    assert {i for i, n in node.items() if n in found} == set(range(12))
    assert len({found[node[i]] for i in range(12)}) == 4
    one = common.materialize(bare.withColumn("_print", F.lit(7).cast("long")), "rows")  # one fingerprint: only what is similar links
    low = min(node.values())
    like = [n for i, n in node.items() if i < 12 and i // 3 in [k // 3 for k, v in node.items() if v == low and k < 12]]
    assert {r.node for r in mh._joined(one, texts, 5, 0.8, 16).collect()} == set(like)
