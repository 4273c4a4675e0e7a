import random

import xxhash
from pyspark.sql import functions as F

from scrubline.llm import simhash as sh
from scrubline.llm.components import components


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """{node: smallest reachable node} by trying all pairs."""
    nodes = sorted(set(prints))
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def unsigned(x):
    return x & (2**64 - 1)


def groups(mapping):
    by = {}
    for k, v in mapping.items():
        by.setdefault(v, set()).add(k)
    return sorted(map(sorted, by.values()))


def test_fingerprints_equal_brute_force():
    rng = random.Random(4)
    texts = ["", None, " \n", "One", "one Two", "É é Two x", "a b c", "A B  C\td", "x " * 3000]
    texts += [" ".join(rng.choice(["the", "Cat", "é", "日本", "\x1c", "w"]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    for t in texts:
        assert unsigned(sh.fingerprint(t.encode() if t is not None else None)) == brute_print(t)


def near_prints(rng, n):
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        out.add(base)
        for _ in range(rng.randint(0, 12)):
            base ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            out.add(base)
    # a crowd: many fingerprints in the same cells
    centre = rng.getrandbits(64)
    out |= {centre ^ (1 << i) for i in range(64)} | {centre ^ (3 << i) for i in range(63)} | {0, 2**64 - 1, 2**63}
    return out


def test_links_connect_what_all_pairs_connect(spark):
    prints = near_prints(random.Random(8), 300)
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for limit in (2, 16, 10**6):
        rows = sh.links(frame, limit).collect()
        assert all((r.a ^ r.b) & (2**64 - 1) and (unsigned(r.a) ^ unsigned(r.b)).bit_count() <= 2 for r in rows)
        got = {r.node: r.component for r in components(sh.links(frame, limit)).collect()}
        full = {x: got.get(x, x) for x in signed}
        assert groups({unsigned(k): unsigned(v) for k, v in full.items()}) == groups(brute_components(prints))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, None), (None, None), (2000, 3000)] * 2 + [(9000, 9001 + i) for i in range(300)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(12)]
    texts = [*base, *base[:4], *(b + " extra" for b in base[:6]), "", None, " ", "hi", "HI", "x " * 100000]
    rows = [(t, 100 - i, "c", i) for i, t in enumerate(texts)] + [("only null", None, "c", 0), (base[0], None, "c", 1), (base[0], 100, "c", 0)]
    df = spark.createDataFrame(rows, "text string, doc_id long, component_id string, fp int")
    got = sh.near_duplicates(df).collect()
    prints = [brute_print(t) for t, *_ in rows]
    root = brute_components(prints)
    lows = {}
    for p, (_, d, *_) in zip(prints, rows, strict=True):
        lows.setdefault(root[p], []).append(d)
    name = {k: min((d for d in v if d is not None), default=None) for k, v in lows.items()}
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    expected = sorted(((d, p, name[root[p]]) for p, (_, d, *_) in zip(prints, rows, strict=True)), key=key)
    assert sorted(((r.doc_id, unsigned(r.fp), r.component_id) for r in got), key=key) == expected
    kept = sh.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(d for d in ids if d is not None) == sorted(v for v in name.values() if v is not None) and ids.count(None) == 2
    assert sh.near_duplicates(df.limit(0)).count() == 0 and sh.keep_one(df.limit(0)).count() == 0


def test_query_columns_on_the_documents(spark):
    got = sh.op1_simhash_grid(spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = got.collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{brute_print(t):016x}" for d, t in texts.items()}
    root = brute_components([int(r.fingerprint, 16) for r in rows])
    lows = {}
    for r in rows:
        k = root[int(r.fingerprint, 16)]
        lows[k] = min(lows.get(k, r.doc_id), r.doc_id)
    assert all(r.component_id == lows[root[int(r.fingerprint, 16)]] for r in rows)
    assert got.where(F.length("fingerprint") != 16).count() == 0


def test_one_row_of_each_component_stays_though_ids_repeat_over_texts(spark):
    rng = random.Random(2)
    x, y, z = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(100)) for _ in range(3))
    rows = [(1, x), (2, x), (2, y), (2, z), (3, z)]
    kept = sh.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted([(1, x), (2, y), (2, z)])


def test_no_table_that_grows_with_the_input_is_broadcast(spark, monkeypatch):
    plans, stored = [], sh.common.materialize

    def noted(df, label):
        made = stored(df, label)
        plans.append((label, df))
        return made

    monkeypatch.setattr(sh.common, "materialize", noted)
    rows = [(i, " ".join(random.Random(i // 3).choices("abcdefgh", k=40)) + " z" * (i % 3)) for i in range(60)]
    plans.append(("result", sh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert {"cells", "low", "links", "groups", "labels"} <= {label for label, _ in plans}
    assert [label for label, df in plans if "Broadcast" in df._jdf.queryExecution().executedPlan().toString()] == []
