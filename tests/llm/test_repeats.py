import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from scrubline.llm import bwt_dedup as bd, repeats as rp, substring_tree as sst

SCHEMA = "text string, doc_id long, n_removed string, start int"


def brute_words(rows, size):
    first = {}
    for text, d in rows:
        w = (text or "").split()
        order = -(2**63) if d is None else d
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, (order, i)), (order, i))
    out = []
    for text, d in rows:
        w = (text or "").split()
        order = -(2**63) if d is None else d
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (order, i):
                gone |= set(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_bytes(rows, size):
    seen = defaultdict(int)
    for text, _ in rows:
        b = (text or "").encode()
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] += 1
    out = []
    for text, d in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "cc", "é", "the", "of", "日"]
    passage = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 60))) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passage)
            cut = rng.randrange(len(p))
            parts.append(rng.choice([p, p[cut:], p[:cut], "".join(rng.choice("abcdefghij \n") for _ in range(rng.randint(0, 90)))]))
        out.append(rng.choice([" ", "", "\n"]).join(parts))
    return [*out, *out[:3], "", None, "ab" * 200, "x" * 300, "a b " * 90, "a", "\x00\x00\x00" * 30, "\x00" * 50]


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def rows_of(seed):
    rows = [(t, 1000 - i) for i, t in enumerate(texts(seed))]
    return rows


@pytest.mark.parametrize("size", [2, 5, 9, 20])
def test_words_equal_brute_force(spark, size):
    rows = rows_of(size)
    df = spark.createDataFrame([(t, d, "x", 1) for t, d in rows], SCHEMA).repartition(3)
    got = sst.remove_repeated_words(df, size, with_text=False).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_words(rows, size), key=key)


@pytest.mark.parametrize("size", [3, 10, 25, 60])
def test_bytes_equal_brute_force(spark, size):
    rows = rows_of(size)
    df = spark.createDataFrame([(t, d, "x", 1) for t, d in rows], SCHEMA).repartition(3)
    got = bd.remove_repeated_bytes(df, size, with_text=False).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_bytes(rows, size), key=key)


def test_repeated_rows_and_null_ids(spark):
    base = rows_of(77)[:25]
    rows = [*base, *base[:4], (base[0][0], None), (base[5][0], None), (None, None), (base[7][0], 1000)]
    df = spark.createDataFrame([(t, d, "x", 1) for t, d in rows], SCHEMA).repartition(2)
    for got, want in (
        (sst.remove_repeated_words(df, 5, with_text=False), brute_words(rows, 5)),
        (bd.remove_repeated_bytes(df, 10, with_text=False), brute_bytes(rows, 10)),
    ):
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_kept_text_and_empty_table(spark):
    df = spark.createDataFrame([("one two three four five six", 1, "", 0), ("zero two three four five seven", 2, "", 0)], SCHEMA)
    assert {r.doc_id: r.kept for r in sst.remove_repeated_words(df, 4).collect()} == {1: "one two three four five six", 2: "zero seven"}
    assert {r.doc_id: bytes(r.kept) for r in bd.remove_repeated_bytes(df, 10).collect()} == {1: b"oneix", 2: b"zeroeven"}
    assert sst.remove_repeated_words(df.limit(0)).count() == 0 and bd.remove_repeated_bytes(df.limit(0)).count() == 0


def test_pieces_of_long_texts_give_all_windows_once(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("ab c") for _ in range(3000)).encode()
    monkeypatch.setattr(rp, "CHUNK", 256)
    monkeypatch.setattr(rp, "POSITION", np.uint64(255))
    rp._powers.cache_clear()
    w = bd.windows(40)
    task = rp._Task(w, 4)
    task.add(1, 1, text)
    task.add(2, 2, text[5:])
    task._chunk()
    starts = sorted((int(k), int(s) + i) for _, _, key_, _, start, _, run in task.records for k, s, r in zip(key_, start, run) for i in range(r + 1))
    assert starts == [(1, i) for i in range(2961)] + [(2, i) for i in range(2956)]
    monkeypatch.undo()
    rp._powers.cache_clear()


def test_common_prefixes_equal_direct_comparison():
    rng = random.Random(9)
    w = bd.windows(40)
    rows = ["".join(rng.choice("ab") for _ in range(w.prefix)) for _ in range(2)]
    sequences = [(rng.randrange(2), "".join(rng.choice("a\x00b") for _ in range(rng.randint(0, 12)))) for _ in range(200)]
    parts = []
    for some in (sequences[:90], sequences[90:120], sequences[120:]):
        some = sorted(some, key=lambda x: (x[0], x[1].encode()))  # a shard comes sorted
        body = [(rows[k] + tail).encode() for k, tail in some]
        n = len(some)
        zero = np.zeros(n, np.int64)
        parts.append(rp.Fragments(np.array([k for k, _ in some], np.uint64), zero, zero, np.arange(n), zero, zero, zero, np.array(list(map(len, body))), np.frombuffer(b"".join(body), np.uint8)))
    f, order, block, shared = bd.merge_shards(parts, w)
    strings = [f.symbols[o : o + s].tobytes() for o, s in zip(f.offset, f.size)]
    assert [strings[r] for r in order] == sorted(strings, key=lambda s: (s[: w.prefix] != rows[0].encode(), s))
    for i in range(1, len(order)):
        a, b = strings[order[i - 1]], strings[order[i]]
        n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[i] == (n if block[i] == block[i - 1] else 0)


@pytest.mark.parametrize("hot_classes, hot_group", [(1, 0), (2, 1), (3, 10**9), (10**9, 2)])
def test_hot_prefixes_give_the_same(spark, hot_classes, hot_group):
    rows = rows_of(31)
    rows += [(f"{i} {i * i} left " + "shared passage of words that many rows hold in common " * 2 + f"right {i * 7} {i}", 5000 + i) for i in range(40)]
    df = spark.createDataFrame([(t, d, "x", 1) for t, d in rows], SCHEMA).repartition(3)
    texts = rp.keyed_texts(df)
    for module, size, brute, columns in ((sst, 6, brute_words, 4), (bd, 20, brute_bytes, 5)):
        spans = rp.repeated_spans(texts, module.windows(size), {sst: sst.subtrees, bd: bd.merge_shards}[module], hot_classes, hot_group)
        schema = module.CUT.rpartition(", kept ")[0]
        got = rp.with_spans(texts, spans).mapInArrow(module._cutter(False), schema).collect()
        assert sorted((tuple(r)[:columns] for r in got), key=key) == sorted(brute(rows, size), key=key)


@pytest.mark.parametrize("n", [399, 400, 401])
def test_passages_about_the_limit(spark, n):
    """A passage of n bytes that three documents share goes from 400 bytes on, in each of them and wholly."""
    rng = random.Random(n)
    noise = lambda m: "".join(rng.choice("abcdefghijklmnop ") for _ in range(m))
    passage = "é" + noise(n - 2)
    rows = [(1, "1" + noise(700) + "A" + passage + "B" + noise(300)), (2, passage), (3, noise(90) + "C" + passage), (4, noise(1200))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in bd.remove_repeated_bytes(df, with_text=False).collect()}
    assert got == {1: (n, 1), 2: (n, 1), 3: (n, 1), 4: (0, 0)} if n >= 400 else set(got.values()) == {(0, 0)}


def test_merging_sorts_no_shard_again():
    """The interleave names shards only: what comes from one shard keeps its order whatever the others hold."""
    rng = random.Random(5)
    w = bd.windows(40)
    parts = []
    for _ in range(6):
        tails = sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 30))).encode() for _ in range(rng.randint(1, 50)))
        body = [b"p" * w.prefix + t for t in tails]
        zero = np.zeros(len(body), np.int64)
        parts.append(rp.Fragments(zero.astype(np.uint64), zero, zero, np.arange(len(body)), zero, zero, zero, np.array(list(map(len, body))), np.frombuffer(b"".join(body), np.uint8)))
    _, rows, _, _ = bd.merge_shards(parts, w)
    first = np.cumsum([0] + [len(p.key) for p in parts])
    for a, b in zip(first, first[1:]):
        assert (np.diff(rows[(rows >= a) & (rows < b)]) > 0).all()
