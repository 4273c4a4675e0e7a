import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from scrubline.llm import packing as pk

PATH = pk.production_tokenizer()


def best_sum(counts, gap):
    """All singles, pairs and triples of available lengths that sum to gap."""
    have = Counter({i: int(c) for i, c in enumerate(counts) if c})
    lengths = sorted(have)
    found = []
    for a in lengths:
        for combo in [(a,), *((a, b) for b in lengths if b >= a), *((a, b, c) for b in lengths if b >= a for c in lengths if c >= b)]:
            if sum(combo) == gap and not Counter(combo) - have:
                found.append(combo)
    return found


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 3), max_size=8), st.integers(1, 40))
def test_complement_finds_an_exact_sum_iff_there_is_one(have, gap):
    counts = np.zeros(60, np.int64)
    for x, n in have.items():
        counts[x] = n
    got = pk.ComplementIndex(counts).complement(gap)
    every = best_sum(counts, gap)
    assert (got is not None) == bool(every)
    assert got is None or tuple(sorted(got)) in every


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=20))
def test_plan_places_each_piece_once_and_slots_agree(have):
    counts = np.zeros(33, np.int64)
    for x, n in have.items():
        counts[x] = n
    patterns = pk.plan(counts, 32)
    used = Counter()
    for p, times in patterns:
        assert sum(p) <= 32 and times >= 1
        for x in p:
            used[x] += times
    assert used == Counter(have)
    slots = pk.Slots.of(patterns)
    rows = [(x, r) for x, n in have.items() for r in range(n)]
    if rows:
        check_gapless([(s, o, x) for (x, _), s, o in zip(rows, *slots.place(*(np.array(v) for v in zip(*rows))), strict=True)], 32)


def check_gapless(places, capacity):
    by = defaultdict(list)
    for s, o, n in places:
        by[s].append((o, n))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_few_sequences():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(4096, rng.lognormal(6.3, 1, 20000).astype(int) + 1), minlength=4097)
    n = sum(t for _, t in pk.plan(counts, 4096))
    assert n <= -(-int((counts * np.arange(4097)).sum()) // 4096) + 3


def test_packing_documents(spark):
    texts = ["", None, "a b c", "Straße É ǅ", "word " * 10000, "x" * 50, "a b c", "a b c", *("lorem ipsum " * k for k in range(60))]
    rows = [(t, i if i != 7 else 6, "k", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "text string, doc_id long, piece string, length int")
    for capacity in (4096, 64):
        got = pk.pack_documents(df, PATH, capacity).collect()
        lib = Tokenizer.from_file(PATH)
        lib.encode_special_tokens = True
        expected = []
        for t, d, *_ in rows:
            ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                expected.append((d, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
        assert sorted(tuple(r)[:5] for r in got) == sorted(expected)
        n = check_gapless([(r.sequence_id, r.offset, r.length) for r in got], capacity)
        assert n <= -(-sum(r.length for r in got) // capacity) + 2
    assert pk.pack_documents(df.limit(0), PATH).count() == 0


def test_encoding_of_the_documents_equals_the_library(spark):
    import public_tokenizers

    from scrubline.llm import encoding

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for name, cls in (("word_bpe_49k.json", encoding.WordEncoder), ("byte_bpe_50k.json", encoding.ByteLevelEncoder)):
        mine, lib = cls(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        assert all(mine(t) == encoding.pack(e.ids) for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True))
