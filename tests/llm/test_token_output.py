import random
import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from scrubline.llm import common, encoding, token_output as to

FMT = to.production_format()
PIECES = ["hello", "wörld", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "don't", "123", "<|endoftext|>", "日本語", ".", "\x1c", "e\u0301", "É", "🙂", "'s", "a_b", "\u0345"]


def random_texts(n=300):
    rng = random.Random(2)
    return ["", " ", "\n", "a ", " a", "a  b", *("".join(rng.choice(PIECES) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(n))]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def unpack(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def test_memoised_encoding_equals_the_library():
    for name, cls in (("byte_bpe_50k.json", encoding.ByteLevelEncoder), ("word_bpe_49k.json", encoding.WordEncoder)):
        mine, theirs = cls(public_tokenizers.path(name)), library(name)
        for text in random_texts():
            assert unpack(mine(text)) == theirs(text), (name, text)


def test_round_trip_order_and_index(spark):
    rows = [(t, i * 3 % 307, "x", 1) for i, t in enumerate(random_texts())] + [(None, 1000, "", 0), (None, None, "", 0), ("dup", 5000, "", 0), ("dup", 5000, "", 0), ("z " * 90000, 4000, "", 0)]
    docs = spark.createDataFrame(rows, "text string, doc_id long, start string, n_tokens int").repartition(5)
    path = common.scratch_path(spark, "t")
    to.write_tokens(docs, path, FMT)
    encode = library("byte_bpe_50k.json")
    at, expected = 0, []
    for text, d, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0] is not None, (r[0] or "").encode())):
        ids = encode(text) + [0]
        expected.append((d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    got = to.read_index(spark, path).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert to.fetch(spark, path, [1000, 5000, -9]) == {1000: [[0]], 5000: [encode("dup") + [0]] * 2, -9: []}
    assert spark.read.parquet(f"{path}/dictionary").first().dict_sha256


def test_empty_and_tiny_tables(spark):
    docs = spark.createDataFrame([("one", 1)], "text string, doc_id long")
    for df, n in ((docs.limit(0), 0), (docs, 1)):
        path = common.scratch_path(spark, "t")
        to.write_tokens(df, path, FMT)
        assert to.read_index(spark, path).count() == n
