import struct
import zlib
from collections import defaultdict

from tokenizers import Tokenizer

import corpus_pipeline
from scrubline.llm import packing, pii, quality_rules as qr

from .test_decontam import brute as brute_contamination
from .test_minhash import brute_keep
from .test_quality_rules import brute as brute_base

DATA = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    judge = qr.Judge(qr.production_rules())
    kept = {d: r.text for d, r in docs.items() if not brute_base(r.text)[5] and judge(r.text.encode(), r.lang)["kept"]}
    kept = {d: kept[d] for d in brute_keep(list(kept.items()))}
    bad = brute_contamination(list(kept.items()), items)
    rewrite = pii.Rewriter(pii.session_key(spark))
    kept = {d: rewrite(t)[0] for d, t in kept.items() if not bad[d][3]}
    lib = Tokenizer.from_file(packing.production_tokenizer())
    expected = []
    for d, t in kept.items():
        ids = lib.encode(t, add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected.append((d, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(expected)
    used = defaultdict(int)
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(used) <= -(-sum(used.values()) // 4096) + 1


def test_stages_hand_on_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.limit(0).count() == 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_stages_take_nulls_ties_repeats_and_any_columns(spark):
    rng = __import__("random").Random(4)
    long = " ".join("".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(60))
    rows = [(1, long, "zz"), (1, long, "zz"), (2, None, None), (None, long + " end", "zz"), (3, "", "xx"), (4, long + " 97.51.17.173", None)]
    fields = "doc_id long, text string, lang string, source string, n_chars long, _row int, _node int, doc string, `a.b` int, kept int"
    df = spark.createDataFrame([(d, t, g, None, None, 1, 2, "d", 3, 0) for d, t, g in rows], fields)
    items = spark.createDataFrame([(9, "no such words here")], "item_id long, text string")
    expected = {
        "quality rules": [(1, 1), (1, 1), (4, 1), (None, 1)], "simhash near-dedup": [(1, 1), (2, None), (None, 1)], "benchmark decontamination": [(1, 1), (1, 1), (2, None), (3, 0), (4, 1), (None, 1)],
        "pii": [(1, 1), (1, 1), (2, None), (3, 0), (4, 1), (None, 1)],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = corpus_pipeline.decontam.drop_contaminated(df, items) if name.startswith("bench") else stage(spark, df, DATA)
        assert got.columns == df.columns, name
        kept = got.collect()
        assert sorted([(r.doc_id, None if r.text is None else int(r.text != "")) for r in kept], key=repr) == sorted(expected[name], key=repr), name
        assert {tuple(r)[5:] for r in kept} == {(1, 2, "d", 3, 0)}, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, df, DATA).collect()
    assert len(pieces) == len(rows) and sum(r.length for r in pieces if r.doc_id in (2, 3)) == 2
