import numpy as np

from scrubline.llm import classifier as c

DATA = "/root/testdata/sf0.01"


def walk(forest, x):
    """One tree and one row at a time."""
    out = []
    for row in x:
        margin = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            while f[node] >= 0:
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            margin += v[node]
        out.append(1 / (1 + np.exp(-margin)))
    return np.array(out)


def test_flat_traversal_equals_a_walk_and_trees_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = c.train(x[:2000], y[:2000], c.Params(trees=60))
    s = forest.scores(x[2000:])
    assert np.allclose(s, walk(forest, x[2000:]))
    assert ((s > 0.5) == y[2000:]).mean() > 0.95


def test_no_label_or_one_class():
    x = np.zeros((4, 5))
    assert np.allclose(c.train(x[:0], np.zeros(0), c.Params()).scores(x), 0.5)
    assert np.allclose(c.train(x, np.ones(4), c.Params()).scores(x), 1, atol=1e-5)


def test_held_out_accuracy_on_documents(spark):
    got = c.op10_quality_gbt(spark, DATA).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().set_index("doc_id")
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(got.held_out[i] == c.held_out(i) for i in got.index)
    both = got[got.held_out].join(labels, how="inner")
    assert (both.predicted == both.quality).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [("a b c. " * 9, 1, 1, "l"), (None, 2, 0, "l"), ("", 3, 1, None), ("x" * 300000, 4, 0, ""), ("a b c. " * 9, 1, 1, "l"), (" \n", None, 1, "")],
        "text string, doc_id long, quality int, lang string",
    )
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (4, 0, 1), (4, 1, 1), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    got = c.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert c.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in c.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(c.fold_of() == c.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda df: sorted((r.doc_id, r.score) for r in df.collect())
    assert key(c.classify(docs, labels)) == key(c.classify(docs, turned))
