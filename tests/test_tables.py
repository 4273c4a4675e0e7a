from pyspark.sql import functions as F

from scrubline.sources.tables import spread


def test_small_tables_are_dealt_and_keep_their_rows(spark, tmp_path):
    df = spark.range(1000).select("id", F.lit("x" * 50).alias("t")).coalesce(1)
    df.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    got = spread(read)
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, read.collect()))
    assert spread(read.limit(0)).count() == 0


def test_large_tables_stay_where_they_are(spark):
    df = spark.range(0, 10**9, 1, 3)
    assert spread(df).rdd.getNumPartitions() == 3
