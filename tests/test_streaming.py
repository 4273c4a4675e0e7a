import datetime

from pyspark.sql import functions as F

from scrubline.plans import samples
from scrubline.sources import files
from scrubline.streaming import queue


def test_media_files_are_cleaned_as_they_arrive(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name in ("jpeg_rich", "png_rich", "png_critical", "text"):
        (inbox / name).write_bytes(samples.samples()[name])
    for late in (None, "gif_rich"):
        if late:
            (inbox / late).write_bytes(samples.samples()[late])
        q = queue.start(queue.media_stream(spark, str(inbox)), str(tmp_path / "out"), str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
    got = {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: (r.status, r.batch) for k, r in got.items()} == {"jpeg_rich": ("DONE", 0), "png_rich": ("DONE", 0), "png_critical": ("FAILED", 0), "text": ("FAILED", 0), "gif_rich": ("DONE", 1)}
    assert got["png_critical"].error.startswith("PNG: unknown critical chunk") and got["jpeg_rich"].has_ai and got["jpeg_rich"].data


def test_batches_finish_once(spark, tmp_path):
    src = tmp_path / "events"
    schema = "batch long, id long, status string"
    steps = [[(1, 1, "QUEUED"), (1, 2, "DONE"), (2, 3, "WORKING")], [(1, 1, "FAILED")], [(2, 3, "DONE"), (1, 2, "DONE")]]
    q = None
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = queue.finished_once(spark.readStream.schema(schema).parquet(str(src)))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("batch", "items", "failed").collect())) == [(1, 2, 1), (2, 1, 0)]


def test_text_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a\u200bb\nc ")
    q = queue.clean_text_stream(queue.text_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("cleaned_texts").start()
    q.processAllAvailable()
    q.stop()
    assert [r.cleaned.text for r in spark.table("cleaned_texts").collect()] == ["ab\nc"]


def test_controls(spark):
    items = spark.createDataFrame([(1, "DONE"), (2, "WORKING"), (3, "FAILED"), (4, "QUEUED"), (5, "DONE")], "id long, status string").withColumn("original_deleted", F.lit(None).cast("boolean"))
    controls = spark.createDataFrame([(3, "retry"), (2, "remove"), (4, "remove"), (1, "clear"), (5, "originals_deleted")], "id long, action string")
    got = {r.id: (r.status, r.original_deleted) for r in queue.apply_controls(items, controls).collect()}
    assert got == {2: ("WORKING", False), 3: ("QUEUED", False), 5: ("DONE", True)}
    assert queue.pending(items).first().pending == 2


def test_debounce(spark):
    t = datetime.datetime(2024, 1, 1)
    at = lambda ms: t + datetime.timedelta(milliseconds=ms)
    rows = [(1, at(0), "a"), (1, at(30), "ab"), (1, at(200), "abc"), (2, at(0), "x" * 20001), (2, at(200), "y" * 20001), (2, at(600), "z")]
    got = queue.debounced(spark.createDataFrame(rows, "user_id long, ts timestamp, text string")).collect()
    assert sorted((r.user_id, r.text[:3]) for r in got) == [(1, "ab"), (1, "abc"), (2, "yyy"), (2, "z")]


def test_sources(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.txt").write_bytes("é\r\nb\n".encode())
    (tmp_path / "s" / "big.txt").write_bytes(b"x" * 100)
    small, large = files.binary_files(spark, [str(tmp_path / "s")], 50)
    assert small.count() == 1 and [r.error for r in large.collect()] == ["too_large"]
    texts = {r.path[-5:]: (r.text, r.error) for r in files.text_files(spark, str(tmp_path / "s"), 50).collect()}
    assert texts == {"a.txt": ("é\nb", None), "g.txt": (None, "too_large")}
    manifest = spark.createDataFrame([(small.first().path, "text/plain")], "path string, mime string")
    got = {r.name: r.mime for r in files.describe(spark.read.format("binaryFile").load(str(tmp_path / "s")), manifest).collect()}
    assert got == {"a.txt": "text/plain", "big.txt": None}
    assert files.heads(small, 2).first().head == "é".encode()


def test_names(spark):
    rows = [("ChatGPT x.png", "IMAGE", 7, False), ("my:pic.v2.jpg", "IMAGE", 8, False), (".png", "VIDEO", 9, False), ("a.mov", "VIDEO", 110, True)]
    df = spark.createDataFrame(rows, "name string, kind string, n int, neutral boolean")
    got = [r[0] for r in df.select(files.output_name(F.col("name"), F.col("kind"), F.lit("S"), F.col("n"), F.col("neutral"))).collect()]
    assert got == ["IMG_S_07", "my_pic.v2_clean", "file_clean", "VID_S_10"]
    same = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4)], "name string, k int")
    assert sorted(r.unique_name for r in files.number_collisions(same, "name", "k").collect()) == ["a", "a_1", "a_2", "b"]
    sizes = spark.createDataFrame([(None,), (5,), (1536,), (3 << 20,), (5 << 30,)], "n long").select(files.human_size(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["—", "5 B", "1.5 KB", "3.0 MB", "5.0 GB"]


def test_videos_in_path_mode(spark, tmp_path):
    for name in ("mp4_rich", "mp4_fragmented"):
        (tmp_path / f"{name}.mp4").write_bytes(samples.samples()[name])
    out = tmp_path / "out"
    out.mkdir()
    got = {r.path.rsplit("/", 1)[1]: r for r in files.write_videos(spark.read.format("binaryFile").load(str(tmp_path / "*.mp4")), str(out)).collect()}
    assert got["mp4_rich.mp4"].bytes == (out / "mp4_rich_clean.mp4").stat().st_size and got["mp4_rich.mp4"].removed == 6
    assert "fragmented" in got["mp4_fragmented.mp4"].error and [p.name for p in out.iterdir()] == ["mp4_rich_clean.mp4"]


def test_cli_and_sql_names(spark, tmp_path, capsys):
    from scrubline import cli, sql

    (tmp_path / "p.png").write_bytes(samples.png_rich())
    assert cli.scan(spark, [str(tmp_path / "p.png")]) == 1
    assert "[AI] AI_PARAMETERS @ tEXt:parameters" in capsys.readouterr().out
    assert cli.clean(spark, [str(tmp_path / "p.png")], str(tmp_path / "o"), cli.StripOptions()) == 0
    assert "p.png -> p_clean.png: CLEAN" in capsys.readouterr().out and (tmp_path / "o" / "p_clean.png").exists()
    assert cli.text(spark, "**a**\u200b\nb", True) == 0 and capsys.readouterr().out == "a\nb\n"
    sql.register(spark)
    spark.createDataFrame([("a\u200bb",)], "t string").createOrReplaceTempView("hidden_in")
    assert [tuple(r) for r in spark.sql("SELECT h.* FROM hidden_in, LATERAL find_hidden(t) h").collect()] == [(1, 0x200B, "INVISIBLE")]
    assert spark.sql("SELECT sniff_format(X'FFD8FFE000104A4649460001')").first()[0] == "JPEG"


def test_outputs_of_one_base_name_are_numbered(spark, tmp_path):
    from scrubline.plans import samples

    for folder in "abc":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.v1.mp4").write_bytes(samples.mp4_rich())
    out = tmp_path / "out"
    out.mkdir()
    got = files.write_videos(spark.read.format("binaryFile").load(str(tmp_path / "*" / "*.mp4")), str(out)).collect()
    assert all(r.error is None for r in got)
    assert sorted(p.name for p in out.iterdir()) == ["x.v1_clean.mp4", "x.v1_clean_1.mp4", "x.v1_clean_2.mp4"]
    written = spark.createDataFrame([*map(tuple, got), ("gone.mp4", str(out / "none"), 1, 1, None)], "path string, output string, bytes long, removed long, error string")
    confirmed = written.where("path LIKE '%/a/%' OR path = 'gone.mp4'")
    told = files.delete_originals(written, confirmed).collect()
    assert sorted((r.path[-15:], r.deleted) for r in told) == [(got_path[-15:], ok) for got_path, ok in sorted([(str(tmp_path / "a" / "x.v1.mp4"), True), ("gone.mp4", False)], key=lambda x: x[0][-15:])]
    assert [p.exists() for p in (tmp_path / "a" / "x.v1.mp4", tmp_path / "b" / "x.v1.mp4")] == [False, True]


def test_many_files_of_one_name_are_numbered_without_a_gap(spark):
    df = spark.range(5000).selectExpr("id AS k", "IF(id % 7 = 0, 'rare' || id, 'video') AS name", "1 AS _salt")
    got = files.number_collisions(df, "name", "k")
    assert got.columns == ["k", "name", "_salt", "unique_name"]
    n = df.where("name = 'video'").count()
    assert sorted(r.unique_name for r in got.where("name = 'video'").collect()) == sorted(["video", *(f"video_{i}" for i in range(1, n))])


def test_oversized_texts_are_not_read(spark, tmp_path):
    (tmp_path / "small").write_text("ok\r\n")
    (tmp_path / "large").write_text("x" * 100)
    got = files.text_files(spark, str(tmp_path), 50)
    assert sorted((r.path[-5:], r.text, r.error) for r in got.collect()) == [("large", None, "too_large"), ("small", "ok", None)]
    assert "LessThanOrEqual(length,50)" in got._jdf.queryExecution().toString()


def test_only_line_ends_split_lines():
    from scrubline import cli

    assert cli.lines("a b\x0bc\x85d\r\ne\rf\n") == "a b\x0bc\x85d\ne\nf"


def test_reported_batches_are_forgotten(spark, tmp_path):
    src, out = tmp_path / "events", tmp_path / "out"
    schema = "batch long, id long, status string, ts timestamp"
    t = datetime.datetime(2024, 1, 1)
    steps = [[(1, 1, "DONE", t)], [(2, 2, "DONE", t + datetime.timedelta(hours=9))], [(3, 3, "QUEUED", t + datetime.timedelta(hours=20))]]
    sizes = []
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = queue.finished_once(spark.readStream.schema(schema).parquet(str(src)), "ts", "1 hour", 1000)
        q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        sizes.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
        q.stop()
    assert sorted(map(tuple, spark.read.parquet(str(out)).select("batch", "items", "failed").collect())) == [(1, 1, 0), (2, 1, 0)]
    assert sizes[-1] <= 2  # batch 1 at least is gone
