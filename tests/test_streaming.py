from loomstead.streaming.incremental import append_new_keys, windowed_counts


def test_stream_equals_batch(spark, sf):
    path = f"{sf}/events.parquet"
    static = spark.read.parquet(path)
    stream = spark.readStream.schema(static.schema).parquet(f"{sf}/event[s].parquet")
    q = windowed_counts(stream, "ts", "event_type", "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("counts").select("window_start", "event_type", "n").collect()}
    want = {tuple(r) for r in windowed_counts(static, "ts", "event_type", "1 day").select("window_start", "event_type", "n").collect()}
    assert got == want and got


def test_incremental_load(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1).write.parquet(src)
    for turn in range(2):
        append_new_keys(spark.readStream.schema("k int, v string").parquet(src), out, ["k"], str(tmp_path / f"cp{turn}")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
