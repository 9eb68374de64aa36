import datetime as dt


from leafline.streaming import flows


def drain(df, mode, name, path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_job_states_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "queued", 0.0, None, t), (1, "cancelled", 1.0, None, t + dt.timedelta(1)), (1, "done", 1.0, None, t + dt.timedelta(2)), (2, "done", 1.0, None, t)]
    cols = "id long, status string, progress double, error string, updated_at timestamp"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "in"))
    out = drain(flows.job_states(spark.readStream.schema(cols).parquet(str(tmp_path / "in"))), "complete", "job_states", tmp_path / "c")
    assert {r["id"]: r["status"] for r in out.collect()} == {1: "cancelled", 2: "done"}


def test_enqueues_and_bursts(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    cols = "document_id string, type string, ts timestamp"
    spark.createDataFrame([("a", "index", t), ("a", "index", t + dt.timedelta(seconds=1)), ("b", "index", t + dt.timedelta(seconds=9))], cols).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(cols).parquet(str(tmp_path / "in"))
    assert drain(flows.enqueues(read()), "append", "enqueues", tmp_path / "c1").count() == 2
    batch = flows.debounced(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(r["events"] for r in batch.collect()) == [1, 2]


def test_snapshots_by_tick(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    cols = "id string, path string, rel_path string, title string, ext string, size long, mtime double, sha256 string"
    state = spark.createDataFrame([("a", "a", "a", "a", ".txt", 1, 1.0, None, "ready", False, t, t)], cols + ", status string, deleted boolean, created_at timestamp, updated_at timestamp")
    snap = spark.createDataFrame([("b", "b", "b", "b", ".txt", 1, 1.0, None)], cols)
    spark.createDataFrame([(1,)], "n int").write.parquet(str(tmp_path / "ticks"))
    seen = []
    ticks = spark.readStream.schema("n int").parquet(str(tmp_path / "ticks"))
    q = flows.poll_snapshots(ticks, lambda: snap, lambda: state, lambda out, b: seen.extend((r["id"], r["change"]) for r in out["documents"].collect()), str(tmp_path / "c"), once=True)
    q.awaitTermination(120)
    assert sorted(seen) == [("a", "deleted"), ("b", "new")]
