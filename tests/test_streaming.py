import shutil

from pyspark.sql import functions as F

from larkspan.streaming import queues


def test_job_states():
    job = queues.step(None, "add", 0)
    job = queues.step(job, "claim", 0)
    assert job["status"] == queues.RUNNING and job["attempts"] == 1
    dirty = queues.step(job, "add", 1)
    assert dirty["dirty"] and queues.step(dirty, "done", 2) == {"status": queues.QUEUED, "dirty": False, "attempts": 0, "available_at": 2}
    failed = queues.step(job, "fail", 5)
    assert failed["available_at"] == 6 and queues.step(failed, "claim", 5) == failed
    assert queues.step(job, "release", 3)["attempts"] == 0 and queues.step(job, "restart", 3)["status"] == queues.QUEUED
    assert queues.step(job, "done", 9) is None and queues.step(None, "claim", 1) is None
    assert [queues.delay(i) for i in (1, 2, 7, 99)] == [1, 2, 60, 60]


def test_captures():
    assert queues.capture_times([0]) == [1]
    assert queues.capture_times([0, 5, 9]) == [1, 19]
    assert queues.capture_times([0, *range(5, 60, 5)])[1] == 35


def _log(spark, path, n=60):
    ops = [(f"d{i % 7}", i, ["add", "claim", "done", "fail", "add", "restart"][(i * 5) % 6], i * 3) for i in range(n)]
    df = spark.createDataFrame(ops, "doc_id string, seq long, op string, at long")
    for lo in range(0, n, 20):
        df.filter(f"seq >= {lo} and seq < {lo + 20}").coalesce(1).write.mode("append").parquet(path)
    return df


def test_stream_ends_in_the_batch_state(spark, tmp_path):
    df = _log(spark, str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = queues.embedding_queue(stream).writeStream.outputMode("update").format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("jobs").groupBy("doc_id").agg(F.max_by(F.struct("status", "dirty", "attempts", "available_at"), "seq").alias("j")).filter("j.status != 'gone'")
    batch = queues.replayed_queue(df)
    assert {(r["doc_id"], *r["j"]) for r in last.collect()} == {(r["doc_id"], r["status"], r["dirty"], r["attempts"], r["available_at"]) for r in batch.collect()}


def test_latest_ops_per_micro_batch(spark, tmp_path):
    rows = [("a", 1, "add"), ("a", 2, "delete"), ("b", 3, "add")]
    df = spark.createDataFrame(rows, "key string, seq long, op string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    queues.latest_ops(stream, lambda b, i: seen.extend((r["key"], r["op"]) for r in b.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [("a", "delete"), ("b", "add")]


def test_running_visits(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    (tmp_path / "in").mkdir()
    shutil.copy(f"{data}/events.parquet", tmp_path / "in" / "events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    cols = lambda df: queues.visit_counts(df.select("user_id", F.col("event_type").alias("query"), "ts"))
    q = cols(stream).writeStream.outputMode("complete").format("memory").queryName("visits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: {(r["user_id"], r["query"], r["visits"]) for r in df.collect()}
    assert key(spark.table("visits")) == key(cols(events))


def test_bursts(spark):
    rows = [("p", "2024-01-01 00:00:00.000", "add"), ("p", "2024-01-01 00:00:00.150", "delete"), ("p", "2024-01-01 00:00:01.000", "add")]
    df = spark.createDataFrame(rows, "path string, ts string, op string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["changes"], r["op"]) for r in queues.debounced(df).collect()) == [(1, "add"), (2, "delete")]
