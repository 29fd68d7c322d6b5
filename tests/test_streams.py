import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from quire.operators import assembly, imaging
from quire.operators.task_store import TaskStore
from quire.sources import connectors
from quire.streaming import control, logs


def batches(spark, df, folder, cuts):
    """Files of df's rows between places, to be read one a micro-batch."""
    rows = df.orderBy("ts", "seq").collect()
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")


def streamed(spark, df, folder, make, checkpoint):
    """All rows that a stream over the files of folder gives, by batch."""
    got = []
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    query = make(source).writeStream.outputMode("update").foreachBatch(lambda b, n: got.append(b.collect())).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(100)
    query.stop()
    return got


def test_last_lines_of_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(5)
    at = datetime.datetime(2026, 1, 1)
    rows = [(rng.choice(["a", "b", None]), at + datetime.timedelta(seconds=i // 2), i, rng.choice(["x", "y", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "job string, ts timestamp, seq long, message string")
    batches(spark, df, tmp_path / "in", [10, 11, 60])
    make = lambda s: logs.last_lines(s, "job", "message", keep=12)
    first = streamed(spark, df, tmp_path / "in", make, tmp_path / "cp")
    more = spark.createDataFrame([("a", at + datetime.timedelta(seconds=100 + i // 3), 200 + i, "xyz"[i % 3]) for i in range(9)], df.schema)
    batches(spark, more, tmp_path / "in/later", [4])
    second = streamed(spark, df, tmp_path / "in", make, tmp_path / "cp")  # goes on from the checkpoint
    assert len(first) >= 4 and len(second) == 2
    every = df.union(more)
    new, ring = [], {}
    for batch in [*first, *second]:
        new += [(r["key"], r["seq"]) for r in batch if r["kind"] == "new"]
        for k in {r["key"] for r in batch}:
            ring[k] = sorted(r["seq"] for r in batch if r["key"] == k and r["kind"] == "last")
    said = every.withColumn("message", F.coalesce("message", F.lit("null")))
    said = said.withColumn("job", F.coalesce("job", F.lit("none")))
    assert sorted((k or "none", s) for k, s in new) == sorted((r["job"], r["seq"]) for r in assembly.changed_logs(said, "job", ["ts", "seq"], "message").collect())
    want = {}
    for r in assembly.last_logs(said, "job", ["ts", "seq"], 12).collect():
        want.setdefault(r["job"], []).append(r["seq"])
    assert {k or "none": v for k, v in ring.items()} == {k: sorted(v) for k, v in want.items()}


def test_throttled_downloads_of_a_stream_equal_the_batch(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    rows = [(t, at + datetime.timedelta(milliseconds=70 * i), i, i * 10, None if t == "v" else 390) for t in ("u", "v") for i in range(40)]
    df = spark.createDataFrame(rows, "task_id string, ts timestamp, seq long, current long, total long")
    batches(spark, df, tmp_path / "in", [3, 30, 31, 64])
    got = [tuple(r) for b in streamed(spark, df, tmp_path / "in", logs.throttled, tmp_path / "cp") for r in b]
    want = [tuple(r) for r in connectors.download_log(df.drop("seq")).join(df.select("task_id", "ts", "seq"), ["task_id", "ts"]).select("task_id", "ts", "seq", "current", "total", "percent", "message").collect()]
    assert sorted(got) == sorted(want, key=lambda x: x) and len(got) < len(rows)


def test_state_of_silent_keys_expires(spark, tmp_path):
    df = spark.createDataFrame([("a", datetime.datetime(2026, 1, 1), 1, "x")], "job string, ts timestamp, seq long, message string")
    batches(spark, df, tmp_path / "in", [])
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)
    try:
        for expiry, kinds in ((None, ["last"]), (1, ["last", "new"])):
            make = lambda s, e=expiry: logs.last_lines(s, "job", "message", expiry_ms=e)
            streamed(spark, df, tmp_path / "in", make, tmp_path / f"cp{expiry}")
            batches(spark, df.withColumn("seq", F.lit(2).cast("long")), tmp_path / f"in/again{expiry}", [])
            got = streamed(spark, df, tmp_path / "in", make, tmp_path / f"cp{expiry}")
            assert sorted({r["kind"] for b in got for r in b if r["seq"] == 2}) == kinds
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_another_process_pauses_resumes_and_retries(spark, tmp_path):
    root = tmp_path / "in"
    (root / "b").mkdir(parents=True)
    names = [f"b/{i}.png" for i in range(6)] + ["b/bad.png"]
    for i, n in enumerate(names):
        (root / n).write_bytes(imaging.encode_png(np.full((4, 4, 3), i, np.uint8)) if "bad" not in n else b"broken")
    store = TaskStore(spark, str(tmp_path / "store"))
    store.register(spark.createDataFrame([(n, 1) for n in names], "file_path string, file_size long"))
    store.claim(100)
    here, there = control.Control(spark, str(tmp_path / "control")), control.Control(spark.newSession(), str(tmp_path / "control"))
    done = []

    def pausing(batch, epoch):
        done.append(epoch)
        if epoch == 1 and len(done) == 2:
            there.say("b", "pause")

    run = lambda: control.run_job(spark, here, "b", str(root), str(tmp_path / "out"), str(tmp_path / "cp"), store, batch_size=2, more=[pausing])
    assert here.state("b") == "idle" and run() == "paused" and done == [0, 1]
    count = lambda s: store.tasks().filter(F.col("status").isin(*s)).count()
    assert count(["DONE", "FAILED"]) == 4 and run() == "paused" and done == [0, 1]
    assert control.job_states(here, store.tasks()).first()["status"] == "paused"
    there.say("b", "resume")
    assert run() == "completed" and done == [0, 1, 2, 3] and here.state("b") == "completed"
    assert count(["DONE"]) == 6 and count(["FAILED"]) == 1
    assert control.job_states(here, store.tasks()).first()["status"] == "has_failed"
    assert control.retry(there, store, "b") == 1 and count(["PENDING"]) == 1 and here.state("b") == "processing"
    here.say("b", "error", "no service")
    assert control.job_states(here, store.tasks()).first()["status"] == "error" and [r["order"] for r in here.orders().orderBy("n").collect()] == ["start", "pause", "resume", "done", "retry", "error"]


def test_a_fault_is_told(spark, tmp_path):
    (tmp_path / "in/b").mkdir(parents=True)
    (tmp_path / "in/b/1.png").write_bytes(imaging.encode_png(np.zeros((2, 2, 3), np.uint8)))

    def broken(batch, epoch):
        raise RuntimeError("disk full")

    c = control.Control(spark, str(tmp_path / "c"))
    assert control.run_job(spark, c, "b", str(tmp_path / "in"), str(tmp_path / "o"), str(tmp_path / "cp"), more=[broken]) == "error"
    assert "disk full" in c.orders().filter("order = 'error'").first()["note"]
