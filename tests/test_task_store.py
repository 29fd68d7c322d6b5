import datetime
import threading

import pytest
from pyspark.sql import functions as F

from quire.operators.task_store import TaskStore, put_new


def registered(spark, root, names, **options):
    store = TaskStore(spark, str(root), **options)
    assert store.register(spark.createDataFrame([(n, 100) for n in names], "file_path string, file_size long")) == len(set(names))
    return store


def paths(df):
    return [r["file_path"] for r in df.orderBy("file_path").collect()]


def test_claims_are_exclusive_among_sessions(spark, tmp_path):
    registered(spark, tmp_path / "s", [f"book/{i:03d}.jpg" for i in range(200)])
    seen, faults = [], []

    def session():
        try:
            own = TaskStore(spark.newSession(), str(tmp_path / "s"), most_changes=10)
            while got := paths(own.claim(7)):
                seen.extend(got)
        except Exception as e:
            faults.append(e)

    threads = [threading.Thread(target=session) for _ in range(6)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not faults and len(seen) == len(set(seen)) == 200
    assert TaskStore(spark, str(tmp_path / "s")).tasks().filter("status = 'IN_PROGRESS'").count() == 200


def test_changes_leave_the_base_and_return_counts(spark, tmp_path):
    store = registered(spark, tmp_path / "s", [f"{b}/{i}.jpg" for b in ("bookA", "bookB", "book_A") for i in range(5)])
    base = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").glob("base-*/*.parquet")}
    again = spark.createDataFrame([("bookA/0.jpg", 5), ("new/1.jpg", 7), ("new/1.jpg", 9)], "file_path string, file_size long")
    assert base and store.register(again) == 1 and store.register(again) == 0
    assert paths(store.claim(2)) == ["bookA/0.jpg", "bookA/1.jpg"] and paths(store.claim(9, "bookB")) == [f"bookB/{i}.jpg" for i in range(5)]
    assert paths(store.claim(0)) == paths(store.claim(5, "none")) == []
    r = [("bookA/0.jpg", True, 0.5, 10.0, None, 1), ("bookA/1.jpg", True, 0.5, 10.0, None, 1), ("bookA/1.jpg", False, 0.0, 1.0, "IOError: x", 2), ("unknown", True, 1.0, 1.0, None, 1)]
    results = spark.createDataFrame(r, "file_path string, success boolean, confidence double, processing_time_ms double, error_msg string, seq int")
    assert store.apply(results, F.lit("2026-01-02 03:04:05").cast("timestamp")) == (1, 1)
    rows = {r["file_path"]: r for r in store.tasks().collect()}
    assert (rows["bookA/0.jpg"]["status"], rows["bookA/1.jpg"]["status"], rows["bookA/1.jpg"]["error_msg"]) == ("DONE", "FAILED", "IOError: x")
    assert rows["bookA/1.jpg"]["updated_at"] == datetime.datetime(2026, 1, 2, 3, 4, 5) and rows["new/1.jpg"]["id"] == 16 and len(rows) == 16
    assert store.reset_hanging("book_A") == 0 and store.reset_hanging("bookB") == 5 and store.retry_failed("bookB") == 0 and store.retry_failed() == 1
    assert store.tasks().filter("status = 'PENDING'").count() == 15 and store.tasks(1).count() == 15
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "s").glob("base-*/*.parquet")} == base
    before = sorted(map(tuple, store.tasks().collect()))
    store.rewrite()
    assert sorted(map(tuple, store.tasks().collect())) == before and store.tidy(keep=1) > 0 and sorted(map(tuple, store.tasks().collect())) == before
    with pytest.raises(ValueError):
        store.restore(store.tasks())


def test_what_stops_before_its_version_changes_nothing(spark, tmp_path, monkeypatch):
    store = registered(spark, tmp_path / "s", ["a/1.jpg", "a/2.jpg"])
    n = store.version()

    def stopped(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr("quire.operators.task_store.put_new", stopped)
        with pytest.raises(KeyboardInterrupt):
            store.claim(1)
    assert store.version() == n and store.tasks().filter("status = 'PENDING'").count() == 2
    assert paths(store.claim(1)) == ["a/1.jpg"]
    assert TaskStore(spark, str(tmp_path / "none")).tasks().count() == 0 and paths(TaskStore(spark, str(tmp_path / "none")).claim(3)) == []


@pytest.mark.parametrize("linked", [None, False])
def test_a_file_is_put_once(spark, tmp_path, linked):
    at = f"file://{tmp_path}/x.json"
    assert put_new(spark, at, b"one", linked) and not put_new(spark, at, b"two", linked)
    assert (tmp_path / "x.json").read_bytes() == b"one" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.json"]
