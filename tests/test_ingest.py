import os
import sys

import pytest
from pyspark import cloudpickle

from quire.sources import connectors
from quire.streaming.control import Paused

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import the tests


class Breaking(connectors.LocalConnector):
    """Breaks off after some bytes of each fetch, and keeps a list of where fetches began."""

    def __init__(self, log, after, never=()):
        self.log, self.after, self.never = log, after, never

    def fetch(self, key, start=0):
        if os.path.basename(key) in self.never and os.path.exists(f"{self.log}.never"):
            raise OSError("gone")
        with open(self.log, "a") as f:
            f.write(f"{os.path.basename(key)} {start}\n")
        data = b"".join(super().fetch(key, start))
        yield data[: self.after]
        if len(data) > self.after:
            raise OSError("broken off")


def test_fetches_go_on_at_their_byte(tmp_path):
    (tmp_path / "x").write_bytes(bytes(range(200)))
    both = connectors.FallbackConnector(*(Breaking(tmp_path / f"log{i}", 70) for i in range(3)))
    assert b"".join(both.fetch(str(tmp_path / "x"))) == bytes(range(200))
    assert [(tmp_path / f"log{i}").read_text() for i in range(3)] == ["x 0\n", "x 70\n", "x 140\n"]
    with pytest.raises(RuntimeError):
        b"".join(connectors.FallbackConnector(Breaking(tmp_path / "log", 70)).fetch(str(tmp_path / "x")))
    assert b"".join(connectors.HttpConnector().fetch((tmp_path / "x").as_uri(), 150)) == bytes(range(150, 200))


def test_ingest_resumes_behind_its_last_batch(spark, tmp_path):
    made = {"a/one.bin": os.urandom(1050), "a/two.bin": os.urandom(10), "empty": b"", "bad.bin": os.urandom(250)}
    for n, data in made.items():
        (tmp_path / "in" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / n).write_bytes(data)
    log, out, cp = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "cp")
    (tmp_path / "log.never").write_text("")
    source = connectors.FallbackConnector(Breaking(str(log), 60, ("bad.bin",)), Breaking(str(log), 1000, ("bad.bin",)))

    def pausing(epoch):
        if epoch == 2:
            raise Paused()

    with pytest.raises(Exception, match="Paused"):
        connectors.ingest(spark, source, str(tmp_path / "in"), out, cp, step=100, workers=4, before=pausing).awaitTermination(200)
    first = log.read_text().splitlines()
    told = connectors.ingest_events(spark, out)
    assert 0 < told.count() < 16 and not connectors.finish(spark, out).filter("complete").filter("name = 'a/one.bin'").count()
    connectors.ingest(spark, source, str(tmp_path / "in"), out, cp, step=100, workers=4).awaitTermination(200)
    again = log.read_text().splitlines()[len(first) :]
    starts = lambda lines: {x for x in lines if int(x.split()[1]) % 100 == 0}
    assert not starts(first) & starts(again)  # no range is fetched twice
    rows = {r["name"]: r for r in connectors.finish(spark, out).collect()}
    assert {n: r["complete"] for n, r in rows.items()} == {n: n != "bad.bin" for n in made}
    (tmp_path / "log.never").unlink()
    connectors.ingest(spark, source, str(tmp_path / "in"), out, cp, step=100, workers=4).awaitTermination(200)  # what failed is planned again
    assert all(r["complete"] and r["size"] == len(made[r["name"]]) for r in connectors.finish(spark, out).collect())
    assert {n: (tmp_path / "out/files" / n).read_bytes() for n in made} == made
    state = {r["task_id"]: r for r in connectors.download_state(connectors.ingest_events(spark, out).filter("status <> 'error'").drop("error_msg")).collect()}
    shown = connectors.download_log(connectors.ingest_events(spark, out).filter("status <> 'error'"))
    assert set(state) == set(made) and state["bad.bin"]["status"] == "done" and shown.filter("task_id = 'a/two.bin'").first()["message"] == "10.0 B / 10.0 B"
