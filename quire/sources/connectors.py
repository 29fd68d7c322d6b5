"""Remote stores behind one small interface: listing, fetching in tasks, falling back, and lazy fetching of what is missing.

No client of a particular service is part of the package; a connector is any object with list() and fetch().
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import format_bytes, progress_percent

#: Bytes of a chunk, and workers that fetch at a time.
CHUNK, WORKERS = 512 * 1024, 4


class Connector(Protocol):
    """A remote store; it is sent to the tasks, so it must be picklable."""

    def list(self, link: str) -> list[tuple[str, str, int | None]]:
        """(name, key, size if known) of the files behind a link to a file or a folder."""

    def fetch(self, key: str, start: int = 0) -> Iterator[bytes]:
        """The chunks of one file from a byte on."""


class LocalConnector:
    """A folder as a remote store: for tests and mounted drives."""

    def list(self, link: str) -> list[tuple[str, str, int | None]]:
        import os

        if os.path.isfile(link):
            return [(os.path.basename(link), link, os.path.getsize(link))]
        return [(os.path.relpath(os.path.join(d, n), link), os.path.join(d, n), os.path.getsize(os.path.join(d, n))) for d, _, names in sorted(os.walk(link)) for n in sorted(names)]

    def fetch(self, key: str, start: int = 0) -> Iterator[bytes]:
        with open(key, "rb") as f:
            f.seek(start)
            while chunk := f.read(CHUNK):
                yield chunk


class HttpConnector:
    """Files by URL, in chunks, with the standard library."""

    def __init__(self, timeout: float = 60.0):
        self.timeout = timeout

    def list(self, link: str) -> list[tuple[str, str, int | None]]:
        return [(link.split("?")[0].rstrip("/").rsplit("/", 1)[-1] or "file", link, None)]

    def fetch(self, key: str, start: int = 0) -> Iterator[bytes]:
        from urllib.request import Request, urlopen

        with urlopen(Request(key, headers={"Range": f"bytes={start}-"} if start else {}), timeout=self.timeout) as f:
            skip = start if getattr(f, "status", None) != 206 else 0  # a server that gives no ranges sends all
            while skip and (gone := f.read(min(skip, CHUNK))):
                skip -= len(gone)
            while chunk := f.read(CHUNK):
                yield chunk


class FallbackConnector:
    """The first of several connectors that answers; a fetch that breaks off goes on at its byte with the next one."""

    def __init__(self, *connectors: Connector):
        self.connectors = connectors

    def _first(self, call):
        fault: Exception | None = None
        for c in self.connectors:
            try:
                return call(c)
            except Exception as e:
                fault = e
        raise RuntimeError(f"no connector answers: {fault}")

    def list(self, link: str) -> list[tuple[str, str, int | None]]:
        return self._first(lambda c: c.list(link))

    def fetch(self, key: str, start: int = 0) -> Iterator[bytes]:
        fault: Exception | None = None
        for c in self.connectors:
            try:
                for chunk in c.fetch(key, start) if start else c.fetch(key):
                    start += len(chunk)
                    yield chunk
                return
            except Exception as e:
                fault = e
        raise RuntimeError(f"no connector answers: {fault}")


class Throttle:
    """Passes a message on at most every `every` seconds, and always the last one of a file."""

    def __init__(self, callback: Callable[[str, float], None] | None, every: float = 0.25, clock: Callable[[], float] = time.monotonic):
        self.callback, self.every, self.clock, self.last = callback, every, clock, float("-inf")

    def __call__(self, message: str, percent: float, final: bool = False) -> None:
        now = self.clock()
        if self.callback and (final or now - self.last >= self.every):
            self.last = now
            self.callback(message, percent)


def download(spark: SparkSession, connector: Connector, link: str, workers: int = WORKERS) -> DataFrame:
    """(name, content, size, seconds, error_msg) of every file behind a link, fetched by that many tasks at a time."""
    files = [(n, k) for n, k, _ in connector.list(link)]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, key in zip(pdf["name"], pdf["key"], strict=True):  # one file in memory at a time
                began, data, fault = time.monotonic(), None, None
                try:
                    data = b"".join(connector.fetch(key))
                except Exception as e:
                    fault = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"name": [name], "content": [data], "size": [len(data or b"")], "seconds": [time.monotonic() - began], "error_msg": [fault]})

    return spark.createDataFrame(files, "name string, key string").repartition(workers).mapInPandas(run, "name string, content binary, size long, seconds double, error_msg string")


#: Bytes of a range, which is what a resumed ingest fetches again at most for each of its workers.
RANGE = 8 << 20
_PLAN = "name string, key string, start long, stop long, total long"
_EVENT = "task_id string, ts timestamp, status string, current long, total long, error_msg string"


def plan_ranges(spark: SparkSession, files: list[tuple[str, str, int | None]], step: int = RANGE) -> DataFrame:
    """(name, key, start, stop, total): the ranges of files(name, key, size); of one whose size isn't known, all in one."""
    known = spark.createDataFrame(files, "name string, key string, total long")
    starts = F.when(F.col("total") > 0, F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(step).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    cut = known.withColumn("start", F.explode(starts))
    return cut.select("name", "key", "start", F.least(F.col("start") + step, "total").alias("stop"), "total")


def ingest(spark: SparkSession, connector: Connector, link: str, out: str, checkpoint: str, step: int = RANGE, workers: int = WORKERS, before: Callable[[int], None] | None = None):
    """Fetches what is behind a link into out/parts as a stream of ranges, and tells of it in out/events.

    The ranges are planned once, into out/plan; a micro-batch takes as many as there are workers, and the checkpoint says
    which are next, so that a run that was broken off goes on behind its last batch. Each range is a file, whole or not
    there; events (task_id, ts, status, current, total, error_msg) are downloading, done or error, and a range that failed
    is planned again when a run begins. before is called with the number of each batch; what it raises ends the run.
    Returns the running query; finish() makes the files.
    """
    from .stores import export, opened

    store, at = opened(out)
    store.create_dir(f"{at}/events", recursive=True)
    if not _has(spark, f"{out}/plan"):
        todo = plan_ranges(spark, connector.list(link), step)
    else:
        todo = missing(spark, out)
    n = todo.count()
    if n:
        todo.repartitionByRange(-(-n // workers), "name", "start").write.mode("append").parquet(f"{out}/plan")

    def fetch(batches):
        import pandas as pd

        for pdf in batches:
            for name, key, start, stop, total in zip(*(pdf[c] for c in ("name", "key", "start", "stop", "total")), strict=True):
                most, data, fault = None if pd.isna(stop) else int(stop - start), bytearray(), None
                try:
                    for chunk in connector.fetch(key, int(start)):
                        data += chunk
                        if most is not None and len(data) >= most:
                            del data[most:]
                            break
                    if most is not None and len(data) < most:
                        raise EOFError(f"{len(data)} of {most} bytes")
                except Exception as e:
                    fault = f"{type(e).__name__}: {e}"
                last = not fault and (most is None or stop == total)
                row = (name, start, None if fault else bytes(data), pd.Timestamp.now(), "error" if fault else "done" if last else "downloading", start + (0 if fault else len(data)), None if pd.isna(total) else int(total), fault)
                yield pd.DataFrame([row], columns=["name", "start", "data", "ts", "status", "current", "total", "error_msg"]).astype({"total": "Int64"})

    def write(batch: DataFrame, epoch: int) -> None:
        if before:
            before(epoch)
        got = batch.repartition(workers, "name", "start").mapInPandas(fetch, "name string, start long, data binary, ts timestamp, status string, current long, total long, error_msg string").persist()
        try:
            export(got.filter("data is not null").select(F.format_string("%s/%015d", "name", "start").alias("name"), "data"), f"{out}/parts")
            got.select(F.col("name").alias("task_id"), "ts", "status", "current", "total", "error_msg").write.mode("overwrite").parquet(f"{out}/events/epoch={epoch}")
        finally:
            got.unpersist()

    found = spark.readStream.schema(_PLAN).option("maxFilesPerTrigger", 1).parquet(f"{out}/plan")
    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _has(spark: SparkSession, folder: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ingest_events(spark: SparkSession, out: str) -> DataFrame:
    """What ingest() has told so far, for download_log() and download_state()."""
    return spark.read.schema(_EVENT).option("recursiveFileLookup", True).parquet(f"{out}/events")


def missing(spark: SparkSession, out: str) -> DataFrame:
    """The planned ranges that ingest() has tried and not got."""
    from .stores import listed

    plan = spark.read.schema(_PLAN).parquet(f"{out}/plan").distinct()
    here = listed(spark, f"{out}/parts").select(F.substring_index("path", "/parts/", -1).alias("part"))
    failed = ingest_events(spark, out).filter("status = 'error'").select(F.col("task_id").alias("name"), F.col("current").alias("start")).distinct()
    return plan.join(failed, ["name", "start"], "left_semi").join(here, F.format_string("%s/%015d", "name", "start") == F.col("part"), "left_anti").select(*(c.split()[0] for c in _PLAN.split(", ")))


def finish(spark: SparkSession, out: str) -> DataFrame:
    """(name, size, complete) of the planned files; those whose parts are all there become out/files/<name>, part by part."""
    import posixpath
    import uuid

    from .stores import listed, opened

    plan = spark.read.schema(_PLAN).parquet(f"{out}/plan").distinct()
    parts = listed(spark, f"{out}/parts").select(F.substring_index("path", "/parts/", -1).alias("part"), F.col("length"))
    own = plan.join(parts, F.format_string("%s/%015d", "name", "start") == F.col("part"), "left")
    whole = own.groupBy("name").agg(F.sum("length").alias("size"), F.count_if(F.col("part").isNull()).alias("gone"), F.count("*").alias("ranges"))

    def join(batches):
        from pyarrow import fs

        for pdf in batches:
            for name, gone in zip(pdf["name"], pdf["gone"], strict=True):
                if gone:
                    continue
                store, at = opened(out)
                to, hidden = f"{at}/files/{name}", f"{at}/.files-{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as f:
                    for part in sorted(i.path for i in store.get_file_info(fs.FileSelector(f"{at}/parts/{name}")) if i.is_file):
                        with store.open_input_stream(part) as source:
                            while chunk := source.read(CHUNK):
                                f.write(chunk)
                store.create_dir(posixpath.dirname(to), recursive=True)
                store.move(hidden, to)
            yield pdf.assign(complete=pdf["gone"] == 0)[["name", "size", "complete"]]

    return whole.repartition("name").mapInPandas(join, "name string, size long, complete boolean")


def download_log(events: DataFrame, every: float = 0.25, largest: str = "TB") -> DataFrame:
    """What is shown of events(task_id, ts, current, total): the first of each time slot, and the last one of a file.

    Of events of one moment the one with the smallest current is first; sizes are told in units up to largest.
    """
    slot = F.floor(F.unix_micros("ts") / int(every * 1_000_000))
    final = F.col("current") == F.col("total")
    kept = events.withColumn("slot", slot).groupBy("task_id", "slot", F.coalesce(final, F.lit(False)).alias("final")).agg(F.min_by(F.struct("ts", "current", "total"), F.struct("ts", F.isnull("current"), "current", "total")).alias("e")).select("task_id", "e.*")
    told = F.concat(format_bytes("current", largest), F.lit(" / "), F.when(F.col("total").isNotNull(), format_bytes("total", largest)).otherwise("---"))
    return kept.withColumn("percent", progress_percent("current", "total")).withColumn("message", told)


def download_state(events: DataFrame) -> DataFrame:
    """The latest event of each task; of one moment's the one with the largest current."""
    return events.groupBy("task_id").agg(F.max_by(F.struct(*(c for c in events.columns if c != "task_id")), F.struct("ts", "current")).alias("e")).select("task_id", "e.*")


def with_missing(local: DataFrame, wanted: DataFrame, connector: Connector) -> DataFrame:
    """(key, content): the local copy that isn't empty, else the remote one, else null; only missing keys are fetched."""
    here = local.filter(F.length("content") > 0).select("key", "content")
    both = wanted.select("key").distinct().join(here, "key", "left")

    def run(batches):
        for pdf in batches:
            content = []
            for key, data in zip(pdf["key"], pdf["content"], strict=True):
                if data is None:
                    try:
                        data = b"".join(connector.fetch(key)) or None
                    except Exception:
                        data = None
                content.append(data)
            yield pdf.assign(content=content)

    return both.mapInPandas(run, "key string, content binary")
