"""Tasks kept in a shared folder: numbered versions, small changes beside a base, and exclusive claims by many sessions.

A version is one small file that names a base folder and the folders of changed rows since; the highest number is the
present state. A change reads version n, writes the rows it changes into a folder of their own, and creates the file of
version n + 1 only if nobody else has; else it starts again from the version that came between. So two sessions never
claim one row, and what stops before the file exists changes nothing. Reading merges: the last change of an id stands for
it. The base is written again, in ranges of ids, when there are many changes; no other change rewrites it.

Creating a file only if absent is a hard link on local disks, and elsewhere a rename that never overwrites, which HDFS does
in one step; the folder must be on a store that does.

Edge cases: an empty store has no tasks; changes of no row make no version; results for unknown paths change nothing; of
several results of a path the last one counts (by seq, if there is one); files registered twice are one task.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import tasks as ops
from .staging import SMALL, small_side

SCHEMA = "id long, file_path string, file_size long, status string, confidence double, error_msg string, processing_time_ms double, created_at timestamp, updated_at timestamp"


def put_new(spark: SparkSession, path: str, data: bytes, linked: bool | None = None) -> bool:
    """Writes a file that is whole from its first moment, unless one of that name exists; whether it did."""
    sc = spark.sparkContext
    jvm = sc._jvm
    to, conf = jvm.org.apache.hadoop.fs.Path(path), sc._jsc.hadoopConfiguration()
    own = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = to.getFileSystem(conf)
    out = fs.create(own)
    out.write(data)
    out.close()
    try:
        if fs.getScheme() == "file" if linked is None else linked:
            os.link(own.toUri().getPath(), to.toUri().getPath())
            return True
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf)
        files.rename(fs.makeQualified(own), fs.makeQualified(to), sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        return True
    except FileExistsError:
        return False
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    finally:
        fs.delete(own, False)


class TaskStore:
    def __init__(self, spark: SparkSession, root: str, most_changes: int = 64):
        """The store in a folder; most_changes: folders of changes after which the base is written again."""
        self.spark, self.root, self.most = spark, root.rstrip("/"), most_changes
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/versions"))

    def version(self) -> int:
        """The highest number; 0 for an empty store."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/versions"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def _named(self, version: int) -> dict:
        if not version:
            return {"base": None, "changes": [], "rows": 0}
        stream = self._fs.open(self._path(f"{self.root}/versions/{version:012}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def tasks(self, version: int | None = None) -> DataFrame:
        """All tasks of a version, the present one if none is given."""
        at = self._named(self.version() if version is None else version)
        read = lambda *paths: self.spark.read.schema(f"{SCHEMA}, version long").parquet(*(f"{self.root}/{p}" for p in paths))
        base = read(at["base"]).drop("version") if at["base"] else self.spark.createDataFrame([], SCHEMA)
        if not at["changes"]:
            return base
        last = read(*at["changes"]).groupBy("id").agg(F.max_by(F.struct(*base.columns), "version").alias("r")).select("r.*")
        ids = last.select("id")
        return base.join(F.broadcast(ids) if at["rows"] <= SMALL else ids, "id", "left_anti").unionByName(last)

    def _changed(self, change: Callable[[DataFrame], DataFrame], folder: str = "change") -> tuple[dict, str | None]:
        """Commits the rows of change(tasks), again and again until no version came between; their counts and folder."""
        while True:
            n = self.version()
            at = self._named(n)
            name = f"{folder}-{n + 1:012}-{uuid.uuid4().hex}"
            seen = Observation()
            s = F.col("status")
            rows = change(self.tasks(n)).select(*(c.split()[0] for c in SCHEMA.split(", "))).withColumn("version", F.lit(n + 1).cast("long"))
            rows.observe(seen, F.count("*").alias("rows"), *(F.count_if(s == x).alias(x.lower()) for x in ("DONE", "FAILED"))).write.parquet(f"{self.root}/{name}")
            counts = seen.get
            if not counts["rows"]:
                self._fs.delete(self._path(f"{self.root}/{name}"), True)
                return counts, None
            if folder == "base":
                after = {"base": name, "changes": [], "rows": 0}
            else:
                after = {"base": at["base"], "changes": [*at["changes"], name], "rows": at["rows"] + counts["rows"]}
            if put_new(self.spark, f"{self.root}/versions/{n + 1:012}.json", json.dumps(after).encode()):
                if len(after["changes"]) > self.most or not after["base"]:
                    self.rewrite()
                return counts, name
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
            if folder == "base":
                return counts, None  # others go on changing; the next one of them that finds many changes tries again

    def rewrite(self) -> None:
        """Writes base and changes as a new base in ranges of ids."""
        self._changed(lambda tasks: tasks.repartitionByRange("id").sortWithinPartitions("id"), "base")

    def restore(self, tasks: DataFrame) -> int:
        """Takes tasks with their ids and states into an empty store; how many they are."""
        if self.version():
            raise ValueError(f"{self.root} has tasks")
        return self._changed(lambda _: tasks, "base")[0]["rows"]

    def register(self, found: DataFrame, now=None) -> int:
        """Adds the files of found(file_path, file_size) that aren't known, PENDING; how many they are."""
        empty = lambda c, kind: F.lit(None).cast(kind).alias(c)

        def new(tasks: DataFrame) -> DataFrame:
            rows = ops.new_tasks(tasks, found, now)
            return rows.select(*(c.split()[0] if c.split()[0] in rows.columns else empty(*c.split()) for c in SCHEMA.split(", ")))

        return self._changed(new)[0]["rows"]

    def claim(self, limit: int, book: str | None = None, now=None) -> DataFrame:
        """(file_path, file_size) of the first pending tasks, IN_PROGRESS from now on and nobody else's."""
        name = None
        if limit > 0:
            _, name = self._changed(lambda tasks: ops.claimed(tasks, limit, book, now))
        if not name:
            return self.spark.createDataFrame([], "file_path string, file_size long")
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{name}").select("file_path", "file_size")

    def apply(self, results: DataFrame, now=None) -> tuple[int, int]:
        """Enters results(file_path, success, ...); how many tasks became DONE and FAILED."""

        def done(tasks: DataFrame) -> DataFrame:
            return ops.apply_results(tasks.join(small_side(results.select("file_path").distinct()), "file_path", "left_semi"), results, now)

        counts = self._changed(done)[0]
        return counts["done"], counts["failed"]

    def reset_hanging(self, book: str | None = None, now=None) -> int:
        """Sets tasks IN_PROGRESS back to PENDING; how many."""
        return self._changed(lambda tasks: ops.reset_hanging(ops.in_book(tasks.filter("status = 'IN_PROGRESS'"), book), None, now))[0]["rows"]

    def retry_failed(self, book: str | None = None, now=None) -> int:
        """Sets FAILED tasks back to PENDING; how many."""
        return self._changed(lambda tasks: ops.retry_failed(ops.in_book(tasks.filter("status = 'FAILED'"), book), now))[0]["rows"]

    def tidy(self, keep: int = 100) -> int:
        """Deletes the folders that neither one of the last keep versions names nor a running change may yet name."""
        n = self.version()
        last = range(max(1, n - keep + 1), n + 1)
        used = {p for at in map(self._named, last) for p in (at["base"], *at["changes"]) if p}
        gone = 0
        for f in self._fs.listStatus(self._path(self.root)):
            name = f.getPath().getName()
            made = name.split("-")
            if made[0] in ("base", "change") and name not in used and int(made[1]) <= n - keep:
                gone += bool(self._fs.delete(f.getPath(), True))
        return gone
