"""Jobs that another process pauses, resumes and retries: a log of orders in a shared folder, read between micro-batches.

Orders are numbered files; the last one for a book counts. A running job looks before each batch: after a pause the batch
that runs is finished, the next one isn't begun, and the stream's checkpoint goes on there after a resume. Retry sets the
book's failed tasks back in the task store. States follow from the orders and the tasks: idle, processing, paused,
completed, error, and has_failed for books whose only open pages failed.
"""

from __future__ import annotations

import json

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tasks as ops
from ..operators.task_store import TaskStore, put_new
from . import digitise

ORDERS = ("start", "pause", "resume", "retry", "done", "error")
#: The state that an order leaves a book in.
STATES = {"start": "processing", "resume": "processing", "retry": "processing", "pause": "paused", "done": "completed", "error": "error"}


class Paused(Exception):
    pass


class Control:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _last(self) -> int:
        return max((int(n[:12]) for f in self._fs.listStatus(self._path(self.root)) if (n := f.getPath().getName()).endswith(".json")), default=0)

    def say(self, book: str, order: str, note: str | None = None) -> int:
        """Adds an order behind all others; its number."""
        if order not in ORDERS:
            raise ValueError(f"order must be one of {ORDERS}, not {order}")
        while True:
            n = self._last() + 1
            if put_new(self.spark, f"{self.root}/{n:012}.json", json.dumps({"n": n, "book": book, "order": order, "note": note}).encode()):
                return n

    def orders(self) -> DataFrame:
        """(n, book, order, note) of all orders."""
        return self.spark.read.schema("n long, book string, order string, note string").option("pathGlobFilter", "*.json").json(self.root)

    def states(self) -> DataFrame:
        """(book, state) by the last order of each book."""
        named = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
        return self.orders().groupBy("book").agg(F.max_by("order", "n").alias("order")).select("book", named[F.col("order")].alias("state"))

    def state(self, book: str) -> str:
        found = self.states().filter(F.col("book") == book).first()
        return found["state"] if found else "idle"


def run_job(spark: SparkSession, control: Control, book: str, root: str, out: str, checkpoint: str, store: TaskStore | None = None, **options) -> str:
    """Digitises a book until it is done or paused; the state it ends in. What failed is in the log with its error.

    With a store, results are entered after each batch.
    """
    more = list(options.pop("more", ()))
    if store:
        more.append(lambda batch, epoch: store.apply(batch.select("file_path", "success", "confidence", "processing_time_ms", "error_msg")))

    def look(epoch: int) -> None:
        if control.state(book) == "paused":
            raise Paused(book)

    if control.state(book) == "paused":
        return "paused"
    if control.state(book) != "processing":
        control.say(book, "start")
    query = digitise.stream(spark, root, out, checkpoint, more=more, before=look, **options)
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if "Paused" in str(e) and control.state(book) == "paused":
            return "paused"
        control.say(book, "error", str(e)[:10_000])
        return "error"
    control.say(book, "done")
    return "completed"


def retry(control: Control, store: TaskStore, book: str) -> int:
    """Sets a book's failed tasks back; how many there were."""
    n = store.retry_failed(book)
    control.say(book, "retry")
    return n


def job_states(control: Control, tasks: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """State of every book's job by its tasks and the last order given for it."""
    said = control.states()
    out = ops.job_status(ops.stats_by_book(tasks), said, outputs)
    faulty = said.filter("state = 'error'").select("book", F.lit(True).alias("faulty"))
    return out.join(faulty, "book", "left").withColumn("status", F.when(F.col("faulty"), "error").otherwise(F.col("status"))).drop("faulty")
