"""The task relation: register, claim, apply results, reset, retry and statistics, as functions of snapshots.

Parquet has no update in place: every mutation maps a snapshot and a delta to the next snapshot. task_store keeps
snapshots and writes only the rows that change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import book_of, percent
from .numbering import numbered, running


def in_book(df: DataFrame, book: str | None) -> DataFrame:
    """Rows under a book's folder; the name is literal."""
    p = F.col("file_path")
    return df if book is None else df.filter(p.startswith(f"{book}/") | p.startswith(f"{book}\\"))


def _touched(tasks: DataFrame, changed, now) -> dict:
    """updated_at of the rows that change, if tasks has that column."""
    if "updated_at" not in tasks.columns:
        return {}
    return {"updated_at": F.when(changed, F.current_timestamp() if now is None else now).otherwise(F.col("updated_at"))}


def new_tasks(tasks: DataFrame, found: DataFrame, now=None) -> DataFrame:
    """The files of found(file_path, file_size) that aren't in tasks, PENDING, numbered in order of path behind its ids."""
    new = found.join(tasks.select("file_path"), "file_path", "left_anti").groupBy("file_path").agg(F.min("file_size").alias("file_size"))
    new = numbered(new, "file_path", tasks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))
    new = new.withColumn("status", F.lit("PENDING"))
    for c in ("created_at", "updated_at"):
        if c in tasks.columns:
            new = new.withColumn(c, F.current_timestamp() if now is None else now)
    return new


def register(tasks: DataFrame, found: DataFrame, now=None) -> DataFrame:
    """tasks and the new tasks of found."""
    return tasks.unionByName(new_tasks(tasks, found, now), allowMissingColumns=True)


def pending(tasks: DataFrame, limit: int | None = None, book: str | None = None) -> DataFrame:
    out = in_book(tasks.filter("status = 'PENDING'"), book).select("id", "file_path", "file_size").orderBy("id")
    return out.limit(limit) if limit else out


def budget(tasks: DataFrame, most: int | None = None) -> int:
    """How many rows a run takes: what is pending, at most `most`; 0 or None is all."""
    n = tasks.filter("status = 'PENDING'").count()
    return min(n, most) if most else n


def budgets(tasks: DataFrame, most: int | None = None) -> DataFrame:
    """(book, budget): budget() of every book."""
    n = tasks.groupBy(book_of("file_path").alias("book")).agg(F.count_if(F.col("status") == "PENDING").alias("n"))
    return n.select("book", (F.least("n", F.lit(most)) if most else F.col("n")).cast("long").alias("budget"))


def claim(tasks: DataFrame, limit: int, book: str | None = None, now=None) -> tuple[DataFrame, DataFrame]:
    """The first PENDING rows by id, and the snapshot in which they are IN_PROGRESS; nothing for limit <= 0."""
    taken = pending(tasks, limit, book) if limit > 0 else pending(tasks, None, book).filter(F.lit(False))
    mine = taken.select("id", F.lit(True).alias("mine"))
    after = tasks.join(mine, "id", "left")
    after = after.withColumns({"status": F.when(F.col("mine"), "IN_PROGRESS").otherwise(F.col("status")), **_touched(tasks, F.col("mine"), now)})
    return taken.select("file_path", "file_size"), after.select(*tasks.columns)


def claimed(tasks: DataFrame, limit: int, book: str | None = None, now=None) -> DataFrame:
    """The first PENDING rows by id, IN_PROGRESS."""
    taken = in_book(tasks.filter("status = 'PENDING'"), book).orderBy("id").limit(limit)
    return taken.withColumns({"status": F.lit("IN_PROGRESS"), **_touched(tasks, F.lit(True), now)})


def apply_results(tasks: DataFrame, results: DataFrame, now=None) -> DataFrame:
    """DONE or FAILED with the metrics of the last result of each path (by seq, if there is one)."""
    seq = F.col("seq") if "seq" in results.columns else F.lit(0)
    last = results.groupBy("file_path").agg(F.max_by(F.struct("success", "confidence", "processing_time_ms", "error_msg"), seq).alias("r"))
    out = tasks.join(last, "file_path", "left")
    hit = F.col("r").isNotNull()
    new = {"status": F.when(F.col("r.success"), "DONE").otherwise("FAILED"), **{c: F.col(f"r.{c}") for c in ("confidence", "processing_time_ms", "error_msg")}}
    done = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()} | _touched(tasks, hit, now)
    return out.select(*(done[c].alias(c) if c in done else F.col(c) for c in tasks.columns))


def reset_hanging(tasks: DataFrame, book: str | None = None, now=None) -> DataFrame:
    here = F.lit(True) if book is None else F.col("file_path").startswith(f"{book}/") | F.col("file_path").startswith(f"{book}\\")
    hanging = (F.col("status") == "IN_PROGRESS") & here
    return tasks.withColumns({"status": F.when(hanging, "PENDING").otherwise(F.col("status")), **_touched(tasks, hanging, now)})


def retry_failed(tasks: DataFrame, now=None, book: str | None = None) -> DataFrame:
    here = F.lit(True) if book is None else F.col("file_path").startswith(f"{book}/") | F.col("file_path").startswith(f"{book}\\")
    failed = (F.col("status") == "FAILED") & here
    return tasks.withColumns({**_touched(tasks, failed, now), "status": F.when(failed, "PENDING").otherwise(F.col("status")), "error_msg": F.when(failed, None).otherwise(F.col("error_msg"))})


def _counts() -> list:
    s = F.col("status")
    done = s == "DONE"
    return [
        F.count("*").alias("total"),
        *(F.count_if(s == x).alias(x.lower()) for x in ("DONE", "FAILED", "PENDING", "IN_PROGRESS")),
        F.coalesce(F.round(F.avg(F.when(done, F.col("processing_time_ms"))), 2), F.lit(0.0)).alias("avg_time_ms"),
        F.coalesce(F.round(F.avg(F.when(done, F.col("confidence"))), 4), F.lit(0.0)).alias("avg_confidence"),
    ]


def stats(tasks: DataFrame, book: str | None = None) -> DataFrame:
    return in_book(tasks, book).agg(*_counts()).withColumn("percent", percent("done", "total", 2))


def stats_by_book(tasks: DataFrame) -> DataFrame:
    out = tasks.groupBy(book_of("file_path").alias("book")).agg(*_counts()).filter("not startswith(book, '.')")
    return out.withColumn("percent", percent("done", "total", 1)).orderBy("book")


def job_status(by_book: DataFrame, running: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """State of every book's job; running(book, state) is what is worked on, outputs(book, has_text_file, has_zip_file) what is written."""
    out = by_book.join(running, "book", "left")
    state = (
        F.when(F.col("state") == "processing", "processing")
        .when((F.col("done") == F.col("total")) & (F.col("total") > 0), "completed")
        .when((F.col("failed") > 0) & (F.col("pending") == 0) & (F.col("in_progress") == 0), "has_failed")
        .when(F.col("state") == "paused", "paused")
        .when(F.col("done") > 0, "paused")
        .otherwise("idle")
    )
    flags = ("has_text_file", "has_zip_file")
    if outputs is not None:
        out = out.join(outputs.groupBy("book").agg(*(F.max(c).alias(c) for c in flags)), "book", "left")
    has = [F.coalesce(c, F.lit(False)).alias(c) for c in flags] if outputs is not None else []
    return out.select("book", "total", "done", "failed", state.alias("status"), *has)


def failed_report(tasks: DataFrame) -> DataFrame:
    """What failed, with the time of the failure if tasks has one."""
    at = [F.col("updated_at").alias("timestamp")] if "updated_at" in tasks.columns else []
    return tasks.filter("status = 'FAILED'").select("file_path", F.col("file_size").alias("file_size_bytes"), F.col("error_msg").alias("error_message"), *at)


def throughput(batches: DataFrame) -> DataFrame:
    """batches(run, batch, processed, seconds) with pages a second of each batch and of its run up to it."""
    rate = lambda n, s: F.when(s > 0, F.round(n / s, 2)).otherwise(0.0)
    own = running(batches, "run", "batch", _processed="processed", _seconds="seconds")
    return own.withColumns({"rate": rate(F.col("processed"), F.col("seconds")), "overall": rate(F.col("_processed"), F.col("_seconds"))}).drop("_processed", "_seconds")
