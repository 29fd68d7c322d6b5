"""Digitisation of page images, in batch and as a stream that shares the same transform."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.imaging import downscale, equalise, picture, split_spread
from ..sources.files import IMAGE_GLOB, read_pixels, write_jsonl, write_texts

RESULT = "file_path string, success boolean, full_text string, lines array<struct<text: string, confidence: double, box: array<array<double>>>>, confidence double, processing_time_ms double, error_msg string"


class Recognizer(Protocol):
    def recognize(self, image) -> str: ...


class DigestRecognizer:
    """A stand-in that needs no service: the text is the image's size and digest."""

    def recognize(self, image) -> str:
        h, w = image.shape[:2]
        return f"{w}x{h}\n{hashlib.sha256(image.tobytes()).hexdigest()[:16]}"


class RetryingRecognizer:
    """Calls engines in turn: waits as the service asks, moves on from a used-up or missing one, gives up after tries."""

    def __init__(self, engines: list[Recognizer], tries: int = 8, sleep: Callable[[float], None] = time.sleep):
        self.engines, self.tries, self.sleep, self.at = engines, tries, sleep, 0

    def recognize(self, image) -> str:
        import re

        last: Exception | None = None
        for n in range(self.tries):
            try:
                return self.engines[self.at].recognize(image)
            except Exception as e:
                last, m = e, str(e)
            quota = "429" in m or "quota" in m.lower() or "ResourceExhausted" in m
            busy = "503" in m or "UNAVAILABLE" in m or "high demand" in m.lower()
            gone = "404" in m or "not found" in m.lower()
            daily = any(x in m.lower() for x in ("perday", "limit: 20", "quotaid"))
            if self.at + 1 < len(self.engines) and (quota and daily or not quota and (busy or gone)):
                self.at += 1
                self.sleep(1)
            elif quota:
                hint = re.search(r"(?i)retry in ([0-9.]+)s", m) or re.search(r"""retryDelay['":\s]+([0-9.]+)s""", m)
                self.sleep(float(hint[1]) + 3 if hint else max(20.0, 2.0**n * 5))
            else:
                self.sleep(10.0 + 5 * n if busy else 2.0)
        raise RuntimeError(f"no answer after {self.tries} tries: {last}")


def digitise(images: DataFrame, make: Callable[[], Recognizer] = DigestRecognizer, split_double: bool = False, most: int = 2560, contrast: bool = False) -> DataFrame:
    """Results of images(file_path, content) or of read_images(); the recogniser is made once a partition, an error becomes a failed row."""
    columns = [c for c in ("content", "pixels", "height", "width", "nChannels", "turn") if c in images.columns]

    def run(batches):
        import pandas as pd

        engine = make()
        for pdf in batches:
            rows = []
            for path, *row in pdf[["file_path", *columns]].itertuples(index=False, name=None):
                began = time.monotonic()
                try:
                    image = picture(*row)
                    parts = split_spread(image) if split_double else [image]
                    texts = [engine.recognize(equalise(x) if contrast else x) for x in (downscale(p, most) for p in parts)]
                    if len(texts) == 2:
                        text = "\n\n".join(f"=== [TRANG {side}] ===\n{t}" for side, t in zip(("TRÁI", "PHẢI"), texts, strict=True))
                    else:
                        text = texts[0]
                    sure = 0.99 if text.strip() else 0.0
                    lines = [{"text": x.strip(), "confidence": sure, "box": []} for x in text.splitlines() if x.strip()]
                    rows.append((path, True, text, lines, sure, round((time.monotonic() - began) * 1000, 2), None))
                except Exception as e:
                    rows.append((path, False, "", [], 0.0, round((time.monotonic() - began) * 1000, 2), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["file_path", "success", "full_text", "lines", "confidence", "processing_time_ms", "error_msg"])

    return images.select("file_path", *columns).mapInPandas(run, RESULT)


#: Images of a folder, decoded by Spark or else with their content; what a stream gives its batches.
read_images = read_pixels


def empty_results(scanned: DataFrame) -> DataFrame:
    """Failed results for the empty files of scanned(rel_path, size), which Spark's file sources never read; any batch's result comes after them."""
    return scanned.filter("size = 0").select(F.col("rel_path").alias("file_path"), F.lit(False).alias("success"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("processing_time_ms"), F.lit("DecodeError: empty file (0 bytes)").alias("error_msg"), F.lit(-1).alias("seq"))


#: A sink takes a batch of results and its number; writing a number again must replace what it wrote before.
Sink = Callable[[DataFrame, int], None]


def text_sink(path: str) -> Sink:
    return lambda batch, epoch: write_texts(batch.filter("success"), f"{path}/epoch={epoch}", "overwrite")


def jsonl_sink(path: str) -> Sink:
    return lambda batch, epoch: write_jsonl(batch, f"{path}/epoch={epoch}", "overwrite")


def result_sink(path: str) -> Sink:
    """What apply_results() takes; seq is the batch's number."""
    columns = ("file_path", "success", "confidence", "processing_time_ms", "error_msg")
    return lambda batch, epoch: batch.select(*columns, F.lit(epoch).alias("seq")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def sinks(out: str, output: str = "both") -> list[Sink]:
    """The sinks of an output setting: txt, jsonl or both, and the results."""
    if output not in ("txt", "jsonl", "both"):
        raise ValueError(f"output must be txt, jsonl or both, not {output}")
    found = [text_sink(f"{out}/texts")] if output != "jsonl" else []
    return [*found, *([jsonl_sink(f"{out}/jsonl")] if output != "txt" else []), result_sink(f"{out}/results")]


class Progress(StreamingQueryListener):
    """Tells a callback of each batch: pages so far, pages a second, and seconds left if the total is known."""

    def __init__(self, callback: Callable[[dict], None], total: int | None = None):
        self.callback, self.total, self.done, self.began = callback, total, 0, time.monotonic()

    def onQueryStarted(self, event) -> None:
        self.began = time.monotonic()

    def onQueryProgress(self, event) -> None:
        self.add(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def add(self, batch: int, rows: int) -> None:
        self.done += rows
        rate = self.done / max(time.monotonic() - self.began, 1e-9)
        left = (self.total - self.done) / rate if self.total is not None and rate else None
        self.callback({"batch": batch, "rows": rows, "done": self.done, "rate": round(rate, 2), "seconds_left": left})


def stream(spark: SparkSession, root: str, out: str, checkpoint: str, batch_size: int = 50, output: str = "both", more: list[Sink] = (), before: Callable[[int], None] | None = None, **options):
    """Digitise what is in root and not yet done, batch by batch; the checkpoint replays a batch that was cut off.

    The stream itself carries paths only; those of a batch, at most batch_size, are read as read_images() reads a folder,
    so that every format gives what it gives in a batch job; a file that is gone by then gives no result. A batch is
    computed once and feeds all sinks, also those of more; each writes under the batch's number, so a replay replaces and
    never repeats. before is called with the number of each batch before it begins; what it raises ends the query, and a
    new call begins with that batch. Returns the running query.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", IMAGE_GLOB).option("maxFilesPerTrigger", batch_size).load(root)
    every = [*sinks(out, output), *more]

    def write(batch: DataFrame, epoch: int) -> None:
        if before:
            before(epoch)
        paths = [r["path"] for r in batch.collect()]
        results = digitise(read_images(batch.sparkSession, root, paths=paths), **options).persist()
        try:
            for sink in every:
                sink(results, epoch)
        finally:
            results.unpersist()

    return found.select("path").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_background(job: Callable[[], object], failed: Callable[[Exception], None] | None = None):
    """job() in a thread of the driver, for pushes that nobody waits for; errors go to failed and stop nothing."""
    import threading

    def run() -> None:
        try:
            job()
        except Exception as e:
            if failed:
                failed(e)

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    return thread
