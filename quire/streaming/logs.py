"""Logs of jobs and downloads as streams with state: the last lines of each job, lines that say something new, throttled progress.

A key's state is small and bounded: the ring of its last lines, the line before, the time slot shown last. With expiry_ms
it goes when nothing has come for the key for so long; Spark then runs batches without rows too, so such a query wants a
trigger by time (availableNow would not end unless spark.sql.streaming.noDataMicroBatches.enabled is false). Rows of a micro-batch are put in order by (ts, seq) within their key; between
micro-batches, what comes later counts as later, except in the ring, which is in order of (ts, seq) whatever comes when.
A key's rows of one micro-batch are in memory together, so its size is that of the source's limit for a batch.

Edge cases: null lines are lines like any other; ties of ts are in order of seq; repeated rows are one line in the
ring and in what is new; keys that are null are a key of their own; without rows nothing comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import format_bytes, progress_percent

#: Lines that a job's log keeps.
KEEP = 100
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(frames):
    import pandas as pd

    own = [f for f in frames if len(f)]
    return pd.concat(own).sort_values(["ts", "seq"], kind="stable") if own else None


class LastLines(StatefulProcessor):
    """The ring of a key's last lines, and those of them that differ from the line before."""

    def __init__(self, keep: int = KEEP, expiry_ms: int | None = None):
        self.keep, self.expiry = keep, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "ts timestamp, seq long, line string", self.expiry)
        self.last = handle.getValueState("last", "line string", self.expiry)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        new = _ordered(rows)
        if new is None:
            return
        new = list(new[["ts", "seq", "line"]].drop_duplicates().itertuples(index=False, name=None))
        before = self.last.get() if self.last.exists() else None
        old = [tuple(x) for x in self.ring.get()] if self.ring.exists() else []
        fresh = []
        for ts, seq, line in new:
            if before is None or before[0] != line:
                fresh.append((key[0], ts, seq, line, "new"))
            before = (line,)
        self.last.update(before)
        held = {(pd.Timestamp(ts).tz_localize(None), seq, line) for ts, seq, line in [*old, *new]}
        ring = sorted(held, key=lambda x: (x[0], x[1]))[-self.keep :]
        self.ring.put([(ts.to_pydatetime(), seq, line) for ts, seq, line in ring])
        out = [*fresh, *((key[0], ts, seq, line, "last") for ts, seq, line in ring)]
        yield pd.DataFrame(out, columns=["key", "ts", "seq", "line", "kind"])

    def close(self) -> None:
        pass


class Throttled(StatefulProcessor):
    """The first event of each time slot, and the first that is final."""

    def __init__(self, every: float = 0.25, expiry_ms: int | None = None):
        self.every, self.expiry = int(every * 1_000_000), expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getValueState("shown", "slot long, final_slot long", self.expiry)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        new = _ordered(rows)
        if new is None:
            return
        slots = list(self.shown.get()) if self.shown.exists() else [None, None]
        micros = new["ts"].dt.tz_localize(None).astype("datetime64[us]").astype("int64") // self.every
        take = []
        for slot, current, total in zip(micros.tolist(), new["current"], new["total"], strict=True):
            final = int(not pd.isna(total) and current == total)
            take.append(slots[final] is None or slot > slots[final])
            if take[-1]:
                slots[final] = slot
        self.shown.update(tuple(slots))
        out = new[take].assign(key=key[0])[["key", "ts", "seq", "current", "total"]]
        yield out.astype({"current": "Int64", "total": "Int64"})

    def close(self) -> None:
        pass


def _with_state(rows: DataFrame, key: str, processor: LastLines | Throttled, schema: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.withColumnRenamed(key, "key").groupBy("key").transformWithStateInPandas(processor, schema, "Update", "ProcessingTime" if processor.expiry else "None")


def last_lines(events: DataFrame, key: str, line: str, keep: int = KEEP, expiry_ms: int | None = None) -> DataFrame:
    """(key, ts, seq, line, kind) of the stream events(key, ts, seq, line): after each batch, of every key that it has rows
    of, the lines that are new (kind new) and all of its last lines (kind last, in place of those said before)."""
    kind = dict(events.dtypes)[key]
    own = events.select(key, "ts", "seq", F.col(line).alias("line"))
    return _with_state(own, key, LastLines(keep, expiry_ms), f"key {kind}, ts timestamp, seq long, line string, kind string")


def throttled(events: DataFrame, key: str = "task_id", every: float = 0.25, expiry_ms: int | None = None) -> DataFrame:
    """What is shown of the stream events(key, ts, seq, current, total), with percent and message as download_log() has them."""
    kind = dict(events.dtypes)[key]
    out = _with_state(events.select(key, "ts", "seq", "current", "total"), key, Throttled(every, expiry_ms), f"key {kind}, ts timestamp, seq long, current long, total long")
    return out.withColumnRenamed("key", key).withColumn("percent", progress_percent("current", "total")).withColumn("message", F.concat(format_bytes("current"), F.lit(" / "), F.when(F.col("total").isNotNull(), format_bytes("total")).otherwise("---")))
