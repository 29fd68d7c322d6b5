"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model, thresholded for each language.

The model is over bytes of lower-cased UTF-8 text, order ORDER, so an n-gram is an exact integer. It is trained on all
trusted rows (labelled good and not toxic, in any row of the label table) but every tenth, which calibrate the
thresholds: a language's threshold is the KEEP quantile of the perplexities of its held-out trusted rows (of all
held-out trusted rows where a language has fewer than LEAST of them). Trained rows are scored by a model that has seen
them, so a trusted row that isn't held out is practically always kept: it was labelled good, and the model is for the rest.

Plan. Pass 1 cuts every scan partition into blocks of BLOCK bytes and gives each block's distinct n-grams with their
trusted counts, so that what is shuffled grows with distinct n-grams a block and not with tokens. Count tables, contexts
and probabilities are joins sharded by n-gram. Pass 2 sends the blocks, compressed, to where their probabilities went
and sums them for each document.

Edge cases: null or empty text has one event (its end); null lang is the language ''; a row without doc_id is scored;
without trusted rows all perplexities are those of the uniform model and every row is kept; repeated rows are scored
each; other columns are not read.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, pinned_splits, small_side, staged

ORDER = 5
BLOCK = 18_000_000
PIECE = 2_000_000
KEEP = 0.99
LEAST = 30
HELD_OUT = 10
_CLEAN = bytes(32 if b < 4 else b for b in range(256))


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of all events of all texts (each byte and the end), and the text of each event."""
    head = b"\0" * (order - 1)
    data = np.frombuffer(b"".join(head + t.translate(_CLEAN) + b"\1" for t in texts) + head, np.uint8)
    n = len(data) - order + 1
    g = data[:n].astype(np.int64)
    for i in range(1, order):
        g <<= 8
        g |= data[i : i + n]
    sizes = np.fromiter((len(t) + order for t in texts), np.int64, len(texts))
    event = data[order - 1 :] != 0
    return g[event], np.repeat(np.arange(len(texts)), sizes - order + 1)


def _low(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def _pieces(texts: list[bytes]):
    a = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= PIECE:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _blocks(batches):
    """(block number, rows) of one scan partition: neighbouring rows of up to BLOCK characters in all."""
    base, seq, rows, total = TaskContext.get().partitionId() << 24, 0, [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and total + len(row[1] or "") > BLOCK:
                yield base + seq, rows
                seq, rows, total = seq + 1, [], 0
            rows.append(row)
            total += len(row[1] or "")
    if rows:
        yield base + seq, rows


def _counted(order: int):
    def run(batches):
        for block, rows in _blocks(batches):
            parts: list[tuple[np.ndarray, np.ndarray]] = []
            for trusted in (True, False):
                texts = [_low(r[1]) for r in rows if (r[3] and not r[4]) == trusted]
                for a, b in _pieces(texts):
                    u, c = np.unique(grams(texts[a:b], order)[0], return_counts=True)
                    parts.append((u, c if trusted else np.zeros(len(u), np.int64)))
            u, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            c = np.bincount(at, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), block)), pa.array(u), pa.array(c)], ["block", "gram", "n"])

    return run


def _packed(batches):
    for block, rows in _blocks(batches):
        t = pa.table({k: pa.array(v, kind) for k, v, kind in zip(("doc_id", "text", "lang", "trusted", "held"), zip(*rows, strict=True), (pa.int64(), pa.large_string(), pa.string(), pa.bool_(), pa.bool_()), strict=True)})
        out = io.BytesIO()
        with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as w:
            w.write_table(t)
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([out.getvalue()], pa.binary())], ["block", "blob"])


def _scored(order: int):
    def run(blobs, probabilities):
        import pandas as pd

        out = []
        probabilities = probabilities.sort_values("gram")
        keys, values = probabilities["gram"].to_numpy(), probabilities["logp"].to_numpy()
        for blob in blobs["blob"]:
            t = pa.ipc.open_stream(blob).read_all()
            texts = [_low(x) for x in t.column("text").to_pylist()]
            total, events = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for a, b in _pieces(texts):
                g, of = grams(texts[a:b], order)
                at = np.minimum(np.searchsorted(keys, g), max(len(keys) - 1, 0))
                if not len(keys) or (keys[at] != g).any():
                    raise RuntimeError("the two scans were cut differently; stage the documents first")
                total[a:b] += np.bincount(of, values[at], b - a)
                events[a:b] += np.bincount(of, minlength=b - a)
            out.append(pd.DataFrame({"doc_id": t.column("doc_id").to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), "lang": t.column("lang").to_pandas(), "trusted": t.column("trusted").to_pandas(), "held": t.column("held").to_pandas(), "n_events": events, "perplexity": np.exp(-total / events)}))
        return pd.concat(out)

    return run


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts; 0.5 for one that these leave without a positive value, as small corpora do."""
    n = [0, *counts.agg(*(F.count_if(F.col("c") == i) for i in (1, 2, 3, 4))).first()]
    if not (n[1] and n[2]):
        return (0.5, 0.5, 0.5)
    y = n[1] / (n[1] + 2 * n[2])
    found = [min(k - (k + 1) * y * n[k + 1] / n[k], float(k)) if n[k] else 0.5 for k in (1, 2, 3)]
    return tuple(d if d > 0 else 0.5 for d in found)  # without a discount, what wasn't seen would have no probability


def probabilities(seen: DataFrame, needed: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, logp) of every needed n-gram under the model of the counts seen(gram, c)."""
    tables = {order: seen}
    for k in range(order - 1, 0, -1):
        tables[k] = staged(tables[k + 1].groupBy(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count("*").alias("c")), f"kn{k}")
    lower = None
    for k in range(1, order + 1):
        t = tables[k]
        d1, d2, d3 = discounts(t)
        c = F.col("c")
        cut = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        context = t.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(F.sum("c").alias("total"), (F.sum(cut) / F.sum("c")).alias("back"))
        want = needed.select(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).distinct() if k < order else needed
        p = want.join(t.select("gram", (c - cut).alias("held")), "gram", "left").withColumn("ctx", F.shiftright("gram", 8)).join(context, "ctx", "left")
        if lower is None:
            below = F.lit(1 / 256)
        else:
            p = p.withColumn("tail", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(lower, "tail")
            below = F.col("q")
        prob = F.coalesce(F.greatest("held", F.lit(0.0)) / F.col("total"), F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * below
        p = p.select(F.col("gram").alias("tail"), prob.alias("q"))
        lower = staged(p, f"p{k}") if k in (2, 4) and k < order else p
    return lower.select(F.col("tail").alias("gram"), F.log("q").alias("logp"))


def scores(documents: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, trusted, held, n_events, perplexity for every row."""
    spark = documents.sparkSession
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality") == 1, F.lit(False)) & F.coalesce(F.col("toxic") == 0, F.lit(False))).alias("good"))
    good = staged(good.filter("good").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("trusted")), "trusted")
    side = small_side(good)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")).join(side, "doc_id", "left")
    docs = docs.select("doc_id", "text", "lang", F.coalesce("trusted", F.lit(False)).alias("trusted"), (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("held"))
    if side is good:  # the join was shuffled, so a second scan would deal rows in another order
        docs = staged(docs, "flagged")
    with pinned_splits(spark):
        found = staged(docs.mapInArrow(_counted(order), "block long, gram long, n long"), "grams")
        total = found.groupBy("gram").agg(F.sum("n").alias("c"))
        total = staged(total, "total")
        logp = probabilities(total.filter("c > 0"), total.select("gram"), order)
        back = found.select("block", "gram").join(logp.select("gram", F.col("logp").cast("float").alias("logp")), "gram")
        blobs = docs.mapInArrow(_packed, "block long, blob binary")
        return staged(blobs.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(_scored(order), "doc_id long, lang string, trusted boolean, held boolean, n_events long, perplexity double"), "scores")


def classify(documents: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, n_events, perplexity, threshold, kept for every row of documents(doc_id, text, lang)."""
    s = scores(documents, labels, order)
    held = s.filter("trusted and held")
    quantile = F.percentile_approx("perplexity", KEEP, 10_000)
    whole = held.agg(quantile.alias("whole"))
    by = held.groupBy("lang").agg(quantile.alias("own"), F.count("*").alias("n")).filter(F.col("n") >= LEAST).select("lang", "own")
    out = s.join(by, "lang", "left").join(F.broadcast(whole))  # one row
    out = out.withColumn("threshold", F.coalesce("own", "whole"))
    return out.select("doc_id", "lang", "n_events", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
