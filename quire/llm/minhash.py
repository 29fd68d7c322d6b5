"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets and distributed union-find.

The signature of a document has SLOTS values. Every distinct shingle draws, for ranks 0, 1, 2, ..., a slot from its own
random permutation and a random fraction; a slot keeps the least rank-and-fraction. Ranks of one shingle are thus
correlated (a permutation), which lowers the variance against independent minima, and a document stops as soon as all
of its slots have a rank below the next one.

BANDS bands of ROWS slots find a pair with similarity 0.75 with probability 1 - (1 - 0.75**4)**32 > 0.999994. Pairs of
a shared bucket whose estimated similarity is below ESTIMATE (six standard deviations under 0.75) are not fetched.

Edge cases: null text or a text without words has an empty set and links with nothing; rows with equal word sequences
form one class, a node of its own number whatever ids its rows have, so rows of one doc_id with different texts are linked
each by its own text; a component has the smallest doc_id of all its rows; rows without doc_id link with nothing, have no
component and are kept; repeated rows are returned as often as they come; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, discard, fresh, grouped, small_side, smallest, spread_join, staged
from .words import chunks, lean, mix, shingle_sets, text_key

SLOTS, ROWS, SHINGLE = 128, 4, 5
BANDS = SLOTS // ROWS
ESTIMATE = 0.5
#: Characters of neighbouring texts that are hashed at once.
CHUNK = 500_000
#: Members of a bucket that are compared at once.
BLOCK = 1_024
#: Classes whose ids and keys are broadcast at most, to fetch their texts, about 25 MB.
WANTED = 300_000
_U = np.uint64


def super_minhash(sets: list[np.ndarray], m: int = SLOTS) -> np.ndarray:
    """One row of m codes (rank << 24 | fraction) for each set; an empty set keeps the largest code."""
    n = len(sets)
    sig = np.full(n * m, 0xFFFFFFFF, np.uint32)
    x = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    d = np.repeat(np.arange(n), [len(s) for s in sets])
    drawn: list[np.ndarray] = []
    perm = None
    for j in range(m):
        if not len(x):
            break
        r = mix(x + _U((j + 1) * 0xD1B54A32D192ED03 & (2**64 - 1)))
        k = (((r >> _U(40)) * _U(m - j)) >> _U(24)).astype(np.int64) + j
        if j <= 6:  # the slot at place k after the swaps so far
            slot = k.copy()
            for i in range(j - 1, -1, -1):
                hit, back = slot == drawn[i], slot == i
                slot[hit] = i
                slot[back & ~hit] = drawn[i][back & ~hit]
            drawn.append(k)
        else:
            row = np.arange(len(x))
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(x), 1))
                for i, other in enumerate(drawn):
                    a, b = perm[row, i].copy(), perm[row, other].copy()
                    perm[row, other], perm[row, i] = a, b
            slot = perm[row, k].astype(np.int64)
            perm[row, k], perm[row, j] = perm[row, j].copy(), slot.astype(np.uint8)
        np.minimum.at(sig, d * m + slot, (_U(j << 24) | (r & _U(0xFFFFFF))).astype(np.uint32))
        on = (sig.reshape(n, m).max(axis=1) >> 24)[d] > j
        if not on.all():
            x, d, drawn = x[on], d[on], [y[on] for y in drawn]
            perm = None if perm is None else perm[on]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    x = sig.reshape(len(sig), -1, ROWS).astype(np.uint64)
    h = np.arange(1, x.shape[1] + 1, dtype=np.uint64)[None, :] * _U(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        h = mix(h ^ (x[:, :, i] + _U(1)) * _U(0xC2B2AE3D27D4EB4F))
    return h.view(np.int64)


@lean
def _signatures(batches):
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        for a, b in chunks([len(t or "") for t in texts], CHUNK):
            low = [(t or "").encode("utf-8", "replace").lower() for t in texts[a:b]]
            sets = shingle_sets(low, SHINGLE)
            sig = super_minhash(sets)
            keys = band_keys(sig)
            full = np.fromiter((len(s) > 0 for s in sets), bool, len(sets))
            offsets = pa.array(np.r_[0, np.cumsum(np.where(full, keys.shape[1], 0))].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([text_key(x) for x in low], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys[full].ravel())),
                    pa.array([s.tobytes() if f else None for s, f in zip(sig, full, strict=True)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "text_key", "bands", "sig"],
            )


@lean
def _sets(batches):
    """The sets of the rows whose text is that of the class they were fetched for."""
    for batch in batches:
        ids, keys, texts = batch.column("rid"), batch.column("text_key").to_pylist(), batch.column("text").to_pylist()
        for a, b in chunks([len(t or "") for t in texts], CHUNK):
            low = [(t or "").encode("utf-8", "replace").lower() for t in texts[a:b]]
            own = [i for i, x in enumerate(low) if text_key(x) == keys[a + i]]
            sets = shingle_sets([low[i] for i in own], SHINGLE)
            offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32))
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            rid = ids.take(pa.array([a + i for i in own], pa.int64()))
            yield pa.RecordBatch.from_arrays([rid, pa.ListArray.from_arrays(offsets, pa.array(flat))], ["rid", "shingles"])


def _estimate(x, y):
    """The share of equal slots of two signatures, as a column."""

    def run(x, y):
        import pandas as pd

        a, b = (np.frombuffer(b"".join(s), np.uint32).reshape(len(s), -1) for s in (x, y))
        return pd.Series((a == b).mean(axis=1) if len(a) else np.empty(0))

    return F.pandas_udf(run, "double")(x, y)


def _shingles(docs: DataFrame, classes: DataFrame, rids: DataFrame, tag: str) -> DataFrame:
    """(rid, shingles), staged, of the given classes, from the whole text of a row with the class's smallest doc_id."""
    wanted = staged(classes.join(rids, "rid").select(F.col("least").alias("doc_id"), "rid", "text_key"), "ids")
    sets = docs.join(small_side(wanted, WANTED), "doc_id").select("rid", "text_key", "text").mapInArrow(_sets, "rid long, shingles array<long>")
    sets = staged(sets, tag)
    discard(wanted)
    return sets.dropDuplicates(["rid"])


def _in_blocks(members: DataFrame, columns: list[str]):
    """members(..., size of their bucket) grouped by pairs of blocks of a bucket, so that any two members meet in a group."""
    dealt = members.withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int"))
    dealt = dealt.select(*columns, "own", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    dealt = dealt.select(*columns, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    # Rows dealt by bucket would satisfy this grouping too, and leave all blocks of a large bucket to one task.
    return dealt.repartition("bucket", "lo", "hi").groupBy("bucket", "lo", "hi")


def _close(group, percent: int) -> np.ndarray:
    """Which members of a group may link: apart so far, of fitting size, and of fitting estimate."""
    sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(len(group), -1)
    same = np.zeros((len(group), len(group)), np.uint8)
    for column in np.ascontiguousarray(sig.T):
        same += column[:, None] == column[None, :]
    n, comp = group["n_shingles"].to_numpy(), group["comp"].to_numpy()
    fit = np.minimum(n[:, None], n[None, :]) * 100 >= np.maximum(n[:, None], n[None, :]) * percent
    return (same >= ESTIMATE * SLOTS) & fit & (comp[:, None] != comp[None, :])


def _plausible(percent: int):
    def run(group):
        return group.loc[_close(group, percent).any(axis=1), ["bucket", "rid"]]

    return run


def _joined(percent: int):
    """Links between members in different components, as many as it takes to join them."""

    def run(group):
        import pandas as pd

        rid, comp = group["rid"].to_numpy(), group["comp"].tolist()
        sets = list(group["shingles"])
        parent = {c: c for c in comp}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        out = []
        for i, j in zip(*np.nonzero(np.triu(_close(group, percent))), strict=True):
            x, y = root(comp[i]), root(comp[j])
            if x == y:
                continue
            inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if inter * 100 >= (len(sets[i]) + len(sets[j]) - inter) * percent:
                parent[x] = y
                out.append((rid[i], rid[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, sigs: DataFrame, percent: int, tag: str) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    one = lambda c: sigs.select(F.col("rid").alias(c), F.col("sig").alias(f"sig_{c}"))
    near = spread_join(pairs, one("a"), "a", "b").join(one("b"), "b").withColumn("est", _estimate("sig_a", "sig_b"))
    near = staged(near.filter(F.col("est") >= ESTIMATE).select("a", "b"), f"{tag}-near")
    sets = _shingles(docs, classes, near.select(F.col("a").alias("rid")).union(near.select("b")).distinct(), f"{tag}-sets")
    side = lambda c: sets.select(F.col("rid").alias(c), F.col("shingles").alias(f"s_{c}"))
    both = spread_join(near, side("a"), "a", "b").join(side("b"), "b")
    inter = F.size(F.array_intersect("s_a", "s_b"))
    both = both.select("a", "b", inter.alias("i"), (F.size("s_a") + F.size("s_b")).alias("n"))
    return both.filter(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("a", "b")


def near_duplicates(documents: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of documents(doc_id, text)."""
    return _judged(documents, percent).drop("text_key")


def _judged(documents: DataFrame, percent: int) -> DataFrame:
    """near_duplicates() with the key of each row's text."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = docs.mapInArrow(_signatures, "doc_id long, n_shingles long, text_key binary, bands array<long>, sig binary")
    base = staged(base, "sig")
    classes = base.filter("text_key is not null and doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("least"))
    classes = staged(classes.withColumn("rid", F.monotonically_increasing_id()), "classes")
    own = classes.withColumnRenamed("least", "doc_id")
    firsts = staged(base.join(own, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("rid", "n_shingles", "bands", "sig"), "firsts")
    rows = firsts.select("rid", "n_shingles", F.explode("bands").alias("bucket"))
    rows, ends = grouped(rows, "bucket", "rid", "a < z", a=("min", "rid"), z=("max", "rid"))
    rows = staged(rows.join(ends.drop("z"), ["bucket", "salt"]).drop("salt"), "buckets")

    # Round 1: every member of a bucket against the bucket's first; so many pairs as members.
    stars = rows.filter("rid > a").select("a", F.col("rid").alias("b")).distinct()
    links = staged(_verified(docs, classes, stars, firsts, percent, "star"), "links")
    found = connected_components(links)

    # Round 2: buckets whose other members are still apart. Members are compared in blocks within tasks; what leaves a
    # task is members and links of a spanning forest, never pairs.
    m = rows.filter("rid > a").join(found.withColumnRenamed("node", "rid"), "rid", "left")
    m = staged(m.select("bucket", "rid", "n_shingles", F.coalesce("component", "rid").alias("comp")).distinct(), "members")
    discard(rows)
    dealt, apart = grouped(m, "bucket", "rid", "lo < hi", lo=("min", "comp"), hi=("max", "comp"), size=("count", "*"), who=("sum", "cast(xxhash64(rid) AS decimal(38, 0))"))
    once = apart.groupBy("size", "who").agg(F.min("bucket").alias("bucket"))  # bands that hold the same members once
    apart = apart.join(once, ["size", "who", "bucket"], "left_semi").select("bucket", "salt", "size")
    open_ = staged(dealt.join(apart, ["bucket", "salt"]).drop("salt"), "open")
    discard(m)
    m = open_
    sigs = firsts.select("rid", "sig")
    near = _in_blocks(m.join(sigs, "rid"), ["bucket", "rid", "n_shingles", "comp", "sig"]).applyInPandas(_plausible(percent), "bucket long, rid long")
    near = staged(near.distinct(), "plausible")
    sets = _shingles(docs, classes, near.select("rid").distinct(), "rest-sets")
    dealt, size = grouped(near, "bucket", "rid", size=("count", "*"))
    dealt = dealt.join(size, ["bucket", "salt"]).drop("salt")
    m = m.drop("size").join(dealt, ["bucket", "rid"]).join(sigs, "rid").join(sets, "rid")
    more = _in_blocks(m, ["bucket", "rid", "n_shingles", "comp", "sig", "shingles"]).applyInPandas(_joined(percent), "a long, b long")
    more = staged(more.distinct(), "more")
    if not more.isEmpty():
        found = connected_components(found.toDF("a", "b").union(more))

    classes = classes.join(smallest(found, classes.select(F.col("rid").alias("node"), "least")).withColumnRenamed("node", "rid"), "rid", "left")
    out = spread_join(base.select("doc_id", "n_shingles", "text_key"), classes, "text_key", "doc_id", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "least", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_key")


def _text_keys(texts):
    import pandas as pd

    return pd.Series([text_key((t or "").encode("utf-8", "replace").lower()) for t in texts], dtype=object)


def deduplicated(documents: DataFrame, percent: int = 75) -> DataFrame:
    """documents without the rows that near_duplicates() drops, and each (doc_id, text) once; all columns stay.

    Of a doc_id with several texts, the rows of those texts go that are dropped.
    """
    found = staged(_judged(documents, percent).select("doc_id", "kept", "text_key"), "kept")
    gone, twice, part, of = (fresh(documents, c) for c in ("gone", "twice", "part", "of"))
    by_id = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("lost"))
    by_id = staged(by_id.filter("lost > 0 or kept > 1"), "by-id")
    key = F.col("doc_id").cast("long")
    out = documents.join(small_side(by_id.filter("kept = 0").select(F.col("doc_id").alias(gone))), key == F.col(gone), "left_anti")
    mixed = by_id.filter("kept > 0 and lost > 0").select("doc_id")
    if not mixed.isEmpty():
        side = small_side(mixed.withColumnRenamed("doc_id", part))
        lost = staged(found.filter("not kept").join(small_side(mixed), "doc_id", "left_semi").select(F.col("doc_id").alias(part), F.col("text_key").alias(gone)).distinct(), "lost")
        some = out.join(side, key == F.col(part), "left_semi").withColumn(of, F.pandas_udf(_text_keys, "binary")(F.col("text").cast("string")))
        some = some.join(lost, (key == F.col(part)) & F.col(of).eqNullSafe(F.col(gone)), "left_anti").drop(of)
        out = out.join(side, key == F.col(part), "left_anti").unionByName(some)
    discard(found)
    many = by_id.filter("kept > 1").select(F.col("doc_id").alias(twice))
    if many.isEmpty():
        return out
    side = small_side(many)
    once = out.join(side, key == F.col(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(side, key == F.col(twice), "left_anti").unionByName(once)
