"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative a group.

Vectors of equal label and equal components are one class. A class lives in the cell of its nearest centroid and is held
against the classes of its own cell and of every cell c whose bisecting hyperplane is at most the chord of the threshold
away: two unit vectors with cosine t are sqrt(2 - 2 t) apart, so a link can't cross farther. No link is lost, whatever
the centroids are. Cells are cut into home blocks and probe blocks of about BLOCK rows; one task multiplies one block
pair, adds up each probe's links (copies weighed) and returns a spanning forest, never pairs.

Centroids are fitted on classes with the smallest hash, SAMPLE or two a cell; every class is assigned. The number of cells
grows with the largest label, one for PER_CELL classes. More than FLAT cells come in two levels: a class's upper cell is that
of the nearest upper centroid, its cell the nearest below it, and both levels are probed by their own bisectors. Centroids
and sample have at most BYTES each, which is what goes to the driver and the tasks; only beyond that do cells grow, and then
the blocks of a cell grow in number, not in size.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without label or vec_id,
link with nothing and are kept (component_id is their own vec_id); vectors of unequal length don't link; repeated rows
count as copies; rows of one vec_id with different vectors are linked each by its own vector, and a component has the
smallest vec_id of all its rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, smallest, spread_join, staged

SAMPLE, ROUNDS, PER_CELL, FLAT, BLOCK, SEED, BYTES = 20_000, 12, 4_096, 1_024, 2_048, 5, 256 << 20


def _keyed(batches):
    for batch in batches:
        ids, labels, vectors = (batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding"))
        keys, units, dims = [], [], []
        for i, label, v in zip(ids, labels, vectors, strict=True):
            x = None
            if i is not None and label is not None and v and None not in v:
                x = np.array(v, float)
                top = np.abs(x).max()
                x = x / top if np.isfinite(x).all() and top > 0 else None
            if x is None:
                keys.append(None), units.append(None), dims.append(None)
                continue
            x = (x / np.sqrt((x * x).sum())) + 0.0
            keys.append(hashlib.blake2b(x.tobytes(), key=str(label).encode()[:60], digest_size=16).digest())
            units.append(x.tobytes())
            dims.append(len(x))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(units, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "label", "key", "unit", "dim"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """k unit centroids of unit rows x."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        n = np.sqrt((s * s).sum(axis=1))
        c = np.where(n[:, None] > 1e-12, s / np.maximum(n, 1e-12)[:, None], c)
    return c


def fitted_cells(sample: np.ndarray, cells: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Upper centroids, and the centroids of the cells below each; one upper cell for all if they are few."""
    if cells <= FLAT:
        return sample[:1] * 0, [spherical_kmeans(sample, cells)]
    top = spherical_kmeans(sample, int(np.ceil(np.sqrt(cells))))
    at = (sample @ top.T).argmax(axis=1)
    below = [sample[at == t] if (at == t).any() else top[t : t + 1] for t in range(len(top))]
    return top, [spherical_kmeans(x, max(1, round(cells * len(x) / len(sample)))) for x in below]


def _near(x: np.ndarray, c: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and which ones' rows may lie within chord of it."""
    s = x @ c.T
    own = s.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
    near = s[np.arange(len(x)), own][:, None] - s <= (chord + 1e-9) * apart[own] + 1e-12
    near[np.arange(len(x)), own] = True
    return own, near


def _assigned(centroids: dict[int, tuple[np.ndarray, list[np.ndarray]]], chord: float):
    def run(batches):
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist(), int)
            units = batch.column("unit").to_pylist()
            row, cell, home = [], [], []
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join([units[i] for i in at]), float).reshape(len(at), d)
                top, below = centroids.get(int(d), (x[:1] * 0, [x[:1] * 0]))
                upper, reached = _near(x, top, chord)
                first = 0
                for t, c in enumerate(below):
                    some = np.flatnonzero(reached[:, t])
                    if len(some):
                        own, near = _near(x[some], c, chord)
                        i, j = np.nonzero(near)
                        row.append(at[some[i]]), cell.append(j + first), home.append((own[i] == j) & (upper[some[i]] == t))
                    first += len(c)
            row, cell, home = (np.concatenate(v) if v else np.empty(0, int) for v in (row, cell, home))
            b = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(home.astype(bool))], [*b.schema.names, "cell", "home"])

    return run


def _products(least: float):
    def run(group):
        import pandas as pd

        home, probe = group[group["home_side"]], group[~group["home_side"]]
        if not len(home) or not len(probe):
            return pd.DataFrame({"rid": [], "links": [], "root": []}).astype("int64")
        h = np.frombuffer(b"".join(home["unit"]), float).reshape(len(home), -1)
        p = np.frombuffer(b"".join(probe["unit"]), float).reshape(len(probe), -1)
        hid, pid = home["rid"].to_numpy(), probe["rid"].to_numpy()
        s = p @ h.T
        near = s >= least
        for i, j in zip(*np.nonzero(np.abs(s - least) < 1e-12), strict=True):  # one summing order for both directions
            near[i, j] = cosine(p[i], h[j]) >= least
        near &= pid[:, None] != hid[None, :]
        pi, hi = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        near = near[np.ix_(pi, hi)]
        links = near @ home["n"].to_numpy()[hi]
        big = np.iinfo(np.int64).max
        mine, theirs = pid[pi].copy(), hid[hi].copy()
        while len(pi):
            new = np.minimum(mine, np.where(near, theirs[None, :], big).min(axis=1))
            other = np.minimum(theirs, np.where(near, new[:, None], big).min(axis=0))
            if (new == mine).all() and (other == theirs).all():
                break
            mine, theirs = new, other
        return pd.DataFrame({"rid": np.r_[pid[pi], hid[hi]], "links": np.r_[links, np.zeros(len(hi), np.int64)].astype(np.int64), "root": np.r_[mine, theirs]})

    return run


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    from math import fsum, sqrt

    return fsum(x * y) / sqrt(fsum(x * x) * fsum(y * y))


def near_duplicates(embeddings: DataFrame, least: float = 0.98, per_cell: int = PER_CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings(vec_id, embedding, label)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = staged(rows.mapInArrow(_keyed, "vec_id long, label long, key binary, unit binary, dim int"), "vectors")
    full = rows.filter("key is not null")
    classes = full.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    classes = staged(classes.withColumn("rid", F.monotonically_increasing_id()), "classes")
    most = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("most")).collect()  # one row for each length of vectors
    wanted = {r["dim"]: max(1, min(-(-r["most"] // per_cell), BYTES // (8 * r["dim"]))) for r in most}
    rows_most = max(1, BYTES // (8 * max(wanted, default=1)))
    sample = classes.orderBy(F.xxhash64("key"), "key").select("dim", "unit").limit(min(max(SAMPLE, 2 * max(wanted.values(), default=0)), rows_most)).collect()
    centroids = {}
    for d, cells in wanted.items():
        own = [r["unit"] for r in sample if r["dim"] == d]
        if own:
            centroids[d] = fitted_cells(np.frombuffer(b"".join(own), float).reshape(len(own), d), cells)
    near = classes.select("rid", "n", "label", "dim", "unit").mapInArrow(_assigned(centroids, float(np.sqrt(2 - 2 * least))), "rid long, n long, label long, dim int, unit binary, cell int, home boolean")
    near = staged(near, "cells")
    cell = ["label", "dim", "cell"]
    size = near.groupBy(*cell).agg(F.ceil(F.count_if("home") / block).alias("hb"), F.ceil(F.count("*") / block).alias("pb")).filter("hb > 0")
    dealt = near.join(size, cell)
    at = lambda seed, n: F.pmod(F.xxhash64("rid", F.lit(seed)), F.col(n))
    homes = dealt.filter("home").select(*cell, at(1, "hb").alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pb") - 1)).alias("p"), "rid", "n", "unit", F.lit(True).alias("home_side"))
    probes = dealt.select(*cell, F.explode(F.sequence(F.lit(0).cast("long"), F.col("hb") - 1)).alias("h"), at(2, "pb").alias("p"), "rid", "n", "unit", F.lit(False).alias("home_side"))
    found = homes.union(probes).groupBy(*cell, "h", "p").applyInPandas(_products(least), "rid long, links long, root long")
    found = staged(found, "links")
    comps = connected_components(found, "rid", "root")
    links = found.groupBy("rid").agg(F.sum("links").alias("links")).filter("links > 0")
    named = smallest(comps, classes.select(F.col("rid").alias("node"), "least")).withColumnRenamed("node", "rid")
    each = classes.select("key", "rid", "least", "n").join(links, "rid", "left").join(named, "rid", "left")
    out = spread_join(rows.select("vec_id", "key"), each, "key", "vec_id", "left")
    out = out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).cast("long").alias("n_links"), F.coalesce("component_id", "least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
