"""Staging, guarded joins and connected components shared by the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A set of ids is broadcast only when it was counted to be at most this long (about 24 MB as a hash relation).
BROADCAST_IDS = 1_000_000
#: Parts that the rows of one group are dealt to, as bits of a long.
SALTS = 63


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or an own one where that is unset on local masters."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file:///tmp/checkpoints/quire"
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


_made: list[list[DataFrame]] = []


@contextmanager
def stages():
    """The frames that are staged meanwhile, for discard() once what was made of them is written."""
    own: list[DataFrame] = []
    _made.append(own)
    try:
        yield own
    finally:
        _made.remove(own)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage = path
    for own in _made:
        own.append(out)
    return out


def discard(*stages: DataFrame) -> None:
    """Delete staged frames that nothing reads any more; what is never discarded goes when the session ends."""
    for df in stages:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df.stage)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _dealt(rows: DataFrame, spread: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))


def _parts(salted: DataFrame, key: str, *totals) -> DataFrame:
    """(key, totals, salts): one row a key, with one bit for each of its salts; partial sums go into the one shuffle."""
    return salted.groupBy(key).agg(*totals, F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))


def _each_part(whole: DataFrame) -> DataFrame:
    """A row for each bit of salts, whose number becomes salt."""
    some = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)
    one = F.array(F.bit_count(F.col("salts") - 1))
    salts = F.when(F.bit_count("salts") == 1, one).otherwise(some)
    return whole.select("*", F.explode(salts).alias("salt")).drop("salts")


def grouped(rows: DataFrame, key: str, spread: str, only: str | None = None, **totals: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a salt, the totals of each group repeated for each of its salts); to be joined by key and salt.

    totals: name=(min, max, sum or count, expression); only: a condition on them. A group's rows are dealt by spread to
    SALTS parts, so that a group of any size is never one task's; a group has at most SALTS rows in the second frame.
    """
    salted = _dealt(rows, spread)
    one = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    whole = _parts(salted, key, *(one[kind](F.expr(x)).alias(name) for name, (kind, x) in totals.items()))
    return salted, _each_part(whole.filter(only) if only else whole)


@contextmanager
def pinned_splits(spark: SparkSession):
    """Two scans of the same files are cut into the same partitions even if executors come or go between them."""
    key = "spark.sql.files.minPartitionNum"
    old = spark.conf.get(key, None)
    spark.conf.set(key, old or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)


def small_side(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """ids with a broadcast hint if it has at most limit rows, else as it is (Spark then shuffles both sides)."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


def spread_join(rows: DataFrame, side: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """rows joined with side(key, ...), one row a key: side's row goes to each of the at most SALTS parts of its key's rows."""
    salted = _dealt(rows, spread)
    there = _each_part(_parts(salted, key).join(side, key))
    return salted.join(there, [key, "salt"], how).drop("salt")


def _stars(e: DataFrame) -> bool:
    """Whether every u has one v only, and no v is a u."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
    ends = ends.union(e.select("v", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return not ends.agg(F.max(F.expr("child > 1 or child > 0 and parent > 0"))).first()[0]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest id reachable, for every node of an edge; alternating large-star and small-star.

    Each round is written to the shared folder, the one before is then deleted; the loop ends when all components are
    stars around their smallest id. One value a round reaches the driver. The neighbours of a hub are dealt to many tasks.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = staged(e, "cc")
    while not _stars(e):
        both, least = grouped(e.select("u", "v").union(e.select("v", "u")), "u", "v", m=("min", "v"))
        large = both.join(least, ["u", "salt"]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        dealt, least = grouped(large, "u", "v", m=("min", "v"))
        other = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))  # u itself goes with its least neighbour
        after = staged(dealt.join(least, ["u", "salt"]).select(other.alias("u"), F.col("m").alias("v")).distinct(), "cc")
        discard(e)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def smallest(found: DataFrame, of: DataFrame) -> DataFrame:
    """(node, component_id): of connected_components() found, the smallest number least among of(node, least) in the component."""
    own = found.join(of, "node")
    own, least = grouped(own, "component", "node", component_id=("min", "least"))
    return own.join(least, ["component", "salt"]).select("node", "component_id")
