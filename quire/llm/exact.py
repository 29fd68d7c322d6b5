"""Exact duplicates by skew-safe combining: copies meet locally, then in salted digest groups, then among salt winners.

1. A narrow scan writes (doc_id, SHA-256 of the text) of every row; a digest that occurs once needs no comparison.
2. The texts of the others are combined in three stages, each grouped by digest and whole text: within the partition that
   reads them (the partial aggregation), by digest, salt and text, and, where a digest is salted, by digest and text.
   Salts are numbers of partitions, so that a partition's copies are one row before they are shuffled. Salted digests
   have more than HOT copies and more than a HOT_SHARE-th of all rows, so there are fewer than HOT_SHARE of them.
3. Winners go back to the narrow rows by digest. Digests that turn out to stand for several texts (none by SHA-256, but
   any digest may be given) go back by text.

Native: DataFrame functions only. Texts are equal when identical after lower-casing A-Z.

Edge cases: null text is empty; among equal texts the largest doc_id stays; rows without doc_id give way to any other, and
where all copies lack one, keep_id is null and all are kept by exact_duplicates(), one of them by deduplicated(); repeated
rows of the doc_id that stays are all kept by exact_duplicates(), once by deduplicated(); rows of one doc_id with
different texts are judged by their texts; an empty table gives no rows; other columns are not read, and deduplicated()
returns them whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SALTS, discard, fresh, small_side, spread_join, staged

HOT, HOT_SHARE = 64, 100_000
#: Repeated digests that are broadcast at most, about 25 MB; beyond, all texts go through the combining.
REPEATED = 250_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str) -> Column:
    """The text that is compared: A-Z in lower case, nothing else changed, null as empty."""
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _combined(docs: DataFrame) -> DataFrame:
    """(digest, hot, texts, keep_id, group_size): one row a digest of docs(doc_id, digest, t, hot)."""
    largest, rows = F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    local = docs.withColumn("salt", F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0))
    salted = local.groupBy("digest", "hot", "salt", "t").agg(largest, rows)
    salted = staged(salted.withColumn("t", F.when(F.col("hot"), F.col("t"))).drop("salt"), "salted")
    winners = salted.filter("hot").groupBy("digest", "hot", "t").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    both = salted.filter("not hot").unionByName(winners).groupBy("digest", "hot")
    out = staged(both.agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")), "winners")
    discard(salted)
    return out


def exact_duplicates(documents: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of documents(doc_id, text)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), normalised("text").alias("t"))
    sha = "digest" if digest is sha256 else "sha"
    rows = staged(docs.select("doc_id", *(f(F.col("t")).alias(c) for c, f in {"digest": digest, sha: sha256}.items())), "digests")
    counts = staged(rows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    hot = F.col("n") > max(HOT, rows.count() // HOT_SHARE)
    docs = docs.withColumn("digest", digest(F.col("t")))
    if counts.limit(REPEATED + 1).count() <= REPEATED:
        some = docs.join(F.broadcast(counts.select("digest", hot.alias("hot"))), "digest")
    else:
        some = docs.join(F.broadcast(counts.filter(hot).select("digest", F.lit(True).alias("hot"))), "digest", "left")
        some = some.withColumn("hot", F.col("hot").isNotNull())
    won = _combined(some)
    discard(counts)

    alone = won.filter("texts = 1").drop("texts")
    few = F.broadcast(alone.filter("hot").drop("hot"))  # fewer than HOT_SHARE
    cold = rows.join(few.select("digest"), "digest", "left_anti").join(alone.filter("not hot").drop("hot"), "digest", "left")
    out = cold.unionByName(rows.join(few, "digest"))
    clash = won.filter("texts > 1").select("digest")
    if not clash.isEmpty():
        out = out.join(small_side(clash), "digest", "left_anti")
        own = docs.join(small_side(clash), "digest", "left_semi")
        by_text = own.groupBy("t").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        found = spread_join(own, by_text, "t", "doc_id").withColumn(sha, sha256(F.col("t")))
        out = out.unionByName(found.select(*out.columns))
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    out = out.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select("doc_id", "keep_id", size.alias("group_size"), kept.alias("kept"), F.lower(F.hex(sha)).alias("text_sha256"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """documents without the rows that exact_duplicates() drops, and each (doc_id, text) once; all columns stay."""
    found = staged(exact_duplicates(documents).select("doc_id", "kept", F.unhex("text_sha256").alias("sha")), "exact")
    of = fresh(documents, "sha")
    docs = documents.withColumn(of, sha256(normalised("text")))
    own = F.col("doc_id").cast("long")

    def ids(rows: DataFrame) -> tuple[DataFrame, Column]:
        side = staged(rows.select(F.col("doc_id").alias("id_"), F.col("sha").alias("sha_")).distinct(), "ids").toDF(fresh(docs, "id_"), fresh(docs, "sha_"))
        return small_side(side, REPEATED), own.eqNullSafe(F.col(side.columns[0])) & (F.col(of) == F.col(side.columns[1]))

    gone, same = ids(found.filter("not kept"))
    out = docs.join(gone, same, "left_anti")
    many, same = ids(found.filter("kept").groupBy("doc_id", "sha").count().filter("count > 1"))
    discard(found)
    if many.isEmpty():
        return out.drop(of)
    once = out.join(many, same, "left_semi").dropDuplicates(["doc_id", of])
    return out.join(many, same, "left_anti").unionByName(once).drop(of)
