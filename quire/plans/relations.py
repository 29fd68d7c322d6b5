"""The catalogue's relations over the driver's tables, and the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each document; labels tell how it went."""
    d, lab = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), read(spark, sf_dir, "labels")
    known = F.col("toxic").isNotNull()
    status = F.when(~known, F.when(F.col("doc_id") % 7 == 0, "IN_PROGRESS").otherwise("PENDING")).when(F.col("toxic") == 1, "FAILED").otherwise("DONE")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.concat("source", F.lit("/page_"), F.col("doc_id"), F.lit(".jpg")).alias("file_path"), F.col("n_chars").alias("file_size"), status.alias("status"),
        F.when(known, (F.col("doc_id") % 100) / 100.0).alias("confidence"), F.when(F.col("toxic") == 1, "IOError: page").alias("error_msg"), F.when(known, F.col("n_chars") * F.lit(0.5).cast("double")).alias("processing_time_ms"),
    )


TASKS = """tasks AS (SELECT d.doc_id AS id, source || '/page_' || d.doc_id || '.jpg' AS file_path, n_chars AS file_size,
 CASE WHEN toxic IS NULL THEN CASE WHEN d.doc_id % 7 = 0 THEN 'IN_PROGRESS' ELSE 'PENDING' END WHEN toxic = 1 THEN 'FAILED' ELSE 'DONE' END AS status,
 CASE WHEN toxic IS NOT NULL THEN (d.doc_id % 100) / 100.0::DOUBLE END AS confidence, CASE WHEN toxic = 1 THEN 'IOError: page' END AS error_msg,
 CASE WHEN toxic IS NOT NULL THEN n_chars * 0.5::DOUBLE END AS processing_time_ms FROM documents d LEFT JOIN labels l USING (doc_id))"""

HALL_NAMES = ("Khu Trưng Bày Chung", "Di sản Khoa học & Giáo dục", "Phòng Khách")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each web page."""
    p = read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.length("html").cast("long").alias("size"))
    i = F.col("page_id")
    return p.select(
        i.alias("id"), slugify("title").alias("slug"), "title", F.concat(F.lit("nhóm "), i % 5).alias("category"), F.col("url").alias("tags"), F.substring("title", 1, 20).alias("summary"), (F.col("size") % 97).alias("total_pages"), F.col("size").alias("word_count"), (F.col("size") * 3).alias("file_size_bytes"),
        F.when(i % 4 == 0, F.concat(F.lit("src"), i % 40)).otherwise("").alias("source_id"), F.when(i % 7 == 0, "PROCESSING").otherwise("COMPLETED").alias("status"), F.when(i % 6 == 0, 0).otherwise(1).alias("is_public"),
        F.when(i % 3 == 0, F.concat(F.lit("MH-"), i)).otherwise("").alias("artifact_code"), F.lit("").alias("period_era"), F.lit("").alias("provenance"), F.lit("").alias("material_condition"), F.when(i % 2 == 0, "ghi chú").otherwise("").alias("curator_notes"),
        F.element_at(F.array(*map(F.lit, HALL_NAMES)), (i % 3 + 1).cast("int")).alias("exhibition_hall"), F.timestamp_seconds(F.lit(1700000000) + i % 50 * 3600).alias("created_at"),
    )


SLUG = """coalesce(nullif(trim(regexp_replace(regexp_replace(replace(strip_accents(lower(trim({0}))), 'đ', 'd'), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), '-'), ''), 'untitled')"""

BOOKS = f"""p AS (SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, length(html)::BIGINT AS size FROM pages),
books AS (SELECT page_id AS id, {SLUG.format('title')} AS slug, title, 'nhóm ' || page_id % 5 AS category, url AS tags, substr(title, 1, 20) AS summary, size % 97 AS total_pages, size AS word_count, size * 3 AS file_size_bytes,
 CASE WHEN page_id % 4 = 0 THEN 'src' || page_id % 40 ELSE '' END AS source_id, CASE WHEN page_id % 7 = 0 THEN 'PROCESSING' ELSE 'COMPLETED' END AS status, CASE WHEN page_id % 6 = 0 THEN 0 ELSE 1 END AS is_public,
 CASE WHEN page_id % 3 = 0 THEN 'MH-' || page_id ELSE '' END AS artifact_code, '' AS period_era, '' AS provenance, '' AS material_condition, CASE WHEN page_id % 2 = 0 THEN 'ghi chú' ELSE '' END AS curator_notes,
 CASE page_id % 3 WHEN 0 THEN '{HALL_NAMES[0]}' WHEN 1 THEN '{HALL_NAMES[1]}' ELSE '{HALL_NAMES[2]}' END AS exhibition_hall, make_timestamp((1700000000 + page_id % 50 * 3600) * 1000000) AS created_at FROM p)"""


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of books from the turns of conversations."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("book"), F.format_string("p%d.txt", "turn").alias("filename"), "text", "role")
