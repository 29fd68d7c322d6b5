"""What a user runs every day, made of the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.repair import restore_diacritics
from ..functions.text import slugify, stem, summary, word_count
from . import assembly, library, tasks


def book_outputs(pages: DataFrame, merged: DataFrame) -> DataFrame:
    """(book): every book that has a page text of pages(book, ...) or a merged text of merged(book, ...), but hidden ones."""
    return pages.select("book").union(merged.select("book")).filter("not startswith(book, '.')").distinct()


def output_files(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(book) from page folders and from names(name) of merged files, by their stem."""
    return book_outputs(pages, names.filter(F.lower("name").endswith(".txt")).select(stem("name").alias("book")))


def sync_catalogue(books: DataFrame, pages: DataFrame, merged: DataFrame, covers: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """books with every output book in it: page number, words, size and summary of its merged text, cover, COMPLETED.

    pages(book, filename), merged(book, text), covers(book, cover_image); books are taken in order of their name.
    """
    found = book_outputs(pages, merged)
    n = pages.filter(~F.col("filename").startswith(".") & F.lower("filename").endswith(".txt")).groupBy("book").agg(F.count("*").alias("total_pages"))
    whole = merged.select("book", word_count("text").alias("word_count"), F.octet_length("text").cast("long").alias("file_size_bytes"), summary("text").alias("summary"))
    out = found.join(n, "book", "left").join(whole, "book", "left")
    if covers is not None:
        out = out.join(covers, "book", "left")
    cover = [F.coalesce("cover_image", F.lit("")).alias("cover_image")] if covers is not None else []
    delta = out.select(F.col("book").alias("seq"), F.col("book").alias("title"), slugify("book").alias("slug"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total_pages", "word_count", "file_size_bytes")), F.coalesce("summary", F.lit("")).alias("summary"), F.lit("COMPLETED").alias("status"), *cover)
    return library.upsert(books, delta, now)


def merge_and_package(books: DataFrame, pages: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged texts, archives, books after it) of pages(book, filename, text); words of known books stay as they are."""
    pages = pages.filter(F.lower("filename").endswith(".txt"))
    merged = assembly.merge_pages(pages)
    counts = pages.groupBy("book").agg(F.count("*").alias("total_pages"))
    delta = merged.select("book", F.octet_length("text").cast("long").alias("file_size_bytes")).join(counts, "book")
    delta = delta.select(F.col("book").alias("seq"), F.col("book").alias("title"), slugify("book").alias("slug"), "total_pages", "file_size_bytes", F.lit("COMPLETED").alias("status"))
    return merged, assembly.zip_books(pages, merged), library.upsert(books, delta, now)


def scan_and_register(known: DataFrame, scanned: DataFrame, book: str | None = None, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(tasks with the new files of scanned(rel_path, size), statistics of one book or of each)."""
    found = scanned.select(F.col("rel_path").alias("file_path"), F.col("size").cast("long").alias("file_size"))
    after = tasks.register(known, tasks.in_book(found, book), now)
    return after, tasks.stats(after, book) if book else tasks.stats_by_book(after)


def list_jobs(known: DataFrame, scanned: DataFrame, running: DataFrame, outputs: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(tasks after the scan, state of every book's job with its output files)."""
    after, by_book = scan_and_register(known, scanned, None, now)
    return after, tasks.job_status(by_book, running, outputs)


def restore(books: DataFrame, manifest: DataFrame, now: Column | None = None) -> DataFrame:
    """books after the rows of a manifest, in their order (column pos); covers are the slugs'."""
    rows = manifest.withColumn("slug", F.coalesce(F.nullif("slug", F.lit("")), slugify("title")))
    rows = rows.withColumn("cover_image", F.concat(F.lit("/covers/"), "slug", F.lit(".jpg")))
    return library.upsert(books, rows.withColumnRenamed("pos", "seq").drop("id", "created_at", "updated_at"), now)


def retry_run(known: DataFrame, run, book: str | None = None, now: Column | None = None) -> DataFrame:
    """tasks after the failed rows were set back and run(tasks to do) gave results(file_path, success, ...) for them."""
    again = tasks.retry_failed(known, now)
    todo = tasks.pending(again.join(tasks.in_book(known.filter("status = 'FAILED'"), book).select("id"), "id", "left_semi"))
    return tasks.apply_results(again, run(todo), now)


def restore_texts(texts: DataFrame, words: list[str]) -> tuple[DataFrame, Observation]:
    """texts(..., text) with diacritics restored, and the counts of the same pass: once the frame is written, get has files
    and changed."""
    seen = Observation()
    both = restore_diacritics(texts.withColumn("before", F.col("text")), "text", words)
    counts = F.count("*").alias("files"), F.count_if(~F.col("text").eqNullSafe(F.col("before"))).alias("changed")
    return both.observe(seen, *counts).drop("before"), seen
