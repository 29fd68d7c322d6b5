"""Documents from pages and back: numbering, merging, splitting, alignment, dossiers and exhibition halls."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import citations, natural_key
from .library import DEFAULT_HALL


def number_pages(pages: DataFrame) -> DataFrame:
    """pages(book, filename, ...) with page_num in natural order and total_pages."""
    w = Window.partitionBy("book")
    return pages.withColumn("page_num", F.row_number().over(w.orderBy(natural_key("filename"), "filename"))).withColumn("total_pages", F.count("*").over(w))


def merge_pages(pages: DataFrame) -> DataFrame:
    """(book, text): all pages of a book in natural order, each behind its marker."""
    n = number_pages(pages)
    part = F.concat(F.lit("=== [Trang "), F.col("page_num"), F.lit("/"), F.col("total_pages"), F.lit("] "), F.col("filename"), F.lit(" ===\n\n"), F.trim("text"), F.lit("\n\n"))
    parts = n.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("page_num", part.alias("part")))).alias("p"))
    return parts.select("book", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("text"))


#: The line before each page of a merged text, and the form that readers look for.
MARKER = r"===\s*\[Trang\s+(\d+)/\d+\]\s+([^=\n\r]+)\s*==="


READER_MARKER = r"===\s*\[Trang\s+(\d+)/\d+\]\s+([^=]+)\s*==="


def split_merged(merged: DataFrame, reader: bool = False) -> DataFrame:
    """(book, page_num, filename, text) for each page of merged(book, text); without markers one page full.txt.

    reader=True takes the reader's form of markers: case counts, and names may run over lines.
    """
    mark, flags = (READER_MARKER, "(?s)") if reader else (MARKER, "(?is)")
    parts = F.regexp_extract_all("text", F.lit(rf"{flags}{mark}(?:(?!{mark}).)*+"), F.lit(0))
    own = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.col("text")))
    out = merged.select("book", (F.size(parts) > 0).alias("marked"), F.posexplode(own).alias("i", "part"))
    m = lambda g: F.regexp_extract("part", rf"{flags}^{mark}", g)
    body = F.regexp_replace("part", rf"{flags}^{mark}", "")
    num = F.when(F.col("marked"), m(1).cast("long")).otherwise(1)
    return out.select("book", num.cast("long").alias("page_num"), F.when(F.col("marked"), F.trim(m(2))).otherwise("full.txt").alias("filename"), F.trim(body, F.lit(" \t\r\n")).alias("text"))


def align_scans(texts: DataFrame, images: DataFrame, covers: DataFrame | None = None) -> DataFrame:
    """The i-th text of each book beside its i-th image; both(book, filename). covers(book) have an image for page 1."""
    t = number_pages(texts)
    i = number_pages(images).select("book", "page_num", F.col("filename").alias("image"))
    out = t.join(i, ["book", "page_num"], "left")
    has = F.col("image").isNotNull()
    if covers is not None:
        out = out.join(covers.select("book", F.lit(True).alias("cover")).distinct(), "book", "left")
        has = has | ((F.col("page_num") == 1) & F.coalesce("cover", F.lit(False)))
    return out.withColumn("has_image", has).drop("cover")


def zip_books(pages: DataFrame, merged: DataFrame) -> DataFrame:
    """(book, archive): the merged text at the root and the pages under pages/."""

    def pack(key, texts, whole):
        import pandas as pd

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for t in whole["text"]:
                z.writestr(f"{key[0]}.txt", t)
            for name, t in zip(texts["filename"], texts["text"], strict=True):
                z.writestr(f"pages/{name}", t)
        return pd.DataFrame({"book": [key[0]], "archive": [out.getvalue()]})

    return pages.select("book", "filename", "text").groupBy("book").cogroup(merged.select("book", "text").groupBy("book")).applyInPandas(pack, "book string, archive binary")


def dossier(books: DataFrame, publisher: str = "Thư viện số", year: int = 2026, url: str = "https://library.example/exhibit/") -> DataFrame:
    """Curator fields with their defaults, and citations, for every book."""
    filled = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), d).alias(c)
    return books.select(
        "id", "slug", "title",
        filled("artifact_code", F.format_string("HERITAGE-%04d", "id")), filled("period_era", F.lit("Tư liệu Lịch sử & Văn hóa")), filled("provenance", F.lit("Kho tư liệu số hóa")), filled("material_condition", F.lit("Bản lưu trữ số hóa độ phân giải cao")),
        filled("curator_notes", F.coalesce(F.nullif("summary", F.lit("")), F.lit("Tư liệu quý được số hóa."))), filled("exhibition_hall", F.lit(DEFAULT_HALL)), citations("title", "slug", publisher, year, url).alias("citations"),
    )


#: The standard halls: name, id, title, subtitle; the last is the default.
HALLS = (
    ("Huyền tích & Tín ngưỡng Sông Hồng", "song-hong-heritage", "Huyền tích & Tín ngưỡng Sông Hồng", "Ký ức phù sa, Tứ Bất Tử và tín ngưỡng ngàn năm châu thổ"),
    ("Địa phương chí & Ký ức Làng xã", "dia-phuong-chi", "Địa phương chí & Ký ức Làng xã", "Gia phả, địa bạ, hương ước và di tích các vùng đất văn hiến"),
    ("Di sản Khoa học & Giáo dục", "khoa-hoc-giao-duc", "Di sản Khoa học & Giáo dục", "Luận án tiến sĩ, chuyên khảo khoa học và tài liệu nghiên cứu ứng dụng"),
    (DEFAULT_HALL, "khu-trung-bay-chung", "Bộ Sưu Tập Tổng Hợp", "Các ấn phẩm văn hóa và tư liệu đa dạng đã được giám định số"),
)


def hall_of(column="exhibition_hall"):
    """The standard hall that a book stands in; any other name is the default hall."""
    return F.when(F.col(column).isin(*(h[0] for h in HALLS)), F.col(column)).otherwise(DEFAULT_HALL)


def halls(books: DataFrame) -> DataFrame:
    """hall, hall_id, hall_title, place, n_books and the artifact (id, slug, title, total_pages, created_at) of every public book.

    Halls come in order of their first artifact from the newest book on, then the empty standard halls but the default
    one, with a null artifact. One row an artifact: a hall's catalogue is never collected; readers order by place,
    created_at and id descending.
    """
    dim = books.sparkSession.createDataFrame([(*h[:3], k) for k, h in enumerate(HALLS)], "hall string, hall_id string, hall_title string, pos int")
    shown = books.filter("is_public = 1").withColumn("hall", hall_of())
    per = shown.groupBy("hall").agg(F.count("*").alias("n_books"), F.max(F.struct("created_at", "id")).alias("newest"))
    w = Window.orderBy(F.desc("newest"), "pos")  # at most one row a standard hall
    rows = dim.join(per, "hall", "left").filter(F.col("newest").isNotNull() | (F.col("hall") != DEFAULT_HALL)).withColumn("place", F.row_number().over(w))
    rows = rows.select("hall", "hall_id", "hall_title", "place", F.coalesce("n_books", F.lit(0)).cast("long").alias("n_books"))
    item = F.struct("id", "slug", "title", "total_pages", "created_at").alias("artifact")
    full = shown.select("hall", item).join(F.broadcast(rows), "hall")
    return full.unionByName(rows.filter("n_books = 0").withColumn("artifact", F.lit(None).cast(full.schema["artifact"].dataType)))


def museum_totals(books: DataFrame) -> DataFrame:
    """Artifacts, pages, words and shown halls: the three named ones always, the default hall if a book stands there."""
    here = F.max((hall_of() == DEFAULT_HALL).cast("int"))
    return books.filter("is_public = 1").agg(F.count("*").alias("artifacts"), F.coalesce(F.sum("total_pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), (F.coalesce(here, F.lit(0)) + len(HALLS) - 1).cast("long").alias("halls"))


def chat_context(pages: DataFrame, limit: int = 12, size: int = 6000) -> DataFrame:
    """(book, context): the first non-empty pages of each book, cut to size."""
    n = number_pages(pages.filter("trim(text) <> ''")).filter(F.col("page_num") <= limit)
    parts = n.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("page_num", "text"))).alias("p"))
    return parts.select("book", F.left(F.array_join(F.transform("p", lambda x: F.concat(F.lit("[Trang "), x["page_num"], F.lit("] "), x["text"])), "\n"), F.lit(size)).alias("context"))


#: The heading of a chat's sources, and the answer where no service gives one.
CHAT_HEADING = "\n\n--- Trích đoạn nội dung hiện vật ---\n\n"


def chat_prompt_context(pages: DataFrame, limit: int = 12, size: int = 6000) -> DataFrame:
    """(book, context): the heading and the texts of the first pages that have one, cut to size; '' without any."""
    n = number_pages(pages).filter((F.col("page_num") <= limit) & (F.col("text") != ""))
    parts = n.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("page_num", "text"))).alias("p"))  # at most limit pages
    body = F.left(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"), F.lit(size))
    return pages.select("book").distinct().join(parts, "book", "left").select("book", F.coalesce(F.concat(F.lit(CHAT_HEADING), body), F.lit("")).alias("context"))


def fallback_answer():
    """The answer from a book's fields alone, as a column."""
    return F.concat(
        F.lit("Kính chào quý khách. Về hiện vật **"), "title", F.lit("** ("), "artifact_code", F.lit(", niên đại "), "period_era", F.lit("), ghi chép giám tuyển ghi nhận: "), "curator_notes", F.lit(". Hiện vật có nguồn gốc từ "), "provenance",
        F.lit(". Quý khách có thể sử dụng chế độ 'So sánh đối chiếu' (Dual-View) phóng đại trang sách để trực tiếp quan sát văn bản nguyên tác."),
    )


def last_logs(logs: DataFrame, key: str, order: list, keep: int = 100) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return logs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)


def changed_logs(logs: DataFrame, key: str, order: list, line: str) -> DataFrame:
    """logs without lines equal to the one before."""
    before = F.lag(line).over(Window.partitionBy(key).orderBy(*order))
    return logs.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col(line))).drop("before")


def sequential_names(files: DataFrame, key: str = "book") -> DataFrame:
    from ..functions.text import suffix

    n = F.row_number().over(Window.partitionBy(key).orderBy(natural_key("filename"), "filename"))
    return files.withColumn("new_name", F.format_string("page_%04d%s", n, suffix("filename")))


def flatten_names(files: DataFrame, *within: str) -> DataFrame:
    """Archive members(path) by file name; from the second of a name (within the given columns) on, the parent's name goes before it."""
    from ..functions.text import base_name

    name = base_name("path")
    n = F.row_number().over(Window.partitionBy(*within, name).orderBy("path"))
    parent = F.coalesce(F.nullif(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1), F.lit("")), F.lit("root"))
    return files.withColumn("flat_name", F.when(n > 1, F.concat(parent, F.lit("_"), name)).otherwise(name))
