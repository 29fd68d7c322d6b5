"""The book catalogue: search, sort, page, group, find duplicates, upsert, patch and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import categorize, slugify, sqlite_like
from .numbering import numbered
from .staging import small_side

#: Fixed value: the hall of books that have none.
DEFAULT_HALL = "Khu Trưng Bày Chung"
SORTS = {"newest": [F.desc, "created_at"], "pages_desc": [F.desc, "total_pages"], "pages_asc": [F.asc, "total_pages"], "title_asc": [F.asc, "title"]}


def select_books(books: DataFrame, category: str | None = None, search: str | None = None) -> DataFrame:
    out = books.filter("is_public = 1")
    if category and category != "all":
        out = out.filter(F.col("category") == category)
    if search:
        term = f"%{search.strip()}%"
        out = out.filter(sqlite_like("title", term) | sqlite_like("tags", term) | sqlite_like("summary", term))
    return out


def list_books(books: DataFrame, category=None, search=None, sort: str = "newest", limit: int = 50, offset: int = 0) -> DataFrame:
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    order, column = SORTS.get(sort, SORTS["newest"])
    return select_books(books, category, search).orderBy(order(column), order("id")).offset(offset).limit(limit)


def count_books(books: DataFrame, category=None, search=None) -> DataFrame:
    return select_books(books, category, search).agg(F.count("*").alias("total"))


def categories(books: DataFrame) -> DataFrame:
    return books.filter("is_public = 1").groupBy("category").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "category")


def by_slug(books: DataFrame, slug: str) -> DataFrame:
    return books.filter(F.col("slug") == slug).orderBy("id").limit(1)


def by_title(books: DataFrame, title: str) -> DataFrame:
    """The book whose slug is the title's."""
    return books.filter(F.col("slug") == slugify(F.lit(title))).orderBy("id").limit(1)


def page_totals(page: DataFrame) -> DataFrame:
    """Sums over the rows of one listed page of books."""
    return page.agg(F.count("*").alias("books"), F.coalesce(F.sum("total_pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))


def in_hall(artifacts: DataFrame, hall: str = "all") -> DataFrame:
    return artifacts if hall == "all" else artifacts.filter(F.col("hall") == hall)


def find_duplicates(books: DataFrame, queries: DataFrame) -> DataFrame:
    """Per qid of queries(qid, title, source_id) the completed book of equal source, else of equal slug or title.

    Of several books the one with the smallest id; books are reduced to that before the joins, as copies would meet in pairs.
    """
    done = books.filter("status = 'COMPLETED'")
    first = lambda c: done.groupBy(F.col(c).alias(f"_{c}")).agg(F.min("id").alias(f"of_{c}"))
    q = queries.select("qid", slugify("title").alias("slug"), "title", "source_id")
    # Many queries have no source: unless there are many sources, these rows are not shuffled by it.
    of = q.join(small_side(first("source_id").filter("_source_id <> ''")), F.col("source_id") == F.col("_source_id"), "left")
    for c in ("slug", "title"):
        of = of.join(first(c), F.col(c) == F.col(f"_{c}"), "left")
    found = of.groupBy("qid").agg(F.min("of_source_id").alias("source"), F.min(F.least("of_slug", "of_title")).alias("name"))
    return found.select("qid", F.when(F.col("qid").isNotNull(), F.coalesce("source", "name")).alias("duplicate_id"))


#: What a new book has where nothing is given.
DEFAULTS = {
    "title": "", "category": "Tài liệu tổng hợp", "tags": "", "total_pages": 0, "word_count": 0, "file_size_bytes": 0, "source_type": "upload", "source_id": "", "cover_image": "", "summary": "", "is_public": 1, "status": "COMPLETED",
    "artifact_code": "", "period_era": "", "provenance": "", "material_condition": "", "curator_notes": "", "exhibition_hall": DEFAULT_HALL, "highlights_json": "[]",
}

_ALWAYS = ("title", "status")
_POSITIVE = ("total_pages", "word_count", "file_size_bytes")
_FILLED = ("cover_image", "artifact_code", "period_era", "provenance", "material_condition", "curator_notes")
MERGED = (*_ALWAYS, *_POSITIVE, *_FILLED, "exhibition_hall", "highlights_json")


def _qualifies(c: str) -> Column:
    if c in _ALWAYS:
        return F.lit(True)
    if c in _POSITIVE:
        return F.col(c) > 0
    if c in _FILLED:
        return F.col(c) != ""
    return F.col(c) != (DEFAULT_HALL if c == "exhibition_hall" else "[]")


def upsert(books: DataFrame, delta: DataFrame, now: Column | None = None) -> DataFrame:
    """books after the rows of delta(seq, title, ...) in order of seq: inserts, and the columns that a conflict replaces.

    A row without slug has its title's, one without category the category of its title; what is missing or null
    otherwise has its default. A column of an existing slug takes the last value that qualifies: counts only above 0,
    texts only if not empty; category, tags, summary, visibility and source stay as they were. New books are numbered
    behind the highest id in order of their first row. Repeated slugs in delta fold in order of seq.
    """
    now = F.current_timestamp() if now is None else now
    given = delta.withColumn("slug", F.coalesce(F.nullif("slug", F.lit("")), slugify("title")) if "slug" in delta.columns else slugify("title"))
    kind = {f.name: f.dataType for f in books.schema}
    for c, v in DEFAULTS.items():
        if c in kind:
            default = categorize("title") if c == "category" else F.lit(v)
            own = F.nullif(F.col(c), F.lit("")) if c == "category" and c in delta.columns else F.col(c) if c in delta.columns else F.lit(None)
            given = given.withColumn(c, F.coalesce(own.cast(kind[c]), default.cast(kind[c])))
    merged = [c for c in MERGED if c in kind]
    first = [c for c in given.columns if c in kind and c not in ("id", "slug", "created_at", "updated_at")]
    # A default that no column of delta gave never qualifies, but for title and status.
    last = lambda c: F.max_by(F.col(c), F.when(_qualifies(c) if c in delta.columns else F.lit(c == "status"), F.col("seq")))
    one = given.groupBy("slug").agg(F.min("seq").alias("_seq"), *(last(c).alias(f"_u_{c}") for c in merged), *(F.min_by(c, "seq").alias(f"_f_{c}") for c in first))
    both = books.withColumn("_old", F.lit(True)).join(one, "slug", "full_outer")
    new = both.filter("_old is null").select("slug", "_seq", *(F.coalesce(f"_u_{c}", f"_f_{c}").alias(c) if c in merged else F.col(f"_f_{c}").alias(c) for c in first))
    new = numbered(new, "_seq", books.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))).drop("_seq")
    for c in ("created_at", "updated_at"):
        if c in kind:
            new = new.withColumn(c, now.cast(kind[c]))
    hit = F.col("_seq").isNotNull()
    old = both.filter("_old").select(*(F.coalesce(f"_u_{c}", F.col(c)).alias(c) if c in merged else F.when(hit, now).otherwise(F.col(c)).cast(kind[c]).alias(c) if c == "updated_at" else F.col(c) for c in books.columns))
    return old.unionByName(new, allowMissingColumns=True).select(*(F.col(c).cast(kind[c]).alias(c) for c in books.columns))


PATCHABLE = ("title", "category", "tags", "summary", "is_public")


def patch(books: DataFrame, slug: str | Column, now: Column | None = None, **changes) -> DataFrame:
    """books with the given fields of one slug; None leaves a field; the slug never changes."""
    if bad := set(changes) - set(PATCHABLE):
        raise ValueError(f"can't be patched: {sorted(bad)}")
    new = {c: F.lit(v) for c, v in changes.items() if v is not None}
    if new and "updated_at" in books.columns:
        new["updated_at"] = F.current_timestamp() if now is None else now
    return books.withColumns({c: F.when(F.col("slug") == slug, v).otherwise(F.col(c)) for c, v in new.items()})


#: Curation of four books: slug, then artifact_code to exhibition_hall.
SEEDS = (
    ("tho-chu-dong-tu", "MUSEUM-HERITAGE-001", "Thế kỷ XX • Khảo cứu văn hóa dân gian", "Sưu tập tư liệu điền dã Đền Đa Hòa - Dạ Trạch", "Ảnh chụp tài liệu gốc tại thực địa, có thủ bút và triện", "Công trình ghi chép toàn diện về một trong 'Tứ bất tử' của tín ngưỡng dân gian Việt Nam, bảo tồn các nghi thức rước nước, tế lễ cổ truyền.", "Huyền tích & Tín ngưỡng Sông Hồng"),
    ("dat-yen-my-hung-yen", "MUSEUM-HERITAGE-002", "Thế kỷ XIX - XX • Địa phương chí", "Tài liệu địa chí lưu trữ huyện Yên Mỹ, tỉnh Hưng Yên", "Tư liệu in nguyên bản, bản chụp độ phân giải cao", "Tập đại thành địa chí ghi nhận lịch sử hình thành các tổng, làng, dòng họ, phong tục tập quán và di tích lịch sử vùng đất Hưng Yên văn hiến.", "Địa phương chí & Ký ức Làng xã"),
    ("pp-nc-khoa-hoc-du-lich-giao-trinh", "MUSEUM-HERITAGE-003", "Hiện đại • Thập niên 2000", "Thư viện Giáo trình Đại học Quốc gia", "Giáo trình chuyên khảo hoàn chỉnh, lưu trữ số nguyên bản", "Hệ thống phương pháp luận nghiên cứu du lịch học ứng dụng, làm sáng tỏ các giá trị di sản và kinh tế văn hóa.", "Di sản Khoa học & Giáo dục"),
    ("luan-an-song-hong-1", "MUSEUM-HERITAGE-004", "Thế kỷ XX • Nghiên cứu địa lý & thủy văn", "Viện Nghiên cứu Địa lý & Môi trường", "Bản luận án đánh máy cổ điển kèm sơ đồ đo đạc", "Công trình nghiên cứu chuyên sâu về bồi tích, hệ sinh thái và tác động của sông Hồng đến đời sống cư dân đồng bằng Bắc Bộ.", "Huyền tích & Tín ngưỡng Sông Hồng"),
)


def standard_seeds(spark) -> DataFrame:
    return spark.createDataFrame(SEEDS, "slug string, artifact_code string, period_era string, provenance string, material_condition string, curator_notes string, exhibition_hall string")


def seed(books: DataFrame, seeds: DataFrame) -> DataFrame:
    """Curation texts of seeds(slug, ...) where a book has none, and the hall where it is the default."""
    cols = ("artifact_code", "period_era", "provenance", "material_condition", "curator_notes", "exhibition_hall")
    s = seeds.select("slug", *(F.col(c).alias(f"s_{c}") for c in cols))
    out = books.join(s, "slug", "left")
    empty = lambda c: F.col(c) == (DEFAULT_HALL if c == "exhibition_hall" else "")
    return out.select(*(F.when(empty(c) & F.col(f"s_{c}").isNotNull(), F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in books.columns))


def add_missing_columns(books: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return books.withColumns({c: v for c, v in defaults.items() if c not in books.columns})


def resolve_folders(books: DataFrame, folders: DataFrame) -> DataFrame:
    """(slug, folder): the folder named as the title, else the first whose slug is the book's."""
    titles, names = books.select("slug", "title").distinct(), folders.select("folder").distinct()
    exact = titles.join(names, F.col("title") == F.col("folder")).select("slug", F.lit(0).alias("rank"), "folder")
    # One folder a slug before the join: copies of a slug would meet in pairs.
    first = names.groupBy(slugify("folder").alias("slug")).agg(F.min("folder").alias("folder"))
    close = titles.select("slug").distinct().join(first, "slug").select("slug", F.lit(1).alias("rank"), "folder")
    return exact.union(close).groupBy("slug").agg(F.min(F.struct("rank", "folder")).alias("b")).select("slug", F.col("b.folder").alias("folder"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last by order."""
    return df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), order).alias("r")).select(key, "r.*")


def latest_texts(files: DataFrame, size: int = 600) -> DataFrame:
    """(book, filename, preview): the last changed text of each book of files(book, filename, modified, text)."""
    last = latest(files.withColumn("at", F.struct("modified", "filename")), "book", "at")
    return last.select("book", "filename", F.left("text", F.lit(size)).alias("preview"))


def rank_rows(df: DataFrame, key, order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order)))
