"""Scans of image trees and page texts, archives, manifests and settings; and the text, JSONL and report sinks."""

from __future__ import annotations

import dataclasses
import gzip
import io
import re
import tarfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, book_of, natural_key, stem, suffix, with_suffix
from ..operators.imaging import encode_png, orientation, picture, thumbnail
from ..operators.staging import small_side, staged
from .stores import Opener, export, export_joined, known, listed, opened

#: File name endings of page images.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp", ".heic", ".heif")

#: Those whose files browsers show, and those that Spark's image source decodes; the rest needs an opener.
WEB_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
NATIVE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")


def glob_of(suffixes: tuple[str, ...]) -> str:
    """A file name pattern for suffixes in any case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s[1:]) for s in suffixes) + "}"


IMAGE_GLOB = glob_of(IMAGE_SUFFIXES)
#: Bytes of a file in which its orientation is looked for.
HEAD = 1 << 17


def relative_to(root: str):
    clean = re.sub(r"^file:/+", "/", root).rstrip("/")
    path = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    return F.when(path.startswith(clean + "/"), F.substring(path, len(clean) + 2, 1 << 30)).otherwise(path)


def _listed(spark: SparkSession, root: str, opener: Opener = opened) -> DataFrame:
    """(path, length) of all files under root. Stores that only Spark reaches are listed by it, without empty files."""
    if known(root, opener):
        return listed(spark, root, opener)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def scan_images(spark: SparkSession, root: str, book: str | None = None, opener: Opener = opened) -> DataFrame:
    """(rel_path, size) of page images under root or one book; content is never read, empty files are listed too.

    in_scan_order() gives the order of reading.
    """
    found = _listed(spark, root if book is None else f"{root.rstrip('/')}/{book}", opener)
    out = found.filter(suffix("path").isin(*IMAGE_SUFFIXES)).select(relative_to(root).alias("rel_path"), F.col("length").alias("size"))
    return out.filter(~F.col("rel_path").startswith("."))


def _files(spark: SparkSession, kind: str, root: str, suffixes: tuple[str, ...], paths: list[str] | None, **options) -> DataFrame | None:
    """Files of the given suffixes under root, or those among paths; None if no path is left."""
    reader = spark.read.format(kind).options(recursiveFileLookup=True, pathGlobFilter=glob_of(suffixes), **options)
    if paths is None:
        return reader.load(root)
    own = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths if p.lower().endswith(suffixes)]  # a path is read as a pattern
    return reader.option("ignoreMissingFiles", True).load(own) if own else None


def read_pixels(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, paths: list[str] | None = None) -> DataFrame:
    """(file_path, content, pixels, height, width, nChannels, turn) of the images under root, or of paths below it.

    JPEG, PNG, BMP and TIFF files are decoded by Spark's image source: pixels are rows of blue, green and red bytes as
    stored, null if the file is corrupt; turn is the Exif orientation, which that source leaves out. Files of other
    formats come with their content, for an opener. Pixels are not shuffled: the paths of turned images are broadcast,
    if they are few enough.
    """
    turned = F.pandas_udf(lambda heads: heads.map(lambda h: orientation(bytes(h))), "int")
    clean = lambda c: F.regexp_replace(F.col(c), r"^file:/+", "file:/").alias("path")
    columns = "path string, content binary, pixels binary, height int, width int, nChannels int, turn int"
    native, other = (tuple(s for s in suffixes if (s in NATIVE_SUFFIXES) == own) for own in (True, False))
    found = []
    if native and (i := _files(spark, "image", root, native, paths, dropInvalid=False)) is not None:
        origin = F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))  # that source gives paths as URLs
        i = i.withColumn("origin", origin).select(clean("origin"), "image.height", "image.width", "image.nChannels", "image.data").select("path", "height", "width", "nChannels", F.when(F.col("height") > 0, F.col("data")).alias("pixels"))
        heads = _files(spark, "binaryFile", root, native, paths).select(clean("path"), turned(F.substring("content", 1, HEAD)).alias("turn"))
        turns = staged(heads.filter("turn > 1"), "turns")
        i = i.join(small_side(turns), "path", "left").fillna(1, ["turn"])
        found.append(i.select("path", F.lit(None).cast("binary").alias("content"), "pixels", "height", "width", "nChannels", "turn"))
    if other and (rest := _files(spark, "binaryFile", root, other, paths)) is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in columns.split(", ")[2:])]
        found.append(rest.select(clean("path"), "content", *none))
    out = found[0].union(found[1]) if len(found) == 2 else found[0] if found else spark.createDataFrame([], columns)
    return out.select(relative_to(root).alias("file_path"), "content", "pixels", "height", "width", "nChannels", "turn")


_PICTURE = ("content", "pixels", "height", "width", "nChannels", "turn")


def _as_png(pages: DataFrame, change=lambda image: image):
    """A column of pages(content) or of read_pixels(): struct of the changed picture as a PNG, and the error if there is one."""

    def run(frame):
        import pandas as pd

        out = []
        for row in frame.itertuples(index=False, name=None):
            try:
                out.append((encode_png(change(picture(*row))), None))
            except Exception as e:
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["png", "error_msg"])

    return F.pandas_udf(run, "png binary, error_msg string")(F.struct(*(c for c in _PICTURE if c in pages.columns)))


def covers(pages: DataFrame) -> DataFrame:
    """(book, cover) of pages(book, filename) with content or the columns of read_pixels(): the first page by number that
    decodes, as a PNG of at most 400 x 600. Every page becomes a thumbnail where it is read; thumbnails are what is shuffled.
    """
    small = pages.withColumn("made", _as_png(pages, thumbnail)).filter("made.png is not null")
    place = F.struct(natural_key("filename"), F.col("filename"))
    return small.groupBy("book").agg(F.min_by("made.png", place).alias("cover"))


def _made_pages(spark: SparkSession, root: str) -> DataFrame:
    """(book, filename, content, error_msg) of the pages that browsers don't show, as PNG."""
    found = read_pixels(spark, root, tuple(s for s in IMAGE_SUFFIXES if s not in WEB_SUFFIXES))
    name = base_name("file_path")
    shown = F.when(F.col("made.png").isNotNull(), F.concat(stem("file_path"), F.lit(".png"))).otherwise(name)
    return found.withColumn("made", _as_png(found)).select(book_of("file_path").alias("book"), shown.alias("filename"), F.col("made.png").alias("content"), "made.error_msg")


def web_pages(spark: SparkSession, root: str) -> DataFrame:
    """(book, filename, content, error_msg) of the pages under root as browsers show them: web formats as they are, others
    as PNG; what can't be read has its error instead of content."""
    web = _files(spark, "binaryFile", root, WEB_SUFFIXES, None).select(relative_to(root).alias("file_path"), "content")
    web = web.select(book_of("file_path").alias("book"), base_name("file_path").alias("filename"), "content", F.lit(None).cast("string").alias("error_msg"))
    return web.union(_made_pages(spark, root))


def cache_web_pages(spark: SparkSession, root: str, cache: str) -> int:
    """<book>/<name>.png under cache for each page that browsers don't show; a second run writes the same files again."""
    made = _made_pages(spark, root).filter("error_msg is null")
    return export(made.select(F.concat("book", F.lit("/"), "filename").alias("name"), F.col("content").alias("data")), cache)


def in_scan_order(scanned: DataFrame) -> DataFrame:
    """Book folders in natural order, each book's pages in natural order of their path, then loose images."""
    loose = ~F.col("rel_path").contains("/")
    return scanned.orderBy(loose, natural_key(F.when(loose, F.lit("")).otherwise(F.substring_index("rel_path", "/", 1))), natural_key("rel_path"), "rel_path")


def list_books(scanned: DataFrame) -> DataFrame:
    """Distinct first folders that aren't hidden, in natural order."""
    b = F.substring_index("rel_path", "/", 1)
    books = scanned.filter(F.col("rel_path").contains("/")).select(b.alias("book")).filter(~F.col("book").startswith(".")).distinct()
    return books.orderBy(natural_key("book"), "book")


def read_page_texts(spark: SparkSession, root: str) -> DataFrame:
    """(book, filename, text) of the *.txt files under root, one folder a book."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    p = F.col("_metadata.file_path")
    return t.select(F.element_at(F.split(p, "/"), -2).alias("book"), F.url_decode(base_name(p)).alias("filename"), F.col("value").alias("text"))


def archive_members(data: bytes):
    """(path, content) of the page images in a zip, tar or gzip archive; hidden names and folders are left out.

    A gzip file that holds no tar is one image whose name unpack() takes from the archive. rar and 7z need programs that
    aren't part of the standard library: ValueError.
    """
    ok = lambda n: n.lower().endswith(IMAGE_SUFFIXES) and not n.rsplit("/", 1)[-1].startswith(".") and not n.startswith("__MACOSX")
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for n in sorted(z.namelist()):
                if ok(n):
                    yield n, z.read(n)
        return
    if data[:2] == b"\x1f\x8b" and not _is_tar(plain := gzip.decompress(data)):
        yield "", plain
        return
    if not data[:2] == b"\x1f\x8b" and not _is_tar(data):
        raise ValueError("not a zip, tar or gzip archive")
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in sorted((m for m in t.getmembers() if m.isfile() and ok(m.name)), key=lambda m: m.name):
            yield m.name, t.extractfile(m).read()


def _is_tar(data: bytes) -> bool:
    try:
        tarfile.open(fileobj=io.BytesIO(data)).close()
        return True
    except tarfile.TarError:
        return False


def unpack(archives: DataFrame) -> DataFrame:
    """(archive, path, content, error_msg) of binaryFile rows(path, content): works on any store that Spark reads.

    An archive that can't be read is one row with its error.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                rows, fault = [], None
                try:
                    own = path.rsplit("/", 1)[-1].removesuffix(".gz")
                    rows = [(path, n or own, c, None) for n, c in archive_members(data) if (n or own).lower().endswith(IMAGE_SUFFIXES)]
                except Exception as e:
                    rows, fault = [], f"{type(e).__name__}: {e}"
                if fault:
                    rows = [(path, None, None, fault)]
                yield pd.DataFrame(rows, columns=["archive", "path", "content", "error_msg"])

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, content binary, error_msg string")


def flattened(members: DataFrame) -> DataFrame:
    """Members of each archive by file name; from the second of a name on, the parent's name goes before it."""
    from ..operators.assembly import flatten_names

    return flatten_names(members.filter("path is not null"), "archive")


@dataclasses.dataclass(frozen=True)
class Settings:
    workers: int = 4
    batch_size: int = 50
    max_dimension: int = 2560
    split_double_pages: bool = False
    output: str = "both"
    mirror: bool = True
    max_retries: int = 8

    def __post_init__(self):
        if self.workers < 1 or self.batch_size < 1 or self.max_retries < 1:
            raise ValueError("workers, batch_size and max_retries must be at least 1")


#: Where each setting stands in a settings file.
SETTING_PLACES = {"workers": ("system", "num_workers"), "batch_size": ("system", "batch_size"), "max_dimension": ("preprocessing", "max_dimension"), "split_double_pages": ("preprocessing", "split_double_pages"), "output": ("output", "format"), "mirror": ("output", "mirror_folder_structure"), "max_retries": ("ocr", "gemini", "max_retries")}


def load_settings(text: str | None) -> Settings:
    """Settings from a YAML text; unknown keys are ignored, missing ones and an empty or missing file give the defaults."""
    import yaml

    tree = yaml.safe_load(text) if text else None
    found = {}
    for name, place in SETTING_PLACES.items():
        value = tree
        for key in place:
            value = value.get(key) if isinstance(value, dict) else None
        if value is None and isinstance(tree, dict):  # by the setting's own name in any section
            value = next((section[name] for section in tree.values() if isinstance(section, dict) and section.get(name) is not None), None)
        if value is not None:
            found[name] = type(getattr(Settings, name))(value)
    return Settings(**found)


def read_words(spark: SparkSession, *paths: str) -> list[str]:
    """The non-blank lines of the first of several word lists that exists, in order; a list has tens of thousands of lines."""
    sc = spark.sparkContext
    for p in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at):
            text = spark.read.text(p, wholetext=True).first()
            return [w for line in (text[0].splitlines() if text else []) if (w := line.strip())]
    raise FileNotFoundError(f"none of {paths}")


def write_jsonl(results: DataFrame, path: str, mode: str = "append") -> None:
    """One object a page with nulls kept; confidence and time fall back to avg_confidence and elapse_ms where 0 or null."""

    def either(a: str, b: str, digits: int):
        options = [F.nullif(F.col(c), F.lit(0.0)) for c in (a, b) if c in results.columns]
        return F.round(F.coalesce(*options, F.lit(0.0)), digits).alias(a)

    out = results.select("file_path", F.coalesce("full_text", F.lit("")).alias("text"), either("confidence", "avg_confidence", 4), "lines", either("processing_time_ms", "elapse_ms", 2))
    out.write.mode(mode).option("ignoreNullFields", False).json(path)


def export_texts(results: DataFrame, root: str, mirror: bool = True) -> int:
    """One .txt a page under root, in the page's folders or flat; returns the number of pages."""
    name = with_suffix("file_path", ".txt")
    return export(results.select((name if mirror else with_suffix(base_name("file_path"), ".txt")).alias("name"), F.encode(F.coalesce("full_text", F.lit("")), "UTF-8").alias("data")), root)


def export_merged(merged: DataFrame, root: str) -> int:
    """<book>.txt under root for every row of merged(book, text)."""
    return export(merged.select(F.concat("book", F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("data")), root)


def export_archives(archives: DataFrame, root: str) -> int:
    """<book>_package.zip under root for every row of archives(book, archive)."""
    return export(archives.select(F.concat("book", F.lit("_package.zip")).alias("name"), F.col("archive").alias("data")), root)


def export_books(pages: DataFrame, root: str, block: int | None = None) -> int:
    """<book>.txt and <book>_package.zip under root for every book of pages(book, filename, text), however large."""
    from ..operators.large_books import BLOCK, merged_blocks, paged, zip_blocks

    numbered = paged(pages, block or BLOCK)
    texts = merged_blocks(numbered).select(F.concat("book", F.lit(".txt")).alias("name"), "block", F.encode("text", "UTF-8").alias("data"))
    zips = zip_blocks(numbered, block or BLOCK).select(F.concat("book", F.lit("_package.zip")).alias("name"), "block", "data")
    return export_joined(texts, root) + export_joined(zips, root)


def export_dataset(books: DataFrame, texts: DataFrame, covers: DataFrame, root: str, limit: int = 1000) -> int:
    """<slug>/<slug>.txt, <slug>/cover.png and <slug>/metadata.json of every book, and the manifest; how many files.

    texts(title, text) and covers(slug, cover) may lack books. Returns the number of files without the manifest.
    """
    slug = F.col("slug")
    own = books.filter("slug is not null")
    meta = own.select(F.concat(slug, F.lit("/metadata.json")).alias("name"), F.encode(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}), "UTF-8").alias("data"))
    text = own.select("slug", "title").join(texts, "title").select(F.concat(slug, F.lit("/"), slug, F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("data"))
    cover = own.select("slug").join(covers, "slug").select(F.concat(slug, F.lit("/cover.png")).alias("name"), F.col("cover").alias("data"))
    n = export(meta.union(text).union(cover), root)
    export_manifest(books, f"{root.rstrip('/')}/library_manifest.json", limit)
    return n


def read_outputs(spark: SparkSession, root: str) -> DataFrame:
    """(book, has_text_file, has_zip_file) of the merged texts and packages right under root."""
    top = _listed(spark, root).select(relative_to(root).alias("name")).filter(~F.col("name").contains("/"))
    zipped = F.col("name").endswith("_package.zip")
    out = top.filter(zipped | F.col("name").endswith(".txt")).select(F.when(zipped, F.regexp_replace("name", "_package\\.zip$", "")).otherwise(stem("name")).alias("book"), (~zipped).alias("t"), zipped.alias("z"))
    return out.groupBy("book").agg(F.max("t").alias("has_text_file"), F.max("z").alias("has_zip_file"))


def write_texts(results: DataFrame, path: str, mode: str = "append") -> None:
    """Page texts as a table partitioned by book."""
    results.select(book_of("file_path").alias("book"), "file_path", F.col("full_text").alias("text")).write.mode(mode).partitionBy("book").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)


def export_report(report: DataFrame, path: str) -> None:
    """The report as one CSV file that starts with a byte order mark, as spreadsheets want it; rows are streamed."""
    import csv

    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    with store.open_output_stream(at) as f:
        text = io.TextIOWrapper(f, encoding="utf-8-sig", newline="", write_through=True)
        w = csv.writer(text)
        w.writerow(report.columns)
        for row in report.toLocalIterator():
            w.writerow(row)
        text.flush()


def public_manifest(books: DataFrame, limit: int = 1000) -> DataFrame:
    """The newest public books, as many as the manifest holds."""
    return books.filter("is_public = 1").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def export_manifest(books: DataFrame, path: str, limit: int = 1000) -> None:
    """The public books as one indented JSON array of at most limit objects."""
    import json

    from pyarrow import fs

    rows = [json.loads(r[0]) for r in public_manifest(books, limit).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    store, at = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    with store.open_output_stream(at) as f:
        f.write(json.dumps(rows, ensure_ascii=False, indent=2).encode())


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a JSON array, or one a line, with their place in column pos."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.withColumn("pos", F.monotonically_increasing_id())
