"""Archives as a data source: spark.read.format("archive").load(folder or file), after register(spark).

Rows are the page images in zip, tar, tar.gz and gzip files: archive, path, flat_name, content, error_msg. A zip's directory
stands at its end: archives of more than splitBytes are cut into ranges of members by it, and a partition seeks to its
own; a tar's members are read one behind the other. No archive is ever in memory as a whole, and batches hold about
BATCH bytes. flat_name is the file's name, from the second of a name on with the parent's name before it.

Edge cases: an archive that can't be read is one row with its error, a damaged member too, and the others are read;
hidden names, folders and other files are left out; a gzip file that holds no tar is one image; rar and 7z need programs
that aren't part of the standard library and give an error; an empty or missing folder gives no rows.
"""

from __future__ import annotations

import gzip
import posixpath
import tarfile
import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import IMAGE_SUFFIXES
from .stores import opened

#: Endings of archives.
ARCHIVE_SUFFIXES = (".zip", ".tar", ".tar.gz", ".tgz", ".gz", ".rar", ".7z")
SCHEMA = "archive string, path string, flat_name string, content binary, error_msg string"
BATCH, SPLIT = 16 << 20, 64 << 20


def is_page(name: str) -> bool:
    return name.lower().endswith(IMAGE_SUFFIXES) and not posixpath.basename(name).startswith(".") and not name.startswith("__MACOSX")


def flat_names(paths: list[str]) -> dict[str, str]:
    """Each path's name without folders; of equal names the first by path keeps it."""
    seen, out = set(), {}
    for path in sorted(paths):
        name = posixpath.basename(path)
        out[path] = f"{posixpath.basename(posixpath.dirname(path)) or 'root'}_{name}" if name in seen else name
        seen.add(name)
    return out


@dataclass
class Share(InputPartition):
    """Members first to last of an archive in the order of their bytes; last None: all."""

    archive: str
    first: int = 0
    last: int | None = None


def _zip_pages(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return sorted((i for i in z.infolist() if not i.is_dir() and is_page(i.filename)), key=lambda i: i.header_offset)


def members(share: Share):
    """(path, flat name, content, error) of a share."""
    store, at = opened(share.archive)
    name = share.archive.lower()
    if name.endswith(".zip"):
        with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            pages = _zip_pages(z)
            flat = flat_names([i.filename for i in pages])
            for i in pages[share.first : share.last]:
                try:
                    yield i.filename, flat[i.filename], z.read(i), None
                except Exception as e:
                    yield i.filename, flat[i.filename], None, f"{type(e).__name__}: {e}"
        return
    packed = name.endswith((".gz", ".tgz"))
    if not packed and not name.endswith(".tar"):
        raise ValueError("not a zip, tar or gzip archive")

    def plain():
        f = store.open_input_file(at)
        return gzip.GzipFile(fileobj=f) if packed else f

    try:
        with plain() as f, tarfile.open(fileobj=f, mode="r|" if packed else "r:") as t:
            flat = flat_names([m.name for m in t if m.isfile() and is_page(m.name)])  # headers only
    except tarfile.ReadError:
        if not packed or name.endswith((".tar.gz", ".tgz")):
            raise
        own = posixpath.basename(share.archive)[: -len(".gz")]
        if is_page(own):
            with plain() as f:
                yield own, own, f.read(), None
        return
    with plain() as f, tarfile.open(fileobj=f, mode="r|" if packed else "r:") as t:
        for m in t:
            if m.name in flat and m.isfile():
                yield m.name, flat[m.name], t.extractfile(m).read(), None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.split = options["path"], int(options.get("splitbytes", options.get("splitBytes", SPLIT)))

    def partitions(self) -> list[Share]:
        from pyarrow import fs

        store, top = opened(self.root)
        info = store.get_file_info(top)
        found = [info] if info.is_file else sorted(store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)), key=lambda f: f.path)
        out = []
        for f in found:
            if not f.is_file or not f.path.lower().endswith(ARCHIVE_SUFFIXES):
                continue
            uri = self.root.rstrip("/") + f.path[len(top.rstrip("/")) :]
            if f.size <= self.split or not f.path.lower().endswith(".zip"):
                out.append(Share(uri))
                continue
            try:
                with store.open_input_file(f.path) as file, zipfile.ZipFile(file) as z:
                    sizes = [i.compress_size for i in _zip_pages(z)]
            except Exception:
                out.append(Share(uri))  # its task tells the error
                continue
            first = total = 0
            for k, n in enumerate(sizes):
                if total and total + n > self.split:
                    out.append(Share(uri, first, k))
                    first, total = k, 0
                total += n
            out.append(Share(uri, first, len(sizes)))
        return out or [Share("")]

    def read(self, share: Share):
        rows, size = [], 0

        def batch():
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary() if k == 3 else pa.string()) for k, c in enumerate(columns)], [c.split()[0] for c in SCHEMA.split(", ")])

        if not share.archive:
            return
        try:
            for path, flat, data, fault in members(share):
                rows.append((share.archive, path, flat, data, fault))
                size += len(data or b"")
                if size >= BATCH:
                    yield batch()
                    rows, size = [], 0
        except Exception as e:
            rows.append((share.archive, None, None, None, f"{type(e).__name__}: {e}"))
        if rows:
            yield batch()


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
