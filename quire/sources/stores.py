"""Folders and files of any store that pyarrow knows, or that a caller opens: listing in tasks, and named files that appear whole."""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import discard, staged

#: Opens a URI: (a pyarrow file system, the path in it).
Opener = Callable[[str], tuple[object, str]]


def opened(uri: str) -> tuple[object, str]:
    """By scheme: local files for file: or none, and what else pyarrow can reach (s3, gs, hdfs, abfs)."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, found, rest = uri.partition("://")
    if not found or scheme == "file" or uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@?=&%')}")


def known(uri: str, opener: Opener = opened) -> bool:
    """Whether the opener reaches a URI; other stores are for Spark's own sources."""
    try:
        opener(uri)
        return True
    except (ValueError, OSError, ImportError):
        return False


def listed(spark: SparkSession, root: str, opener: Opener = opened) -> DataFrame:
    """(path, length) of all files under root, empty ones too; a missing root has none.

    Folders are listed level by level, each in a task of its own; neither folders nor files reach the driver.
    """

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            for folder in pdf["folder"]:
                store, at = opener(folder)
                found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
                for a in range(0, len(found), 10_000):
                    own = [(f"{folder}/{f.base_name}", f.size if f.is_file else None, not f.is_file) for f in found[a : a + 10_000]]
                    yield pd.DataFrame(own, columns=["path", "length", "deep"]).astype({"length": "Int64"})

    level, out = spark.createDataFrame([(root.rstrip("/"),)], "folder string"), None
    while True:
        found = staged(level.repartition("folder").mapInPandas(run, "path string, length long, deep boolean"), "listing")
        here = found.filter("not deep").select("path", "length")
        out = here if out is None else out.union(here)
        level = found.filter("deep").select(F.col("path").alias("folder"))
        if level.isEmpty():
            return out


def export_joined(blocks: DataFrame, root: str, opener: Opener = opened) -> int:
    """Files under root from blocks(name, block, data), joined in order; returns how many.

    Blocks are written apart, by as many tasks as there are; then one task a file passes them on as a stream, so that
    neither a file nor its list of pages is ever in memory. Files appear whole, as those of export().
    """
    hidden = f".joined-{uuid.uuid4().hex}"
    store, top = opener(root)
    try:
        export(blocks.select(F.format_string("%s/%015d", F.sha2("name", 256), "block").alias("name"), "data"), f"{root.rstrip('/')}/{hidden}", opener)

        def join(batches):
            import pandas as pd
            from pyarrow import fs

            for pdf in batches:
                for name in pdf["name"]:
                    store, top = opener(root)
                    parts = posixpath.join(top, hidden, hashlib.sha256(name.encode()).hexdigest())
                    to = posixpath.normpath(posixpath.join(top, name.lstrip("/")))
                    if not to.startswith(top.rstrip("/") + "/"):
                        raise ValueError(f"{name} leaves {root}")
                    own = posixpath.join(top, hidden, uuid.uuid4().hex)
                    with store.open_output_stream(own) as f:
                        for part in sorted(i.path for i in store.get_file_info(fs.FileSelector(parts))):
                            with store.open_input_stream(part) as source:
                                while chunk := source.read(1 << 20):
                                    f.write(chunk)
                    store.create_dir(posixpath.dirname(to), recursive=True)
                    store.move(own, to)
                yield pd.DataFrame({"n": [len(pdf)]})

        names = blocks.select("name").distinct()
        return names.repartition("name").mapInPandas(join, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    finally:
        from pyarrow import fs

        if store.get_file_info(posixpath.join(top, hidden)).type != fs.FileType.NotFound:
            store.delete_dir(posixpath.join(top, hidden))


def export(files: DataFrame, root: str, opener: Opener = opened) -> int:
    """Files (name, data) under root, each from its first moment whole; returns how many there are.

    Tasks write to a hidden folder, every attempt under names of its own; when all have ended well, tasks move the files
    of the attempts that counted to their names, over what is there. A job that fails leaves nothing, a task that is
    killed half-way leaves nothing to see, and a repeated job gives the same files.
    """
    hidden = f".export-{uuid.uuid4().hex}"

    def places(name: str) -> tuple[object, str, str]:
        store, top = opener(root)
        at = posixpath.normpath(posixpath.join(top, name.replace("\\", "/").lstrip("/")))
        if not at.startswith(top.rstrip("/") + "/"):
            raise ValueError(f"{name} leaves {root}")
        return store, top, at

    def write(batches):
        import pandas as pd

        for pdf in batches:
            own = []
            for name, data in zip(pdf["name"], pdf["data"], strict=True):
                store, top, _ = places(name)
                part = f"{hidden}/{uuid.uuid4().hex}"
                store.create_dir(posixpath.join(top, hidden), recursive=True)
                with store.open_output_stream(posixpath.join(top, part)) as f:
                    f.write(data)
                own.append((name, part))
            yield pd.DataFrame(own, columns=["name", "part"])

    def move(batches):
        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            for name, part in zip(pdf["name"], pdf["part"], strict=True):
                store, top, at = places(name)
                part = posixpath.join(top, part)
                if store.get_file_info(part).type != fs.FileType.NotFound:  # else an attempt before this one moved it
                    store.create_dir(posixpath.dirname(at), recursive=True)
                    store.move(part, at)
            yield pd.DataFrame({"n": [len(pdf)]})

    store, top = opener(root)
    written = None
    try:
        written = staged(files.select("name", "data").mapInPandas(write, "name string, part string"), "export")
        one = written.groupBy("name").agg(F.max("part").alias("part"))  # of several files of a name one stays
        return one.mapInPandas(move, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    finally:
        if written is not None:
            discard(written)
        from pyarrow import fs

        if store.get_file_info(posixpath.join(top, hidden)).type != fs.FileType.NotFound:
            store.delete_dir(posixpath.join(top, hidden))
