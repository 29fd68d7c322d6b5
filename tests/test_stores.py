import gzip
import io
import json
import os
import tarfile
import zipfile

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from quire.sources import archives, files, stores


def shelf(base):
    """An opener of the scheme shelf:, whose paths are below base."""

    def opener(uri):
        if not uri.startswith("shelf://"):
            raise ValueError(uri)
        return fs.SubTreeFileSystem(base, fs.LocalFileSystem()), uri.removeprefix("shelf://").strip("/")

    return opener


def test_listing_by_levels_on_another_scheme(spark, tmp_path):
    made = {f"top/huge/{i}.png": 0 if i % 10 == 0 else 1 for i in range(300)} | {f"top/deep/{'x/' * k}p.jpg": 2 for k in range(5)} | {"top/.hidden/1.png": 1, "top/a b/né.TIF": 3, "top/n.txt": 1}
    for name, n in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"." * n)
    want = {p.removeprefix("top/"): n for p, n in made.items() if not p.endswith(".txt") and "hidden" not in p}
    for root, opener in (("shelf://top", shelf(str(tmp_path))), (str(tmp_path / "top"), stores.opened), (f"file:{tmp_path}/top", stores.opened)):
        found = files.scan_images(spark, root, opener=opener)
        assert {r["rel_path"]: r["size"] for r in found.collect()} == want
    assert {r["rel_path"] for r in files.scan_images(spark, str(tmp_path / "top"), "a b").collect()} == {"a b/né.TIF"}
    assert stores.listed(spark, "shelf://none", shelf(str(tmp_path))).count() == 0
    assert not stores.known("viewfs://x/y") and files._listed(spark, f"shelf://{tmp_path}/top", lambda uri: stores.opened(uri.removeprefix("shelf://"))).count() == len(made)


def packed(path, names, size=100):
    with zipfile.ZipFile(path, "w") as z:
        for i, n in enumerate(names):
            z.writestr(n, bytes([i % 251]) * size)


def rows(df):
    return sorted((os.path.basename(r["archive"]), r["path"], r["flat_name"], r["content"] and bytes(r["content"]), (r["error_msg"] or "").split(":")[0]) for r in df.collect())


def test_archives_as_a_data_source(spark, tmp_path):
    archives.register(spark)
    names = [f"a/{i:03d}.png" for i in range(40)] + ["b/000.png", "c/000.png", "z.JPG", "b/.x.png", "n.txt", "__MACOSX/1.png"]
    (tmp_path / "in").mkdir()
    packed(tmp_path / "in/big.zip", names)
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        for n in ("p/1.png", "q/1.png", "r.txt"):
            info = tarfile.TarInfo(n)
            info.size = 3
            t.addfile(info, io.BytesIO(n[:3].encode()))
    (tmp_path / "in/t.tar").write_bytes(tar.getvalue()), (tmp_path / "in/t.tgz").write_bytes(gzip.compress(tar.getvalue()))
    (tmp_path / "in/s.png.gz").write_bytes(gzip.compress(b"one")), (tmp_path / "in/bad.zip").write_bytes(b"PK no"), (tmp_path / "in/x.rar").write_bytes(b"Rar!"), (tmp_path / "in/y.txt").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "in/hurt.zip", "w") as z:
        z.writestr("1.png", b"A" * 50), z.writestr("2.png", b"B" * 50)
    whole = bytearray((tmp_path / "in/hurt.zip").read_bytes())
    whole[whole.index(b"A" * 50)] = 0
    (tmp_path / "in/hurt.zip").write_bytes(whole)
    df = spark.read.format("archive").option("splitBytes", 500).load(str(tmp_path / "in"))
    pages = [n for n in names if archives.is_page(n)]
    flat = {n: os.path.basename(n) for n in pages} | {"b/000.png": "b_000.png", "c/000.png": "c_000.png"}
    want = [("big.zip", n, flat[n], bytes([i % 251]) * 100, "") for i, n in enumerate(names) if n in pages]
    for t in ("t.tar", "t.tgz"):
        want += [(t, "p/1.png", "1.png", b"p/1", ""), (t, "q/1.png", "q_1.png", b"q/1", "")]
    want += [("s.png.gz", "s.png", "s.png", b"one", ""), ("hurt.zip", "2.png", "2.png", b"B" * 50, "")]
    got = rows(df.filter("path is not null and content is not null"))
    assert got == sorted(want)
    assert [(os.path.basename(r["archive"]), r["path"]) for r in df.filter("error_msg is not null").orderBy("archive").collect()] == [("bad.zip", None), ("hurt.zip", "1.png"), ("x.rar", None)]
    assert df.filter("archive like '%big.zip'").select(F.spark_partition_id()).distinct().count() > 5
    assert max(r[0] for r in df.filter("archive like '%big.zip'").groupBy(F.spark_partition_id()).agg(F.sum(F.length("content"))).select("sum(length(content))").collect()) <= 500
    unpacked = files.flattened(files.unpack(spark.read.format("binaryFile").load(str(tmp_path / "in/big.zip"))))
    assert {(r["path"], r["flat_name"]) for r in unpacked.collect()} == set(flat.items())
    (tmp_path / "none").mkdir()
    assert spark.read.format("archive").load(str(tmp_path / "none")).count() == 0
    assert spark.read.format("archive").load(str(tmp_path / "in/t.tar")).count() == 2


def test_exports_are_whole_or_not_there(spark, tmp_path):
    out = tmp_path / "out"
    df = spark.createDataFrame([(f"b{i % 3}/{i}.txt", f"text {i}".encode()) for i in range(30)], "name string, data binary").repartition(5)
    for _ in range(2):
        assert stores.export(df, str(out)) == 30
    assert {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file()} == {r["name"]: bytes(r["data"]) for r in df.collect()}
    assert [p.name for p in out.iterdir() if p.name.startswith(".")] == []

    def breaking(batches):
        for pdf in batches:
            yield pdf.iloc[:1]
            raise RuntimeError("lost")

    broken = df.mapInPandas(breaking, "name string, data binary")
    with pytest.raises(Exception, match="lost"):
        stores.export(broken, str(tmp_path / "broken"))
    assert [p for p in (tmp_path / "broken").rglob("*") if p.is_file()] == []
    with pytest.raises(Exception, match="leaves"):
        stores.export(spark.createDataFrame([("../x", b"")], "name string, data binary"), str(out))
    assert stores.export(df.limit(0), str(tmp_path / "empty")) == 0 and stores.export(df, "shelf://y", shelf(str(tmp_path))) == 30
    twice = spark.createDataFrame([("x.txt", b"1"), ("x.txt", b"2")], "name string, data binary")
    assert stores.export(twice, str(tmp_path / "twice")) == 1 and (tmp_path / "twice/x.txt").read_bytes() in (b"1", b"2")


def test_dataset_of_books(spark, tmp_path):
    books = spark.createDataFrame([(1, "mot", "Một", 1, None), (2, "hai", "Hai", 1, "n"), (3, "ba", "Ba", 0, "n")], "id long, slug string, title string, is_public int, notes string").withColumn("created_at", F.timestamp_seconds("id"))
    texts = spark.createDataFrame([("Một", "chữ"), ("Lạ", "x")], "title string, text string")
    covers = spark.createDataFrame([("hai", b"png")], "slug string, cover binary")
    assert files.export_dataset(books, texts, covers, str(tmp_path / "d")) == 5
    assert (tmp_path / "d/mot/mot.txt").read_text() == "chữ" and (tmp_path / "d/hai/cover.png").read_bytes() == b"png"
    meta = json.loads((tmp_path / "d/mot/metadata.json").read_text())
    assert meta["title"] == "Một" and meta["notes"] is None
    assert [b["slug"] for b in json.loads((tmp_path / "d/library_manifest.json").read_text())] == ["hai", "mot"]
