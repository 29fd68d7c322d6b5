import datetime
import random
import gzip
import io
import json
import tarfile
import zlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import assembly, composites, imaging, layout, library, numbering, tasks
from quire.sources import connectors, files
from quire.streaming import digitise

AT = datetime.datetime(2026, 1, 2, 3, 4, 5)
BOOKS = "id long, slug string, title string, category string, tags string, total_pages long, word_count long, file_size_bytes long, source_type string, source_id string, cover_image string, summary string, is_public int, status string, artifact_code string, period_era string, provenance string, material_condition string, curator_notes string, exhibition_hall string, highlights_json string, created_at timestamp, updated_at timestamp"


def at():
    return F.lit(AT)


def no_books(spark):
    return spark.createDataFrame([], BOOKS)


def again(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def test_upsert_numbers_and_fills_new_books_and_keeps_them(spark):
    delta = spark.createDataFrame([(1, "Lịch sử làng", 7), (2, "Sách B", 0), (3, "Lịch sử làng", 0)], "seq int, title string, total_pages long")
    first = again(spark, library.upsert(no_books(spark), delta, at()))
    rows = {r["slug"]: r.asDict() for r in first.collect()}
    assert [(k, rows[k]["id"]) for k in sorted(rows)] == [("lich-su-lang", 1), ("sach-b", 2)]
    a = rows["lich-su-lang"]
    assert (a["total_pages"], a["category"], a["status"], a["is_public"], a["exhibition_hall"], a["highlights_json"], a["source_type"], a["created_at"]) == (7, "Lịch sử - Địa chí", "COMPLETED", 1, library.DEFAULT_HALL, "[]", "upload", AT)
    later = at() + F.expr("interval 1 day")
    more = spark.createDataFrame([(1, "lich-su-lang", "Lịch sử làng", 0, "CHANGED", "ghi chú"), (2, "c", "C", 4, "k", "")], "seq int, slug string, title string, total_pages long, category string, curator_notes string")
    second = again(spark, library.upsert(first, more, later))
    rows = {r["slug"]: r.asDict() for r in second.collect()}
    a, c = rows["lich-su-lang"], rows["c"]
    assert (a["id"], a["total_pages"], a["category"], a["curator_notes"], a["created_at"], a["updated_at"]) == (1, 7, "Lịch sử - Địa chí", "ghi chú", AT, AT + datetime.timedelta(days=1))
    assert (c["id"], c["total_pages"], c["category"]) == (3, 4, "k") and len(rows) == 3 and rows["sach-b"]["updated_at"] == AT
    assert library.upsert(second, more.limit(0)).count() == 3 and second.schema == first.schema
    assert library.by_title(second, "sách b").first()["id"] == 2 and library.by_title(second, "nope").count() == 0
    patched = library.patch(second, "c", at(), title="C2").filter("slug = 'c'").first()
    assert (patched["title"], patched["updated_at"]) == ("C2", AT)


def test_numbering_is_dense_and_in_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(7)
    got = numbering.numbered(rows, "k", spark.range(1).select(F.lit(10).cast("long").alias("top"))).orderBy("k").collect()
    assert [r["id"] for r in got] == list(range(11, 5011))


def test_timestamps_of_task_changes(spark):
    old = datetime.datetime(2025, 1, 1)
    now = spark.createDataFrame([(1, "a/1.png", 5, "PENDING", None, old, old), (2, "a/2.png", 0, "FAILED", "E", old, old), (3, "b/1.png", 5, "IN_PROGRESS", None, old, old)], "id long, file_path string, file_size long, status string, error_msg string, created_at timestamp, updated_at timestamp")
    at_of = lambda df: {r["id"]: r["updated_at"] for r in df.collect()}
    assert at_of(tasks.claim(now, 1, None, at())[1]) == {1: AT, 2: old, 3: old}
    assert at_of(tasks.reset_hanging(now, None, at())) == {1: old, 2: old, 3: AT}
    assert at_of(tasks.retry_failed(now, at())) == {1: old, 2: AT, 3: old}
    found = spark.createDataFrame([("c/1.png", 9)], "file_path string, file_size long")
    assert [(r["id"], r["created_at"]) for r in tasks.register(now, found, at()).filter("id > 3").collect()] == [(4, AT)]
    assert tasks.failed_report(now).first()["timestamp"] == old
    assert tasks.budget(now) == 1 and tasks.budget(now, 0) == 1 and tasks.budget(now, 5) == 1


def test_composites(spark):
    pages = spark.createDataFrame([("Sách A", "p2.txt", "hai"), ("Sách A", "p1.txt", " một "), (".tmp", "p1.txt", "x"), ("B", "p1.txt", "b b")], "book string, filename string, text string")
    merged, archives, books = composites.merge_and_package(no_books(spark), pages.filter("book <> '.tmp'"), at())
    rows = {r["slug"]: r for r in books.collect()}
    size = len(merged.filter("book = 'B'").first()["text"].encode())
    assert set(rows) == {"sach-a", "b"} and rows["sach-a"]["total_pages"] == 2 and rows["b"]["file_size_bytes"] == size and archives.count() == 2
    synced = {r["slug"]: r for r in composites.sync_catalogue(again(spark, books), pages, merged, None, at()).collect()}
    assert set(synced) == {"sach-a", "b"} and synced["b"]["word_count"] == len(merged.filter("book = 'B'").first()["text"].split()) and synced["sach-a"]["summary"] == ""
    assert composites.sync_catalogue(no_books(spark), pages, merged).filter("slug = 'sach-a'").first()["summary"] == "một hai..."
    known = spark.createDataFrame([(1, "a/1.png", 1, "FAILED", "E", 0.0, 1.0)], "id long, file_path string, file_size long, status string, error_msg string, confidence double, processing_time_ms double")
    scanned = spark.createDataFrame([("a/1.png", 1), ("a/2.png", 1), ("b/1.png", 1)], "rel_path string, size long")
    after, stats = composites.scan_and_register(known, scanned, "a")
    assert after.count() == 2 and stats.first()["total"] == 2
    outputs = spark.createDataFrame([("a", True, False)], "book string, has_text_file boolean, has_zip_file boolean")
    jobs = composites.list_jobs(known, scanned, spark.createDataFrame([], "book string, state string"), outputs)[1]
    assert {r["book"]: (r["has_text_file"], r["has_zip_file"]) for r in jobs.collect()} == {"a": (True, False), "b": (False, False)}
    run = lambda todo: todo.select("file_path", F.lit(True).alias("success"), F.lit(0.9).alias("confidence"), F.lit(1.0).alias("processing_time_ms"), F.lit(None).cast("string").alias("error_msg"))
    assert composites.retry_run(known, run).first()["status"] == "DONE"


def test_halls_and_answers(spark):
    b = spark.createDataFrame([(1, "a", 1, "Di sản Khoa học & Giáo dục"), (2, "b", 1, "somewhere"), (3, "c", 0, ""), (4, "d", 1, None)], "id long, slug string, is_public int, exhibition_hall string").withColumns({"title": F.col("slug"), "total_pages": F.lit(1), "word_count": F.lit(2), "created_at": at()})
    rows = assembly.halls(b).orderBy("place", F.desc("artifact.id")).collect()
    assert [(r["hall_id"], r["n_books"], r["artifact"] and r["artifact"]["slug"]) for r in rows] == [("khu-trung-bay-chung", 2, "d"), ("khu-trung-bay-chung", 2, "b"), ("khoa-hoc-giao-duc", 1, "a"), ("song-hong-heritage", 0, None), ("dia-phuong-chi", 0, None)]
    assert assembly.museum_totals(b).first()[:] == (3, 3, 6, 4) and assembly.museum_totals(b.limit(0)).first()["halls"] == 3
    seeds = library.standard_seeds(spark)
    assert seeds.count() == 4 and seeds.select("slug").distinct().count() == 4
    pages = spark.createDataFrame([("x", "2.txt", "hai"), ("x", "1.txt", "một"), ("y", "1.txt", "")], "book string, filename string, text string")
    assert {r["book"]: r["context"] for r in assembly.chat_prompt_context(pages).collect()} == {"x": assembly.CHAT_HEADING + "một\n\nhai", "y": ""}
    dossier = spark.createDataFrame([("T", "M-1", "E", "P", "N")], "title string, artifact_code string, period_era string, provenance string, curator_notes string")
    assert dossier.select(assembly.fallback_answer()).first()[0].startswith("Kính chào quý khách. Về hiện vật **T** (M-1, niên đại E)")
    texts = spark.createDataFrame([("x", "1.txt", "t")], "book string, filename string, text string")
    none = spark.createDataFrame([], "book string, filename string")
    assert assembly.align_scans(texts, none, spark.createDataFrame([("x",)], "book string")).first()["has_image"]
    assert assembly.split_merged(spark.createDataFrame([("d", "=== [trang 1/1] a ===\nx")], "book string, text string"), reader=True).first()["filename"] == "full.txt"


def test_manifest_and_exports(spark, tmp_path):
    delta = spark.createDataFrame([(1, "A", 1), (2, "Đ", 0)], "seq int, title string, is_public int")
    books = again(spark, library.upsert(no_books(spark), delta, at()))
    files.export_manifest(books, str(tmp_path / "m.json"))
    rows = json.loads((tmp_path / "m.json").read_text())
    assert [r["slug"] for r in rows] == ["a"] and (tmp_path / "m.json").read_text().startswith("[\n  {")
    back = composites.restore(no_books(spark), files.read_manifest(spark, str(tmp_path / "m.json"), BOOKS), at()).first()
    assert (back["id"], back["slug"], back["cover_image"]) == (1, "a", "/covers/a.jpg")
    results = spark.createDataFrame([("a/b.x/1.png", "một", 0.0, 5.0, 0.25)], "file_path string, full_text string, confidence double, processing_time_ms double, avg_confidence double").withColumn("lines", F.array().cast("array<string>"))
    assert files.export_texts(results, str(tmp_path / "t")) == 1 and (tmp_path / "t/a/b.x/1.txt").read_text() == "một"
    files.export_texts(results, str(tmp_path / "flat"), mirror=False)
    assert (tmp_path / "flat/1.txt").exists()
    with pytest.raises(Exception, match="leaves"):
        files.export_texts(results.withColumn("file_path", F.lit("../../x.png")), str(tmp_path / "t"))
    merged = spark.createDataFrame([("a", "x")], "book string, text string")
    assert files.export_merged(merged, str(tmp_path / "t")) == 1
    assert files.read_outputs(spark, str(tmp_path / "t")).first()[:] == ("a", True, False)
    files.write_jsonl(results, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["confidence"] == 0.25
    files.export_report(spark.createDataFrame([("é,", 1)], "file_path string, n int"), str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbffile_path,n") and "é" in (tmp_path / "r.csv").read_text("utf-8-sig")
    (tmp_path / "w.txt").write_text("lịch\n\n sử \n")
    assert files.read_words(spark, str(tmp_path / "none"), str(tmp_path / "w.txt")) == ["lịch", "sử"]
    with pytest.raises(FileNotFoundError):
        files.read_words(spark, str(tmp_path / "none"))


def test_scan_order_archives_and_settings(spark, tmp_path):
    for p in ("b10/1.png", "b2/10.png", "b2/2.png", "b2/in/1.png", "z.png", "z.txt"):
        (tmp_path / "in" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / p).write_bytes(b"x")
    found = files.scan_images(spark, str(tmp_path / "in"))
    assert [r[0] for r in files.in_scan_order(found).collect()] == ["b2/2.png", "b2/10.png", "b2/in/1.png", "b10/1.png", "z.png"]
    assert [r[0] for r in files.list_books(found).collect()] == ["b2", "b10"]
    assert {r[0] for r in files.scan_images(spark, str(tmp_path / "in"), "b10").collect()} == {"b10/1.png"}
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as z:
        for n in ("a/1.png", "b/1.png"):
            info = tarfile.TarInfo(n)
            info.size = 1
            z.addfile(info, io.BytesIO(b"1"))
    (tmp_path / "x.tar.gz").write_bytes(tar.getvalue()), (tmp_path / "s.png.gz").write_bytes(gzip.compress(b"22")), (tmp_path / "bad.7z").write_bytes(b"7z")
    rows = files.unpack(spark.read.format("binaryFile").load(str(tmp_path / "*[z]"))).collect()
    assert sorted((r["path"], bytes(r["content"])) for r in rows if r["path"]) == [("a/1.png", b"1"), ("b/1.png", b"1"), ("s.png", b"22")]
    assert [r["error_msg"].split(":")[0] for r in rows if not r["path"]] == ["ValueError"]
    flat = files.flattened(spark.createDataFrame([tuple(r) for r in rows], "archive string, path string, content binary, error_msg string"))
    assert sorted(r["flat_name"] for r in flat.collect()) == ["1.png", "b_1.png", "s.png"]
    s = files.load_settings("system:\n  num_workers: 2\n  batch_size: 20\nocr:\n  gemini:\n    max_retries: 3\npreprocessing:\n  split_double_pages: true\noutput:\n  format: 'txt'\n")
    assert s == files.Settings(workers=2, batch_size=20, split_double_pages=True, output="txt", max_retries=3) and files.load_settings("") == files.Settings()


def test_image_formats_and_turns():
    image = np.arange(5 * 3 * 3, dtype=np.uint8).reshape(5, 3, 3)
    line = (3 * 3 + 3) // 4 * 4
    body = b"".join(r[:, ::-1].tobytes().ljust(line, b"\0") for r in image[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 5, 1, 24, 0, len(body), 0, 0, 0, 0) + body
    assert (imaging.decode(bmp) == image).all()
    tiff = b"MM\0*\0\0\0\x08" + struct.pack(">H", 1) + struct.pack(">HHIHH", 0x0112, 3, 1, 6, 0) + b"\0" * 4
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xda"
    assert imaging.orientation(jpeg) == 6 and imaging.orientation(b"\xff\xd8\xff\xda\0\0") == imaging.orientation(b"") == 1
    assert (imaging.transpose(image, 6) == np.rot90(image, -1)).all() and (imaging.transpose(image, 8) == np.rot90(image)).all() and (imaging.transpose(image, 3) == np.rot90(image, 2)).all()
    raw = b"".join(bytes([k % 5]) + bytes(range(k, k + 9)) for k in range(4))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 4, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    out = imaging.decode(png)
    assert out[1].tolist() == np.cumsum(np.arange(1, 10).reshape(3, 3), axis=0).tolist() and out[2].reshape(-1).tolist() == (np.arange(2, 11) + out[1].reshape(-1)).tolist()
    grey = np.tile(np.linspace(100, 130, 64).astype(np.uint8), (64, 1))
    even = imaging.equalise(grey)
    assert even.shape == (64, 64, 3) and np.ptp(even) > np.ptp(grey) and (imaging.equalise(np.full((20, 30), 7, np.uint8)).std() == 0)
    assert imaging.thumbnail(np.zeros((1200, 400, 3), np.uint8)).shape == (600, 200, 3) and imaging.thumbnail(image) is image
    for bad in (b"BM", bmp[:60], b"GIF89a"):
        with pytest.raises(imaging.DecodeError):
            imaging.decode(bad)


def drawn(spark, path, kind, grey=False):
    """A picture of 80 x 60 written by Java as jpg, png, bmp or tiff."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(80, 60, 10 if grey else 5)
    for x in range(80):
        for y in range(60):
            image.setRGB(x, y, ((x * 3) << 16) | ((y * 4) << 8) | (128 if x < 40 else 7))
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))


def turned(jpeg, turn):
    """A JPEG file with an Exif orientation put in."""
    tiff = b"MM\0*\0\0\0\x08" + struct.pack(">H", 1) + struct.pack(">HHIHH", 0x0112, 3, 1, turn, 0) + b"\0" * 4
    return jpeg[:2] + b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + jpeg[2:]


def test_all_formats_in_batch_and_stream(spark, tmp_path):
    root = tmp_path / "in"
    (root / "a b[1]").mkdir(parents=True), (root / "t").mkdir()
    for i, kind in enumerate(("jpg", "png", "bmp", "tiff"), 1):
        drawn(spark, root / "a b[1]" / f"{i}.{kind}", kind)
    drawn(spark, root / "a b[1]" / "5.TIF", "tiff", grey=True)
    (root / "a b[1]" / "6.jpeg").write_bytes(turned((root / "a b[1]" / "1.jpg").read_bytes(), 6))
    (root / "a b[1]" / "7.jpg").write_bytes(b"\xff\xd8 broken"), (root / "a b[1]" / "8.jpg").write_bytes(b""), (root / "a b[1]" / "9.heic").write_bytes(b"no opener")
    (root / "t" / "1.tif").write_bytes(b"II*\0"), drawn(spark, root / "t" / "2.tif", "tiff")
    batch = {r["file_path"]: r for r in digitise.digitise(digitise.read_images(spark, str(root))).collect()}
    good = {p for p, r in batch.items() if r["success"]}
    assert good == {f"a b[1]/{x}" for x in ("1.jpg", "2.png", "3.bmp", "4.tiff", "5.TIF", "6.jpeg")} | {"t/2.tif"}
    assert set(batch) - good == {"a b[1]/7.jpg", "a b[1]/9.heic", "t/1.tif"}  # the empty file is empty_results()'s
    assert len({batch[f"a b[1]/{x}"]["full_text"] for x in ("2.png", "3.bmp", "4.tiff")}) == 1
    assert batch["a b[1]/6.jpeg"]["full_text"].startswith("60x80") and batch["a b[1]/1.jpg"]["full_text"].startswith("80x60")
    told = []
    digitise.stream(spark, str(root), str(tmp_path / "out"), str(tmp_path / "cp"), batch_size=3, more=[lambda b, n: told.append(b.count())]).awaitTermination(240)
    rows = {r["file_path"]: r for r in spark.read.json(str(tmp_path / "out/jsonl")).collect()}
    assert {k: v["text"] for k, v in rows.items()} == {k: v["full_text"] for k, v in batch.items()} and sum(told) == len(batch) and len(told) > 2
    done = {r["file_path"]: r["success"] for r in spark.read.parquet(str(tmp_path / "out/results")).collect()}
    assert done == {k: v["success"] for k, v in batch.items()}
    png = digitise.digitise(spark.createDataFrame([("x", (root / "a b[1]/2.png").read_bytes())], "file_path string, content binary")).first()
    assert png["full_text"] == batch["a b[1]/2.png"]["full_text"]


def test_an_opener_for_another_format(spark, tmp_path, monkeypatch):
    """Content of formats that Spark doesn't decode reaches the openers."""
    (tmp_path / "b").mkdir()
    (tmp_path / "b/1.webp").write_bytes(imaging.encode_png(np.full((3, 5, 3), 9, np.uint8)))
    assert digitise.digitise(digitise.read_images(spark, str(tmp_path))).first()["full_text"].startswith("5x3")


def test_covers_and_web_pages(spark, tmp_path):
    for book in ("j", "t", "none"):
        (tmp_path / "in" / book).mkdir(parents=True)
    drawn(spark, tmp_path / "in/j/2.jpg", "jpg"), drawn(spark, tmp_path / "in/j/10.png", "png"), (tmp_path / "in/j/1.jpg").write_bytes(b"broken")
    drawn(spark, tmp_path / "in/t/1.tiff", "tiff"), (tmp_path / "in/t/2.bmp").write_bytes(b"BM"), (tmp_path / "in/none/1.jpg").write_bytes(b"x")
    pixels = files.read_pixels(spark, str(tmp_path / "in"))
    pages = pixels.withColumns({"book": t.book_of("file_path"), "filename": t.base_name("file_path")})
    got = {r["book"]: imaging.decode(bytes(r["cover"])) for r in files.covers(pages).collect()}
    assert set(got) == {"j", "t"} and got["j"].shape == got["t"].shape == (60, 80, 3) and (got["j"] != got["t"]).any()  # 2.jpg, not 10.png
    big = spark.createDataFrame([("a", "2.png", b"x"), ("a", "1.png", imaging.encode_png(np.zeros((1200, 800, 3), np.uint8)))], "book string, filename string, content binary")
    assert imaging.decode(bytes(files.covers(big).first()["cover"])).shape == (600, 400, 3)
    web = {(r["book"], r["filename"]): r for r in files.web_pages(spark, str(tmp_path / "in")).collect()}
    assert set(web) == {("j", "1.jpg"), ("j", "2.jpg"), ("j", "10.png"), ("t", "1.png"), ("t", "2.bmp"), ("none", "1.jpg")}
    assert bytes(web["j", "2.jpg"]["content"]) == (tmp_path / "in/j/2.jpg").read_bytes() and imaging.decode(bytes(web["t", "1.png"]["content"])).shape == (60, 80, 3)
    assert web["t", "2.bmp"]["content"] is None and web["t", "2.bmp"]["error_msg"].startswith("DecodeError")
    for _ in range(2):
        assert files.cache_web_pages(spark, str(tmp_path / "in"), str(tmp_path / "cache")) == 1
    assert (tmp_path / "cache/t/1.png").read_bytes() == bytes(web["t", "1.png"]["content"])


def test_stream_replays_and_reports(spark, tmp_path):
    root = tmp_path / "in" / "b"
    root.mkdir(parents=True)
    for i in range(3):
        (root / f"{i}.png").write_bytes(imaging.encode_png(np.full((4, 4, 3), i, np.uint8)))
    (root / "empty.png").write_bytes(b"")
    extra, out = [], str(tmp_path / "out")
    digitise.stream(spark, str(tmp_path / "in"), out, str(tmp_path / "cp"), batch_size=2, more=[lambda batch, epoch: extra.append((epoch, batch.count()))]).awaitTermination(120)
    assert sorted(e for e, _ in extra) == [0, 1] and sum(n for _, n in extra) == 3  # the empty file is in one of the batches
    batch = digitise.digitise(digitise.read_images(spark, str(tmp_path / "in"))).limit(dict(extra)[0])
    for sink in digitise.sinks(out):
        sink(batch, 0), sink(batch, 0)  # a replayed batch replaces what it wrote
    assert spark.read.parquet(f"{out}/results").count() == spark.read.json(f"{out}/jsonl").count() == 3
    known = spark.createDataFrame([(1, "b/empty.png", 0, "IN_PROGRESS", None, None, None)], "id long, file_path string, file_size long, status string, confidence double, error_msg string, processing_time_ms double")
    after = tasks.apply_results(known, digitise.empty_results(files.scan_images(spark, str(tmp_path / "in")))).first()
    assert (after["status"], after["error_msg"]) == ("FAILED", "DecodeError: empty file (0 bytes)")
    told = []
    p = digitise.Progress(told.append, total=10)
    p.add(0, 4), p.add(1, 6)
    assert [x["done"] for x in told] == [4, 10] and told[1]["seconds_left"] == 0
    done, failed = [], []
    digitise.in_background(lambda: done.append(1)).join(), digitise.in_background(lambda: 1 / 0, failed.append).join()
    assert done == [1] and isinstance(failed[0], ZeroDivisionError)
    with pytest.raises(ValueError):
        digitise.sinks(out, "xml")


def test_connectors(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/1.bin").write_bytes(b"one"), (tmp_path / "d/2.bin").write_bytes(b"")

    class Broken:
        def list(self, link):
            raise OSError("no")

        fetch = list

    c = connectors.FallbackConnector(Broken(), connectors.LocalConnector())
    got = {r["name"]: (bytes(r["content"]), r["error_msg"]) for r in connectors.download(spark, c, str(tmp_path / "d"), 2).collect()}
    assert got == {"1.bin": (b"one", None), "2.bin": (b"", None)}
    with pytest.raises(RuntimeError):
        connectors.FallbackConnector(Broken()).list("x")
    web = connectors.HttpConnector()
    assert web.list("http://x/a/b.zip?c=1")[0][0] == "b.zip" and b"".join(web.fetch((tmp_path / "d/1.bin").as_uri())) == b"one"
    local = spark.createDataFrame([(str(tmp_path / "d/1.bin"), b""), ("k", b"here")], "key string, content binary")
    wanted = spark.createDataFrame([(str(tmp_path / "d/1.bin"),), ("k",), ("none",)], "key string")
    assert {r["key"][-5:]: r["content"] and bytes(r["content"]) for r in connectors.with_missing(local, wanted, connectors.LocalConnector()).collect()} == {"1.bin": b"one", "k": b"here", "none": None}
    now, told = [0.0], []
    say = connectors.Throttle(lambda m, p: told.append(m), clock=lambda: now[0])
    say("a", 1), say("b", 2), say("c", 3, final=True)
    now[0] = 1.0
    say("d", 4)
    assert told == ["a", "c", "d"]
    events = spark.createDataFrame([("t", datetime.datetime(2026, 1, 1, 0, 0, 0, k * 100_000), k, 9) for k in range(10)], "task_id string, ts timestamp, current long, total long")
    assert [r["current"] for r in connectors.download_log(events).orderBy("current").collect()] == [0, 3, 5, 8, 9]
    assert connectors.download_state(events).first()["current"] == 9


def test_download_log_of_equal_times_and_large_files(spark):
    at = datetime.datetime(2026, 1, 1)
    events = spark.createDataFrame([("t", at, k * 2**30, 9 * 2**30) for k in (3, 1, 2)], "task_id string, ts timestamp, current long, total long")
    for e in (events, events.orderBy("current"), events.orderBy(F.desc("current"))):
        assert connectors.download_log(e).first()["message"] == "1.0 GB / 9.0 GB" and connectors.download_log(e, largest="MB").first()["message"] == "1024.0 MB / 9216.0 MB"
        assert connectors.download_state(e).first()["current"] == 3 * 2**30


def test_download_log_equals_its_sql_beyond_a_gigabyte(spark, tmp_path):
    import duckdb
    from quire import catalog_queries

    sql = f"SELECT i * 97003 AS event_id, TIMESTAMP '2026-01-01' + INTERVAL (i // 9) HOUR AS ts, (i % 3)::BIGINT AS user_id, CASE WHEN i % 5 = 0 THEN 'click' ELSE 'view' END AS event_type FROM range(60) r(i) ORDER BY i % 7"
    duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/events.parquet'")
    want = duckdb.sql(catalog_queries.ORACLE_SQL["download_log"].replace("FROM events)", f"FROM '{tmp_path}/events.parquet')")).fetchall()
    assert sorted(map(tuple, catalog_queries.QUERIES["download_log"](spark, str(tmp_path)).collect())) == sorted(want)


def test_reading_order_is_stable(spark):
    box = [[0.0, 0.0], [9.0, 5.0]]
    rows = [(1, x, box) for x in "cab"] + [(2, "solo", box)]
    df = spark.createDataFrame(rows, "page_id int, text string, box array<array<double>>")
    for d in (df, df.orderBy(F.desc("text")).repartition(3)):
        assert [r["text"] for r in layout.sort_pages(d).filter("page_id = 1").orderBy("place").collect()] == ["a", "b", "c"]


def plain_order(boxes):
    """The order of one page's sorted boxes by the rules, box by box."""
    if len(boxes) <= 2:
        return sorted(boxes, key=lambda x: x[2])
    w, h, n = max(x[1] for x in boxes), max(x[3] for x in boxes), len(boxes)
    best = None
    for s in (0.35 * w + k * (0.3 * w / 30) for k in range(30)):
        cross = sum(x[0] < s - 10 and x[1] > s + 10 for x in boxes)
        left = sum(x[1] <= s + 10 for x in boxes)
        if left >= 5 and n - left - cross >= 5 and (best is None or cross < best[0]):
            best = cross, s
    parts = [[], [], [], []]
    for x in boxes:
        if best is None or best[0] > max(3, 0.15 * n):
            k = 0
        elif x[0] < best[1] - 15 and x[1] > best[1] + 15:
            y = (x[2] + x[3]) / 2
            k = 0 if y < 0.25 * h else 3 if y > 0.85 * h else 1 if (x[0] + x[1]) / 2 < best[1] else 2
        else:
            k = 1 if x[1] <= best[1] + 15 else 2
        parts[k].append(x)
    out = []
    for part in parts:
        lines = []
        for x in sorted(part, key=lambda x: (x[2], x[0])):
            shared = lines and min(x[3], lines[-1][-1][3]) - max(x[2], lines[-1][-1][2])
            if lines and shared > 0 and shared / max(min(x[3] - x[2], lines[-1][-1][3] - lines[-1][-1][2]), 1) > 0.35:
                lines[-1].append(x)
            else:
                lines.append([x])
        out += [x for line in lines for x in sorted(line, key=lambda x: x[0])]
    return out


def test_reading_order_of_pages_across_batches(spark):
    rng, rows = random.Random(5), []
    for page in [None, *range(1, 60)]:
        for k in range(rng.choice((1, 2, 3, 12, 30, 45))):
            x, y = rng.randint(0, 1) * 450 + rng.randint(0, 300), rng.randint(0, rng.choice((40, 900)))
            rows.append((page, f"{page}-{k}", [[float(x), float(y)], [900.0 if rng.random() < 0.08 else x + 60.0, y + rng.randint(0, 50) + 0.0]]))
    want = {}
    for page, text, ((x0, y0), (x1, y1)) in rows:
        want.setdefault(page, []).append((x0, x1, y0, y1, text))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = layout.sort_pages(spark.createDataFrame(rows, "page_id int, text string, box array<array<double>>")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted(((page, x[4], k) for page, boxes in want.items() for k, x in enumerate(plain_order(sorted(boxes)))), key=str)


def test_pages_are_laid_out_together():
    """5,000 pages at once take less time than one by one."""
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 800, 150_000), rng.integers(0, 900, 150_000)
    b = np.column_stack([x, x + 60, y, y + rng.integers(1, 50, len(x))]).astype(float)
    page = np.repeat(np.arange(5_000), 30)
    clock = __import__("time").perf_counter
    began = clock()
    layout.reading_places(b, page)
    together = clock() - began
    began = clock()
    for k in range(500):
        layout.reading_order(b[k * 30 : k * 30 + 30])
    assert together < 10 * (clock() - began)


def test_small_scalars(spark):
    df = spark.createDataFrame([("a/b.c/d.JPG", 1234567, "x y&z")], "p string, n long, q string")
    row = df.select(t.parent("p"), t.with_suffix("p", ".txt"), t.parent(F.lit("d")), t.with_suffix(F.lit("a.b/d"), ".txt"), t.thousands("n"), t.url_encode("q"), t.highlights(F.lit('["a", "b"]')), t.highlights(F.lit("no")), t.ordered_distinct(F.array(F.lit("b"), F.lit(""), F.lit("a"), F.lit("b")))).first()
    assert row[:] == ("a/b.c", "a/b.c/d.txt", ".", "a.b/d.txt", "1,234,567", "x%20y%26z", ["a", "b"], [], ["b", "a"])


def test_restored_texts_are_counted_as_they_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "lich su"), (2, "khac"), (3, None), (4, "Lich"), (5, "")], "id int, text string")
    out, seen = composites.restore_texts(df, ["lịch", "sử"])
    out.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"files": 5, "changed": 2} and {r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"lịch sử", "khac", None, "Lịch", ""}
