import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import repair, text as t
from quire.operators import assembly, imaging, layout, library, tasks
from quire.sources import files
from quire.streaming import digitise


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(f("x")).collect()]


def test_natural_order(spark):
    names = ["p10.jpg", "p2.jpg", "P1.jpg", "1.jpg", "p" + "9" * 50, "p007.jpg"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "x string").orderBy(t.natural_key("x"), "x").collect()]
    assert got == ["1.jpg", "P1.jpg", "p2.jpg", "p007.jpg", "p10.jpg", "p" + "9" * 50]


def test_slugs_and_accents(spark):
    values = ("Đất Yên Mỹ", "Đất Yên Mỹ", "!!!", " a  -- b_c ", None)
    want = ["dat-yen-my", "dat-yen-my", "untitled", "a-b-c"]
    assert one(spark, t.slugify_exact, *values)[:4] == want
    assert one(spark, t.slugify, *values)[:4] == want
    assert one(spark, t.strip_accents, "Đường ĐỜI") == ["Duong DOI"]


def test_scalar_functions(spark):
    assert one(spark, t.categorize, "Luận án tiến sĩ", "Lịch sử thơ", "x") == ["Nghiên cứu / Luận án", "Lịch sử - Địa chí", "Tài liệu tổng hợp"]
    assert one(spark, lambda c: t.sqlite_like(c, "a_c%"), "ABCd", "a\nc", "ac", "x") == [True, True, False, False]
    assert one(spark, t.book_of, "a/b.jpg", "a\\b.jpg", "b.jpg") == ["a", "a", "[root]"]
    assert one(spark, t.drive_id, "x/folders/A_1?id=2", "u?id=b-3", "file/d/c/view", "none") == ["A_1", "b-3", "c", None]
    assert one(spark, t.summary, "=== x\n a \n\nb\nc\nd\ne\nf", "", "=== only") == ["a b c d e...", "", ""]
    assert one(spark, t.sanitize_name, "a:b?-20240101T010203Z-1", "???") == ["ab", "Untitled_Book"]
    assert one(spark, lambda c: t.highlight(c, "a.b"), "xA.By aab") == ["x<mark>A.B</mark>y aab"]
    assert one(spark, t.capitalize, "nGUYỄN") == ["Nguyễn"]


def test_repair(spark):
    df = spark.createDataFrame([("Iớp NCUYỄN 10O cí", "nuoc 12.00O  lich su LICH")], "a string, b string")
    assert df.select(repair.repair(F.col("a")), repair.repair(F.col("b"))).first()[:] == ("lớp NGUYỄN 100 chí", "nước 12.000  lich su LICH")
    out = repair.restore_diacritics(df, "b", ["lịch", "lích", "sử"]).first()["b"]
    assert out == "nuoc 12.00O  lịch sử LỊCH"


TASKS = "id long, file_path string, file_size long, status string, confidence double, error_msg string, processing_time_ms double"


def some_tasks(spark):
    return spark.createDataFrame([(1, "a_b/1.jpg", 5, "PENDING", None, None, None), (2, "a_b/2.jpg", 5, "FAILED", 0.0, "E", 3.0), (3, "axb/1.jpg", 5, "IN_PROGRESS", None, None, None), (4, ".tmp/1.jpg", 5, "DONE", 0.9, None, 10.0)], TASKS)


def test_register_is_idempotent_and_numbered(spark):
    found = spark.createDataFrame([("b/2.jpg", 1), ("b/1.jpg", 1), ("a_b/1.jpg", 9), ("b/1.jpg", 1)], "file_path string, file_size long")
    once = tasks.register(some_tasks(spark), found)
    rows = {r["file_path"]: (r["id"], r["file_size"]) for r in once.collect()}
    assert rows["b/1.jpg"] == (5, 1) and rows["b/2.jpg"] == (6, 1) and rows["a_b/1.jpg"] == (1, 5)
    assert tasks.register(once, found).count() == 6


def test_claims_are_disjoint_and_complete(spark):
    now = spark.createDataFrame([(i, f"book/{i:03}.jpg", 100, "PENDING", None, None, None) for i in range(20)], TASKS)
    seen = []
    while True:
        taken, now = tasks.claim(now, 7)
        got = [r[0] for r in taken.collect()]
        if not got:
            break
        seen += got
        now = spark.createDataFrame(now.collect(), TASKS)
    assert seen == [f"book/{i:03}.jpg" for i in range(20)]
    assert tasks.claim(some_tasks(spark), 0)[0].count() == 0


def test_transitions(spark):
    s = some_tasks(spark)
    assert {r["book"]: r["total"] for r in tasks.stats_by_book(s).collect()} == {"a_b": 2, "axb": 1}
    assert tasks.stats(s, "a_b").first()["failed"] == 1
    assert tasks.reset_hanging(s, "a_b").filter("id = 3").first()["status"] == "IN_PROGRESS"
    assert tasks.reset_hanging(s).filter("id = 3").first()["status"] == "PENDING"
    assert tasks.retry_failed(s).filter("id = 2").first()[3:6] == ("PENDING", 0.0, None)
    r = spark.createDataFrame([("axb/1.jpg", True, 0.5, 1.0, None, 1), ("axb/1.jpg", False, 0.0, 2.0, "X", 2), ("no", True, 1.0, 1.0, None, 1)], "file_path string, success boolean, confidence double, processing_time_ms double, error_msg string, seq int")
    assert tasks.apply_results(s, r).filter("id = 3").first()[3:] == ("FAILED", 0.0, "X", 2.0)
    assert tasks.stats(s.limit(0)).first()["percent"] == 0.0


def test_upsert_folds_in_order(spark):
    kind = "slug string, title string, status string, total_pages long, curator_notes string, exhibition_hall string, category string"
    books = spark.createDataFrame([(1, "a", "A", "COMPLETED", 9, "n", "H", "c")], "id long, " + kind)
    delta = spark.createDataFrame([(1, "a", "A1", "PROCESSING", 0, "", library.DEFAULT_HALL, "z"), (2, "a", "A2", "COMPLETED", 3, "", "H2", "z"), (3, "b", "B", "COMPLETED", 0, "", library.DEFAULT_HALL, "k")], "seq int, " + kind)
    rows = {r["slug"]: r for r in library.upsert(books, delta).collect()}
    assert rows["a"][1:] == ("a", "A2", "COMPLETED", 3, "n", "H2", "c")
    assert rows["b"][2:] == ("B", "COMPLETED", 0, "", library.DEFAULT_HALL, "k")
    with pytest.raises(ValueError):
        library.list_books(books, limit=-1)


def test_merge_then_split_gives_the_pages(spark):
    pages = spark.createDataFrame([("b", "p10.txt", "ten\nlines"), ("b", "p2.txt", " two "), ("c", "x.txt", "")], "book string, filename string, text string")
    merged = assembly.merge_pages(pages)
    assert merged.filter("book = 'b'").first()["text"].startswith("=== [Trang 1/2] p2.txt ===\n\ntwo\n\n=== [Trang 2/2] p10.txt ===")
    rows = {(r["book"], r["page_num"]): (r["filename"], r["text"]) for r in assembly.split_merged(merged).collect()}
    assert rows == {("b", 1): ("p2.txt", "two"), ("b", 2): ("p10.txt", "ten\nlines"), ("c", 1): ("x.txt", "")}
    plain = spark.createDataFrame([("d", "no marker")], "book string, text string")
    assert assembly.split_merged(plain).first()[:] == ("d", 1, "full.txt", "no marker")
    z = assembly.zip_books(pages, merged).filter("book = 'b'").first()["archive"]
    assert sorted(zipfile.ZipFile(io.BytesIO(z)).namelist()) == ["b.txt", "pages/p10.txt", "pages/p2.txt"]


def test_reading_order():
    left = [(0, 400, 100 * i, 100 * i + 50) for i in range(1, 7)]
    right = [(600, 1000, 100 * i, 100 * i + 50) for i in range(1, 7)]
    order = layout.reading_order(np.array([*right, *left, (0, 1000, 0, 50)], float))
    assert order == [12, 6, 7, 8, 9, 10, 11, 0, 1, 2, 3, 4, 5]
    assert layout.reading_order(np.array([(0, 10, 50, 60), (0, 10, 0, 10)], float)) == [1, 0]
    one_line = layout.reading_order(np.array([(50, 90, 2, 12), (0, 40, 0, 10), (0, 90, 40, 50)], float))
    assert one_line == [1, 0, 2]


def test_images():
    image = np.arange(60 * 30 * 3, dtype=np.uint8).reshape(30, 60, 3)
    assert (imaging.decode_png(imaging.encode_png(image)) == image).all()
    assert imaging.downscale(image, 30).shape == (15, 30, 3) and imaging.downscale(image, 0) is image
    assert [x.shape[1] for x in imaging.split_spread(image)] == [31, 31]
    for bad in (b"", b"x", imaging.encode_png(image)[:60]):
        with pytest.raises(imaging.DecodeError):
            imaging.decode_png(bad)


def test_scan_stream_equals_batch(spark, tmp_path):
    root = tmp_path / "in"
    for book, n in (("bookA", 3), ("bookB", 1)):
        (root / book).mkdir(parents=True)
        for i in range(n):
            (root / book / f"{i}.png").write_bytes(imaging.encode_png(np.full((4, 4 + i, 3), i, np.uint8)))
    (root / "bookB" / "bad.PNG").write_bytes(b"zz")
    (root / "bookB" / "empty.jpg").write_bytes(b"")
    (root / "bookB" / "notes.txt").write_text("x")
    scanned = files.scan_images(spark, str(root))
    assert {(r[0], r[1] == 0) for r in scanned.collect()} == {("bookA/0.png", False), ("bookA/1.png", False), ("bookA/2.png", False), ("bookB/0.png", False), ("bookB/bad.PNG", False), ("bookB/empty.jpg", True)}
    assert files.scan_images(spark, str(root / "none")).count() == 0
    batch = {r["file_path"]: (r["success"], r["full_text"]) for r in digitise.digitise(digitise.read_images(spark, str(root))).collect()}
    assert not batch["bookB/bad.PNG"][0] and batch["bookA/1.png"][0]
    digitise.stream(spark, str(root), str(tmp_path / "out"), str(tmp_path / "cp"), batch_size=2).awaitTermination(120)
    rows = spark.read.json(str(tmp_path / "out/jsonl")).collect()
    assert {r["file_path"]: r["text"] for r in rows} == {k: v[1] for k, v in batch.items()}


def test_retries():
    class Down:
        def __init__(self, m):
            self.m = m

        def recognize(self, image):
            raise RuntimeError(self.m)

    slept = []
    assert digitise.RetryingRecognizer([Down("503"), digitise.DigestRecognizer()], sleep=slept.append).recognize(np.zeros((2, 3, 3), np.uint8)).startswith("3x2")
    assert slept == [1]
    with pytest.raises(RuntimeError):
        digitise.RetryingRecognizer([Down("429 retry in 2.5s")], tries=2, sleep=slept.append).recognize(None)
    assert slept == [1, 5.5, 5.5]


def test_settings_and_archives():
    assert files.load_settings(None) == files.Settings()
    assert files.load_settings("processing:\n  workers: 2 # x\n  mirror: false\n  other: 1").workers == 2
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/1.png", b"1"), z.writestr("a/.h.png", b""), z.writestr("a/n.txt", b"")
    assert list(files.archive_members(out.getvalue())) == [("a/1.png", b"1")]


def test_filters_reach_the_scan(spark, tmp_path):
    some_tasks(spark).write.parquet(str(tmp_path / "t"))
    plan = tasks.pending(spark.read.parquet(str(tmp_path / "t")), 5)._jdf.queryExecution().toString()
    assert "EqualTo(status,PENDING)" in plan and "TakeOrderedAndProject" in plan and "confidence" not in plan.split("ReadSchema")[1]


def test_entry_without_the_optional_modules(monkeypatch):
    import importlib

    import __spark_entry__ as e

    monkeypatch.setattr(importlib, "import_module", lambda name: (_ for _ in ()).throw(ModuleNotFoundError(name=name)))
    assert "task_stats_by_book" in e.queries() and not any(k.startswith("op") for k in e.queries())


def joined_rows(df):
    """The most rows that a join of df, which has been collected, gave."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        elif "Join" in p.nodeName():
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_folders_of_many_copies_are_not_paired(spark):
    books = spark.createDataFrame([("a-b", "A b")] * 100 + [("x-y", "X y"), ("untitled", None), ("none", "none")], "slug string, title string")
    folders = spark.createDataFrame([(x,) for x in ["A b!", "a B"] * 100 + ["X y", "X y!", None, "?"]], "folder string")
    out = library.resolve_folders(books, folders)
    assert sorted(map(tuple, out.collect())) == [("a-b", "A b!"), ("untitled", "?"), ("x-y", "X y")]
    assert 0 < joined_rows(out) < 10


def test_duplicates_of_many_copies_are_not_paired(spark):
    kind = "id long, slug string, title string, source_id string, status string"
    books = spark.createDataFrame([(i, "a-b", "A b", f"s{i % 2}", "COMPLETED") for i in range(10, 110)] + [(1, "a-b", "A b", "s0", "NEW"), (5, "x-y", "old", "", "COMPLETED"), (6, "moved", "X y", "", "COMPLETED"), (7, "z", "Z", None, "COMPLETED")], kind)
    asked = [(k, "A b", "s1") for k in range(100)] + [(100, "X y", ""), (101, "Z", None), (102, "none", "s0"), (103, "none", ""), (104, None, "no"), (105, "Z", ""), (105, "none", "s1")]
    out = library.find_duplicates(books, spark.createDataFrame(asked, "qid long, title string, source_id string"))
    assert sorted(map(tuple, out.collect())) == [*((k, 11) for k in range(100)), (100, 5), (101, 7), (102, 10), (103, None), (104, None), (105, 11)]
    assert 0 < joined_rows(out) <= len(asked)
