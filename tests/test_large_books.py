import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quire.operators import assembly, large_books
from quire.sources import files


def pages(spark):
    rng = random.Random(1)
    rows = [("big", f"p{i}.txt", "".join(rng.choices("né xyz\n", k=rng.randint(0, 300)))) for i in range(400)] + [("b 2", "10.txt", "  ten "), ("b 2", "2.txt", "two"), ("b 2", "3.txt", ""), ("one", "é.txt", "x")]
    return spark.createDataFrame(rows, "book string, filename string, text string").repartition(5)


def test_checksums_combine():
    rng = random.Random(2)
    for n in (0, 1, 7, 1000, 70_000):
        a, b = rng.randbytes(50), rng.randbytes(n)
        assert large_books.combined(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


@pytest.mark.parametrize("most, size", [(large_books.MOST, large_books.SIZE), (2, 500)])
def test_blocks_are_the_whole_book(spark, most, size):
    """Also in the 64-bit form of the format, here for small counts."""
    df, block = pages(spark), 5_000
    numbered = large_books.paged(df, block)
    texts = large_books.merged_blocks(numbered).collect()
    want = {r["book"]: r["text"] for r in assembly.merge_pages(df).collect()}
    assert {b: "".join(r["text"] for r in sorted(texts, key=lambda r: r["block"]) if r["book"] == b) for b in want} == want
    assert max(len(r["text"].encode()) for r in texts) < block + 1_000 and sum(r["book"] == "big" for r in texts) > 10
    blocks = large_books.zip_blocks(numbered, block, most, size).collect()
    assert max(len(r["data"]) for r in blocks) < 2 * block + 1_000
    known = {r["book"]: bytes(r["archive"]) for r in assembly.zip_books(df, assembly.merge_pages(df)).collect()}
    for book, small in known.items():
        data = b"".join(bytes(r["data"]) for r in sorted(blocks, key=lambda r: r["block"]) if r["book"] == book)
        with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(io.BytesIO(small)) as y:
            assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {n: y.read(n) for n in y.namelist()}
            assert [i.CRC for i in sorted(z.infolist(), key=lambda i: i.filename)] == [i.CRC for i in sorted(y.infolist(), key=lambda i: i.filename)]


def test_books_of_any_size_are_exported(spark, tmp_path):
    df = pages(spark)
    for _ in range(2):
        assert files.export_books(df, str(tmp_path / "out"), block=5_000) == 6
    want = {r["book"]: r["text"] for r in assembly.merge_pages(df).collect()}
    assert {p.stem: p.read_text(newline="") for p in (tmp_path / "out").glob("*.txt")} == want
    with zipfile.ZipFile(tmp_path / "out/big_package.zip") as z:
        assert z.testzip() is None and z.read("big.txt").decode() == want["big"] and len(z.namelist()) == 401
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted([*(f"{b}.txt" for b in want), *(f"{b}_package.zip" for b in want)])
    assert {r["book"]: (r["has_text_file"], r["has_zip_file"]) for r in files.read_outputs(spark, str(tmp_path / "out")).collect()} == {b: (True, True) for b in want}
    assert files.export_books(df.filter(F.lit(False)), str(tmp_path / "none")) == 0
