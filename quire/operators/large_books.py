"""Merged texts and packages of books of any size: blocks of pages, members deflated in parallel, files joined from blocks.

A book is never one row or one group. Its pages are numbered by running totals over ranges; the merged text is rows of
blocks of about BLOCK bytes. A package is a zip whose members are deflated apart: the merged text block by block (each
ends at a byte, only the last one ends the stream, and the checksums of blocks combine to that of the text), each page by
itself. Sizes of members give their places by a running total, and these the directory at the end. The pieces in order
are dealt to blocks again, which stores.export_joined() makes files of.

Edge cases: null text is empty; pages of one name in one book keep both; books without pages have no text and no package;
repeated rows are pages of their own; archives of more members or bytes than the plain format can tell use its 64-bit form.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural_key
from .numbering import running
from .staging import small_side, staged

#: Bytes of a block; a block ends behind the page that fills it.
BLOCK = 4 << 20
#: What the plain zip format can count and measure.
MOST, SIZE = 0xFFFF, 0xFFFFFFFF


def paged(pages: DataFrame, block: int = BLOCK) -> DataFrame:
    """pages(book, filename, text) with page_num, total_pages, the text's part in the merged text, and its block."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + F.octet_length("filename") + 32
    own = pages.select("book", "filename", F.coalesce("text", F.lit("")).alias("text"), size.cast("long").alias("size"), F.lit(1).cast("long").alias("one"), F.struct(natural_key("filename").alias("k"), F.col("filename").alias("f")).alias("place"))
    own = running(own, "book", "place", page_num="one", upto="size")
    total = staged(own.groupBy("book").agg(F.max("page_num").alias("total_pages")), "totals")
    own = own.join(small_side(total), "book")
    part = F.concat(F.lit("=== [Trang "), "page_num", F.lit("/"), "total_pages", F.lit("] "), "filename", F.lit(" ===\n\n"), F.trim("text"), F.lit("\n\n"))
    return own.select("book", "page_num", "total_pages", "filename", "text", part.alias("part"), F.floor((F.col("upto") - F.col("size")) / block).alias("block"))


def merged_blocks(numbered: DataFrame) -> DataFrame:
    """(book, block, text) of paged(): the merged text of each book in blocks, which joined in order are merge_pages()'s."""
    parts = numbered.groupBy("book", "block").agg(F.sort_array(F.collect_list(F.struct("page_num", "part"))).alias("p"))
    return parts.select("book", "block", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("text"))


def combined(crc1: int, crc2: int, length: int) -> int:
    """The CRC-32 of two strings behind one another, from theirs and the second one's length."""

    def times(matrix, vector):
        out, i = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[i]
            vector >>= 1
            i += 1
        return out

    if not length:
        return crc1
    odd = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit behind
    square = lambda m: [times(m, row) for row in m]
    shift = square(square(square(odd)))  # one zero byte behind
    while length:
        if length & 1:
            crc1 = times(shift, crc1)
        length >>= 1
        shift = square(shift)
    return crc1 ^ crc2


def _deflated():
    """A UDF of bytes and whether they end their member: raw deflate, CRC-32."""

    def run(data, last):
        import pandas as pd

        out = []
        for x, end in zip(data, last, strict=True):
            z = zlib.compressobj(6, zlib.DEFLATED, -15)
            out.append((z.compress(x) + z.flush(zlib.Z_FINISH if end else zlib.Z_SYNC_FLUSH), zlib.crc32(x)))
        return pd.DataFrame(out, columns=["data", "crc"])

    return F.pandas_udf(run, "data binary, crc long")


def _checksum(blocks) -> int:
    crc = 0
    for _, own, size in sorted((tuple(b) if not isinstance(b, dict) else (b["block"], b["crc"], b["plain"])) for b in blocks):
        crc = combined(crc, int(own), int(size))
    return crc


def member(name: str, crc: int, packed: int, plain: int, at: int | None = None, size: int = SIZE) -> bytes:
    """The header before a member's data, or with its place at its entry in the directory."""
    title = name.encode()
    big = [n for n in (plain, packed, *([] if at is None else [at])) if n >= size]
    extra = struct.pack(f"<HH{len(big)}Q", 1, 8 * len(big), *big) if big else b""
    if big and at is None:
        extra = struct.pack("<HHQQ", 1, 16, plain, packed)
    short = lambda n: 0xFFFFFFFF if n >= size or (big and at is None) else n
    common = struct.pack("<HHHHHIIIHH", 45 if big else 20, 0x800, 8, 0, 0x21, crc, short(packed), short(plain), len(title), len(extra))
    if at is None:
        return b"PK\x03\x04" + common + title + extra
    return b"PK\x01\x02" + struct.pack("<H", 45) + common + struct.pack("<HHHII", 0, 0, 0, 0o600 << 16, short(at)) + title + extra


def ending(members: int, length: int, at: int, most: int = MOST, size: int = SIZE) -> bytes:
    """What stands behind the directory."""
    out = b""
    if members >= most or length >= size or at >= size:
        out = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, members, members, length, at) + b"PK\x06\x07" + struct.pack("<IQI", 0, at + length, 1)
    cut = lambda n, m: (0xFFFF if m == most else 0xFFFFFFFF) if n >= m else n
    return out + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, cut(members, most), cut(members, most), cut(length, size), cut(at, size), 0)


def zip_blocks(numbered: DataFrame, block: int = BLOCK, most: int = MOST, size: int = SIZE) -> DataFrame:
    """(book, block, data) of paged(): each book's package in blocks, with <book>.txt and pages/<filename>."""
    zero = F.lit(0).cast("long")
    whole = merged_blocks(numbered).select("book", zero.alias("member"), F.concat("book", F.lit(".txt")).alias("name"), "block", F.encode("text", "UTF-8").alias("plain"))
    last = numbered.groupBy("book").agg(F.max("block").alias("last"))
    whole = whole.join(last, "book").withColumn("last", F.col("block") == F.col("last"))
    each = numbered.select("book", F.col("page_num").alias("member"), F.concat(F.lit("pages/"), "filename").alias("name"), zero.alias("block"), F.encode("text", "UTF-8").alias("plain"), F.lit(True).alias("last"))
    packed = whole.unionByName(each).withColumn("z", _deflated()("plain", "last"))
    packed = staged(packed.select("book", "member", "name", "block", F.length("plain").cast("long").alias("plain"), "z.data", "z.crc"), "packed")

    sums = packed.groupBy("book", "member", "name").agg(F.sum(F.length("data")).alias("packed"), F.sum("plain").alias("plain"), F.collect_list(F.struct("block", "crc", "plain")).alias("blocks"))
    crc = F.pandas_udf(lambda s: s.map(_checksum), "long")
    head = F.pandas_udf(lambda n, c, p, u: _mapped(lambda *x: member(*x, size=size), n, c, p, u), "binary")
    sums = sums.withColumn("crc", crc("blocks")).drop("blocks")
    sums = sums.withColumn("head", head("name", "crc", "packed", "plain")).withColumn("size", F.length("head") + F.col("packed"))
    sums = running(sums, "book", "member", upto="size").withColumn("at", F.col("upto") - F.col("size"))
    entry = F.pandas_udf(lambda n, c, p, u, a: _mapped(lambda *x: member(*x, size=size), n, c, p, u, a), "binary")
    sums = staged(sums.withColumn("entry", entry("name", "crc", "packed", "plain", "at")).select("book", "member", "head", "entry", "upto"), "members")
    end = F.pandas_udf(lambda n, x, a: _mapped(lambda *v: ending(*v, most=most, size=size), n, x, a), "binary")
    ends = sums.groupBy("book").agg(F.count("*").alias("n"), F.sum(F.length("entry")).alias("length"), F.max("upto").alias("at"))

    place = lambda part, member, block: F.struct(F.lit(part).alias("part"), member.alias("member"), block.alias("block")).alias("place")
    pieces = sums.select("book", place(0, F.col("member"), F.lit(-1).cast("long")), F.col("head").alias("data"))
    pieces = pieces.union(packed.select("book", place(0, F.col("member"), F.col("block")), "data"))
    pieces = pieces.union(sums.select("book", place(1, F.col("member"), zero), "entry"))
    pieces = pieces.union(ends.select("book", place(2, zero, zero), end("n", "length", "at")))
    dealt = running(pieces.withColumn("size", F.length("data").cast("long")), "book", "place", upto="size")
    dealt = dealt.select("book", F.floor((F.col("upto") - F.col("size")) / block).alias("block"), "place", "data")

    def join(key, rows):
        import pandas as pd

        order = sorted(range(len(rows)), key=lambda i: tuple(rows["place"].iloc[i].values()))
        return pd.DataFrame({"book": [key[0]], "block": [key[1]], "data": [b"".join(rows["data"].iloc[i] for i in order)]})

    return dealt.groupBy("book", "block").applyInPandas(join, f"book {dict(numbered.dtypes)['book']}, block long, data binary")


def _mapped(f, *columns):
    import pandas as pd

    return pd.Series([f(*(x if isinstance(x, str) else int(x) for x in row)) for row in zip(*columns, strict=True)], dtype=object)
