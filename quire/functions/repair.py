"""Repair of recognised Vietnamese text: ordered substitutions and diacritics from a dictionary."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOW = "a-zàáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
_UP = "A-ZÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴĐ"
#: Fixed values: (pattern, replacement), in the order in which they apply.
SUBSTITUTIONS = (
    (rf"\bI([{_LOW}])", "l$1"),
    (r"\bNCUYỄN\b", "NGUYỄN"),
    (r"\bNCUYEN\b", "NGUYEN"),
    (r"\bNCUVỄN\b", "NGUYỄN"),
    (r"\bNCUNỂN\b", "NGUYỄN"),
    (r"\bĐẩng chí\b", "Đồng chí"),
    (r"\bĐổng chí\b", "Đồng chí"),
    (r"\bĐổng chỉ\b", "Đồng chí"),
    (r"\bđổng chí\b", "đồng chí"),
    (rf"\bchí([{_UP}])", "chí $1"),
    (r"\bcí\b", "chí"),
    (r"\bnuoc\b", "nước"),
    (r"\bnuóc\b", "nước"),
    (r"\bngưdi\b", "người"),
    (r"\bđổng thờl\b", "đồng thời"),
    (r"\bvăn hlến\b", "văn hiến"),
    (r"\bgiao luu\b", "giao lưu"),
    (r"\bthực hành đặc trung\b", "thực hành đặc trưng"),
    (r"\bhuyện ủỵ\b", "Huyện ủy"),
    (r"\bHuyện ủỵ\b", "Huyện ủy"),
    (r"\bHuyệnửỵ\b", "Huyện ủy"),
    (r"\bHuyệnửy\b", "Huyện ủy"),
    (r"\bHuyệnủy\b", "Huyện ủy"),
    (r"\bHuyện úỵ\b", "Huyện ủy"),
    (r"\bBan Thường vu\b", "Ban Thường vụ"),
    (r"\bChlhuy\b", "Chỉ huy"),
    (r"\bGuânshuyện\b", "Quân sự huyện"),
    (r"\bChủ tjch\b", "Chủ tịch"),
    (r"\bthành vỈên\b", "thành viên"),
    (r"\bIruông ban\b", "Trưởng ban"),
    (r"\bTruởng\b", "Trưởng"),
    (r"\bIão thành\b", "lão thành"),
    (r"\btiển khởi nghĩa\b", "tiền khởi nghĩa"),
    (r"(\d+)\.00O\b", "$1.000"),
    (r"(\d+)\.0O0\b", "$1.000"),
    (r"(?<=\d)O\b", "0"),
)


def repair(text: Column) -> Column:
    """All substitutions, one after the other."""
    for pattern, to in SUBSTITUTIONS:
        text = F.regexp_replace(text, f"(?U){pattern}", to)
    return text


def bare(s: str) -> str:
    """NFC text without marks, đ as d."""
    s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", s.replace("đ", "d").replace("Đ", "D"))


def word_map(words: list[str]) -> dict[str, str]:
    """Bare lower-case word to its first accented form in the list."""
    out: dict[str, str] = {}
    for w in words:
        if w := w.strip():
            out.setdefault(bare(w.lower()), w.lower())
    return out


def restore(text: str | None, known: dict[str, str], only_bare: bool) -> str | None:
    """Tokens with their dictionary form, in the token's case; white space stays."""
    if text is None:
        return None
    out = []
    for token in re.split(r"(\s+)", text):
        low = token.lower()
        found = known.get(bare(low)) if token and not token.isspace() and (not only_bare or bare(low) == low) else None
        if found is None:
            out.append(token)
        elif token.isupper():
            out.append(found.upper())
        else:
            out.append(found.capitalize() if token[:1].isupper() else found)
    return "".join(out)


def restore_diacritics(df: DataFrame, column: str, words: list[str], only_bare: bool = False) -> DataFrame:
    """df with column restored; the word list (tens of thousands of entries) goes along with the function."""
    known = word_map(words)
    return df.withColumn(column, F.pandas_udf(lambda s: s.map(lambda t: restore(t, known, only_bare)), "string")(column))


def clean_text(df: DataFrame, column: str, words: list[str] = ()) -> DataFrame:
    """Substitutions, then diacritics for tokens without any; null is ''."""
    out = df.withColumn(column, repair(F.coalesce(F.col(column), F.lit(""))))
    return restore_diacritics(out, column, list(words), only_bare=True) if words else out
