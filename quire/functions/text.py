"""Scalar functions as native column expressions, and exact Unicode variants as Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def natural_key(name) -> Column:
    """Orderable key: digit runs compare as numbers, other runs as lower-cased text."""
    runs = F.regexp_extract_all(F.lower(_c(name)), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.transform(runs, lambda t: F.struct((~t.rlike("^[0-9]")).alias("text"), F.when(t.rlike("^[0-9]"), F.length(F.ltrim(t, F.lit("0")))).alias("size"), F.when(t.rlike("^[0-9]"), F.ltrim(t, F.lit("0"))).otherwise(t).alias("run")))


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Precomposed letters up to U+1EFF and their bases, from the Unicode database."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in range(0xC0, 0x1F00) if unicodedata.decomposition(chr(i)) and not unicodedata.decomposition(chr(i)).startswith("<") and unicodedata.category(chr(i))[0] == "L"]
    return "".join(a for a, _ in pairs) + "đĐ", "".join(b for _, b in pairs) + "dD"


def strip_accents(x) -> Column:
    """Letters without combining marks, đ as d."""
    return F.regexp_replace(F.translate(_c(x), *_accents()), r"\p{Mn}", "")


def slugify(title) -> Column:
    """Lower-cased ASCII-like slug; `untitled` if nothing is left."""
    s = strip_accents(F.lower(F.trim(_c(title))))
    s = F.regexp_replace(s, r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("untitled"))


def _slug(t: str | None) -> str | None:
    if t is None:
        return None
    s = unicodedata.normalize("NFKD", t.strip().lower().replace("đ", "d"))
    s = "".join(c for c in s if not unicodedata.combining(c))
    s = re.sub(r"[\s_-]+", "-", re.sub(r"[^\w\s-]", "", s)).strip("-")
    return s or "untitled"


def slugify_exact(title) -> Column:
    """slugify() with compatibility decomposition, in an Arrow UDF."""
    return F.pandas_udf(lambda s: s.map(_slug), "string")(_c(title))


#: Category keywords in order of priority, and the default.
CATEGORIES = (
    ("Nghiên cứu / Luận án", ("luận án", "tiến sĩ", "nghiên cứu", "khảo sát")),
    ("Giáo trình - Học liệu", ("giáo trình", "bài giảng", "học liệu", "đại học")),
    ("Lịch sử - Địa chí", ("lịch sử", "địa chí", "vùng đất", "dân cư", "yên mỹ")),
    ("Văn hóa - Tín ngưỡng", ("thờ", "tín ngưỡng", "chùa", "đền", "tâm linh", "chử đồng tử")),
    ("Văn học nghệ thuật", ("tiểu thuyết", "truyện", "thơ", "văn học")),
)
DEFAULT_CATEGORY = "Tài liệu tổng hợp"


def categorize(title, rules=CATEGORIES, default: str = DEFAULT_CATEGORY) -> Column:
    low, out = F.lower(_c(title)), F
    for name, words in rules:
        out = out.when(F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w)), name)
    return out.otherwise(default)


def sqlite_like(x, pattern: str) -> Column:
    """SQLite's LIKE: % and _ only, no escape, ASCII case ignored, across lines."""
    body = "".join({"%": ".*", "_": "."}.get(c, re.sub(r"([^\w\s])", r"\\\1", c)) for c in pattern)
    return _c(x).rlike(rf"(?s)(?i)\A{body}\z")


def quoted(term: str) -> str:
    """A Java pattern that matches term literally."""
    return r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def search_count(text, term: str) -> Column:
    return F.regexp_count(_c(text), F.lit("(?iu)" + quoted(term)))


def highlight(text, term: str) -> Column:
    return F.regexp_replace(_c(text), "(?iu)" + quoted(term), "<mark>$0</mark>")


def escape_html(x) -> Column:
    out = _c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fill_template(template, values: dict[str, Column]) -> Column:
    out = _c(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(v, F.lit("")))
    return out


def format_bytes(n, largest: str = "TB") -> Column:
    """1024 steps with one decimal, halves to the even digit, up to the largest unit."""
    units = ("B", "KB", "MB", "GB", "TB")
    last = units.index(largest)
    v, out = _c(n).cast("double"), F
    shown = lambda x, unit: F.concat(F.format_string("%.1f", F.bround(x, 1)), F.lit(f" {unit}"))
    for i, unit in enumerate(units[:last]):
        out = out.when(F.abs(v / 1024.0**i) < 1024, shown(v / 1024.0**i, unit))
    return out.otherwise(shown(v / 1024.0**last, largest)) if last else shown(v, largest)


def drive_id(url) -> Column:
    """The id in a shared link: a folder's, an id parameter's, or a file's; else null."""
    get = lambda p: F.nullif(F.regexp_extract(_c(url), p + "([a-zA-Z0-9_-]+)", 1), F.lit(""))
    return F.coalesce(get("folders/"), get("id="), get("file/d/"))


def sanitize_name(name, default: str = "Untitled_Book") -> Column:
    """A book name without export time stamp and the characters that paths don't take."""
    s = F.regexp_replace(_c(name), r"-\d{8}T\d{6}Z.*$", "")
    return F.coalesce(F.nullif(F.trim(F.translate(s, '<>:"/\\|?*', "")), F.lit("")), F.lit(default))


def summary(text) -> Column:
    """First five lines with text that don't start a page marker, in 300 characters."""
    lines = F.filter(F.split(_c(text), r"\r\n|\r|\n"), lambda x: (F.trim(x) != "") & ~x.startswith("==="))
    joined = F.array_join(F.slice(F.transform(lines, lambda x: F.trim(x)), 1, 5), " ")
    return F.when(F.size(lines) > 0, F.concat(F.left(joined, F.lit(300)), F.lit("..."))).otherwise("")


def word_count(text) -> Column:
    return F.regexp_count(_c(text), F.lit(r"(?U)\S+")).cast("long")


def text_lines(text) -> Column:
    """Trimmed lines with text."""
    return F.filter(F.transform(F.split(_c(text), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")


def capitalize(x) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(_c(x), 1, 1)), F.lower(F.substring(_c(x), 2, 1 << 30)))


def is_upper(x) -> Column:
    return (F.upper(_c(x)) == _c(x)) & (F.lower(_c(x)) != _c(x))


def suffix(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.[^./\\]+$", 0))


def base_name(path) -> Column:
    return F.regexp_extract(_c(path), r"[^/\\]*$", 0)


def stem(path) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def parent(path) -> Column:
    """The path without its last part; '.' for a bare name."""
    return F.coalesce(F.nullif(F.regexp_replace(_c(path), r"[/\\]?[^/\\]*$", ""), F.lit("")), F.lit("."))


def with_suffix(path, new: str) -> Column:
    """The path with another ending; a name without one gets it."""
    return F.concat(F.regexp_replace(_c(path), r"(?<=[^/\\])\.[^./\\]*$", ""), F.lit(new))


def book_of(path) -> Column:
    """The folder before the first slash, else before the first backslash, else [root]."""
    p = _c(path)
    return F.when(p.contains("/"), F.substring_index(p, "/", 1)).when(p.contains("\\"), F.substring_index(p, "\\", 1)).otherwise("[root]")


def percent(part, whole, digits: int) -> Column:
    return F.when(_c(whole) > 0, F.round(_c(part) / _c(whole) * 100, digits)).otherwise(F.lit(0.0))


def progress_percent(current, total) -> Column:
    """Download progress of one file: at most 90, 45 while the size is unknown."""
    return F.when(F.coalesce(_c(total), F.lit(0)) > 0, F.round(F.least(F.lit(90.0), _c(current) / _c(total) * 90), 1)).otherwise(45.0)


def folder_percent(done, total) -> Column:
    """Download progress of a folder of files: 12 at first, 90 when all are done."""
    return F.round(12 + _c(done) / _c(total) * 78, 1)


def clock(ts) -> Column:
    """The time of day before a log line."""
    return F.date_format(_c(ts), "HH:mm:ss")


def day(ts) -> Column:
    """The date at the start of a time stamp's text."""
    return F.substring(_c(ts).cast("string"), 1, 10)


def thousands(n) -> Column:
    return F.format_number(_c(n), 0)


def url_encode(x) -> Column:
    """Percent encoding with %20 for a blank."""
    return F.replace(F.url_encode(_c(x)), F.lit("+"), F.lit("%20"))


def is_drive_url(url) -> Column:
    u = F.coalesce(F.trim(_c(url)), F.lit(""))
    return u.contains("drive.google.com") | u.contains("docs.google.com")


#: Endings of archives that can be uploaded, and messages of refused downloads.
ARCHIVE_SUFFIXES = (".zip", ".rar", ".7z", ".tar", ".gz")
REFUSALS = ("Cannot retrieve the public link", "Permission denied", "Failed to retrieve", "FileURLRetrievalError")
REFUSED = "Không thể tải từ Google Drive do quyền riêng tư. Vui lòng chuyển link sang chế độ: 'Bất kỳ ai có đường liên kết đều có thể xem' (Anyone with the link can view)."


def is_archive(path) -> Column:
    return suffix(path).isin(*ARCHIVE_SUFFIXES)


def download_error(message) -> Column:
    """One friendly text for refused downloads, else the message behind a prefix."""
    m = _c(message)
    refused = F.lit(False)
    for r in REFUSALS:
        refused = refused | m.contains(r)
    return F.when(refused, REFUSED).otherwise(F.concat(F.lit("Lỗi tải từ Google Drive: "), m))


def ordered_distinct(items) -> Column:
    """An array without repeats, empty strings and nulls, in order of first appearance."""
    return F.array_distinct(F.filter(_c(items), lambda x: x.isNotNull() & (x != "")))


def highlights(column) -> Column:
    """The entries of a JSON array of strings; none for null or text that isn't one."""
    return F.coalesce(F.from_json(_c(column), "array<string>"), F.array().cast("array<string>"))


def error_class(message) -> Column:
    """quota, overload, missing or other, from a service's message."""
    m = _c(message)
    return F.when(m.contains("429") | m.contains("ResourceExhausted") | F.lower(m).contains("quota"), "quota").when(m.contains("503") | m.contains("UNAVAILABLE") | F.lower(m).contains("high demand"), "overload").when(m.contains("404") | F.lower(m).contains("not found"), "missing").otherwise("other")


def retry_delay(message, attempt) -> Column:
    """Seconds to wait: the service's hint and 3, or by class and attempt."""
    m, n = _c(message), _c(attempt)
    hint = F.coalesce(F.nullif(F.regexp_extract(m, r"(?i)retry in ([0-9.]+)s", 1), F.lit("")), F.nullif(F.regexp_extract(m, r"""retryDelay['":\s]+([0-9.]+)s""", 1), F.lit("")))
    kind = error_class(m)
    return F.when(kind == "quota", F.coalesce(hint.cast("double") + 3, F.greatest(F.lit(20.0), F.pow(F.lit(2.0), n) * 5))).when(kind == "overload", 10 + n * 5.0).otherwise(2.0)


def citations(title, slug, publisher: str, year: int, url: str) -> Column:
    """APA, BibTeX and national references."""
    t, s = _c(title), _c(slug)
    link = F.concat(F.lit(url), s)
    return F.struct(
        F.concat(t, F.lit(f". ({year}). {publisher}. "), link).alias("apa"),
        F.concat(F.lit("@book{"), s, F.lit(",\n  title = {"), t, F.lit(f"}},\n  year = {{{year}}},\n  publisher = {{{publisher}}},\n  url = {{"), link, F.lit("}\n}")).alias("bibtex"),
        F.concat(t, F.lit(f". {publisher}, {year}.")).alias("national"),
    )
