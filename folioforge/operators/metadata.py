"""Document metadata by ordered rules. Only what a text or file name says is taken; anything missing is ''."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_lines, first_lines, first_nonempty, let, rstrip, stem, strip

# Document types in order, with patterns over capitals.
TYPES = [
    ("HLD", [r"\bHLD\b", r"\bHIGH-LEVEL DESIGN\b", r"\bTHIẾT KẾ TỔNG THỂ\b"]),
    ("LLD", [r"\bLLD\b", r"\bLOW-LEVEL DESIGN\b", r"\bTHIẾT KẾ CHI TIẾT\b"]),
    ("PRO", [r"\bPRO\b", r"\bPROCEDURE\b", r"\bQUY TRÌNH\b", r"\bQUY TRINH\b"]),
    ("QĐ", [r"\bQĐ\b", r"\bQUYẾT ĐỊNH\b", r"\bQUYET DINH\b", r"\bQD\b"]),
    ("QC", [r"\bQUY CHẾ\b", r"\bQUY CHE\b", r"\bQUY CHUẨN\b", r"\bQUY CHUAN\b"]),
    ("TT", [r"\bTHÔNG TƯ\b", r"\bTHONG TU\b", r"\bTT\b"]),
    ("BC", [r"\bBÁO CÁO\b", r"\bBAO CAO\b", r"\bREPORT\b"]),
    ("PL", [r"\bPHỤ LỤC\b", r"\bPHU LUC\b", r"\bAPPENDIX\b"]),
    ("HD", [r"\bHƯỚNG DẪN\b", r"\bHUONG DAN\b"]),
    ("TB", [r"\bTHÔNG BÁO\b", r"\bTHONG BAO\b"]),
    ("CV", [r"\bCV\b", r"\bCÔNG VĂN\b", r"\bCONG VAN\b"]),
    ("QD", [r"\bQUY ĐỊNH VỀ\b", r"\bQUY DINH VE\b", r"^\s*QUY ĐỊNH\b", r"^\s*QUY DINH\b"]),
    ("UM", [r"\bUM\b", r"\bUSER MANUAL\b", r"\bHƯỚNG DẪN SỬ DỤNG\b", r"\bHUONG DAN SU DUNG\b"]),
]
DISPATCH = r"\b(?:Kính gửi|Kinh gui|V/v|Về việc|Ve viec)\b"

# Units by the suffix of the document number, in order.
UNITS = [
    ("-CNM", "Ban Công nghệ - Mạng"), ("-KHĐT", "Ban Kế hoạch - Đầu tư"), ("-KHDT", "Ban Kế hoạch - Đầu tư"), ("-TCKT", "Ban Tài chính - Kế toán"),
    ("-TCCB", "Ban Tổ chức cán bộ"), ("-CLG", "Ban Chất lượng"), ("-CL", "Ban Chất lượng"), ("-VT", "Ban Viễn thông"), ("-CN", "Ban Công nghệ"),
    ("-IT", "Ban Công nghệ thông tin"), ("-NET", "Tổng công ty VNPT-Net"), ("-VINAPHONE", "Tổng công ty VNPT-VinaPhone"),
]

# Status by the first of these words in capitals.
STATUSES = [("DỰ THẢO", "Dự thảo"), ("DRAFT", "Dự thảo"), ("BAN HÀNH", "Đã ban hành"), ("PHÊ DUYỆT", "Đã phê duyệt"), ("BÃI BỎ", "Hết hiệu lực"), ("HẾT HIỆU LỰC", "Hết hiệu lực")]

# Openings of the parts of a letter, kinds of numbered documents, patterns of numbers, versions and dates.
HEADER_ENDS = r"(?iuU)\b(?:Căn cứ|Can cir|Can dr|Kính gửi|Kinh gui)\b"
GROUNDS = r"(?iuU)^\s*(?:Căn cứ|Can cir|Can dr)\b"
KINDS = "VNPT|QĐ|QD|TT|TB|BC|HD|NQ|CT|KH|BB|VB|CV"
NUMBER_IN_NAME = rf"(?iuU)\b(\d+[\-_/](?:{KINDS})[\-_/][A-Za-z0-9\-_/Đđ]+)\b"
NUMBER_IN_HEADER = r"(?iuU)(?:Số|Số hiệu|No\.?|:)\s*([0-9]+\s*[/-]\s*[A-Za-z0-9\-_/Đđ]+)"
NUMBER_IN_TEXT = r"(?U)(\d+/(?:VNPT|QĐ|TT|TB|BC|HD|NQ|QD|CV)-[A-Za-z0-9\-_/Đđ]+)"
VERSION_IN_NAME = r"(?U)[_\-vV](\d+[._]\d+(?:[._]\d+)?)"
VERSION_IN_TEXT = r"(?iuU)(?:Phiên bản|Version|Ver\.?)\s*[:\-]?\s*(\d+(?:\.\d+)+)"
DAY_IN_HEADER = r"(?iuU)(?:ngày|ngay[.\s]*)\s*(\d{1,2})\s*tháng\s*(\d{1,2})\s*năm\s*(\d{4})"
DAY_IN_TEXT = r"(?iuU)(?:ngày|Hà Nội, ngày)\s*(\d{1,2})\s*tháng\s*(\d{1,2})\s*năm\s*(\d{4})"
ISO_IN_NAME = r"(?U)\b(20\d{2})[-_.](\d{1,2})[-_.](\d{1,2})\b"
DMY_IN_NAME = r"(?U)\b(\d{1,2})[-_.](\d{1,2})[-_.](20\d{2})\b"
ISSUED = r"(?iuU)(?:Ngày ban hành|Ban hành ngày|Ngày|Date|Issued Date)\s*[:\-]?\s*(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4})"
FROM_SIGNING = r"(?iuU)(?:hiệu lực|hieu luc)\s+(?:thi hành\s+|thi hanh\s+)?(?:kể từ|ke tu)\s+(?:ngày ký|ngay ky)"
EFFECTIVE = r"(?iuU)(?:Hiệu lực từ ngày|Có hiệu lực từ ngày|Ngày hiệu lực|Effective Date)\s*[:\-]?\s*(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4})"
SUBJECT = r"(?iuU)^\s*(?:V/v|Về việc|Ve viec)"
SUBJECT_ENDS = r"(?iuU)^\s*(?:Kính gửi|Kinh gui|TỔNG|TONG|GIÁM|GIAM|CĂN|CAN|Điều|Dieu)\b"
TITLE_IN_CAPITALS = r"(?U)\b((?:QUY ĐỊNH|QUY CHẾ|QUY TRÌNH|BỘ CHỈ TIÊU|HƯỚNG DẪN|THÔNG TƯ)[^\n\r]{10,})"
PROPOSED = r"(?iuU)Theo đề nghị của (?:các )?(?:Ông|Bà)?\s*(?:Trưởng Ban\s*)?([^\n\r,;.]+)"


def _has(text: Column, *words: str) -> Column:
    """Whether any of the words is in the text: a cheap test that spares regular expressions most texts."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _folded(text: Column) -> Column:
    """Text in which words of any case are found as small letters."""
    return F.lower(F.upper(text))


def _extract(test: Column, text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(test, F.regexp_extract(text, pattern, group)).otherwise("")


def document_id(filename: Column) -> Column:
    s = F.regexp_replace(stem(filename), r"(?U)^\d+[.\-_]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w\-_]+", "-"), "[-_]+", "-")
    return first_nonempty(F.upper(F.regexp_replace(s, "^-+|-+$", "")), F.lit("DOC"))


def _type(caps: Column) -> Column:
    def fits(pattern: str) -> Column:
        # Its letters are looked for first, then where they are: a test of word ends at every character is dear.
        word = pattern.removeprefix(r"^\s*").replace(r"\b", "")
        return caps.contains(word) & caps.rlike("(?U)" + (pattern if pattern.startswith("^") else f"(?={word}){pattern}"))

    cases = [(reduce(lambda a, b: a | b, map(fits, patterns)), name) for name, patterns in TYPES]
    return reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0]))


def capitals(text: Column) -> Column:
    """The first 3000 characters in capitals."""
    return F.upper(F.left(text, F.lit(3000)))


def document_type(filename: Column, text: Column, caps: Column | None = None) -> Column:
    """``caps``: :func:`capitals` of the text, which callers of several rules work out once."""

    def of(head: Column) -> Column:
        dispatched = let(_folded(head), lambda low: _has(low, "kính gửi", "kinh gui", "v/v", "về việc", "ve viec"))
        return F.coalesce(let(F.upper(filename), _type), _type(head), F.when(dispatched & head.rlike("(?iuU)" + DISPATCH), "CV"), F.lit(""))

    return let(capitals(text), of) if caps is None else of(caps)


def header(text: Column) -> Column:
    """The first 1500 characters, up to the grounds or the addressee."""
    head = F.left(text, F.lit(1500))
    return F.when(_has(_folded(head), "căn cứ", "can cir", "can dr", "kính gửi", "kinh gui"), F.get(F.split(head, HEADER_ENDS, 2), F.lit(0))).otherwise(head)


def _standard(number: Column) -> Column:
    return F.replace(number, F.lit("QD"), F.lit("QĐ"))


def document_number(text: Column, filename: Column, head: Column | None = None) -> Column:
    named = _standard(F.regexp_replace(F.regexp_extract(filename, NUMBER_IN_NAME, 1), r"(?U)^(\d+)[-_]([A-Za-zĐđ]+)", "$1/$2"))
    head = header(text) if head is None else head
    found = F.when(head.rlike(r"(?U)[0-9]\s*[/-]"), F.regexp_replace(F.regexp_extract(head, NUMBER_IN_HEADER, 1), r"(?U)\s+", "")).otherwise("")
    found = F.regexp_replace(found, rf"(?iuU)^(\d+)[-_]({KINDS})", "$1/$2")
    found = F.when(F.length(found) >= 4, _standard(found)).otherwise("")
    listed = text.contains("/") & _has(text, *[f"/{k}-" for k in ("VNPT", "QĐ", "TT", "TB", "BC", "HD", "NQ", "QD", "CV")])
    rest = F.array_join(F.slice(F.filter(all_lines(text), lambda x: ~x.rlike(GROUNDS)), 1, 60), "\n")
    return first_nonempty(named, found, F.when(listed, _standard(F.regexp_extract(rest, NUMBER_IN_TEXT, 1))))


def version(filename: Column, text: Column, low: Column | None = None) -> Column:
    return first_nonempty(F.translate(F.regexp_extract(filename, VERSION_IN_NAME, 1), "_", "."), _extract(_has(_low(text, low), "phiên bản", "ver"), text, VERSION_IN_TEXT))


def _low(text: Column, low: Column | None) -> Column:
    """The folded text, which callers of several rules work out once."""
    return _folded(text) if low is None else low


def _iso(text: Column, pattern: str, y: int, m: int, d: int) -> Column:
    """The date as year, month and day, '' without a match. The text is searched once, its parts are found in the match."""

    def parts(found: Column) -> Column:
        part = lambda i: F.regexp_extract(found, pattern, i)
        return F.when(found == "", "").otherwise(F.concat(part(y), F.lit("-"), F.lpad(part(m), 2, "0"), F.lit("-"), F.lpad(part(d), 2, "0")))

    return let(F.regexp_extract(text, pattern, 0), parts)


def issued_date(text: Column, filename: Column, low: Column | None = None, head: Column | None = None) -> Column:
    low = _low(text, low)
    dated = _has(low, "tháng")
    head = F.when(dated, _iso(header(text) if head is None else head, DAY_IN_HEADER, 3, 2, 1)).otherwise("")
    name = first_nonempty(_iso(filename, ISO_IN_NAME, 1, 2, 3), _iso(filename, DMY_IN_NAME, 3, 2, 1))
    # A file name that agrees in year and month has the better day.
    agreed = lambda n, h: F.when((n != "") & ((h == "") | (F.left(h, F.lit(7)) == F.left(n, F.lit(7)))), n).otherwise(h)
    sure = let(name, lambda n: let(head, lambda h: agreed(n, h)))
    return first_nonempty(sure, F.when(dated, _iso(text, DAY_IN_TEXT, 3, 2, 1)), F.translate(_extract(_has(low, "ngày", "date"), text, ISSUED), "-.", "//"))


def effective_date(text: Column, issued: Column, low: Column | None = None) -> Column:
    low = _low(text, low)
    named = _extract(_has(low, "hiệu lực từ ngày", "ngày hiệu lực", "effective date"), text, EFFECTIVE)
    return F.when(_has(low, "hiệu lực", "hieu luc") & _has(low, "ngày ký", "ngay ky") & text.rlike(FROM_SIGNING), issued).otherwise(F.translate(named, "-.", "//"))


def status(text: Column, caps: Column | None = None) -> Column:
    head = capitals(text) if caps is None else caps
    return reduce(lambda c, x: c.when(head.contains(x[0]), x[1]), STATUSES[1:], F.when(head.contains(STATUSES[0][0]), STATUSES[0][1])).otherwise("")


def unit(text: Column, number: Column, low: Column | None = None) -> Column:
    said = _extract(_has(_low(text, low), "theo đề nghị"), F.left(text, F.lit(3000)), PROPOSED)
    named = strip(said)
    named = F.when(named.contains("Ban ") | named.startswith("Tổng"), named).otherwise(F.concat(F.lit("Ban "), named))
    listed = let(F.upper(number), lambda n: reduce(lambda c, x: c.when(n.contains(x[0]), x[1]), UNITS[1:], F.when(n.contains(UNITS[0][0]), UNITS[0][1])).otherwise(""))
    return F.when(said != "", named).otherwise(listed)


def scope(text: Column, number: Column) -> Column:
    return F.when(number.contains("VNPT") | text.contains("TẬP ĐOÀN"), "Toàn Tập đoàn VNPT").otherwise("")


def subject(text: Column) -> Column:
    """The subject line and its continuation lines."""
    empty = F.array().cast("array<string>")

    def add(acc: Column, line: Column) -> Column:
        opens = line.rlike(SUBJECT + r"\b")
        own = F.regexp_replace(line, SUBJECT + r"\s*[:\-]?\s*", "")
        ends = acc["on"] & ~opens & (line.rlike(SUBJECT_ENDS) | (strip(line) == ""))
        more = F.when(opens & (own != ""), F.array(own)).when(acc["on"] & ~opens & ~ends, F.array(strip(line))).otherwise(empty)
        live = ~acc["over"]
        return F.struct((acc["on"] | opens).alias("on"), (acc["over"] | ends).alias("over"), F.when(live, F.concat(acc["parts"], more)).otherwise(acc["parts"]).alias("parts"))

    first = F.struct(F.lit(False).alias("on"), F.lit(False).alias("over"), empty.alias("parts"))
    joined = F.aggregate(all_lines(F.left(text, F.lit(2500))), first, add, lambda acc: F.array_join(acc["parts"], " "))
    said = let(_folded(F.left(text, F.lit(2500))), lambda low: _has(low, "v/v", "về việc", "ve viec"))

    def cut(whole: Column) -> Column:
        quoted = strip(F.regexp_extract(whole, "[“\"']([^”\"']{10,})[”\"']", 1))
        bare = F.regexp_replace(whole, "(?U)^[“\"'\\s]+|[”\"'\\s]+$", "")
        bare = F.regexp_replace(F.regexp_replace(bare, "(?iuU)^(?:Ban hành|Ban hanh)\\s*[“\"'\\s]*", ""), "(?U)[”\"'\\s]+$", "")
        return F.when(quoted != "", quoted).when(F.length(bare) > 5, bare).otherwise("")

    return F.when(said, let(rstrip(strip(joined), "."), cut)).otherwise("")


def title(filename: Column, text: Column, own_title: Column | None = None, first_heading: Column | None = None) -> Column:
    """The file's own title, its first heading, the subject, a title in capitals, the first Markdown heading, or the file name."""
    own = strip(F.coalesce(own_title, F.lit(""))) if own_title is not None else F.lit("")
    head = strip(F.coalesce(first_heading, F.lit(""))) if first_heading is not None else F.lit("")
    shouted = let(F.left(text, F.lit(2500)), lambda x: strip(_extract(_has(x, "QUY ĐỊNH", "QUY CHẾ", "QUY TRÌNH", "BỘ CHỈ TIÊU", "HƯỚNG DẪN", "THÔNG TƯ"), x, TITLE_IN_CAPITALS)))
    marked = F.when(text.contains("# "), F.filter(F.transform(first_lines(text, 20), strip), lambda x: x.startswith("# ") | x.startswith("## ")))
    marked = F.filter(F.transform(marked, lambda x: strip(F.regexp_replace(x, "^[# ]+", ""))), lambda x: (F.length(x) > 5) & (x != "QUYẾT ĐỊNH"))
    name = F.regexp_replace(stem(filename), r"(?U)^\d{4}[-_.]\d{1,2}[-_.]\d{1,2}\s*", "")
    name = F.regexp_replace(name, rf"(?iuU)^\d+[-/](?:{KINDS})[-_/][A-Za-z0-9\-_/Đđ]+\s*", "")
    name = strip(F.regexp_replace(F.regexp_replace(name, r"(?U)^[_\-\s]+|[_\-\s]+$", ""), "[-_]+", " "))
    return first_nonempty(
        F.when(F.length(own) > 3, own), head, subject(text), let(shouted, lambda x: F.when(F.length(x) > 10, x)), F.coalesce(F.get(marked, F.lit(0)), F.lit("")),
        let(name, lambda x: F.when(F.length(x) > 3, x)), F.translate(stem(filename), "_-", "  "),
    )


def retention(markdown_chars: Column, source_chars: Column) -> Column:
    ratio = F.round(markdown_chars / source_chars, 3)
    return F.when(source_chars > 0, ratio).when(markdown_chars > 0, 1.0).otherwise(0.0)


#: Front matter keys in order; the last four are numbers.
KEYS = [
    "document_id", "source_file", "title", "document_type", "organization", "unit", "version", "document_status", "document_number", "issued_date", "effective_date", "supersedes",
    "superseded_by", "scope", "language", "conversion_date", "converter_version", "source_sha256", "page_count", "source_text_char_count", "markdown_text_char_count", "text_retention_ratio",
]


def with_metadata(df: DataFrame, filename: str, markdown: str, source: str, sha256: str, pages: str | Column, conversion_date: str, prefix: str = "__m_", organization: str = "VNPT", language: str = "vi", converter_version: str = "1.0.0", own_title: Column | None = None, first_heading: Column | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with a column for each metadata key, and these columns by key.

    Columns, not fields of a struct: the optimizer puts the making of a struct in
    the place of every field that is read from it, and long rules would run again
    and again. What several rules need is a column of its own for the same reason.
    """
    c, name = F.col, F.col(filename)
    d = df.withColumn("__pages", pages if isinstance(pages, Column) else c(pages)).withColumn("__text", first_nonempty(c(source), c(markdown)))
    d = d.withColumns({"__low": _folded(c("__text")), "__head": header(c("__text")), "__caps": capitals(c("__text"))})
    d = d.withColumns({"__number": document_number(c("__text"), name, c("__head")), "__issued": issued_date(c("__text"), name, c("__low"), c("__head")), "__md": F.length(markdown), "__src": F.length(source)})
    d = d.withColumn("__src", F.when(c("__src") > 0, c("__src")).otherwise(c("__md")))
    values = {
        "document_id": document_id(name), "source_file": name, "title": title(name, c(markdown), own_title, first_heading), "document_type": document_type(name, c("__text"), c("__caps")),
        "organization": F.lit(organization), "unit": unit(c("__text"), c("__number"), c("__low")), "version": version(name, c("__text"), c("__low")), "document_status": status(c("__text"), c("__caps")), "document_number": c("__number"),
        "issued_date": c("__issued"), "effective_date": effective_date(c("__text"), c("__issued"), c("__low")), "supersedes": F.lit(""), "superseded_by": F.lit(""), "scope": scope(c("__text"), c("__number")),
        "language": F.lit(language), "conversion_date": F.lit(conversion_date), "converter_version": F.lit(converter_version), "source_sha256": c(sha256),
        "page_count": F.greatest(F.lit(1), c("__pages")).cast("int"), "source_text_char_count": c("__src"), "markdown_text_char_count": c("__md"), "text_retention_ratio": retention(c("__md"), c("__src")),
    }
    d = d.withColumns({prefix + k: v for k, v in values.items()}).drop("__pages", "__text", "__low", "__head", "__caps", "__number", "__issued", "__md", "__src")
    return d, {k: F.col(prefix + k) for k in KEYS}


def as_struct(meta: dict[str, Column]) -> Column:
    return F.struct(*[meta[k].alias(k) for k in KEYS])


def front_matter(meta: Column | dict[str, Column], escape: bool = False) -> Column:
    """The metadata as YAML between rules. Strings are quoted; ``escape`` also escapes backslashes and quotes in them."""

    def line(key: str) -> Column:
        if key in KEYS[-4:]:
            return F.concat(F.lit(f"{key}: "), meta[key].cast("string"))
        value = meta[key]
        if escape:
            value = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit(f'{key}: "'), value, F.lit('"'))

    return F.array_join(F.array(F.lit("---"), *[line(k) for k in KEYS], F.lit("---"), F.lit("")), "\n")
