"""Operators of the conversion on golden texts and edge cases."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import cleaning, metadata, pages, quality, structure, tables

DECISION = """TẬP ĐOÀN
Số: 2123/QĐ-VNPT-CNM
Hà Nội, ngày 21 tháng 12 năm 2016

QUYẾT ĐỊNH
V/v Ban hành "Quy định về quản lý chất lượng mạng"
của Tập đoàn.

Căn cứ Luật số 68/QĐ-TTg-XX;
Theo đề nghị của Trưởng Ban Công nghệ - Mạng,
Quyết định có hiệu lực thi hành kể từ ngày ký.
"""


def one(spark, **cols):
    """Values of expressions over a row without columns."""
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def lit(x):
    return F.lit(x)


def test_text_functions(spark):
    r = one(
        spark, slug=T.slugify(lit("  Điều 1. Phạm vi_áp dụng ô-a ")), none=T.slugify(lit("!!")), strip=T.strip(lit("　 a\tb \x1c\n")), stem=T.stem(lit("a.b.docx")), dot=T.stem(lit(".docx")),
        ext=T.suffix(lit("A.DocX")), no=T.suffix(lit(".docx")), clean=T.clean_boundaries(lit("\n\na\n\n\n\n\nb\n")), mark=T.strip_watermark(lit("x a.b@c.vn_10:30 1/2/2024 y\n12:05 03/04/2025 z")),
        own=T.strip_watermark(lit("top\nroom 5 secret\nend"), ["room"]), dense=T.dense_chars(lit(" a b\n c ")), marked=T.marked_letters(lit("ÀáĐđx")), plain=T.plain_letters(lit("ÀáĐđx")),
        words=T.word_count(lit("# a *b* [c](d)\n\n|e|")), empty=T.word_count(lit(" # ")), html=T.html_escape(lit("<a & \"b'>")), lines=T.all_lines(lit("a\r\nb\x85c\n")), nothing=T.all_lines(lit("")),
    )
    assert (r.slug, r.none, r.strip) == ("dieu-1-pham-vi_ap-dung-o-a", "section", "a\tb")
    assert (r.stem, r.dot, r.ext, r.no) == ("a.b", ".docx", ".docx", "")
    assert r.clean == "a\n\n\nb" and r.mark == "x  y\n z" and r.own == "top\n\nend"
    assert (r.dense, r.marked, r.plain, r.words, r.empty) == (3, 4, 4, 5, 0)
    assert r.html == "&lt;a &amp; &quot;b&#x27;&gt;" and r.lines == ["a", "b", "c"] and r.nothing == []


def test_normalize_encoding(spark):
    raw = ["\ufeffa\x00b\r\nc\rd", unicodedata.normalize("NFD", "Tiếng Việt"), None, "plain"]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, t string")
    got = {r.i: r.t for r in T.normalize_encoding(df, "t").collect()}
    assert got == {0: "ab\nc\nd", 1: "Tiếng Việt", 2: "", 3: "plain"}


@pytest.mark.parametrize(("line", "mark"), [("quyết định số 1", "#"), ("QUY CHẾ " + "x" * 120, ""), ("Chương IV", "##"), ("PHẦN 2", "##"), ("Phụ lục: x", "##"), ("Phụ lục 3", "##"), ("Mục A. b", "###"), ("Điều 12. c", "###"), ("Điều 12", ""), ("# Điều 1. d", ""), ("> Điều 1.", ""), ("<!-- Điều 1. -->", ""), ("", ""), ("thường", "")])
def test_heading_mark(spark, line, mark):
    assert one(spark, m=structure.heading_mark(lit(line))).m == mark


def test_sections(spark):
    text = "<!-- source_page: 1 -->\n# A\n# A 2\n<!-- Page 3 -->\n## <b>A</b>\n#nope\n# A\ntext\n<!-- source_page: 5 -->"
    r = one(spark, s=structure.sections(lit(text)))
    assert [x.id for x in r.s] == ["sec-a", "sec-a-2", "sec-a-3", "sec-a-4"]
    assert [(x.heading, x.level, x.source_page_start, x.source_page_end) for x in r.s] == [("A", 1, 1, 1), ("A 2", 1, 1, 3), ("A", 2, 3, 3), ("A", 1, 3, 5)]
    made = spark.createDataFrame([(text,)], "t string").withColumn("s", structure.sections(F.col("t"))).select(structure.anchored(F.col("t"), F.col("s")).alias("a")).first().a
    assert made.split("\n")[1:5] == ['<a id="sec-a"></a>', "# A", '<a id="sec-a-2"></a>', "# A 2"] and "## A\n" in made and "<b>" not in made
    assert one(spark, s=structure.sections(lit("no heading"))).s == []
    assert one(spark, f=structure.format_structure(lit("a\nĐiều 1. x\nb"))).f == "a\n\n### Điều 1. x\n\nb"


def test_decision_metadata(spark):
    name = lit("2016-12-21 2123-QĐ-VNPT-CNM Quy định chất lượng.pdf")
    number = metadata.document_number(lit(DECISION), name)
    issued = metadata.issued_date(lit(DECISION), name)
    r = one(spark, n=number, n2=metadata.document_number(lit(DECISION), lit("")), d=issued, e=metadata.effective_date(lit(DECISION), issued), t=metadata.document_type(name, lit(DECISION)), u=metadata.unit(lit(DECISION), number), u2=metadata.unit(lit(""), number), title=metadata.title(name, lit(DECISION)), id=metadata.document_id(name), s=metadata.scope(lit(DECISION), number))
    assert r.n == r.n2 == "2123/QĐ-VNPT-CNM" and r.d == r.e == "2016-12-21" and r.t == "QĐ"
    assert r.u == r.u2 == "Ban Công nghệ - Mạng" and r.title == "Quy định về quản lý chất lượng mạng"
    assert r.id == "12-21-2123-QĐ-VNPT-CNM-QUY-ĐỊNH-CHẤT-LƯỢNG" and r.s == "Toàn Tập đoàn VNPT"


@pytest.mark.parametrize(("text", "name", "want"), [("ngày 1 tháng 2 năm 2020", "2020-02-05 x.pdf", "2020-02-05"), ("ngày 1 tháng 2 năm 2020", "2020-03-05 x.pdf", "2020-02-01"), ("", "05-03-2021.pdf", "2021-03-05"), ("Ngày ban hành: 5-6.2022", "x.pdf", "5/6/2022"), ("Ngày ban hành: 5-6-2022", "x.pdf", "5/6/2022"), ("", "x.pdf", "")])
def test_dates(spark, text, name, want):
    assert one(spark, d=metadata.issued_date(lit(text), lit(name))).d == want


@pytest.mark.parametrize(("name", "text", "want"), [("IMS_HLD.docx", "", ""), ("IMS HLD.docx", "", "HLD"), ("x.pdf", "hướng dẫn sử dụng", "HD"), ("x.pdf", "Kính gửi: ai", "CV"), ("x.pdf", "user manual", "UM"), ("x", "  quy định abc", "QD")])
def test_types(spark, name, text, want):
    assert one(spark, t=metadata.document_type(lit(name), lit(text))).t == want


def test_versions_units_status_titles(spark):
    r = one(
        spark, v=metadata.version(lit("A_v1_2.docx"), lit("")), v2=metadata.version(lit("a.docx"), lit("Phiên bản: 1.0")), u=metadata.unit(lit(""), lit("1/X-CLG")), u2=metadata.unit(lit(""), lit("1/X-CN")), u3=metadata.unit(lit("theo đề nghị của ông Giám đốc Kỹ thuật, x"), lit("")),
        s=metadata.status(lit("dự thảo ban hành")), s2=metadata.status(lit("đã phê duyệt")), s3=metadata.status(lit("x")), t=metadata.title(lit("2020-01-02 12-QĐ-AB_x so lieu.docx"), lit("")), t2=metadata.title(lit("a-b.docx"), lit("")), t3=metadata.title(lit("a.docx"), lit("x\n# Tên tài liệu")), t4=metadata.title(lit("a.docx"), lit(""), lit(" Core title "), lit("h")), t5=metadata.title(lit("a.docx"), lit("V/v: mua sắm\nthiết bị mới.\n\nkhác")),
        r=metadata.retention(lit(3), lit(4)), r0=metadata.retention(lit(3), lit(0)), r1=metadata.retention(lit(0), lit(0)),
    )
    assert (r.v, r.v2, r.u, r.u2, r.u3) == ("1.2", "1.0", "Ban Chất lượng", "Ban Công nghệ", "Ban Giám đốc Kỹ thuật")
    assert (r.s, r.s2, r.s3) == ("Dự thảo", "Đã phê duyệt", "")
    assert (r.t, r.t2, r.t3, r.t4, r.t5) == ("so lieu", "a b", "Tên tài liệu", "Core title", "mua sắm thiết bị mới")
    assert (r.r, r.r0, r.r1) == (0.75, 1.0, 0.0)


def test_cleaning(spark):
    text = "a.b@c.vn 10:00 1/2/2024 Nguyễn A\n1/6\n---\nxyz\ntm\nTM\nđường\n~|~\nok this stays"
    assert one(spark, c=cleaning.clean_artifacts(lit(text))).c == " Nguyễn A\ntm\nTM\nđường\nok this stays"
    df = spark.createDataFrame([(0, "QUYET DINH DAU TU"), (1, "abc"), (2, None), (3, "xong./. K"), (4, "Hội dong thành viên $1")], "i int, t string")
    got = {r.i: r.t for r in cleaning.correct_terms(df, "t").collect()}
    assert got == {0: "QUYẾT ĐỊNH DAU TU", 1: "abc", 2: "", 3: "xong./. K", 4: "Hội đồng thành viên $1"}
    assert len(cleaning.corrections()) == 199


@pytest.mark.parametrize(("rows", "want"), [([["a", "b|c"], ["1\n2"]], "| a | b\\|c |\n| --- | --- |\n| 1 2 |  |"), ([["", None], ["x", "y"]], "| Cột 1 | Cột 2 |\n| --- | --- |\n|  |  |\n| x | y |"), ([[]], ""), ([["h"]], "| h |\n| --- |")])
def test_tables(spark, rows, want):
    df = spark.createDataFrame([(rows,)], "r array<array<string>>")
    assert df.select(tables.markdown_table(F.col("r")).alias("t")).first().t == want


def test_ocr_truth_table(spark):
    cases = [(image, chars, letters, marked) for image in (False, True) for chars in (0, 49, 50) for letters in (20, 21) for marked in (1, 2)]
    df = spark.createDataFrame(cases, "image boolean, chars int, letters int, marked int")
    for r in df.withColumn("n", pages.recognition_rule(F.col("chars"), F.col("letters"), F.col("marked"), F.col("image"))).collect():
        corrupt = r.letters > 20 and r.marked / r.letters < 0.05
        assert r.n == (r.chars < 50 or (r.image and (corrupt or r.chars == 0)))
    r = one(spark, a=pages.needs_ocr(lit("english words that are more than fifty characters long in all"), lit(0.7), lit(False)), b=pages.needs_ocr(lit("english words that are more than fifty characters long in all"), lit(0.6), lit(None).cast("boolean")))
    assert (r.a, r.b) == (True, False)


def test_pages(spark):
    df = spark.createDataFrame([(1, 2, " b ", "b", True), (1, 1, "a", "a", False), (2, 1, None, None, False)], "doc_id int, page_number int, text string, raw string, is_ocr boolean")
    got = {r.doc_id: r for r in pages.merge_pages(df).collect()}
    assert got[1].body == "<!-- source_page: 1 -->\n\na\n\n---\n\n<!-- source_page: 2 -->\n\nb" and got[1].raw == "a\nb"
    assert (got[1].pages_total, got[1].pages_ocr, got[1].is_pure_ocr, got[2].is_pure_ocr, got[2].body) == (2, [2], True, False, "<!-- source_page: 1 -->\n\n")
    boxes = spark.createDataFrame([(1, 21.0, 5.0, 0, "c"), (1, 0.0, 9.0, 1, "b"), (1, 6.0, 1.0, 2, "a"), (1, 35.0, 0.0, 3, "d"), (1, 0.0, 0.0, 4, " ")], "k int, y double, x double, ord int, text string")
    assert pages.reading_order(boxes, "k").first().text == "a\nb\nd\nc"
    words = spark.createDataFrame([("a", 90), ("", 10), ("b", -1), ("c", 81)], "w string, c int")
    assert words.agg(pages.word_confidence(F.col("c"), F.col("w")).alias("x")).first().x in (0.85, 0.86)
    assert words.limit(0).agg(pages.word_confidence(F.col("c"), F.col("w")).alias("x")).first().x == 1.0
    assert one(spark, w=pages.low_confidence_warning(lit(3), lit(0.59)), n=pages.low_confidence_warning(lit(3), lit(0.6)), r=pages.recognised_page(lit("t"), lit("tesseract"))) == ("Trang 3: Độ tin cậy OCR (59%).", None, "> [Extracted from image via TESSERACT]\nt")


def gate(spark, body, ratio=1.0, pages_=1, paginated=False, ocr=False, title="t", sha="a" * 64, chars=100):
    meta = F.struct(lit("f.pdf").alias("source_file"), lit(title).alias("title"), lit(pages_).alias("page_count"), lit(chars).alias("markdown_text_char_count"), lit(100).alias("source_text_char_count"), lit(ratio).alias("text_retention_ratio"), lit(sha).alias("source_sha256"))
    return quality.with_gate(spark.range(1).select(lit(body).alias("b"), meta.alias("m")), "b", F.col("m"), lit(paginated), lit(ocr)).first().validation


GOOD = '---\ntitle: "t"\n---\n\n# Heading\nenough text in the body here'


@pytest.mark.parametrize(("kw", "status", "n"), [({}, "PASS", 8), ({"ratio": 0.9}, "PASS", 8), ({"ratio": 0.899}, "WARNING", 8), ({"ratio": 0.75}, "WARNING", 8), ({"ratio": 0.749}, "FAIL", 8), ({"title": " "}, "FAIL", 8), ({"pages_": 2, "paginated": True}, "WARNING", 9), ({"ocr": True, "ratio": 0.1}, "PASS", 8), ({"ocr": True, "chars": 20}, "FAIL", 8), ({"sha": ""}, "PASS", 8)])
def test_gate(spark, kw, status, n):
    v = gate(spark, GOOD, **kw)
    assert (v.status, v.is_safe_for_ai, len(v.checks)) == (status, status != "FAIL", n)


@pytest.mark.parametrize(("body", "status"), [("---\n---\n" + "x" * 20, "FAIL"), ("---\n---\n# " + "x" * 19, "PASS"), (GOOD + "\x00", "FAIL"), ("```\n# long enough text to pass\n```", "FAIL"), ("no heading but long enough text", "WARNING"), (GOOD + " data:image/png;base64," + "A" * 200, "WARNING")])
def test_gate_bodies(spark, body, status):
    assert gate(spark, body).status == status
