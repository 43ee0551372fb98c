"""Decoders, whole conversions, packages, the registry and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.plans import convert, package
from folioforge.sources import decoders, files
from folioforge.streaming import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx_bytes(title="Thiết kế IMS"):
    p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in [["STT", "Chức năng"], ["1", "Kết nối | mạng"]]) + "</w:tbl>"
    body = p("Tài liệu", "H1") + p("Phiên bản: 1.0 Trạng thái: Đã ban hành") + p("Kiến trúc", "H2") + p("mục một", "LB") + p("1. Mô tả chung") + p("") + table
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in [("H1", "heading 1"), ("H2", "heading 2"), ("LB", "List Bullet")])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}">{styles}</w:styles>')
        z.writestr("docProps/core.xml", f'<cp xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title></cp>')
    return out.getvalue()


def xlsx_bytes():
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="TongHop" r:id="r1"/><sheet name="Trong" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<x><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></x>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>Ma</t></si><si><r><t>Ket </t></r><r><t>qua</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><f>1+1</f><v>2</v></c><c r="B3" t="inlineStr"><is><t>x|y</t></is></c><c r="C3" t="b"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{s}"><sheetData/></worksheet>')
    return out.getvalue()


def fake_pages(content):
    if not content.startswith(b"%PDF-ok"):
        raise ValueError("damaged")
    page = lambda n, text, share=0.0: {"page_number": n, "text_layer": text, "max_image_area_ratio": share, "image_bbox_error": False, "image": f"image {n}".encode()}
    return [page(1, "QUYẾT ĐỊNH\nVăn bản số hóa có nhiều hơn năm mươi ký tự trong lớp chữ của trang này."), page(2, ""), page(3, "ngắn"), page(4, "lỗi")]


def fake_engine(image):
    if image == b"image 4":
        raise RuntimeError("broken")
    return ("", 1.0) if image == b"image 3" else ("Chữ đọc được từ ảnh quét", 0.5)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("03.IMS HLD.docx", 1, docx_bytes()), ("so lieu.xlsx", 2, xlsx_bytes()), ("quyet dinh.pdf", 3, b"%PDF-bad %PDF-ok"), ("cu.doc", 4, b"x"), ("hong.docx", 5, b"no zip"), ("03.IMS HLD.xlsx", 6, xlsx_bytes())]
    made = spark.createDataFrame(rows, "filename string, ordinal long, content binary")

    def no_office(content, ext):
        raise RuntimeError("no office program")

    found = convert.convert(made, "2024-01-01", {".pdf": decoders.pdf_with(fake_pages)}, {"tesseract": fake_engine}, legacy=no_office).cache()
    return made, found, {r.filename: r for r in found.collect()}


def test_docx(docs):
    r = docs[2]["03.IMS HLD.docx"]
    assert r.metadata.title == "Thiết kế IMS" and r.metadata.version == "1.0" and r.metadata.document_status == "Đã ban hành" and r.metadata.document_type == "HLD"
    assert [(s.id, s.level) for s in r.sections] == [("sec-tai-lieu", 1), ("sec-kien-truc", 2), ("sec-1-mo-ta-chung", 2)]
    assert "| 1 | Kết nối \\| mạng |" in r.markdown and "- mục một" in r.markdown and r.validation.status == "PASS"
    assert r.metadata.source_sha256 in r.markdown and len(r.metadata.source_sha256) == 64


def test_xlsx(docs):
    r = docs[2]["so lieu.xlsx"]
    assert "# File: so lieu.xlsx" in r.markdown and "## Sheet: TongHop" in r.markdown and "Trong" not in r.markdown
    assert "| Ma |  | Ket qua |\n| --- | --- | --- |\n| 2 | x\\|y | True |" in r.markdown
    assert decoders.xlsx(xlsx_bytes(), True)["blocks"][0]["rows"][2][0] == "=1+1"
    assert decoders.xlsx(xlsx_bytes())["blocks"][0]["rows"][1] == ["", "", ""]


def test_pdf(docs):
    r = docs[2]["quyet dinh.pdf"]
    assert r.pages_total == 4 and r.pages_ocr == [2, 3, 4]
    assert "<!-- source_page: 2 -->\n\n> [Extracted from image via TESSERACT]\nChữ đọc được từ ảnh quét" in r.markdown
    assert "> [Extracted from image via TESSERACT]\nngắn" in r.markdown and "\n\n---\n\n<!-- source_page: 4 -->\n\nlỗi" in r.markdown
    assert any("Trang 2: Độ tin cậy OCR (50%)" in w for w in r.warnings) and any("Trang 3: OCR không" in w for w in r.warnings) and any("Trang 4" not in w and "tại trang 4: broken" in w for w in r.warnings)
    assert any("tự động sửa" in w for w in r.warnings) and "sec-quyet-dinh" in [s.id for s in r.sections]


def test_files_that_cannot_be_read(docs):
    assert docs[2]["cu.doc"].validation is None and "no office program" in docs[2]["cu.doc"].markdown
    assert docs[2]["hong.docx"].validation.status == "FAIL"


def test_package(spark, docs):
    made, found, _ = docs
    s = package.summary(found).first()
    assert (s.total_documents, s.ready_count, s.failed_count, s.unvalidated_count, s.overall_status, s.is_single_mode) == (6, 4, 1, 1, "FAIL", False)
    z = zipfile.ZipFile(io.BytesIO(package.package_zip(package.entries(found, made, "2024-01-01T00:00:00", "KB"))))
    names = z.namelist()
    assert {"upload_to_ai/00_Master_Index.md", "upload_to_ai/03.IMS HLD.md", "upload_to_ai/03.IMS HLD-2.md", "technical/manifest.json", "technical/conversion_report.md", "technical/failed/hong.md", "source/cu.doc", "README.txt"} <= set(names) and len(names) == len(set(names))
    assert all(i.flag_bits & 0x800 for i in z.infolist() if not i.filename.isascii())
    manifest = json.loads(z.read("technical/manifest.json"))
    assert [manifest[k] for k in ("schema_version", "knowledge_base", "total_documents", "ready_for_ai_count", "failed_count")] == ["1.0", "KB", 5, 4, 1]
    assert list(manifest["documents"][0])[:3] == ["document_id", "source_file", "markdown_file"] and manifest["documents"][0]["sections"][0]["page_start"] == 1
    assert manifest["failed_documents"][0]["errors"] and '\n  "documents": [\n    {\n      "document_id"' in z.read("technical/manifest.json").decode()
    index, report = z.read("upload_to_ai/00_Master_Index.md").decode(), z.read("technical/conversion_report.md").decode()
    assert "document_count: 4" in index and "  - [Kiến trúc](03.IMS HLD.md#sec-kien-truc) *(Trang 1)*" in index
    assert report.index("`so lieu.xlsx`") < report.index("`hong.docx`") and "❌ FAIL" in report
    assert "(4 tài liệu)" in z.read("README.txt").decode() and "Có 1 file" in z.read("README.txt").decode()


def test_index_only_from_two_documents(docs):
    assert package.master_index(docs[1].filter("ordinal = 1"), "now").count() == 0
    assert package.summary(docs[1].filter("ordinal = 1")).first().is_single_mode
    assert "Single Document Mode" in package.readme(1, 1, 0) and "Knowledge Pack (0" in package.readme(0, 0, 0)


def test_scan_gate_and_registry(spark, tmp_path):
    for name, body in [("một + hai.docx", b"abc"), ("b.txt", b"x"), ("lớn.pdf", b"y" * 50)]:
        (tmp_path / name).write_bytes(body)
    scanned = files.scan_files(spark, str(tmp_path))
    ok, rejected = files.gate_files(scanned, 20)
    assert [r.filename for r in ok.collect()] == ["một + hai.docx"]
    assert {r.filename: r.reason for r in rejected.collect()} == {"b.txt": "unsupported extension", "lớn.pdf": "too large"}
    assert files.scan_files(spark, str(tmp_path), "*.pdf").count() == 1
    empty = files.registry_status(files.registry_table(spark, "no_such_table"), spark)
    assert empty.count() == 0 and "Registry unavailable" in files.status_html(empty).first().html
    status = spark.createDataFrame([("<a>", 2)], "current_state string, n long")
    assert "&lt;a&gt;</td><td>2" in files.status_html(status).first().html
    assert json.loads(files.status_json(status).first().json) == {"registry_available": True, "states": {"<a>": 2}, "document_contents_exposed": False}
    assert decoders.capabilities(spark).first().formats == [".docx", ".pdf", ".xlsx"]
    assert decoders.engine(" Paddle ", {"paddleocr": 1, "tesseract": 2}) == 1 and decoders.engine("other", {"tesseract": 2}) == 2


def test_dear_steps_run_once(spark, tmp_path):
    """Every file is decoded and every page recognised once, however many branches read them."""

    def slow_pages(content):
        with open(f"{tmp_path}/decoded", "a") as f:
            f.write("x")
        return [{"page_number": 1, "text_layer": "", "max_image_area_ratio": 0.0, "image_bbox_error": False, "image": b"i"}]

    def slow_engine(image):
        with open(f"{tmp_path}/read", "a") as f:
            f.write("x")
        return "QUYẾT ĐỊNH số một", 0.9

    made = spark.createDataFrame([("a.pdf", 1, b"%PDF-"), ("b.pdf", 2, b"%PDF-")], "filename string, ordinal long, content binary")
    out = convert.convert(made, "2024-01-01", {".pdf": decoders.pdf_with(slow_pages)}, {"tesseract": slow_engine}).collect()
    assert len(out) == 2 and all("QUYẾT ĐỊNH số một" in r.markdown for r in out)
    assert (tmp_path / "decoded").read_text() == "xx" == (tmp_path / "read").read_text()


def test_pdf_slices():
    assert list(decoders.pdf_slices(b"%PDF-1 %PDF-2 %PDF-3")) == [b"%PDF-1 %PDF-2 %PDF-3", b"%PDF-3", b"%PDF-2 %PDF-3"]
    assert decoders.pdf_with(fake_pages)(b"nothing")["error"] == "damaged"


def test_recognised_words():
    head = "level\tblock_num\tpar_num\tline_num\tword_num\tconf\ttext"
    assert decoders.parse_words("\n".join([head, "5\t1\t1\t2\t1\t80\tb", "5\t1\t1\t1\t1\t91\ta", "5\t1\t1\t1\t2\t-1\tc", "4\t1\t1\t1\t0\t-1\t", "5\t1\t1\t1\t3\t10\t "])) == ("a c\nb", 0.85 if round(1.71 / 2, 2) == 0.85 else 0.86)
    assert decoders.parse_words(head) == ("", 1.0) == decoders.parse_words("")


def test_batch_files(spark, docs, tmp_path):
    z = zipfile.ZipFile(io.BytesIO(package.package_zip(package.batch_entries(docs[1]))))
    assert sorted(z.namelist()) == sorted(["03.IMS HLD.md", "03.IMS HLD-2.md", "so lieu.md", "quyet dinh.md", "cu.md", "hong.md"])
    package.write_folder(package.entries(docs[1], docs[0], "now"), f"{tmp_path}/kb")
    assert {r.folder for r in spark.read.parquet(f"{tmp_path}/kb").select("folder").collect()} == {"root", "source", "technical", "upload_to_ai"}


def test_progress(spark):
    d = spark.createDataFrame([("a", 1, 2), ("b", 2, 1), ("c", 3, 0)], "filename string, ordinal int, pages_total int")
    got = [(r.type, r.file_index, r.completed_files, r.remaining_files, r.page_current, r.percent) for r in ingest.ordered_events(ingest.progress_events(d)).collect()]
    assert got[:4] == [("file_start", 1, 0, 3, None, 0), ("page_progress", 1, 0, 3, 1, 0), ("page_progress", 1, 0, 3, 2, 16), ("file_done", 1, 1, 2, None, 33)]
    assert got[-1] == ("file_done", 3, 3, 0, None, 100)
    line = ingest.sse(ingest.progress_events(d)).first().line
    assert line.startswith("data: {") and line.endswith("}\n\n")


def test_watched_folder_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.docx").write_bytes(docx_bytes())
    (source / "b.xlsx").write_bytes(xlsx_bytes())
    (source / "c.txt").write_bytes(b"x")
    seen = []
    run = lambda f: convert.convert(f, "2024-01-01")
    for _ in range(2):
        ingest.watch_folder(spark, str(source), run, f"{tmp_path}/out", f"{tmp_path}/check", seen.append).awaitTermination()
    streamed = spark.read.parquet(f"{tmp_path}/out").drop("batch_id")
    ok, _ = files.gate_files(files.scan_files(spark, str(source)))
    assert sorted((r.filename, r.markdown) for r in streamed.collect()) == sorted((r.filename, r.markdown) for r in run(ok).collect())
    assert [e["type"] for e in seen] == ["file_start", "page_progress", "file_done"] * 2 + ["error", "complete"]
