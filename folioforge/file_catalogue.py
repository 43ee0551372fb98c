"""Registered queries of readers, recognition, packages and streams, with their SQL.

Files are made from the driver's tables (PDF text in the plan, archives in a UDF) and
read back by the readers; the SQL says what must come out of them.
"""

from __future__ import annotations

import io
import re
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _GATED, _table, gated_documents, query
from .functions import text as T
from .operators import cleaning, metadata, quality
from .plans import convert, package
from .sources import decoders, images, pdf
from .sources import files as sources
from .sources.archives import zipped
from .streaming import ingest


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.spread(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))


# --- PDF -----------------------------------------------------------------------------------------------------------


def _pdf(pages: list[Column], image: Column | None = None) -> Column:
    """A PDF file of pages of text, made by joining strings; with an image of hexadecimal grey samples on every page."""
    kids = " ".join(f"{10 + i} 0 R" for i in range(len(pages)))
    parts: list[Column | str] = [f"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /MediaBox [0 0 100 100] /Count {len(pages)} /Kids [{kids}] >>\nendobj\n"]
    if image is not None:
        parts += ["4 0 obj\n<< /Type /XObject /Subtype /Image /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /ASCIIHexDecode /Width ", (F.length(image) / 2).cast("int").cast("string"), " /Length ", (F.length(image) + 1).cast("string"), " >>\nstream\n", image, ">\nendstream\nendobj\n"]
    for i, page in enumerate(pages):
        shown = "q 50 0 0 40 0 0 cm /Im Do Q " if image is not None else ""
        parts += [f"{10 + i} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {100 + i} 0 R /Resources << /XObject << /Im 4 0 R >> >> >>\nendobj\n{100 + i} 0 obj\n<< /Length 5 >>\nstream\n{shown}BT 12 TL (", F.replace(page, F.lit("\n"), F.lit(") Tj T* (")), ") Tj ET\nendstream\nendobj\n"]
    parts.append("trailer\n<< /Root 1 0 R >>\n%%EOF\n")
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third file has a whole one behind other bytes, every third is none."""
    first = F.concat(F.lit("So "), F.col("o_orderkey").cast("string"), F.lit("/QD\n"), F.col("o_orderpriority"), F.lit(" \\(x\\)"))
    second = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.concat(F.lit("trang hai "), F.col("o_orderstatus")))
    whole = _pdf([first, second])
    broken = F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.repeat(F.lit("junk"), 300), whole)).when(F.col("o_orderkey") % 3 == 2, F.lit("%PDF- nothing in it")).otherwise(whole)
    return _orders(spark, sf_dir).select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(".PDF")).alias("filename"), broken.cast("binary").alias("content"))


@query("""SELECT o_orderkey, CAST(p AS INT) AS page_number, CASE WHEN o_orderkey % 3 = 2 THEN '' WHEN p = 1 THEN 'So ' || o_orderkey || '/QD' || chr(10) || o_orderpriority || ' (x)' WHEN o_orderkey % 2 = 0 THEN '' ELSE 'trang hai ' || o_orderstatus END AS text_layer
FROM orders, unnest(CASE WHEN o_orderkey % 3 = 2 THEN [1] ELSE [1, 2] END) AS t(p)""")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text layers of PDF files, damaged ones too."""
    found = decoders.decode_files(_pdf_files(spark, sf_dir))
    return decoders.exploded_pages(found, "o_orderkey").select("o_orderkey", "page_number", "text_layer")


@query("SELECT o_orderkey, o_orderkey % 3 = 1 AS repaired, o_orderkey % 3 = 2 AS failed, 'pdf' AS kind FROM orders")
def pdf_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last whole part of a damaged file takes its place."""
    found = decoders.decode_files(_pdf_files(spark, sf_dir))
    return found.select("o_orderkey", "decoded.repaired", F.col("decoded.error").isNotNull().alias("failed"), "decoded.kind")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 2 = 0 ELSE false END AS healthy FROM orders")
def pdf_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with pages, none of which is a white image, is healthy."""
    white = F.when(F.col("o_orderkey") % 2 == 0, "FF00").otherwise("FFFF")
    made = _pdf([F.lit("x")], white)
    files = _orders(spark, sf_dir).select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, made).when(F.col("o_orderkey") % 3 == 1, F.lit("")).otherwise(_pdf([])).cast("binary").alias("content"))

    @F.pandas_udf("boolean")
    def healthy(content: pd.Series) -> pd.Series:
        return content.map(lambda c: pdf.healthy(bytes(c)))

    return files.select("o_orderkey", healthy("content").alias("healthy"))


@query("SELECT o_orderkey, 0.2::DOUBLE AS share, '1x3' AS shape, '3x1' AS turned, CAST((o_orderkey % 256 <= 165)::INT + 1 AS BIGINT) AS black FROM orders")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image of a page, turned upright and without faint marks."""
    samples = F.concat(F.lpad(F.hex(F.col("o_orderkey") % 256), 2, "0"), F.lit("0AA6"))
    files = _orders(spark, sf_dir).select("o_orderkey", F.lit("a.pdf").alias("filename"), _pdf([F.lit("x")], samples).cast("binary").alias("content"))

    @F.pandas_udf("shape string, turned string, black long")
    def seen(image: pd.Series) -> pd.DataFrame:
        size = lambda x: "x".join(map(str, x.shape[:2]))
        out = []
        for raw in map(bytes, image):
            ready = images.read_png(images.without_marks(raw))
            out.append((size(ready), size(images.read_png(images.upright(raw, lambda _: (90, 2.5)))), int(np.count_nonzero(ready == 0))))
        return pd.DataFrame(out, columns=["shape", "turned", "black"])

    pages = decoders.exploded_pages(decoders.decode_files(files), "o_orderkey")
    return pages.select("o_orderkey", F.col("max_image_area_ratio").alias("share"), seen("image").alias("s")).select("o_orderkey", "share", "s.*")


# --- office files --------------------------------------------------------------------------------------------------


def _docx(title: pd.Series, text: pd.Series, cell: pd.Series) -> pd.Series:
    """Documents of a title, styled paragraphs and a table."""
    w = decoders.W[1:-1]

    def one(a: str, b: str, c: str) -> bytes:
        p = lambda t, style: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
        grid = "".join("<w:tr>" + "".join(f"<w:tc>{p(x, '')}</w:tc>" for x in r) + "</w:tr>" for r in (["Ma", ""], [c, "a|b"]))
        body = p(a, "H1") + p(b, "LB") + p("", "") + p("1. Quy định", "") + p("1.2. nhỏ", "") + f"<w:tbl>{grid}</w:tbl>" + p(b, "")
        return zipped({
            "word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>',
            "word/styles.xml": f'<w:styles xmlns:w="{w}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="LB"><w:name w:val="List Bullet"/></w:style></w:styles>',
        }, deflate=False)

    return pd.Series([one(*x) for x in zip(title, text, cell)])


def _body(files: DataFrame) -> DataFrame:
    d = F.col("decoded")
    md, raw = convert.blocks_markdown(F.col("filename"), d["kind"], d["blocks"])
    return decoders.decode_files(files).withColumn("md", md).withColumn("raw", raw)


@query("""SELECT o_orderkey, 'Don ' || o_orderkey AS first_heading, '# Don ' || o_orderkey || chr(10) || chr(10) || '- muc ' || o_orderpriority || chr(10) || chr(10) || '## 1. Quy định' || chr(10) || chr(10) || chr(10) || '### 1.2. nhỏ' || chr(10) || chr(10) || chr(10)
 || '| Ma |  |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderstatus || ' | a\\|b |' || chr(10) || chr(10) || 'muc ' || o_orderpriority AS md,
 'Don ' || o_orderkey || chr(10) || 'muc ' || o_orderpriority || chr(10) || '1. Quy định' || chr(10) || '1.2. nhỏ' || chr(10) || 'Ma' || chr(10) || chr(10) || o_orderstatus || chr(10) || 'a|b' || chr(10) || 'muc ' || o_orderpriority AS raw FROM orders""")
def docx_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs by style and number, and tables, in their order."""
    rows = _orders(spark, sf_dir)
    made = F.pandas_udf(_docx, "binary")(F.concat(F.lit("Don "), F.col("o_orderkey").cast("string")), F.concat(F.lit("muc "), F.col("o_orderpriority")), F.col("o_orderstatus"))
    return _body(rows.select("o_orderkey", F.lit("a.docx").alias("filename"), made.alias("content"))).select("o_orderkey", "decoded.first_heading", "md", "raw")


def _xlsx(key: pd.Series, text: pd.Series) -> pd.Series:
    """Workbooks of two sheets, of which one is blank, with an empty row; every third lacks its list of sheets."""

    def one(k: int, t: str) -> bytes:
        sheets = {"So lieu": [["Ma", "Ten"], ["", " "], [str(k), t]], "Trong": [["", ""]]}
        if k % 3:
            return decoders.xlsx_of(sheets)
        return zipped({n: part for n, part in decoders.xlsx_parts(sheets).items() if n != "xl/workbook.xml"}, deflate=False)

    return pd.Series([one(*x) for x in zip(key, text)])


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AS warned, '# File: b.xlsx' || chr(10) || chr(10) || '## Sheet: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'sheet1' ELSE 'So lieu' END || chr(10) || chr(10) || '| Ma | Ten |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderkey || ' | ' || o_orderpriority || ' |' AS md FROM orders""")
def xlsx_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets as tables without empty rows; the generic reader takes over where a workbook can't be read."""
    rows = _orders(spark, sf_dir)
    found = _body(rows.select("o_orderkey", F.lit("b.xlsx").alias("filename"), F.pandas_udf(_xlsx, "binary")("o_orderkey", "o_orderpriority").alias("content")))
    return found.select("o_orderkey", F.coalesce(F.col("decoded.error").startswith("Excel parser warning: "), F.lit(False)).alias("warned"), "md")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'text' ELSE 'docx' END AS kind, o_orderkey % 2 = 1 AS empty, CASE WHEN o_orderkey % 2 = 0 THEN 'ghi chu ' || o_orderkey ELSE '' END AS md FROM orders")
def generic_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents under a wrong suffix: text is read as such, other bytes are an error."""
    content = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("ghi chu "), F.col("o_orderkey").cast("string")).cast("binary")).otherwise(F.unhex(F.lit("00FF01")))
    found = _body(_orders(spark, sf_dir).select("o_orderkey", F.lit("c.docx").alias("filename"), content.alias("content")))
    return found.select("o_orderkey", "decoded.kind", (F.size("decoded.blocks") == 0).alias("empty"), "md")


@query("SELECT 'NCC ' || s_suppkey || '.doc' AS filename, '# Lỗi chuyển đổi' || chr(10) || chr(10) || 'no program' AS markdown, true AS unvalidated, false AS converted_via_legacy FROM supplier")
def legacy_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy files that no program converts are documents of their own that never reach the gate."""

    def none(content: bytes, ext: str) -> tuple[bytes, str]:
        raise RuntimeError("no program")

    files = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("NCC "), F.col("s_suppkey").cast("string"), F.lit(".doc")).alias("filename"), F.col("s_suppkey").alias("ordinal"), F.lit("x").cast("binary").alias("content"))
    found = convert.convert(files, "2024-01-01", legacy=none)
    return found.select("filename", "markdown", F.col("validation").isNull().alias("unvalidated"), "converted_via_legacy")


@query("SELECT s_suppkey, 'xlsx' AS kind, true AS converted_via_legacy, '# File: d.xls' || chr(10) || chr(10) || '## Sheet: ' || 'NCC' || chr(10) || chr(10) || '| Ma | ' || s_suppkey || ' |' || chr(10) || '| --- | --- |' AS md FROM supplier")
def legacy_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy files go through the conversion that is handed in and are then read like new ones."""
    convert_ = lambda content, ext: (decoders.xlsx_of({"NCC": [["Ma", content.decode()]]}), ext + "x")
    files = _table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("d.xls").alias("filename"), F.col("s_suppkey").cast("string").cast("binary").alias("content"))
    found = decoders.decode_files(files, legacy=convert_)
    d = F.col("decoded")
    md, _ = convert.blocks_markdown(F.col("filename"), d["kind"], d["blocks"])
    return found.select("s_suppkey", "decoded.kind", "decoded.converted_via_legacy", md.alias("md"))


# --- recognition ---------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT l_orderkey, l_linenumber AS n, CASE WHEN l_linenumber = 2 THEN '' ELSE l_returnflag || l_linenumber END AS word FROM lineitem),
lines AS (SELECT l_orderkey, n // 3 AS line, string_agg(word, ' ' ORDER BY n, word) AS said FROM w WHERE word <> '' GROUP BY ALL)
SELECT l_orderkey, coalesce(string_agg(said, chr(10) ORDER BY line), '') AS text FROM (SELECT DISTINCT l_orderkey FROM w) LEFT JOIN lines USING (l_orderkey) GROUP BY l_orderkey""")
def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text from tables of recognised words."""
    word = F.when(F.col("l_linenumber") == 2, " ").otherwise(F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
    row = F.concat_ws("\t", F.lit("1"), F.lit("1"), F.floor(F.col("l_linenumber") / 3).cast("string"), (F.col("l_quantity").cast("int") * 2 - 2).cast("string"), word)
    tables = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", word.alias("w"), "l_quantity", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))

    @F.pandas_udf("string")
    def read(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: decoders.parse_words("block_num\tpar_num\tline_num\tconf\ttext\n" + r)[0])

    return tables.select("l_orderkey", read("rows").alias("text"))


@query("""SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, chr(10) ORDER BY CASE WHEN l_linenumber = 4 THEN 0 ELSE round_even(l_quantity / 14, 0) * 14 END, CASE WHEN l_linenumber = 4 THEN 0 ELSE l_suppkey END, l_linenumber, l_returnflag, l_suppkey, l_quantity) AS text,
  round_even(avg(CASE WHEN l_linenumber % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END), 2) AS confidence FROM lineitem WHERE l_linenumber <> 3 GROUP BY l_orderkey""")
def ocr_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text in reading order from recognised boxes: blank ones are left out, boxes without four numbers are at the origin."""
    box = F.struct("l_linenumber", F.when(F.col("l_linenumber") == 3, " ").otherwise(F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("text"), F.col("l_suppkey").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"))
    pages = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(box)).alias("boxes"), F.count_if(F.col("l_linenumber") != 3).alias("n")).filter("n > 0")

    @F.pandas_udf("text string, confidence double")
    def read(boxes: pd.Series) -> pd.DataFrame:
        at = lambda b: [b["x"]] if b["l_linenumber"] == 4 else [b["x"], b["y"], 0, 0]
        form = lambda p: [{"rec_texts": [b["text"] for b in p], "rec_scores": [1 - b["l_linenumber"] % 2 for b in p], "rec_boxes": [at(b) for b in p]}]
        return pd.DataFrame([decoders.parse_boxes(form(p)) for p in boxes], columns=["text", "confidence"])

    return pages.select("l_orderkey", read("boxes").alias("r")).select("l_orderkey", "r.*")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber AS n, l_suppkey % 4 AS k, CASE WHEN l_suppkey % 4 = 3 THEN repeat('chu so ', 20) || l_linenumber ELSE 'it ' || l_linenumber END AS layer FROM lineitem)
SELECT l_orderkey, n AS page_number, k <> 3 AS needs_ocr,
  CASE k WHEN 0 THEN '> [Extracted from image via TESSERACT]' || chr(10) || 'doc ' || n WHEN 1 THEN layer WHEN 2 THEN '> [Extracted from image via TESSERACT]' || chr(10) || layer ELSE layer END AS text,
  CASE k WHEN 0 THEN 'Trang ' || n || ': Độ tin cậy OCR (' || 50 || '%).' WHEN 1 THEN 'Lỗi OCR tại trang ' || n || ': broken' WHEN 2 THEN 'Trang ' || n || ': OCR không trích xuất được chữ, tự động sử dụng lớp văn bản (text layer) có sẵn.' END AS warning FROM p""")
def recognised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that need it go through the engine; failed and empty ones keep their text layer; low confidence is noted."""

    def engine(image: bytes) -> tuple[str, float]:
        kind, page = image.decode().split(":")
        if kind == "1":
            raise RuntimeError("broken")
        return ("", 1.0) if kind == "2" else (f"doc {page}", 0.5)

    n, k = F.col("l_linenumber"), F.col("l_suppkey") % 4
    layer = F.when(k == 3, F.concat(F.repeat(F.lit("chu so "), 20), n.cast("string"))).otherwise(F.concat(F.lit("it "), n.cast("string")))
    pages = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.cast("int").alias("page_number"), layer.alias("text_layer"), F.lit(0.0).alias("max_image_area_ratio"), F.lit(False).alias("image_bbox_error"), F.concat_ws(":", k.cast("string"), n.cast("string")).cast("binary").alias("image"))
    found = convert.recognise(pages, "tesseract", {"tesseract": engine})
    return found.select(F.col("doc_id").alias("l_orderkey"), "page_number", "needs_ocr", "text", "warning")


@query("SELECT name, engine FROM (VALUES ('tesseract', 'T'), (' Paddle ', 'P'), ('paddleocr', 'P'), ('none', 'T')) AS t(name, engine)")
def engine_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {"tesseract": "T", "paddleocr": "P"}
    return spark.createDataFrame([(n, decoders.engine(n, known)) for n in ("tesseract", " Paddle ", "paddleocr", "none")], "name string, engine string")


# --- texts ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus || repeat(chr(10), least(3, CAST(o_orderkey % 7 AS INT))) || 'x' AS text FROM orders")
def clean_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two blank lines in a row, none at the ends."""
    said = F.concat(F.lit("\n \n"), F.col("o_orderstatus"), F.repeat(F.lit("\n"), (F.col("o_orderkey") % 7).cast("int")), F.lit("x\n\n\n\n"))
    return _orders(spark, sf_dir).select("o_orderkey", T.clean_boundaries(said).alias("text"))


@query("SELECT o_orderkey, 'Đơn vị đầu tư ' || o_orderstatus || chr(10) || 'tm' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'QUYẾT ĐỊNH ./.' ELSE '' END AS text FROM orders")
def recognised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stray lines, page numbers and stamps go, then misread terms are put right."""
    said = F.concat(F.lit("3/12\nĐơn vi đâu tư "), F.col("o_orderstatus"), F.lit("\n~~~ ---\ntm\nab1\na.b@c.vn 10:30 1/2/2024\n"), F.when(F.col("o_orderkey") % 2 == 0, "QUYET DINH ./x").otherwise("  "))
    return cleaning.process_recognised(_orders(spark, sf_dir).select("o_orderkey", said.alias("text")), "text")


@query("SELECT o_orderkey, sha256(nfc_normalize('E' || chr(770) || chr(769) || 'n a' || chr(769) || o_orderstatus || chr(55) || 'o' || chr(795) || chr(803))) AS sha256, CAST(length(nfc_normalize('E' || chr(770) || chr(769) || 'n a' || chr(769) || o_orderstatus || chr(55) || 'o' || chr(795) || chr(803))) AS BIGINT) AS chars FROM orders")
def nfc_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and marks that follow them are composed."""
    said = F.concat(F.lit("Ến á"), F.col("o_orderstatus"), F.lit("7ợ"))
    clean = T.normalize_encoding(_orders(spark, sf_dir).select("o_orderkey", said.alias("text")), "text")
    return clean.select("o_orderkey", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("chars"))


_TITLES = [
    ("V/v: sửa đổi quy trình\nvận hành mạng.\n\nNội dung", "sửa đổi quy trình vận hành mạng"),
    ("Về việc Ban hành “Quy định quản lý chất lượng”\nCăn cứ luật", "Quy định quản lý chất lượng"),
    ("V/v\nbáo cáo tuần\nKính gửi: các đơn vị", "báo cáo tuần"),
    ("# Giới thiệu chung\nmở đầu", "Giới thiệu chung"),
    ("# QUYẾT ĐỊNH\n## Phần mở đầu", "Phần mở đầu"),
    ("không có gì", None),
]


@query("WITH t AS (SELECT *, o_orderkey % 6 AS k FROM orders) SELECT o_orderkey, CASE k " + " ".join(f"WHEN {i} THEN '{said}'" for i, (_, said) in enumerate(_TITLES) if said) + " ELSE 'ho so ' || o_orderkey END AS title FROM t")
def title_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from subjects, quoted names, headings and file names."""
    texts = F.element_at(F.array(*[F.lit(t) for t, _ in _TITLES]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    name = F.concat(F.lit("2024-01-02 ho_so-"), F.col("o_orderkey").cast("string"), F.lit(".docx"))
    return _orders(spark, sf_dir).select("o_orderkey", metadata.title(name, texts).alias("title"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Toàn Tập đoàn VNPT' WHEN 1 THEN 'Toàn Tập đoàn VNPT' ELSE '' END AS scope, CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN '{said}'" for i, (_, said) in enumerate(metadata.STATUSES[:4])) + " ELSE '' END AS status FROM orders")
def scope_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scope, and statuses by the first word that is found."""
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, "TẬP ĐOÀN").otherwise("công ty")
    number = F.when(k % 3 == 1, "12/QĐ-VNPT-CN").otherwise("12/QĐ")
    words = F.element_at(F.array(*[F.lit(w.lower()) for w, _ in metadata.STATUSES[:4]], F.lit("hết")), (k % 5 + 1).cast("int"))
    return _orders(spark, sf_dir).select("o_orderkey", metadata.scope(text, number).alias("scope"), metadata.status(words).alias("status"))


_TYPED = [
    ("thiết kế tổng thể", "HLD"), ("low-level design", "LLD"), ("quy trình", "PRO"), ("quyết định", "QĐ"), ("quy chuẩn", "QC"), ("thông tư", "TT"), ("báo cáo", "BC"), ("phụ lục", "PL"), ("hướng dẫn", "HD"), ("thông báo", "TB"),
    ("công văn", "CV"), ("quy định về", "QD"), ("user manual", "UM"), ("v/v họp", "CV"), ("khác", ""), ("thông báo quy chế", "QC"),
]


@query(f"SELECT o_orderkey, CASE o_orderkey % {len(_TYPED)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(_TYPED)) + " END AS type FROM orders")
def document_type_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document type, from the text."""
    said = F.element_at(F.array(*[F.lit(f"{t} số 1") for t, _ in _TYPED]), (F.col("o_orderkey") % len(_TYPED) + 1).cast("int"))
    return _orders(spark, sf_dir).select("o_orderkey", metadata.document_type(F.lit("x.pdf"), said).alias("type"))


#: What correction rules of plain words look for.
_MISREAD = [x for p, _ in cleaning.corrections() if re.fullmatch(r"[\w\s,./-]+", x := p.removeprefix("(?U)").replace(r"\b", ""))]


def _put_right(text: str) -> str:
    """All rules in order, by another engine of patterns."""
    for p, r in cleaning.corrections():
        text = re.sub(p.removeprefix("(?U)"), lambda m, r=r: r.replace("\\$", "$").replace("\\\\", "\\"), text)
    return text


@query("SELECT o_orderkey, [" + ", ".join(f"'{_put_right(x)}'" for x in _MISREAD) + f"][CAST(o_orderkey % {len(_MISREAD)} + 1 AS INT)] AS text FROM orders")
def term_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every correction rule of plain words makes of them, with the rules that follow."""
    said = F.element_at(F.array(*map(F.lit, _MISREAD)), (F.col("o_orderkey") % len(_MISREAD) + 1).cast("int"))
    return cleaning.correct_terms(_orders(spark, sf_dir).select("o_orderkey", said.alias("text")), "text")


# --- gate ----------------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS marked, o_orderkey % 3 = 0 AS pure, o_orderkey % 5 AS r FROM orders)
SELECT k AS o_orderkey, CASE WHEN NOT pure AND r = 0 THEN 'FAIL' WHEN NOT marked OR (NOT pure AND r = 1) THEN 'WARNING' ELSE 'PASS' END AS status, CAST(9 AS BIGINT) AS n_checks,
  CASE WHEN marked THEN 'Đã chèn marker định vị trang.' ELSE 'Thiếu marker ranh giới trang.' END AS page_check, 'SHA256: ' || substring(sha256(CAST(k AS VARCHAR)), 1, 16) || '...' AS hash_check FROM d""")
def quality_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over documents of several pages, recognised ones and others."""
    k = F.col("o_orderkey")
    n = F.lit(100)
    source = F.when(k % 5 == 0, 200).when(k % 5 == 1, 125).otherwise(100)
    meta = F.struct(F.lit("a.pdf").alias("source_file"), F.lit("Title").alias("title"), F.lit(2).alias("page_count"), n.alias("markdown_text_char_count"), source.alias("source_text_char_count"), metadata.retention(n, source).alias("text_retention_ratio"), F.sha2(k.cast("string"), 256).alias("source_sha256"))
    body = F.concat(F.lit("# Heading\n\n"), F.when(k % 2 == 0, "<!-- source_page: 1 -->\n").otherwise(""), F.lit("A body that has more than twenty characters"))
    d = quality.with_gate(_orders(spark, sf_dir).select("o_orderkey", body.alias("md"), meta.alias("meta")), "md", F.col("meta"), F.lit(True), k % 3 == 0)
    found = lambda name: F.filter("validation.checks", lambda c: c["name"] == name)[0]["message"]
    return d.select("o_orderkey", "validation.status", F.size("validation.checks").cast("long").alias("n_checks"), found("Truy vết ranh giới trang (Page Markers)").alias("page_check"), found("Mã băm SHA-256 xác thực").alias("hash_check"))


# --- packages ------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, 'don ' || o_orderpriority || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS md_name FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders)")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal stems get numbers, in the order of the input."""
    suffix = F.when(F.col("o_orderkey") % 2 == 0, ".docx").otherwise(".pdf")
    docs = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("don "), F.col("o_orderpriority"), suffix).alias("filename"))
    return package.named(docs).select(F.col("ordinal").alias("o_orderkey"), "md_name")


@query(f"""WITH {_GATED} SELECT CASE WHEN status = 'FAIL' THEN 'technical/failed/' ELSE 'upload_to_ai/' END || 'doc ' || doc_id || '.md' AS path, sha256(coalesce(text, '')) AS sha256 FROM gated
UNION ALL SELECT 'source/doc ' || doc_id || '.docx', sha256(coalesce(lang, '')) FROM documents
UNION ALL SELECT unnest(['upload_to_ai/00_Master_Index.md', 'technical/manifest.json', 'technical/conversion_report.md', 'README.txt']), 'text'""")
def package_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of a package, each document next to the bytes that it came from."""
    docs = gated_documents(spark, sf_dir)
    files = docs.select("filename", F.coalesce("lang", F.lit("")).cast("binary").alias("content"))
    rows = package.document_entries(docs, files).select("path", F.sha2("content", 256).alias("sha256"))
    for own in package.own_pieces(docs, "2024-01-01T00:00:00"):
        # All pieces of a file are made, and count as one.
        whole = own.groupBy("path").agg(F.sum(F.octet_length("content")).alias("size")).filter("size > 0")
        rows = rows.unionByName(whole.select("path", F.lit("text").alias("sha256")))
    return rows


@query(f"WITH {_GATED} SELECT 'tài liệu/doc ' || doc_id || '.md' AS path, sha256(coalesce(text, '')) AS sha256, true AS utf8 FROM gated")
def batch_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown file for each document, written to archives by the tasks that hold them and read back from these."""

    def run(batches):
        for batch in (b for whole in batches for b in package.slices(whole, "content")):
            out = io.BytesIO()
            package.write_zip(batch.to_pylist(), out)
            with zipfile.ZipFile(out) as z:
                rows = [(i.filename, z.read(i), bool(i.flag_bits & 0x800)) for i in z.infolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.binary(), pa.bool_()))], ["path", "content", "utf8"])

    rows = package.batch_entries(gated_documents(spark, sf_dir)).withColumn("path", F.concat(F.lit("tài liệu/"), "path"))
    found = rows.mapInArrow(run, "path string, content binary, utf8 boolean")
    return found.select("path", F.sha2("content", 256).alias("sha256"), "utf8")


@query(f"""WITH {_GATED}, n AS (SELECT count(*) AS total, count_if(status <> 'FAIL') AS ready, count_if(status = 'FAIL') AS failed FROM gated)
SELECT ready <> 1 AS pack, contains(said, 'Knowledge Pack (' || ready || ' tài liệu)') AS mode, failed > 0 AS noted FROM (SELECT *, 'Chế độ: Knowledge Pack (' || ready || ' tài liệu).' AS said FROM n)""")
def package_readme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that explains a package, from its counts."""
    made = package.summary(gated_documents(spark, sf_dir))

    @F.pandas_udf("string")
    def said(total: pd.Series, ready: pd.Series, failed: pd.Series) -> pd.Series:
        return pd.Series([package.readme(*map(int, x)) for x in zip(total, ready, failed)])

    text = made.select("ready_count", said("total_documents", "ready_count", "failed_count").alias("t"))
    return text.select((~F.col("t").contains("Single Document Mode")).alias("pack"), F.col("t").contains(F.concat(F.lit("Knowledge Pack ("), F.col("ready_count").cast("string"), F.lit(" tài liệu)"))).alias("mode"), F.col("t").contains("LƯU Ý").alias("noted"))


@query("SELECT n_nationkey AS ordinal, '| **DOC-' || lpad(CAST(row_number() OVER (ORDER BY n_nationkey) AS VARCHAR), 2, '0') || '** | ' || n_name || ' | Other |  |  |  | [`' || n_name || '.md`](' || n_name || '.md) |' AS row FROM nation")
def index_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without an id are named by their place in the index."""
    meta = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("document_id", "document_type", "version", "document_status", "issued_date", "effective_date", "source_sha256")], F.col("n_name").alias("title"))
    docs = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"), F.concat("n_name", F.lit(".docx")).alias("filename"), meta.alias("metadata"), F.array().cast("array<struct<id:string,heading:string,level:int,source_page_start:int,source_page_end:int>>").alias("sections"))
    return package.index_rows(package.numbered(docs)).select("ordinal", "row")


_ITEM_HEAD = """'{"document_id":"DOC-' || doc_id || '","source_file":"doc ' || doc_id || '.docx","markdown_file":"upload_to_ai/doc ' || doc_id || '.md","sha256":"' || sha256(text) || '","title":"' || lang || '","document_type":"BC","version":"1.0","status":"","issued_date":"","effective_date":"2024-02-03","page_count":1,"word_count":' || words || ',"character_count":' || length(text) || ',"retention_ratio":' || ratio || ',"validation_status":"' || status || '","is_safe_for_ai":true,"sections":[]}'"""
_FAILED_ITEM = """'{"source_file":"doc ' || doc_id || '.docx","markdown_file":"technical/failed/doc ' || doc_id || '.md","sha256":"' || sha256(text) || '","validation_status":"FAIL","is_safe_for_ai":false,"errors":["' || array_to_string(list_concat(CASE WHEN filled THEN [] ELSE ['Tài liệu không có nội dung văn bản sau khi chuyển đổi.'] END,
  CASE WHEN lang IS NULL THEN ['Thiếu thông tin source_file hoặc title trong metadata.'] ELSE [] END, CASE WHEN ratio < 0.75 THEN ['FAILED: Tỷ lệ ký tự quá thấp (' || CAST(trunc(ratio * 100) AS INT) || '%), cần kiểm tra thủ công.'] ELSE [] END), '","') || '"]}'"""


@query(rf"""WITH {_GATED}, w AS (SELECT *, len(regexp_extract_all(regexp_replace(text, '[#*`_~\[\]()><!|]', ' ', 'g'), '\S+')) AS words FROM gated),
items AS (SELECT CASE WHEN status = 'FAIL' THEN 3 ELSE 1 END AS place, doc_id, CASE WHEN status = 'FAIL' THEN {_FAILED_ITEM} ELSE {_ITEM_HEAD} END AS item FROM w),
n AS (SELECT count_if(place = 1) AS ready, count_if(place = 3) AS failed FROM items)
SELECT place, CAST(doc_id AS BIGINT) AS ordinal, CASE WHEN row_number() OVER (PARTITION BY place ORDER BY doc_id) = 1 THEN '' ELSE ',' END || item AS line FROM items
UNION ALL SELECT 0, NULL, '{{"schema_version":"1.0","knowledge_base":"VNPT-AI-Knowledge-Base","generated_at":"2024-01-01T00:00:00","total_documents":' || (ready + failed) || ',"ready_for_ai_count":' || ready || ',"failed_count":' || failed || ',"documents":[' FROM n
UNION ALL SELECT 2, NULL, '],"failed_documents":[' UNION ALL SELECT 4, NULL, ']}}'""")
def manifest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, line by line."""
    return package.manifest_lines(gated_documents(spark, sf_dir), "2024-01-01T00:00:00")


@query(f"""WITH {_GATED}, r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n, coalesce(nullif(lang, ''), 'doc ' || doc_id || '.docx') AS title, sha256(text) AS h FROM gated WHERE status <> 'FAIL'),
lines AS (SELECT 1 AS place, doc_id, '| **DOC-' || doc_id || '** | ' || title || ' | BC | 1.0 |  | 2024-02-03 | [`doc ' || doc_id || '.md`](doc ' || doc_id || '.md) |' AS line FROM r
UNION ALL SELECT 3, doc_id, '### DOC-' || doc_id || ' — ' || title || chr(10) || '**File:** `doc ' || doc_id || '.md`' || chr(10) || '- **Phiên bản:** 1.0' || chr(10) || '- **Ngày ban hành / hiệu lực:** 2024-02-03' || chr(10) || '- **Mã băm SHA-256:** `' || h || '`' || chr(10) || chr(10) || '#### Cấu trúc đề mục:' || chr(10) || '- *(Văn bản liền mạch không chia phân đoạn)*' || chr(10) || chr(10) FROM r)
SELECT place, doc_id AS ordinal, line FROM lines""")
def index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and trees of the master index, line by line; its fixed wording is left out here."""
    return package.index_lines(gated_documents(spark, sf_dir), "2024-01-01").filter("place in (1, 3)")


_BADGE = "CASE status WHEN 'PASS' THEN '✅ PASS' WHEN 'WARNING' THEN '⚠️ WARNING' ELSE '❌ FAIL' END"


@query(f"""WITH {_GATED}, w AS (SELECT *, (NOT headed)::INT + (ratio >= 0.75 AND ratio < 0.9)::INT AS w FROM gated)
SELECT CASE WHEN status = 'FAIL' THEN 2 ELSE 1 END AS place, doc_id AS ordinal, '| `doc ' || doc_id || '.docx` | ' || {_BADGE} || ' | 1 | 0 | ' || CAST(trunc(ratio * 100) AS INT) || '% | ' || CASE WHEN status = 'FAIL' THEN '`technical/failed/`' ELSE '`upload_to_ai/`' END || ' | ' || CASE WHEN w > 0 THEN 2 * w || ' cảnh báo' ELSE '0' END || ' |' AS line FROM w
UNION ALL SELECT CASE WHEN status = 'FAIL' THEN 5 ELSE 4 END, doc_id, '### 📋 `doc ' || doc_id || '.docx`' FROM gated""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report, line by line; of details their first line."""
    found = package.report_lines(gated_documents(spark, sf_dir)).filter("ordinal is not null")
    return found.withColumn("line", F.substring_index("line", "\n", 1))


# --- streams -------------------------------------------------------------------------------------------------------


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "supplier").select(F.format_string("%06d", "s_suppkey").alias("filename"), F.col("s_suppkey").alias("ordinal"), (F.col("s_suppkey") % 3 + 1).cast("int").alias("pages_total"))
    return ingest.progress_events(docs)


@query("""WITH d AS (SELECT printf('%06d', s_suppkey) AS filename, row_number() OVER (ORDER BY s_suppkey) AS i, count(*) OVER () AS n, s_suppkey % 3 + 1 AS pages FROM supplier)
SELECT filename, CAST(p AS INT) AS page_current, CAST(trunc((i - 1 + (p - 1) / pages) / n * 100) AS INT) AS percent, 'Đang Đọc trang ' || p || '/' || pages || ' (' || filename || ')' AS message FROM d, unnest(range(1, pages + 1)) AS t(p)""")
def page_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _progress(spark, sf_dir).filter("type = 'page_progress'").select("filename", "page_current", "percent", "message")


@query("""WITH d AS (SELECT printf('%06d', s_suppkey) AS f, row_number() OVER (ORDER BY s_suppkey) AS i, count(*) OVER () AS n FROM supplier)
SELECT 'data: {"type":"file_done","filename":"' || f || '","file_index":' || i || ',"total_files":' || n || ',"completed_files":' || i || ',"remaining_files":' || (n - i) || ',"percent":' || CAST(trunc(i / n * 100) AS INT) || ',"message":"Đã hoàn thành (' || i || '/' || n || '): ' || f || '"}' || chr(10) || chr(10) AS line FROM d""")
def sse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sse(_progress(spark, sf_dir).filter("type = 'file_done'"))


@query("SELECT date_trunc('hour', ts) - to_minutes(CAST(m AS BIGINT)) + CASE WHEN minute(ts) >= 30 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END AS start, event_type AS current_state, count(*) AS n FROM events, unnest([0, 30]) AS t(m) GROUP BY ALL")
def sliding_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in hours that begin every half hour."""
    found = ingest.windowed_status(_table(spark, sf_dir, "events"), "event_type", "ts", "1 hour", slide="30 minutes")
    return found.select(F.col("window.start").alias("start"), "current_state", "n")


@query("""WITH e AS (SELECT event_type AS s, ts, ts > lag(ts) OVER w + INTERVAL 20 MINUTE OR lag(ts) OVER w IS NULL AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY s ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT s AS current_state, min(ts) AS start, count(*) AS n FROM g GROUP BY s, k""")
def session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in runs of events that are at most twenty minutes apart."""
    found = ingest.session_status(_table(spark, sf_dir, "events"), "event_type", "ts", "20 minutes")
    return found.select("current_state", F.col("session.start").alias("start"), "n")


@query("SELECT event_type AS current_state, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def deduplicated_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of events of which repeated ones are left out."""
    once = ingest.deduplicated(_table(spark, sf_dir, "events"), "ts", "event_type", "user_id")
    return ingest.stream_status(once, "event_type")
