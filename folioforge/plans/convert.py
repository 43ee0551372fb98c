"""Conversion: files to Markdown documents with metadata, sections and gate result, one row per file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_boundaries, normalize_encoding, strip, strip_text, word_count
from ..operators import metadata as M
from ..operators.cleaning import process_recognised
from ..operators.pages import low_confidence_warning, merge_pages, needs_ocr, recognised_page
from ..operators.quality import with_gate
from ..operators.structure import anchored, format_structure, sections
from ..operators.tables import drop_empty_rows, markdown_table
from ..sources import decoders as D
from ..sources.files import stored

# Capitals that open a numbered heading.
CAPITALS = "A-ZĐÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴ"


def paragraph_markdown(style: Column, text: Column) -> Column:
    """A paragraph by its style, else by its numbering."""
    mark = None
    for n in range(1, 6):
        fits = style.contains(f"heading {n}") | style.contains(f"tiêu đề {n}")
        mark = F.when(fits, "#" * n) if mark is None else mark.when(fits, "#" * n)
    listed = style.contains("list") | style.contains("bullet")
    mark = mark.when(listed, "-").when(text.rlike(rf"(?U)^\d+\.\s+[{CAPITALS}]"), "##").when(text.rlike(r"(?U)^\d+\.\d+\.\s+"), "###").when(text.rlike(r"(?U)^\d+\.\d+\.\d+\.\s+"), "####")
    return F.when(style == "verbatim", text).when(mark == "-", F.concat(F.lit("- "), text)).when(mark.isNotNull(), F.concat(F.lit("\n"), mark, F.lit(" "), text, F.lit("\n"))).otherwise(F.concat(text, F.lit("\n")))


def blocks_markdown(filename: Column, kind: Column, blocks: Column) -> tuple[Column, Column]:
    """Markdown and source text of a file's blocks."""
    table = lambda b: F.concat(F.lit("\n"), markdown_table(b["rows"]), F.lit("\n"))
    body = F.transform(blocks, lambda b: F.when(b["kind"] == "table", table(b)).otherwise(paragraph_markdown(b["style"], b["text"])))
    docx = strip_text(F.array_join(body, "\n"))
    raw = strip_text(F.array_join(F.flatten(F.transform(blocks, lambda b: F.when(b["kind"] == "table", F.flatten(b["rows"])).otherwise(F.array(b["text"])))), "\n"))
    # Rows that aren't empty are worked out once for the test and the table.
    kept = F.transform(blocks, lambda b: F.struct(b["text"].alias("text"), drop_empty_rows(b["rows"]).alias("rows")))
    filled = F.filter(kept, lambda b: F.size(b["rows"]) > 0)
    sheet = lambda b: F.concat(F.lit("## Sheet: "), b["text"], F.lit("\n\n"), markdown_table(b["rows"]), F.lit("\n\n"))
    xlsx = strip(F.array_join(F.concat(F.array(F.concat(F.lit("# File: "), filename, F.lit("\n"))), F.transform(filled, sheet)), "\n"))
    # The text of a workbook is its Markdown.
    is_book = kind == "xlsx"
    return F.when(is_book, xlsx).otherwise(docx), F.when(is_book, xlsx).otherwise(raw)


def recognise(pages: DataFrame, engine_name: str, engines: dict | None = None) -> DataFrame:
    """Pages (doc_id, page_number, text_layer, max_image_area_ratio, image_bbox_error, image) with text, raw, is_ocr, needs_ocr and warning.

    Only pages that need it go through the engine: they are filtered out first and united again.
    """
    rule = needs_ocr(F.col("text_layer"), F.col("max_image_area_ratio"), F.col("image_bbox_error"))
    pages = pages.withColumn("needs_ocr", rule)
    text = pages.filter(~F.col("needs_ocr")).select("doc_id", "page_number", F.col("text_layer").alias("text"), F.col("text_layer").alias("raw"), F.lit(False).alias("needs_ocr"), F.lit(None).cast("string").alias("warning"))
    run = D.engine(engine_name, engines)

    @F.pandas_udf("ocr_text string, confidence double, error string")
    def read(image: pd.Series) -> pd.DataFrame:
        out = []
        for x in image:
            try:
                if run is None:
                    raise RuntimeError("no engine for text recognition is installed")
                said, conf = run(bytes(x) if x is not None else b"")
                out.append((said or "", conf, None))
            except Exception as e:  # noqa: BLE001  a page that can't be read keeps its text layer
                out.append((None, None, str(e) or type(e).__name__))
        return pd.DataFrame(out, columns=["ocr_text", "confidence", "error"])

    found = pages.filter("needs_ocr").withColumn("r", read("image")).select("doc_id", "page_number", F.coalesce("text_layer", F.lit("")).alias("text_layer"), "r.*")
    back = (strip(F.coalesce("ocr_text", F.lit(""))) == "") & (strip(F.col("text_layer")) != "") & F.col("error").isNull()
    found = process_recognised(found.withColumn("back", back), "text_layer", "clean_layer")
    said, page = F.when(F.col("back"), F.col("clean_layer")).otherwise(F.col("ocr_text")), F.col("page_number")
    failed = F.col("error").isNotNull()
    own = F.when(failed, F.concat(F.lit("Lỗi OCR tại trang "), page.cast("string"), F.lit(": "), F.col("error")))
    own = own.when(F.col("back"), F.concat(F.lit("Trang "), page.cast("string"), F.lit(": OCR không trích xuất được chữ, tự động sử dụng lớp văn bản (text layer) có sẵn.")))
    own = own.otherwise(low_confidence_warning(page, F.col("confidence")))
    shown = F.when(failed, F.coalesce(F.nullif("text_layer", F.lit("")), F.lit("*(Lỗi khi nhận diện hình ảnh/OCR)*"))).otherwise(recognised_page(said, F.lit(engine_name)))
    read_ = found.select("doc_id", "page_number", shown.alias("text"), F.when(failed, F.col("text_layer")).otherwise(said).alias("raw"), F.lit(True).alias("needs_ocr"), own.alias("warning"))
    return text.unionByName(read_)


def bodies(decoded: DataFrame, ocr_engine: str = "tesseract", engines: dict | None = None, store: bool = True) -> DataFrame:
    """filename, ordinal, sha256, body, raw, pages and warnings of decoded files.

    ``store``: work out recognised pages once instead of once for every branch that reads them.
    """
    if "source_sha256" not in decoded.columns:
        decoded = decoded.withColumn("source_sha256", F.sha2("content", 256)).drop("content")
    d = F.col("decoded")
    keep = ["filename", "ordinal", "source_sha256", "decoded"]
    md, raw = blocks_markdown(F.col("filename"), d["kind"], d["blocks"])
    none = F.array().cast("array<string>")
    flow = decoded.filter(d["kind"] != "pdf").select(*keep, md.alias("body"), raw.alias("raw"), F.lit(1).alias("pages_total"), F.array().cast("array<int>").alias("pages_ocr"), F.lit(False).alias("is_pure_ocr"), F.lit(False).alias("paginated"), none.alias("page_warnings"))
    paged = decoded.filter(d["kind"] == "pdf")
    pages = paged.select(F.col("ordinal").alias("doc_id"), F.inline(d["pages"]))
    # Recognition is the dearest step; two branches read its pages.
    read = recognise(pages, ocr_engine, engines)
    read = stored(read) if store else read
    merged = merge_pages(read.withColumn("is_ocr", F.col("needs_ocr")))
    noted = read.filter("warning is not null").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "warning"))), lambda x: x["warning"]).alias("page_warnings"))
    whole = paged.select(*keep).join(merged, F.col("ordinal") == merged["doc_id"]).drop("doc_id").join(noted, F.col("ordinal") == noted["doc_id"], "left").drop("doc_id")
    whole = whole.select(*keep, "body", "raw", "pages_total", "pages_ocr", "is_pure_ocr", F.lit(True).alias("paginated"), F.coalesce("page_warnings", none).alias("page_warnings"))
    return flow.unionByName(whole)


def documents(bodies_: DataFrame, conversion_date: str, **meta_options) -> DataFrame:
    """Documents with markdown, metadata, sections, validation, warnings and counts.

    The stages are separated by plain columns, each computed once per row.
    """
    d = normalize_encoding(bodies_, "body", "raw")
    d = d.withColumn("formatted", format_structure(F.col("body")))
    d = d.withColumn("sections", sections(F.col("formatted")))
    d = d.withColumn("clean", clean_boundaries(anchored(F.col("formatted"), F.col("sections"))))
    d, meta = M.with_metadata(d, "filename", "clean", "raw", "source_sha256", "pages_total", conversion_date, own_title=F.col("decoded.own_title"), first_heading=F.col("decoded.first_heading"), **meta_options)
    d = d.withColumn("markdown", F.concat(M.front_matter(meta), F.lit("\n"), F.col("clean")))
    d = with_gate(d, "markdown", meta, F.col("paginated"), F.col("is_pure_ocr"))
    own = F.array_compact(F.array(F.when(F.col("decoded.repaired"), F.lit("Tệp PDF bị lỗi cấu trúc đã được tự động sửa.")), F.when(F.col("decoded.error").isNotNull(), F.col("decoded.error"))))
    d = d.withColumn("warnings", F.array_distinct(F.concat(own, "page_warnings", F.col("validation.warnings"))))
    # A legacy file that no program could convert never reaches the gate.
    lost = F.col("decoded.error").isNotNull() & F.col("decoded.kind").isin("doc", "xls")
    error_doc = F.concat(F.lit("# Lỗi chuyển đổi\n\n"), F.col("decoded.error"))
    return d.select(
        "filename", "ordinal", meta["document_id"].alias("document_id"), F.col("decoded.converted_via_legacy").alias("converted_via_legacy"), F.when(lost, error_doc).otherwise(F.col("markdown")).alias("markdown"),
        F.when(~lost, M.as_struct(meta)).alias("metadata"), "sections", F.when(~lost, F.col("validation")).alias("validation"), "pages_total", "pages_ocr", "warnings",
        word_count(F.col("markdown")).alias("word_count"), F.length("markdown").cast("long").alias("character_count"), "source_sha256",
    )


def convert(files: DataFrame, conversion_date: str, decoders: dict | None = None, engines: dict | None = None, ocr_engine: str = "tesseract", legacy=D.legacy_with_office, **meta_options) -> DataFrame:
    """Documents from files (filename, ordinal, content)."""
    decoded = D.decode_files(files.select("filename", "ordinal", "content"), decoders, legacy)
    # Branches by kind read what is decoded once.
    decoded = stored(decoded.withColumn("source_sha256", F.sha2("content", 256)).drop("content"))
    return documents(bodies(decoded, ocr_engine, engines), conversion_date, **meta_options)
