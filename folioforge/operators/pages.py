"""Pages: which need text recognition, how they are written, and what a document's pages add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dense_chars, marked_letters, plain_letters, strip, strip_watermark

MIN_CHARS, IMAGE_SHARE, MIN_LETTERS, MARKED_SHARE, PURE_SHARE, LOW_CONFIDENCE, LINE_HEIGHT = 50, 0.60, 20, 0.05, 0.5, 0.6, 14


def recognition_rule(chars: Column, letters: Column, marked: Column, image_page: Column, min_chars: int = MIN_CHARS, marked_share: float = MARKED_SHARE) -> Column:
    """True for pages to recognise: too few characters, or on image pages a text layer in the wrong script."""
    corrupt = (letters > MIN_LETTERS) & (marked / letters < marked_share)
    return F.when(image_page, (chars < min_chars) | F.coalesce(corrupt, F.lit(False)) | (chars == 0)).otherwise(chars < min_chars)


def needs_ocr(text: Column, image_share: Column, bbox_error: Column, **limits) -> Column:
    """:func:`recognition_rule` over a text layer and the largest image's share of the page."""
    clean = strip_watermark(text)
    image_page = F.coalesce(image_share > IMAGE_SHARE, F.lit(False)) | F.coalesce(bbox_error, F.lit(False))
    return recognition_rule(dense_chars(clean), plain_letters(clean), marked_letters(clean), image_page, **limits)


def recognised_page(text: Column, engine: Column) -> Column:
    banner = F.concat(F.lit("> [Extracted from image via "), F.upper(engine), F.lit("]\n"), text)
    return F.when(F.coalesce(text, F.lit("")) == "", "*(Trang quét ảnh trống)*").otherwise(banner)


def page_body(number: Column, text: Column) -> Column:
    return F.concat(F.lit("<!-- source_page: "), number.cast("string"), F.lit(" -->\n\n"), strip(F.coalesce(text, F.lit(""))))


def merge_pages(pages: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, body, raw, pages_total, pages_ocr, is_pure_ocr from pages (page_number, text, raw, is_ocr).

    Parts are collected per document, which its own file bounds.
    """
    part = F.struct("page_number", page_body(F.col("page_number"), F.col("text")).alias("body"), F.coalesce("raw", F.lit("")).alias("raw"))
    found = pages.groupBy(doc_id).agg(F.array_sort(F.collect_list(part)).alias("p"), F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list(F.when(F.col("is_ocr"), F.col("page_number")))).alias("pages_ocr"))
    total = F.greatest(F.lit(1), F.col("n"))
    return found.select(
        doc_id, F.array_join(F.transform("p", lambda x: x["body"]), "\n\n---\n\n").alias("body"), F.array_join(F.transform("p", lambda x: x["raw"]), "\n").alias("raw"),
        total.alias("pages_total"), "pages_ocr", is_pure_ocr(F.size("pages_ocr"), total).alias("is_pure_ocr"),
    )


def is_pure_ocr(ocr_pages: Column, pages_total: Column) -> Column:
    return (ocr_pages > 0) & (ocr_pages >= pages_total * PURE_SHARE)


def word_confidence(conf: Column, word: Column) -> Column:
    """Aggregate: mean confidence (of 100) of words that aren't blank and have one, as a share; 1.0 without any."""
    valid = F.when((strip(word) != "") & (conf >= 0), conf)
    return F.round(F.coalesce(F.avg(valid) / 100, F.lit(1.0)), 2)


def box_confidence(score: Column) -> Column:
    """Aggregate: mean score of boxes; 1.0 without any."""
    return F.round(F.coalesce(F.avg(score), F.lit(1.0)), 2)


def reading_line(y: Column) -> Column:
    """The text line of a box: its top, to whole line heights (halves to even)."""
    return F.bround(y / LINE_HEIGHT) * LINE_HEIGHT


def reading_order(boxes: DataFrame, *keys: str) -> DataFrame:
    """keys and text: boxes (x, y, ord, text) joined in reading order."""
    item = F.struct(reading_line(F.col("y")).alias("line"), "x", "ord", "text")
    return boxes.filter(strip(F.col("text")) != "").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda b: b["text"]), "\n").alias("text"))


def low_confidence_warning(number: Column, conf: Column) -> Column:
    said = F.concat(F.lit("Trang "), number.cast("string"), F.lit(": Độ tin cậy OCR ("), (conf * 100).cast("int").cast("string"), F.lit("%)."))
    return F.when(conf < LOW_CONFIDENCE, said)
