"""Quality gate: checks, warnings, errors and status of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, strip_text

PASS_SHARE, WARN_SHARE, MIN_BODY, HASH_CHARS = 0.90, 0.75, 20, 64


def body_of(markdown: Column) -> Column:
    """The text after the front matter, if there is one."""
    rule = F.lit("---")
    end = F.position(rule, markdown, F.position(rule, markdown) + 3)
    return F.when(strip_text(markdown).startswith("---") & (end > 0), strip_text(markdown.substr(end + 3, F.lit(2**31 - 1)))).otherwise(markdown)


def with_gate(df: DataFrame, markdown: str, meta: Column | dict[str, Column], paginated: Column, pure_ocr: Column, out: str = "validation") -> DataFrame:
    """``df`` with struct ``out`` of status, is_safe_for_ai, checks (name, passed, message), warnings and errors.

    Each test of the text is a column first, so it runs once.
    """
    tests = text_tests(F.col(markdown), meta)
    d = df.withColumns({"__t_" + k: v for k, v in tests.items()})
    d = d.withColumn(out, _verdict({k: F.col("__t_" + k) for k in tests}, meta, paginated, pure_ocr))
    return d.drop(*["__t_" + k for k in tests])


def text_tests(markdown: Column, meta: Column | dict[str, Column]) -> dict[str, Column]:
    no_nul = ~markdown.contains("\x00")
    filled = F.length(strip_text(body_of(markdown))) > MIN_BODY
    named = (strip(meta["source_file"]) != "") & (strip(meta["title"]) != "")
    headed = markdown.contains("#") & markdown.rlike(r"(?mU)^#{1,6}\s+")
    s = strip_text(markdown)
    fenced = s.startswith("```") & s.endswith("```") & (F.regexp_count(s, F.lit("```")) == 2)
    base64 = markdown.rlike(r"data:image/[a-zA-Z]+;base64,[A-Za-z0-9+/=]{200,}")
    marked = markdown.contains("<!-- source_page:") | markdown.contains("<!-- Page")
    return {"no_nul": no_nul, "filled": filled, "named": named, "headed": headed, "fenced": fenced, "base64": base64, "marked": marked}


def _verdict(t: dict[str, Column], meta: Column | dict[str, Column], paginated: Column, pure_ocr: Column) -> Column:
    no_nul, filled, named, headed, fenced, base64, marked = (t[k] for k in ("no_nul", "filled", "named", "headed", "fenced", "base64", "marked"))
    long = paginated & (meta["page_count"] > 1)
    chars, ratio = meta["markdown_text_char_count"], meta["text_retention_ratio"]
    percent = F.concat((ratio * 100).cast("int").cast("string"), F.lit("%"))
    counts = F.concat(F.lit(" ("), chars.cast("string"), F.lit("/"), meta["source_text_char_count"].cast("string"), F.lit(" chars)"))
    read = chars > MIN_BODY
    hashed = F.length(meta["source_sha256"]) == HASH_CHARS

    def check(name: str, passed: Column, good, bad) -> Column:
        said = F.when(passed, good).otherwise(bad)
        return F.struct(F.lit(name).alias("name"), passed.alias("passed"), said.alias("message"))

    kept = F.when(ratio >= PASS_SHARE, F.concat(F.lit("Tỷ lệ bảo toàn ký tự xuất sắc: "), percent, counts)).otherwise(F.concat(F.lit("Tỷ lệ bảo toàn ký tự chấp nhận được: "), percent, counts))
    lost = F.concat(F.lit("CẢNH BÁO: Nghi ngờ mất nội dung nghiêm trọng ("), percent, F.lit(" < 75%)."))
    source = F.concat(F.lit("Source: "), meta["source_file"], F.lit(" | Title: "), meta["title"])
    # Names and messages of the checks, in order.
    checks = [
        (None, check("UTF-8 & Không chứa NULL byte", no_nul, "Đạt chuẩn Unicode NFC, không chứa NULL byte.", "Phát hiện NULL byte trong tài liệu.")),
        (None, check("Nội dung không rỗng", filled, "Tài liệu có nội dung đầy đủ.", "Tài liệu rỗng hoặc không có nội dung văn bản sau phần metadata.")),
        (None, check("Metadata source_file & title hợp lệ", named, source, source)),
        (None, check("Cấu trúc Heading hiện diện", headed, "Đã phát hiện phân cấp Heading.", "Không phát hiện Heading nào trong tài liệu.")),
        (None, check("Không bọc toàn bộ văn bản trong code fence", ~fenced, "Văn bản tự nhiên, không bị bọc code fence toàn phần.", "Tài liệu bị bao toàn bộ trong block code.")),
        (None, check("Không chứa chuỗi Base64 hình ảnh thô", ~base64, "Không có chuỗi base64 nhúng trực tiếp.", "Phát hiện chuỗi base64 dung lượng lớn trong văn bản.")),
        (long, check("Truy vết ranh giới trang (Page Markers)", marked, "Đã chèn marker định vị trang.", "Thiếu marker ranh giới trang.")),
        (pure_ocr, check("Tỷ lệ bảo toàn nội dung (OCR Image)", read, F.concat(F.lit("Tài liệu OCR trích xuất "), chars.cast("string"), F.lit(" ký tự.")), "Không trích xuất được ký tự nào từ tài liệu quét OCR.")),
        (~pure_ocr, check("Tỷ lệ bảo toàn nội dung (Retention Ratio)", ratio >= WARN_SHARE, kept, lost)),
        (None, check("Mã băm SHA-256 xác thực", hashed, F.concat(F.lit("SHA256: "), F.left(meta["source_sha256"], F.lit(16)), F.lit("...")), "Thiếu mã băm SHA256.")),
    ]
    errors = [
        (~no_nul, "Tài liệu chứa ký tự NULL byte không hợp lệ."), (~filled, "Tài liệu không có nội dung văn bản sau khi chuyển đổi."),
        (~named, "Thiếu thông tin source_file hoặc title trong metadata."), (fenced, "Toàn bộ văn bản bị bao trong khối code block ```text."),
        (pure_ocr & ~read, "FAILED: Quá trình OCR không trích xuất được nội dung ký tự nào từ trang ảnh."),
        (~pure_ocr & (ratio < WARN_SHARE), F.concat(F.lit("FAILED: Tỷ lệ ký tự quá thấp ("), percent, F.lit("), cần kiểm tra thủ công."))),
    ]
    warnings = [
        (~headed, "Tài liệu không có Heading phân cấp (chỉ có văn bản thuần)."), (base64, "Phát hiện dữ liệu ảnh Base64 thô trong Markdown."),
        (long & ~marked, "Tài liệu nhiều trang nhưng thiếu marker phân định trang."),
        (~pure_ocr & (ratio >= WARN_SHARE) & (ratio < PASS_SHARE), F.concat(F.lit("Tỷ lệ ký tự Markdown giảm nhẹ so với nguồn ("), percent, F.lit(")."))),
    ]
    some = lambda rows: F.array_compact(F.array(*[F.when(c, x if isinstance(x, Column) else F.lit(x)) for c, x in rows]))
    found = F.array_compact(F.array(*[c if when is None else F.when(when, c) for when, c in checks]))
    bad, doubtful = F.size(some(errors)) > 0, F.size(some(warnings)) > 0
    state = F.when(bad, "FAIL").when(doubtful, "WARNING").otherwise("PASS")
    return F.struct(state.alias("status"), (~bad).alias("is_safe_for_ai"), found.alias("checks"), some(warnings).alias("warnings"), some(errors).alias("errors"))
