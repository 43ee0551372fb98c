"""Knowledge packages: buckets, summary, index, manifest, report and archive.

Documents (filename, ordinal, metadata, sections, validation, warnings, counts)
stay tables; each artifact is one ordered aggregation over per-document strings
that are rendered in the plan. The archive writer streams entries to one file.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_nonempty, stem
from ..operators.numbering import number_rows
from ..sources.files import stored


def bucketed(docs: DataFrame) -> DataFrame:
    """``bucket``: ready, failed, or unvalidated for documents that never reached the gate."""
    safe = F.col("validation.is_safe_for_ai")
    return docs.withColumn("bucket", F.when(safe, "ready").when(~safe, "failed").otherwise("unvalidated"))


def summary(docs: DataFrame) -> DataFrame:
    """One row: total, ready, failed, unvalidated and warning counts, single mode and overall status."""
    d, n = bucketed(docs), lambda c: F.count_if(c).cast("long")
    ready, failed = F.col("bucket") == "ready", F.col("bucket") == "failed"
    doubtful = ready & (F.col("validation.status") == "WARNING")
    found = d.agg(F.count("*").alias("total_documents"), n(ready).alias("ready_count"), n(failed).alias("failed_count"), n(F.col("bucket") == "unvalidated").alias("unvalidated_count"), n(doubtful).alias("warning_count"))
    status = F.when(F.col("failed_count") > 0, "FAIL").when(F.col("warning_count") > 0, "WARNING").otherwise("PASS")
    return found.withColumns({"is_single_mode": F.col("ready_count") == 1, "overall_status": status})


def named(docs: DataFrame) -> DataFrame:
    """``md_name``: the Markdown file's name; names of equal stems get a number."""
    w = Window.partitionBy("stem").orderBy("ordinal")
    d = docs.withColumn("stem", stem(F.col("filename")))
    d = d.withColumn("__n", F.row_number().over(w))
    return d.withColumn("md_name", F.concat("stem", F.when(F.col("__n") > 1, F.concat(F.lit("-"), F.col("__n").cast("string"))).otherwise(""), F.lit(".md"))).drop("__n", "stem")


def _ordered(item: Column, sep: str = "\n", *order: str) -> Column:
    """Aggregate: strings joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*(order or ("ordinal",)), item.alias("s")))), lambda x: x["s"]), sep)


def _date() -> Column:
    return first_nonempty(F.col("metadata.issued_date"), F.col("metadata.effective_date"))


# The wording of the artifacts.
KB_NAME = "VNPT-AI-Knowledge-Base"
INDEX_GUIDE = """# MASTER INDEX

## Hướng dẫn sử dụng

Đây là bản đồ điều hướng của Knowledge Base.

Khi trả lời câu hỏi:
1. Xác định tài liệu liên quan từ Master Index.
2. Truy xuất nội dung từ tài liệu Markdown gốc.
3. Không sử dụng Master Index thay cho tài liệu gốc để kết luận.
4. Nếu có nhiều phiên bản, ưu tiên tài liệu có hiệu lực, thẩm quyền và thời gian phù hợp nếu có đủ căn cứ.
5. Nếu không xác định được tài liệu hiện hành, không tự suy đoán.

## Danh mục tài liệu

| ID | Tài liệu | Loại | Phiên bản | Trạng thái | Ngày | File |
|---|---|---|---|---|---|---|
"""
INDEX_TREES = "\n\n---\n\n## Chi tiết cấu trúc mục lục từng tài liệu\n\n"
REPORT_HEAD = """# CONVERSION QUALITY REPORT

Báo cáo kiểm định chất lượng chuyển đổi tài liệu sang Markdown phục vụ AI Knowledge Base.

## 1. Ma trận tổng quan

| Tệp nguồn | Kết quả | Số trang | Số đề mục | Text Retention | Thư mục lưu | Cảnh báo |
|---|---|---:|---:|---:|---|---|
"""
REPORT_DETAILS = "\n\n---\n\n## 2. Chi tiết kiểm định từng tài liệu\n\n"
README = """======================================================================
  HƯỚNG DẪN SỬ DỤNG KNOWLEDGE PACKAGE CHO AI (CHATGPT / RAG)
======================================================================

{mode}
Tổng tài liệu đã xử lý: {total}
Số tài liệu sẵn sàng nạp AI: {ready}{failed}

CÁCH SỬ DỤNG:
1. Mở thư mục 'upload_to_ai/'.
2. Chọn TOÀN BỘ file trong thư mục 'upload_to_ai/'.
3. Upload trực tiếp vào Knowledge/File Library của ChatGPT hoặc hệ thống RAG.
   {upload}

KHÔNG CẦN UPLOAD CÁC THƯ MỤC SAU:
- source/    : Lưu trữ file nguồn gốc (.docx, .pdf, .xlsx, .doc, .xls...).
- technical/ : Chứa manifest.json, conversion_report.md và file lỗi nếu có.
- assets/    : Lưu trữ hình ảnh trích xuất từ tài liệu.

QUY TẮC:
Mọi file trong 'upload_to_ai/' đều đã qua Quality Gate, chuẩn hóa UTF-8 NFC,
có YAML metadata trung thực, bảo toàn Heading và định danh Section ID.
"""


def index_rows(docs: DataFrame) -> DataFrame:
    """filename, ordinal, row (of the index table) and tree (of sections) for each document.

    A document without an id is named by ``idx``, its place in the index, if there is such a column.
    """
    m = "metadata"
    name = F.concat(F.lit("[`"), F.col("md_name"), F.lit("`]("), F.col("md_name"), F.lit(")"))
    doc_id = F.coalesce(F.nullif(F.col(f"{m}.document_id"), F.lit("")), F.format_string("DOC-%02d", "idx") if "idx" in docs.columns else F.lit("DOC"))
    title = first_nonempty(F.col(f"{m}.title"), F.col("filename"))
    cells = [F.concat(F.lit("**"), doc_id, F.lit("**")), title, F.coalesce(f"{m}.document_type", F.lit("Other")), F.coalesce(f"{m}.version", F.lit("")), F.coalesce(f"{m}.document_status", F.lit("")), _date(), name]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    facts = [("**Phiên bản:** ", F.col(f"{m}.version"), ""), ("**Trạng thái:** ", F.col(f"{m}.document_status"), ""), ("**Ngày ban hành / hiệu lực:** ", _date(), ""), ("**Mã băm SHA-256:** `", F.col(f"{m}.source_sha256"), "`")]
    said = F.array_compact(F.array(*[F.when(c != "", F.concat(F.lit(f"- {a}"), c, F.lit(b))) for a, c, b in facts]))
    page = lambda s: F.coalesce(F.concat(F.lit(" *(Trang "), F.nullif(s["source_page_start"], F.lit(0)).cast("string"), F.lit(")*")), F.lit(""))
    item = lambda s: F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), s["level"] - 1)), F.lit("- ["), s["heading"], F.lit("]("), F.col("md_name"), F.lit("#"), s["id"], F.lit(")"), page(s))
    tree = F.when(F.size("sections") > 0, F.transform("sections", item)).otherwise(F.array(F.lit("- *(Văn bản liền mạch không chia phân đoạn)*")))
    head = F.array(F.concat(F.lit("### "), doc_id, F.lit(" — "), title), F.concat(F.lit("**File:** `"), F.col("md_name"), F.lit("`")))
    whole = F.array_join(F.concat(head, said, F.array(F.lit("\n#### Cấu trúc đề mục:")), tree, F.array(F.lit("\n"))), "\n")
    return named(docs).select("filename", "ordinal", row.alias("row"), whole.alias("tree"))


def numbered(docs: DataFrame) -> DataFrame:
    """``idx``: the place of a document in the index."""
    return number_rows(docs, "ordinal", out="idx")[0]


def master_index(docs: DataFrame, generated_at: str) -> DataFrame:
    """One row ``content``; none if fewer than two documents are ready."""
    rows = index_rows(numbered(bucketed(docs).filter("bucket = 'ready'")))
    found = rows.agg(F.count("*").alias("n"), _ordered(F.col("row")).alias("rows"), _ordered(F.col("tree")).alias("trees"))
    head = F.concat(F.lit(f'---\nknowledge_base_schema: "1.0"\ngenerated_at: "{generated_at}"\ndocument_count: '), F.col("n").cast("string"), F.lit("\n---\n\n" + INDEX_GUIDE))
    return found.filter("n >= 2").select(F.rtrim(F.regexp_replace(F.concat(head, F.col("rows"), F.lit(INDEX_TREES), F.col("trees")), r"\s+$", "")).alias("content"))


def manifest_items(docs: DataFrame) -> DataFrame:
    """filename, ordinal, bucket and item (JSON) for each document."""
    m, v = "metadata", "validation"
    where = lambda folder: F.concat(F.lit(folder), F.col("md_name"))
    sections = F.transform("sections", lambda s: F.struct(s["id"].alias("id"), s["heading"].alias("heading"), s["level"].alias("level"), s["source_page_start"].alias("page_start"), s["source_page_end"].alias("page_end")))
    ready = F.struct(
        F.col(f"{m}.document_id").alias("document_id"), F.col("filename").alias("source_file"), where("upload_to_ai/").alias("markdown_file"), F.col(f"{m}.source_sha256").alias("sha256"),
        F.col(f"{m}.title").alias("title"), F.col(f"{m}.document_type").alias("document_type"), F.col(f"{m}.version").alias("version"), F.col(f"{m}.document_status").alias("status"),
        F.col(f"{m}.issued_date").alias("issued_date"), F.col(f"{m}.effective_date").alias("effective_date"), F.col("pages_total").alias("page_count"), "word_count", "character_count",
        F.col(f"{m}.text_retention_ratio").alias("retention_ratio"), F.col(f"{v}.status").alias("validation_status"), F.lit(True).alias("is_safe_for_ai"), sections.alias("sections"),
    )
    failed = F.struct(F.col("filename").alias("source_file"), where("technical/failed/").alias("markdown_file"), F.col(f"{m}.source_sha256").alias("sha256"), F.lit("FAIL").alias("validation_status"), F.lit(False).alias("is_safe_for_ai"), F.col(f"{v}.errors").alias("errors"))
    return named(bucketed(docs).filter("bucket <> 'unvalidated'")).select("filename", "ordinal", "bucket", F.when(F.col("bucket") == "ready", F.to_json(ready, {"ignoreNullFields": "false"})).otherwise(F.to_json(failed, {"ignoreNullFields": "false"})).alias("item"))


def manifest(docs: DataFrame, generated_at: str, kb_name: str = KB_NAME) -> DataFrame:
    """One row ``content``: the manifest as JSON."""
    of = lambda b: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.struct("ordinal", "item")))), lambda x: x["item"]), ","), F.lit("]"))
    found = manifest_items(docs).agg(F.count("*").alias("n"), F.count_if(F.col("bucket") == "ready").alias("ready"), of("ready").alias("documents"), of("failed").alias("failed"))
    head = F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.lit(kb_name).alias("knowledge_base"), F.lit(generated_at).alias("generated_at"), F.col("n").alias("total_documents"), F.col("ready").alias("ready_for_ai_count"), (F.col("n") - F.col("ready")).alias("failed_count")))
    return found.select(F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"documents":'), F.col("documents"), F.lit(',"failed_documents":'), F.col("failed"), F.lit("}")).alias("content"))


def manifest_lines(docs: DataFrame, generated_at: str, kb_name: str = KB_NAME) -> DataFrame:
    """place, ordinal, line: the manifest with one line for each document, of any number; in order the lines are its JSON."""
    items = manifest_items(docs)
    part = F.when(F.col("bucket") == "ready", 1).otherwise(3)
    first = items.groupBy(part.alias("place")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    # Two rows at most.
    found = {r["place"]: r for r in first.collect()}
    ready, failed = (found[p]["n"] if p in found else 0 for p in (1, 3))
    head = json.dumps({"schema_version": "1.0", "knowledge_base": kb_name, "generated_at": generated_at, "total_documents": ready + failed, "ready_for_ai_count": ready, "failed_count": failed}, ensure_ascii=False, separators=(",", ":"))
    starts = F.lit(False)
    for p, r in found.items():
        starts = starts | ((part == p) & (F.col("ordinal") == F.lit(r["first"])))
    rows = items.select(part.alias("place"), "ordinal", F.concat(F.when(starts, "").otherwise(","), "item").alias("line"))
    edges = [(0, head[:-1] + ',"documents":['), (2, '],"failed_documents":['), (4, "]}")]
    frame = docs.sparkSession.createDataFrame(edges, "place int, line string").select("place", F.lit(None).cast(rows.schema["ordinal"].dataType).alias("ordinal"), "line")
    return rows.unionByName(frame)


def index_lines(docs: DataFrame, generated_at: str) -> DataFrame:
    """place, ordinal, line: the master index in lines, for any number of documents; none if fewer than two are ready."""
    ready = stored(index_rows(numbered(bucketed(docs).filter("bucket = 'ready'"))))
    n = ready.count()
    edges = [(0, f'---\nknowledge_base_schema: "1.0"\ngenerated_at: "{generated_at}"\ndocument_count: {n}\n---\n\n{INDEX_GUIDE}'.removesuffix("\n")), (2, INDEX_TREES.removeprefix("\n").removesuffix("\n"))]
    frame = docs.sparkSession.createDataFrame(edges, "place int, line string").select("place", F.lit(None).cast(ready.schema["ordinal"].dataType).alias("ordinal"), "line")
    rows = ready.select(F.lit(1).alias("place"), "ordinal", F.col("row").alias("line")).unionByName(ready.select(F.lit(3).alias("place"), "ordinal", F.col("tree").alias("line")))
    return rows.unionByName(frame) if n >= 2 else rows.limit(0)


def report_lines(docs: DataFrame) -> DataFrame:
    """place, ordinal, line: the report in lines, for any number of documents."""
    found = report_rows(docs)
    edges = [(0, REPORT_HEAD.removesuffix("\n")), (3, REPORT_DETAILS.removeprefix("\n").removesuffix("\n"))]
    frame = docs.sparkSession.createDataFrame(edges, "place int, line string").select("place", F.lit(None).cast(found.schema["ordinal"].dataType).alias("ordinal"), "line")
    rows = found.select((F.col("part") + 1).alias("place"), "ordinal", F.col("row").alias("line")).unionByName(found.select((F.col("part") + 4).alias("place"), "ordinal", F.col("detail").alias("line")))
    return rows.unionByName(frame)


def write_lines(lines: DataFrame, target: str) -> None:
    """Lines as text files whose names are in order: end to end they are the artifact."""
    lines.orderBy("place", "ordinal").select("line").write.mode("overwrite").text(target)


def indented(json_rows: DataFrame) -> DataFrame:
    """One-row ``content`` as JSON with indents of two, other letters as they are."""

    def run(batches):
        for batch in batches:
            made = [json.dumps(json.loads(x), ensure_ascii=False, indent=2) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["content"])

    return json_rows.select("content").mapInArrow(run, "content string")


def all_notes(docs_warnings: Column, validation: Column) -> Column:
    """Distinct warnings and errors of a document, in the order in which they came up."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(x, empty) for x in (docs_warnings, validation["warnings"], validation["errors"])]))


def report_rows(docs: DataFrame) -> DataFrame:
    """filename, place, row (of the matrix) and detail; ready documents come before failed ones."""
    v = F.col("validation")
    badge = F.when(v["status"] == "PASS", "✅ PASS").when(v["status"] == "WARNING", "⚠️ WARNING").otherwise("❌ FAIL")
    folder = F.when(v["is_safe_for_ai"], "`upload_to_ai/`").otherwise("`technical/failed/`")
    n = F.size("warnings") + F.size(v["warnings"])
    cells = [F.concat(F.lit("`"), F.col("filename"), F.lit("`")), badge, F.col("pages_total").cast("string"), F.size("sections").cast("string"), F.concat((F.col("metadata.text_retention_ratio") * 100).cast("int").cast("string"), F.lit("%")), folder, F.when(n > 0, F.concat(n.cast("string"), F.lit(" cảnh báo"))).otherwise("0")]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    icon = lambda c: F.when(c["passed"], "✅").when(v["is_safe_for_ai"], "⚠️").otherwise("❌")
    checks = F.transform(v["checks"], lambda c: F.concat(F.lit("- "), icon(c), F.lit(" **"), c["name"], F.lit(":** "), c["message"]))
    notes = all_notes(F.col("warnings"), v)
    said = F.when(F.size(notes) > 0, F.concat(F.array(F.lit("\n**Ghi chú & Cảnh báo:**")), F.transform(notes, lambda w: F.concat(F.lit("  - ⚠️ "), w)))).otherwise(F.array().cast("array<string>"))
    detail = F.array_join(F.concat(F.array(F.concat(F.lit("### 📋 `"), F.col("filename"), F.lit("`"))), checks, said, F.array(F.lit("\n"))), "\n")
    return bucketed(docs).filter("bucket <> 'unvalidated'").select("filename", F.when(F.col("bucket") == "ready", 0).otherwise(1).alias("part"), "ordinal", row.alias("row"), detail.alias("detail"))


def conversion_report(docs: DataFrame) -> DataFrame:
    """One row ``content``."""
    order = ("part", "ordinal")
    found = report_rows(docs).agg(_ordered(F.col("row"), "\n", *order).alias("rows"), _ordered(F.col("detail"), "\n", *order).alias("details"))
    return found.select(F.regexp_replace(F.concat(F.lit(REPORT_HEAD), F.col("rows"), F.lit(REPORT_DETAILS), F.col("details")), r"\s+$", "").alias("content"))


def readme(total: int, ready: int, failed: int) -> str:
    single = ready == 1
    mode = "Chế độ: 1 tài liệu đơn lẻ (Single Document Mode)." if single else f"Chế độ: Knowledge Pack ({ready} tài liệu)."
    upload = "Upload file .md duy nhất trong thư mục 'upload_to_ai/'." if single else "Upload '00_Master_Index.md' và toàn bộ các file .md trong thư mục 'upload_to_ai/'."
    note = f"\nLƯU Ý: Có {failed} file không đạt Quality Gate đã được chuyển sang 'technical/failed/'.\n" if failed else ""
    return README.format(mode=mode, total=total, ready=ready, failed=note, upload=upload)


#: Documents whose items are objects at a time; lines of a piece, as a power of two.
ITEMS, PIECE = 500, 10


def slices(batch: pa.RecordBatch, column: str, rows: int = ITEMS, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows and, but for single rows beyond that, of few bytes in a column: so few of them are objects at a time."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if i > start and (i - start >= rows or size + (n or 0) > most):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if batch.num_rows:
        yield batch.slice(start)


def _indented_items(items: DataFrame) -> DataFrame:
    """``line`` as an element of an indented list, one document at a time."""

    def run(batches):
        for whole in batches:
            at = whole.schema.get_field_index("line")
            for batch in slices(whole, "line"):
                made = [json.dumps(json.loads(x), ensure_ascii=False, indent=2).replace("\n", "\n    ") for x in batch.column(at).to_pylist()]
                yield batch.set_column(at, "line", pa.array(["    " + x for x in made], pa.string()))

    return items.mapInArrow(run, items.schema)


def _pieces(lines: DataFrame, path: str) -> DataFrame:
    """path, part and content: lines (place, ordinal, line) end to end, in pieces of at most 2 ** PIECE lines, in their order."""
    dealt = lines.repartitionByRange("place", "ordinal").sortWithinPartitions("place", "ordinal").withColumn("id", F.monotonically_increasing_id())
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "")
    found = dealt.groupBy(F.shiftright("id", PIECE).alias("part")).agg(joined.cast("binary").alias("content"))
    return found.select(F.lit(path).alias("path"), "part", "content").orderBy("part")


def own_pieces(docs: DataFrame, generated_at: str, kb_name: str = KB_NAME) -> list[DataFrame]:
    """path, part and content of the index (from two ready documents on), the manifest, the report and the readme.

    Each is made in pieces, so none has to fit into one row or one task; ``part`` is their order.
    """
    spark = docs.sparkSession
    # One row for each of three buckets.
    found = {r["bucket"]: r for r in bucketed(docs).groupBy("bucket").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last")).collect()}
    n = {b: found[b]["n"] if b in found else 0 for b in ("ready", "failed", "unvalidated")}
    place, at = F.col("place"), F.col("ordinal")
    frame = lambda edges: spark.createDataFrame(edges, "place int, line string").select("place", F.lit(None).cast(docs.schema["ordinal"].dataType).alias("ordinal"), "line")
    # What comes last has no blanks at its end.
    ended = lambda lines, p, last: lines.select("place", "ordinal", F.concat(F.when(place == 0, "").when((place == 3) & F.lit(last is None), "\n\n").otherwise("\n"), F.when((place == p) & (F.lit(True) if last is None else at == F.lit(last)), F.regexp_replace("line", r"\s+$", "")).otherwise(F.col("line"))).alias("line"))
    out = []
    if n["ready"] >= 2:
        out.append(_pieces(ended(index_lines(docs, generated_at), 3, found["ready"]["last"]), "upload_to_ai/00_Master_Index.md"))
    items = manifest_items(docs).select(F.when(F.col("bucket") == "ready", 1).otherwise(3).alias("place"), "ordinal", F.col("item").alias("line"))
    starts = F.lit(False)
    for p, b in ((1, "ready"), (3, "failed")):
        starts = starts | ((place == p) & (at == F.lit(found[b]["first"]))) if n[b] else starts
    items = _indented_items(items).select("place", "ordinal", F.concat(F.when(starts, "\n").otherwise(",\n"), "line").alias("line"))
    head = json.dumps({"schema_version": "1.0", "knowledge_base": kb_name, "generated_at": generated_at, "total_documents": n["ready"] + n["failed"], "ready_for_ai_count": n["ready"], "failed_count": n["failed"]}, ensure_ascii=False, indent=2)
    edges = [(0, head[:-2] + ',\n  "documents": ['), (2, ("\n  " if n["ready"] else "") + '],\n  "failed_documents": ['), (4, ("\n  " if n["failed"] else "") + "]\n}")]
    out.append(_pieces(items.unionByName(frame(edges)), "technical/manifest.json"))
    p, last = next(((p, found[b]["last"]) for p, b in ((5, "failed"), (4, "ready")) if n[b]), (3, None))
    out.append(_pieces(ended(report_lines(docs), p, last), "technical/conversion_report.md"))
    said = readme(sum(n.values()), n["ready"], n["failed"])
    out.append(spark.createDataFrame([("README.txt", said)], "path string, content string").select("path", F.lit(None).cast("long").alias("part"), F.col("content").cast("binary").alias("content")))
    return out


def document_entries(docs: DataFrame, files: DataFrame) -> DataFrame:
    """path and content of the documents of a package and of their sources."""
    body = named(bucketed(docs)).filter("bucket <> 'unvalidated'").select(F.concat(F.when(F.col("bucket") == "ready", "upload_to_ai/").otherwise("technical/failed/"), F.col("md_name")).alias("path"), F.col("markdown").cast("binary").alias("content"))
    return body.unionByName(files.select(F.concat(F.lit("source/"), F.col("filename")).alias("path"), F.col("content").cast("binary").alias("content")))


def entries(docs: DataFrame, files: DataFrame, generated_at: str, kb_name: str = KB_NAME) -> DataFrame:
    """path, part and content (binary) of every file of a package; ``files`` has filename and content of the sources.

    Documents and sources are one row each, without ``part``; index, manifest and report may be several, one after the other.
    """
    *own, text = own_pieces(docs, generated_at, kb_name)
    out = document_entries(docs, files).select("path", F.lit(None).cast("long").alias("part"), "content")
    for p in (*own, text):
        out = out.unionByName(p)
    return out


def batch_entries(docs: DataFrame) -> DataFrame:
    """path and content of one Markdown file for each document, without package files."""
    return named(docs).select(F.col("md_name").alias("path"), F.col("markdown").cast("binary").alias("content"))


def write_folder(found: DataFrame, target: str) -> None:
    """Entries as a table, one folder for each top folder of the package; of any size."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("root")
    found.withColumn("folder", top).write.partitionBy("folder").mode("overwrite").parquet(target)


def write_zip(rows: Iterable, target) -> None:
    """Entries, one after the other, to a ZIP archive with UTF-8 names; those of one path that have a ``part`` are one file."""
    out, now = None, None
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        try:
            for r in rows:
                part = r["part"] if "part" in r else None
                if out is None or part is None or r["path"] != now:
                    if out is not None:
                        out.close()
                    info = zipfile.ZipInfo(r["path"])
                    info.flag_bits |= 0x800
                    info.compress_type = zipfile.ZIP_DEFLATED
                    out, now = z.open(info, "w", force_zip64=part is not None or len(r["content"]) > zipfile.ZIP64_LIMIT // 2), r["path"]
                out.write(bytes(r["content"]))
        finally:
            if out is not None:
                out.close()


def package_zip(found: DataFrame) -> bytes:
    """The archive of a package of a size that one machine can hold; entries stream in."""
    buffer = io.BytesIO()
    write_zip(found.toLocalIterator(), buffer)
    return buffer.getvalue()
