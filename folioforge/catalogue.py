"""Registered queries over the driver's tables, each with equivalent DuckDB SQL where there is one.

Language-specific operators work on letters and decisions made from ``orders``; the
SELECT that makes them runs on both engines, so inputs are the same on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import cleaning, metadata, pages, quality, structure, tables
from .plans import convert, package
from .sources import files as sources
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


#: Letters and decisions, one for each order.
LETTERS = """
SELECT o_orderkey AS doc_id,
  concat(CASE WHEN o_orderkey % 3 = 0 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' ') ELSE '' END, CAST(o_orderkey AS STRING),
    CASE o_orderkey % 4 WHEN 0 THEN '-QĐ-VNPT-CNM' WHEN 1 THEN '-QD-VNPT-CLG' WHEN 2 THEN '. ghi chu' ELSE '_v1.2' END, ' Noi dung ', o_orderstatus,
    CASE o_orderkey % 6 WHEN 0 THEN '.docx' WHEN 1 THEN '.PDF' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.txt' WHEN 4 THEN '.doc' ELSE '' END) AS filename,
  concat('TẬP ĐOÀN', chr(10), 'Số: ', CAST(o_orderkey AS STRING), '/QĐ-VNPT-', CASE o_orderkey % 5 WHEN 0 THEN 'CNM' WHEN 1 THEN 'KHĐT' WHEN 2 THEN 'CLG' WHEN 3 THEN 'CN' ELSE 'ZZ' END, chr(10),
    'Hà Nội, ngày ', CAST(day(o_orderdate) AS STRING), ' tháng ', CAST(month(o_orderdate) AS STRING), ' năm ', CAST(year(o_orderdate) AS STRING), chr(10),
    CASE o_orderstatus WHEN 'F' THEN 'QUYẾT ĐỊNH' WHEN 'O' THEN 'THÔNG BÁO' ELSE 'BÁO CÁO' END, chr(10), '<!-- source_page: 2 -->', chr(10),
    'Chương I', chr(10), 'Điều 1. Phạm vi ', o_orderpriority, chr(10), 'Nội dung theo a.b@c.vn và yêu cầu.', chr(10), '<!-- source_page: ', CAST(2 + o_orderkey % 3 AS STRING), ' -->', chr(10),
    'Điều 1. Phạm vi ', o_orderpriority, chr(10), '# Phần chung', chr(10), CASE o_orderkey % 7 WHEN 0 THEN 'Dự thảo' WHEN 1 THEN 'Phê duyệt' WHEN 2 THEN 'Phiên bản: 2.5' ELSE 'Hết' END, chr(10),
    CASE WHEN o_orderkey % 2 = 0 THEN 'Quyết định có hiệu lực kể từ ngày ký.' ELSE concat('Ngày hiệu lực: ', CAST(day(o_orderdate) AS STRING), '-', CAST(month(o_orderdate) AS STRING), '-2030') END) AS text
FROM {orders}
"""
_LETTERS = "letters AS (" + LETTERS.format(orders="orders") + ")"


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LETTERS, orders=sources.spread(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")))


def _letter_query(name: str, make: Callable[[Column, Column], Column], oracle: str | None) -> None:
    """A scalar function of file name and text over all letters, with its SQL expression."""
    QUERIES[name] = lambda spark, sf_dir: letters(spark, sf_dir).select("doc_id", make(F.col("filename"), F.col("text")).alias("value"))
    if oracle:
        ORACLES[name] = f"WITH {_LETTERS} SELECT doc_id, {oracle} AS value FROM letters"


# --- registry ------------------------------------------------------------------------------------------------------

_STATUS = "SELECT event_type AS current_state, count(*) AS n FROM events GROUP BY event_type"


@query(_STATUS + " ORDER BY 1")
def ingestion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.registry_status(_table(spark, sf_dir, "events"), state="event_type")


@query(f"""SELECT '{{"registry_available":true,"states":{{' || string_agg('"' || current_state || '":' || n, ',' ORDER BY current_state) || '}},"document_contents_exposed":false}}' AS json FROM ({_STATUS})""")
def ingestion_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.status_json(ingestion_status(spark, sf_dir))


_HTML = "<!doctype html><title>Local ingestion status</title><h1>Local ingestion status</h1><p>Metadata-only: document content is not exposed.</p><table><thead><tr><th>State</th><th>Documents</th></tr></thead><tbody>"


@query(f"SELECT '{_HTML}' || string_agg('<tr><td>' || current_state || '</td><td>' || n || '</td></tr>', '' ORDER BY current_state) || '</tbody></table>' AS html FROM ({_STATUS})")
def ingestion_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.status_html(ingestion_status(spark, sf_dir))


@query(_STATUS)
def stream_ingestion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a stream that reads the table as it comes."""
    events = _table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    name = f"status_{abs(hash(sf_dir))}"
    ingest.stream_status(stream, "event_type").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("SELECT date_trunc('hour', ts) AS hour, event_type AS current_state, count(*) AS n FROM events GROUP BY ALL")
def windowed_ingestion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.windowed_status(_table(spark, sf_dir, "events"), "event_type", "ts")
    return found.select(F.col("window.start").alias("hour"), "current_state", "n")


# --- text functions ------------------------------------------------------------------------------------------------

_PUNCT = r"[#*`_~\[\]()><!|]"


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(text, '{_PUNCT}', ' ', 'g'), '\S+')) AS BIGINT) AS words, length(text) AS chars FROM documents")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), F.length("text").cast("long").alias("chars"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def doc_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(translate(lower({}), '" + T.ACCENTED + "', '" + T.PLAIN + r"'), '[^\pL\pM\pN_]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section')"


@query(f"SELECT doc_id, {_SLUG.format('text')} AS slug FROM documents")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS sha256, length(nfc_normalize(text)) AS chars FROM documents")
def encoding_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with foreign line ends, marks and NULs put in come back as they were."""
    spoiled = F.concat(F.lit("\ufeff"), F.regexp_replace("text", "\n", "\r\n"), F.lit("\x00"))
    clean = T.normalize_encoding(_table(spark, sf_dir, "documents").select("doc_id", spoiled.alias("text")), "text")
    return clean.select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("chars"))


_MAIL = r"(?i)[a-zA-Z0-9_.+-]+@[a-zA-Z0-9.-]+(?:\.[a-zA-Z0-9-]+)*(?:[_\s]*\d{1,2}:\d{2}(?:\s+\d{1,2}/\d{1,2}/\d{2,4})?)?"
_CLOCK = r"\b\d{1,2}:\d{2}\s+\d{1,2}/\d{1,2}/\d{2,4}\b"
_MARKED = "(?i)[^" + T.ACCENTED + "]"
_ALPHA = "[^a-zA-Z" + T.ACCENTED + "Đ]"


@query(rf"""
WITH clean AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{_MAIL}', '', 'g'), '{_CLOCK}', '', 'g') AS t FROM documents)
SELECT doc_id, CAST(length(regexp_replace(t, '\s+', '', 'g')) AS BIGINT) AS dense FROM clean""")
def watermark_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.dense_chars(T.strip_watermark(F.col("text"))).alias("dense"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


_letter_query("viet_letters", lambda n, t: T.marked_letters(t), f"CAST(length(regexp_replace(text, '{_MARKED}', '', 'g')) AS BIGINT)")
_letter_query("alpha_letters", lambda n, t: T.plain_letters(t), f"CAST(length(regexp_replace(text, '{_ALPHA}', '', 'g')) AS BIGINT)")

# --- metadata ------------------------------------------------------------------------------------------------------

_STEM = r"regexp_replace(filename, '(.)\.[^.]+$', '\1')"
_ID = rf"upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_STEM}, '^\d+[.\-_]', ''), '[^\pL\pM\pN_\-]+', '-', 'g'), '[-_]+', '-', 'g'), '^-+|-+$', '', 'g'))"
_HEAD = "split_part(text, 'Căn cứ', 1)"
_NAMED = rf"regexp_replace(replace(regexp_extract(filename, '(?i)\b(\d+[\-_/](?:{metadata.KINDS})[\-_/][A-Za-z0-9\-_/Đđ]+)', 1), 'QD', 'QĐ'), '^(\d+)[-_]', '\1/')"
_NUMBER = rf"coalesce(nullif({_NAMED}, ''), regexp_extract({_HEAD}, 'Số: (\S+)', 1))"
_ISO = r"regexp_extract(text, 'năm (\d{4})', 1) || '-' || lpad(regexp_extract(text, 'tháng (\d+)', 1), 2, '0') || '-' || lpad(regexp_extract(text, 'ngày (\d+)', 1), 2, '0')"
_EFFECTIVE = rf"CASE WHEN contains(text, 'kể từ ngày ký') THEN {_ISO} ELSE replace(regexp_extract(text, 'Ngày hiệu lực: ([\d-]+)', 1), '-', '/') END"
_UNIT = "CASE WHEN contains({0}, '-CNM') THEN 'Ban Công nghệ - Mạng' WHEN contains({0}, '-KHĐT') THEN 'Ban Kế hoạch - Đầu tư' WHEN contains({0}, '-CLG') THEN 'Ban Chất lượng' WHEN contains({0}, '-CN') THEN 'Ban Công nghệ' ELSE '' END"
_TYPE = "CASE WHEN regexp_matches(filename, '(^|[^\\pL\\pN_])(QĐ|QD)([^\\pL\\pN_]|$)') OR contains(text, 'QUYẾT ĐỊNH') OR contains(text, 'Quyết định') OR contains(text, '/QĐ-') THEN 'QĐ' ELSE '' END"
_STATE = "CASE WHEN contains(text, 'Dự thảo') THEN 'Dự thảo' WHEN contains(text, 'Phê duyệt') THEN 'Đã phê duyệt' ELSE '' END"
_VERSION = r"coalesce(nullif(regexp_extract(filename, '[_\-vV](\d+[._]\d+)', 1), ''), regexp_extract(text, 'Phiên bản: (\d+\.\d+)', 1))"

_letter_query("document_id", lambda n, t: metadata.document_id(n), f"coalesce(nullif({_ID}, ''), 'DOC')")
_letter_query("document_type", metadata.document_type, _TYPE)
_letter_query("document_number", lambda n, t: metadata.document_number(t, n), _NUMBER)
_letter_query("version", metadata.version, _VERSION)
_letter_query("issued_date", lambda n, t: metadata.issued_date(t, n), _ISO)
_letter_query("effective_date", lambda n, t: metadata.effective_date(t, metadata.issued_date(t, n)), _EFFECTIVE)
_letter_query("document_status", lambda n, t: metadata.status(t), _STATE)
_letter_query("unit", lambda n, t: metadata.unit(t, metadata.document_number(t, n)), _UNIT.format(_NUMBER))
_letter_query("scope", lambda n, t: metadata.scope(t, metadata.document_number(t, n)), "'Toàn Tập đoàn VNPT'")
_letter_query("title", lambda n, t: metadata.title(n, t), "'Phần chung'")


@query(f"""
WITH {_LETTERS}, m AS (SELECT doc_id, filename, coalesce(nullif({_ID}, ''), 'DOC') AS id, {_TYPE} AS type, {_NUMBER} AS number, {_VERSION} AS version, {_ISO} AS issued, {_EFFECTIVE} AS effective, {_STATE} AS state, text FROM letters)
SELECT doc_id, concat('---', chr(10), 'document_id: "', id, '"', chr(10), 'source_file: "', filename, '"', chr(10), 'title: "Phần chung"', chr(10), 'document_type: "', type, '"', chr(10), 'organization: "VNPT"', chr(10),
  'unit: "', {_UNIT.format("number")}, '"', chr(10), 'version: "', version, '"', chr(10), 'document_status: "', state, '"', chr(10), 'document_number: "', number, '"', chr(10), 'issued_date: "', issued, '"', chr(10),
  'effective_date: "', effective, '"', chr(10), 'supersedes: ""', chr(10), 'superseded_by: ""', chr(10), 'scope: "Toàn Tập đoàn VNPT"', chr(10), 'language: "vi"', chr(10), 'conversion_date: "2024-01-01"', chr(10),
  'converter_version: "1.0.0"', chr(10), 'source_sha256: "', sha256(text), '"', chr(10), 'page_count: 1', chr(10), 'source_text_char_count: ', length(text), chr(10), 'markdown_text_char_count: ', length(text), chr(10),
  'text_retention_ratio: 1.0', chr(10), '---', chr(10)) AS front_matter FROM m""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = letters(spark, sf_dir).withColumn("sha256", F.sha2("text", 256))
    docs, meta = metadata.with_metadata(docs, "filename", "text", "text", "sha256", F.lit(1), "2024-01-01")
    return docs.select("doc_id", metadata.front_matter(meta).alias("front_matter"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 50 = 0 THEN CASE WHEN l_partkey % 100 > 0 THEN 1.0 ELSE 0.0 END ELSE ((2000 * (l_partkey % 100) + l_suppkey % 50) // (2 * (l_suppkey % 50))) / 1000.0 END AS ratio FROM lineitem")
def retention_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", metadata.retention(F.col("l_partkey") % 100, F.col("l_suppkey") % 50).alias("ratio"))


@query(f"WITH {_LETTERS}, n AS (SELECT doc_id, {_NUMBER} AS number FROM letters) SELECT {_UNIT.format('number')} AS unit, count(*) AS n FROM n GROUP BY 1")
def unit_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit table as a join: the first suffix in order that the number contains. The table is a fixed dozen rows."""
    units = spark.createDataFrame([(i, s, u) for i, (s, u) in enumerate(metadata.UNITS)], "rule int, suffix string, unit string")
    docs = letters(spark, sf_dir).select("doc_id", F.upper(metadata.document_number(F.col("text"), F.col("filename"))).alias("number"))
    found = docs.join(F.broadcast(units), F.col("number").contains(F.col("suffix")), "left").groupBy("doc_id").agg(F.min_by("unit", "rule").alias("unit"))
    return found.groupBy(F.coalesce("unit", F.lit("")).alias("unit")).agg(F.count("*").alias("n"))


# --- structure -----------------------------------------------------------------------------------------------------

_MARK = r"""CASE WHEN starts_with(l, '#') OR starts_with(l, '<!--') OR starts_with(l, '>') OR l = '' THEN ''
  WHEN regexp_matches(l, '(?i)^(QUYẾT ĐỊNH|QUY CHẾ|QUY ĐỊNH)([^\pL\pN_]|$)') AND length(l) < 120 THEN '#'
  WHEN regexp_matches(l, '(?i)^(CHƯƠNG|PHẦN)\s+([IVXLCDM]+|\d+)([^\pL\pN_]|$)') THEN '##' WHEN regexp_matches(l, '(?i)^Điều\s+\d+[.:\s\-]') THEN '###' ELSE '' END"""


@query(f"WITH {_LETTERS} SELECT doc_id, CAST(i AS BIGINT) AS line_no, {_MARK} AS mark FROM (SELECT doc_id, unnest(str_split(text, chr(10))) AS l, generate_subscripts(str_split(text, chr(10)), 1) AS i FROM letters)")
def structure_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = letters(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "line"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), structure.heading_mark(F.col("line")).alias("mark"))


@query(f"""
WITH {_LETTERS}, lines AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS l, generate_subscripts(str_split(text, chr(10)), 1) AS i FROM letters),
paged AS (SELECT *, coalesce(last_value(nullif(regexp_extract(l, 'source_page: (\\d+)', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), '1')::INT AS page FROM lines),
heads AS (SELECT doc_id, i, page, CASE WHEN starts_with(l, '# ') THEN 1 ELSE length({_MARK}) END AS level, regexp_replace(l, '^# ', '') AS heading FROM paged WHERE starts_with(l, '# ') OR {_MARK} <> ''),
named AS (SELECT *, {_SLUG.format("heading")} AS slug FROM heads),
last AS (SELECT doc_id, max_by(page, i) AS last_page FROM paged GROUP BY doc_id)
SELECT doc_id, row_number() OVER w AS ord, 'sec-' || slug || CASE WHEN row_number() OVER s > 1 THEN '-' || row_number() OVER s ELSE '' END AS id, heading, CAST(level AS INT) AS level,
  page AS source_page_start, greatest(page, coalesce(lead(page) OVER w, last_page)) AS source_page_end
FROM named JOIN last USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY i), s AS (PARTITION BY doc_id, slug ORDER BY i)""")
def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = letters(spark, sf_dir).withColumn("formatted", structure.format_structure(F.col("text"))).select("doc_id", F.posexplode(structure.sections(F.col("formatted"))).alias("i", "s"))
    return found.select("doc_id", (F.col("i") + 1).cast("long").alias("ord"), "s.*")


@query("SELECT doc_id, CAST(i AS BIGINT) AS line_no, coalesce(last_value(nullif(regexp_extract(l, '^(\\w+)[.]$', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), '1') AS page FROM (SELECT doc_id, unnest(str_split(text, chr(10))) AS l, generate_subscripts(str_split(text, chr(10)), 1) AS i FROM documents)".replace("\\w", "[A-Za-z]"))
def page_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The carry-forward over lines as a window, with one-word lines as markers."""
    from pyspark.sql import Window

    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.nullif(F.regexp_extract("line", "^([A-Za-z]+)[.]$", 1), F.lit(""))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit("1")).alias("page"))


# --- tables, cleaning ----------------------------------------------------------------------------------------------


@query(r"""
WITH grid AS (SELECT doc_id, list_transform(str_split(text, chr(10)), lambda r: list_transform(str_split(r, '|'), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g'))) AS g FROM documents WHERE contains(text, '|')),
wide AS (SELECT doc_id, g, list_max(list_transform(g, lambda r: len(r))) AS w FROM grid),
padded AS (SELECT doc_id, w, list_transform(g, lambda r: list_resize(r, w, '')) AS g FROM wide)
SELECT doc_id, array_to_string(list_concat(
  CASE WHEN len(list_filter(g[1], lambda c: c <> '')) = 0 THEN ['| ' || array_to_string(list_transform(range(1, w + 1), lambda i: 'Cột ' || i), ' | ') || ' |'] ELSE ['| ' || array_to_string(g[1], ' | ') || ' |'] END,
  ['| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |'],
  list_transform(CASE WHEN len(list_filter(g[1], lambda c: c <> '')) = 0 THEN g ELSE g[2:] END, lambda r: '| ' || array_to_string(r, ' | ') || ' |')), chr(10)) AS md FROM padded""")
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").filter(F.col("text").contains("|"))
    return docs.select("doc_id", tables.markdown_table(F.transform(T.lines(F.col("text")), lambda r: F.split(r, r"\|", -1))).alias("md"))


_MAIL2 = r"(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?:[_\s]*\d{1,2}:\d{2}(?:\s+\d{1,2}/\d{1,2}/\d{2,4})?)?"


@query(rf"""
WITH c AS (SELECT doc_id, list_transform(str_split(text, chr(10)), lambda l: regexp_replace(regexp_replace(l, '{_MAIL2}', '', 'g'), '{_CLOCK}', '', 'g')) AS ls FROM documents)
SELECT doc_id, sha256(coalesce(array_to_string(list_filter(ls, lambda l: NOT (trim(l) = '' OR regexp_matches(trim(l), '^\d+/\d+$') OR (regexp_matches(trim(l), '^[#@&~`^_\-|/\\\s:.,+*%<>=]+$') AND length(trim(l)) < 25)
  OR (regexp_matches(trim(l), '^[a-zA-Z0-9@_`~^|\\/]{{1,3}}$') AND lower(trim(l)) NOT IN ('do', 'tm', 'iv', 'iii', 'ii', 'i', 'dl', 'ul')))), chr(10)), '')) AS sha256 FROM c""")
def artifact_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.sha2(cleaning.clean_artifacts(F.col("text")), 256).alias("sha256"))


@query("SELECT o_orderkey, concat('Đơn vị đầu tư ', o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN ' QUYẾT ĐỊNH ./.' ELSE ' chủ trương.' END) AS text FROM orders")
def term_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("Đơn vi đâu tư "), "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, " QUYET DINH ./x").otherwise(" chi trương."))
    return cleaning.correct_terms(sources.spread(_table(spark, sf_dir, "orders")).select("o_orderkey", said.alias("text")), "text")


# --- pages ---------------------------------------------------------------------------------------------------------

_RULE = "CASE WHEN l_discount * 10 > 0.6 THEN l_quantity * 2 < 50 OR (l_partkey % 60 > 20 AND (l_suppkey % 4) / (l_partkey % 60) < 0.05) OR l_quantity * 2 = 0 ELSE l_quantity * 2 < 50 END"


def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = pages.recognition_rule(F.col("l_quantity") * 2, F.col("l_partkey") % 60, F.col("l_suppkey") % 4, F.col("l_discount") * 10 > 0.6)
    return _table(spark, sf_dir, "lineitem").withColumn("needs_ocr", rule)


@query(f"SELECT l_orderkey, l_linenumber, {_RULE} AS needs_ocr FROM lineitem")
def needs_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", "needs_ocr")


@query(f"SELECT l_orderkey, CAST(count(*) AS BIGINT) AS pages_total, CAST(count_if({_RULE}) AS BIGINT) AS pages_ocr, count_if({_RULE}) > 0 AND count_if({_RULE}) >= count(*) * 0.5 AS is_pure_ocr FROM lineitem GROUP BY l_orderkey")
def ocr_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _page_rows(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").alias("pages_total"), F.count_if("needs_ocr").alias("pages_ocr"))
    return found.withColumn("is_pure_ocr", pages.is_pure_ocr(F.col("pages_ocr"), F.greatest(F.lit(1), F.col("pages_total"))))


@query("""SELECT l_orderkey, string_agg('<!-- source_page: ' || l_linenumber || ' -->' || chr(10) || chr(10) || CASE WHEN l_quantity < 25 THEN '> [Extracted from image via TESSERACT]' || chr(10) || l_shipmode ELSE l_shipmode END,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY l_linenumber, CASE WHEN l_quantity < 25 THEN 0 ELSE 1 END, l_shipmode) AS body FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY l_orderkey""")
def page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, scanned = F.concat("l_returnflag", "l_linestatus"), F.col("l_quantity") < 25
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page_number"), F.when(scanned, pages.recognised_page(t, F.lit("tesseract"))).otherwise(t).alias("text"), t.alias("raw"), scanned.alias("is_ocr"))
    return pages.merge_pages(rows, "l_orderkey").select("l_orderkey", "body")


@query("SELECT l_orderkey, CASE WHEN count(*) FILTER (c >= 0 AND w <> '') = 0 THEN 1.0 ELSE ((2 * sum(c) FILTER (c >= 0 AND w <> '') + count(*) FILTER (c >= 0 AND w <> '')) // (2 * count(*) FILTER (c >= 0 AND w <> ''))) / 100.0 END AS confidence FROM (SELECT l_orderkey, CAST(l_quantity AS INT) * 2 - 20 AS c, CASE WHEN l_linenumber = 3 THEN '' ELSE l_returnflag END AS w FROM lineitem) GROUP BY l_orderkey")
def ocr_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("l_linenumber") == 3, " ").otherwise(F.col("l_returnflag"))
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(pages.word_confidence(F.col("l_quantity").cast("int") * 2 - 20, word).alias("confidence"))


@query("SELECT l_orderkey, string_agg(l_linenumber || l_returnflag, chr(10) ORDER BY round_even(l_quantity / 14, 0) * 14, l_discount, l_linenumber, l_returnflag) AS text FROM lineitem GROUP BY l_orderkey")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("y"), F.col("l_discount").alias("x"), F.col("l_linenumber").alias("ord"), F.concat(F.col("l_linenumber").cast("string"), "l_returnflag").alias("text"))
    return pages.reading_order(boxes, "l_orderkey")


# --- gate and package ----------------------------------------------------------------------------------------------

_SIZE = "length(text)"
_SRC = "(length(text) + doc_id % 5 * length(text) // 10)"
_KEPT = f"((2000 * {_SIZE} + {_SRC}) // (2 * {_SRC})) / 1000.0"
_GATED = f"""docs AS (SELECT doc_id, source, lang, text, {_KEPT} AS ratio, regexp_matches(text, '(?m)^#{{1,6}}\\s+') AS headed, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 20 AS filled FROM documents),
gated AS (SELECT *, CASE WHEN NOT filled OR ratio < 0.75 OR lang IS NULL THEN 'FAIL' WHEN NOT headed OR ratio < 0.9 THEN 'WARNING' ELSE 'PASS' END AS status FROM docs)"""


def gated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as converted files: every fifth to tenth of the source text is taken to be lost."""
    n = F.length("text")
    src = (n + F.floor(F.col("doc_id") % 5 * n / 10)).cast("int")
    meta = F.struct(
        F.format_string("DOC-%d", "doc_id").alias("document_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(".docx")).alias("source_file"), F.coalesce("lang", F.lit("")).alias("title"), F.lit("BC").alias("document_type"),
        F.lit("1.0").alias("version"), F.lit("").alias("document_status"), F.lit("").alias("issued_date"), F.lit("2024-02-03").alias("effective_date"), F.lit(1).alias("page_count"), n.alias("markdown_text_char_count"), src.alias("source_text_char_count"),
        metadata.retention(n, src).alias("text_retention_ratio"), F.sha2("text", 256).alias("source_sha256"),
    )
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("doc_id").alias("ordinal"), F.coalesce("text", F.lit("")).alias("markdown"), meta.alias("metadata"), F.array().cast(f"array<struct<{structure.SECTION.replace(' ', ':').replace(',:', ',')}>>").alias("sections"), T.word_count(F.col("text")).alias("word_count"), n.cast("long").alias("character_count"))
    d = quality.with_gate(d, "markdown", F.col("metadata"), F.lit(False), F.lit(False)).withColumn("filename", F.col("metadata.source_file"))
    return d.withColumn("warnings", F.col("validation.warnings")).withColumn("pages_total", F.lit(1))


@query(f"WITH {_GATED} SELECT doc_id, status, status <> 'FAIL' AS is_safe_for_ai, CAST(8 AS BIGINT) AS n_checks, CAST((NOT headed)::INT + (ratio >= 0.75 AND ratio < 0.9)::INT AS BIGINT) AS n_warnings, CAST((NOT filled)::INT + (ratio < 0.75)::INT + (lang IS NULL)::INT AS BIGINT) AS n_errors FROM gated")
def quality_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.size(f"validation.{c}").cast("long").alias(f"n_{c}")
    return gated_documents(spark, sf_dir).select("doc_id", "validation.status", "validation.is_safe_for_ai", n("checks"), n("warnings"), n("errors"))


@query(f"WITH {_GATED} SELECT doc_id, unnest(['UTF-8 & Không chứa NULL byte', 'Nội dung không rỗng', 'Metadata source_file & title hợp lệ', 'Cấu trúc Heading hiện diện', 'Không bọc toàn bộ văn bản trong code fence', 'Không chứa chuỗi Base64 hình ảnh thô', 'Tỷ lệ bảo toàn nội dung (Retention Ratio)', 'Mã băm SHA-256 xác thực']) AS name, unnest([true, filled, lang IS NOT NULL, headed, true, true, ratio >= 0.75, true]) AS passed FROM gated")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_documents(spark, sf_dir).select("doc_id", F.inline("validation.checks")).select("doc_id", "name", "passed")


@query(f"WITH {_GATED} SELECT CASE WHEN status = 'FAIL' THEN 'failed' ELSE 'ready' END AS bucket, count(*) AS n FROM gated GROUP BY 1")
def ready_failed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package.bucketed(gated_documents(spark, sf_dir)).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"WITH {_GATED} SELECT count(*) AS total_documents, count_if(status <> 'FAIL')::BIGINT AS ready_count, count_if(status = 'FAIL')::BIGINT AS failed_count, 0::BIGINT AS unvalidated_count, count_if(status = 'WARNING')::BIGINT AS warning_count, count_if(status <> 'FAIL') = 1 AS is_single_mode, CASE WHEN count_if(status = 'FAIL') > 0 THEN 'FAIL' WHEN count_if(status = 'WARNING') > 0 THEN 'WARNING' ELSE 'PASS' END AS overall_status FROM gated")
def kb_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package.summary(gated_documents(spark, sf_dir))


@query(f"WITH {_GATED} SELECT lang, status, count(*) AS n FROM gated GROUP BY ROLLUP (lang, status)")
def kb_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_documents(spark, sf_dir).select("lang", F.col("validation.status").alias("status")).rollup("lang", "status").agg(F.count("*").alias("n"))


@query(f"WITH {_GATED} SELECT 'doc ' || doc_id || '.docx' AS filename, '| **DOC-' || doc_id || '** | ' || coalesce(nullif(lang, ''), 'doc ' || doc_id || '.docx') || ' | BC | 1.0 |  | 2024-02-03 | [`doc ' || doc_id || '.md`](doc ' || doc_id || '.md) |' AS row FROM gated WHERE status <> 'FAIL'")
def master_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package.index_rows(package.bucketed(gated_documents(spark, sf_dir)).filter("bucket = 'ready'")).select("filename", "row")


@query(f"""WITH {_GATED} SELECT 'doc ' || doc_id || '.docx' AS filename, '| `doc ' || doc_id || '.docx` | ' || CASE status WHEN 'PASS' THEN '✅ PASS' WHEN 'WARNING' THEN '⚠️ WARNING' ELSE '❌ FAIL' END || ' | 1 | 0 | ' || CAST(trunc(ratio * 100) AS INT) || '% | '
  || CASE WHEN status = 'FAIL' THEN '`technical/failed/`' ELSE '`upload_to_ai/`' END || ' | ' || CASE WHEN w > 0 THEN 2 * w || ' cảnh báo' ELSE '0' END || ' |' AS row FROM (SELECT *, (NOT headed)::INT + (ratio >= 0.75 AND ratio < 0.9)::INT AS w FROM gated)""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package.report_rows(gated_documents(spark, sf_dir)).select("filename", "row")


_JSON = """'{"document_id":"DOC-' || doc_id || '","source_file":"doc ' || doc_id || '.docx","markdown_file":"upload_to_ai/doc ' || doc_id || '.md","sha256":"' || sha256(text) || '","title":"' || coalesce(lang, '') || '","document_type":"BC","version":"1.0","status":"","issued_date":"","effective_date":"2024-02-03","page_count":1'"""


@query(f"WITH {_GATED} SELECT 'doc ' || doc_id || '.docx' AS filename, {_JSON} AS head FROM gated WHERE status <> 'FAIL'")
def manifest_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = package.manifest_items(gated_documents(spark, sf_dir)).filter("bucket = 'ready'")
    return items.select("filename", F.substring_index("item", ',"word_count"', 1).alias("head"))


@query(f"""WITH {_GATED}, notes AS (SELECT doc_id, unnest(list_concat(CASE WHEN headed THEN [] ELSE ['h'] END, CASE WHEN ratio >= 0.75 AND ratio < 0.9 THEN ['w'] ELSE [] END, CASE WHEN filled THEN [] ELSE ['e'] END, CASE WHEN lang IS NULL THEN ['n'] ELSE [] END, CASE WHEN ratio < 0.75 THEN ['f'] ELSE [] END)) AS k FROM gated)
SELECT doc_id, count(*) AS n FROM notes GROUP BY doc_id""")
def distinct_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = gated_documents(spark, sf_dir)
    return d.select("doc_id", F.size(package.all_notes(F.col("warnings"), F.col("validation"))).cast("long").alias("n")).filter("n > 0")


@query(f"WITH {_GATED} SELECT doc_id, 'ready' AS bucket FROM gated WHERE status <> 'FAIL' UNION ALL SELECT doc_id, 'failed' FROM gated WHERE status = 'FAIL'")
def union_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = package.bucketed(gated_documents(spark, sf_dir)).select("doc_id", "bucket")
    return d.filter("bucket = 'ready'").unionByName(d.filter("bucket = 'failed'"))


@query(f"WITH {_GATED} SELECT status, toxic, count(*) AS n FROM gated JOIN labels USING (doc_id) GROUP BY ALL")
def doc_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = gated_documents(spark, sf_dir).select("doc_id", F.col("validation.status").alias("status"))
    return d.join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("status", "toxic").agg(F.count("*").alias("n"))


@query(f"WITH {_LETTERS}, f AS (SELECT doc_id, CASE WHEN contains('.pdf .doc .docx .xls .xlsx', lower(regexp_extract(filename, '.(\\.[^.]+)$', 1))) AND regexp_matches(filename, '.\\.[^.]+$') THEN CASE WHEN strlen(text) > 330 THEN 'too large' END ELSE 'unsupported extension' END AS reason FROM letters) SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM f GROUP BY 1".replace("contains('.pdf .doc .docx .xls .xlsx', lower(regexp_extract(filename, '.(\\.[^.]+)$', 1)))", "lower(regexp_extract(filename, '.(\\.[^.]+)$', 1)) IN ('.pdf', '.doc', '.docx', '.xls', '.xlsx')"))
def size_ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = letters(spark, sf_dir).select("filename", F.octet_length("text").alias("length"), F.col("text").cast("binary").alias("content"))
    ok, rejected = sources.gate_files(files, 330)
    return ok.select(F.lit("ok").alias("reason")).unionByName(rejected.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(trunc((row_number() OVER (ORDER BY o_orderkey) - 1) / count(*) OVER () * 100) AS INT) AS started, CAST(trunc(row_number() OVER (ORDER BY o_orderkey) / count(*) OVER () * 100) AS INT) AS done FROM orders")
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("filename"), F.col("o_orderkey").alias("ordinal"), F.lit(1).alias("pages_total"))
    events = ingest.progress_events(docs)
    found = events.groupBy("filename").agg(F.max(F.when(F.col("type") == "file_start", F.col("percent"))).alias("started"), F.max(F.when(F.col("type") == "file_done", F.col("percent"))).alias("done"))
    return found.select(F.col("filename").cast("long").alias("o_orderkey"), "started", "done")


# --- the whole conversion ------------------------------------------------------------------------------------------


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as files of text, through normalisation, structure, metadata and gate."""
    from .sources.decoders import PAGE

    block = F.struct(F.lit("paragraph").alias("kind"), F.lit("verbatim").alias("style"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("array<array<string>>").alias("rows"))
    # No cast of the whole: through one the optimizer doesn't see that the kind is fixed, and reads all documents again for the pages of PDF files.
    decoded = F.struct(F.lit("text").alias("kind"), F.lit("").alias("own_title"), F.lit("").alias("first_heading"), F.array(block).alias("blocks"), F.array().cast(f"array<{PAGE}>").alias("pages"), F.lit(False).alias("converted_via_legacy"), F.lit(False).alias("repaired"), F.lit(None).cast("string").alias("error"))
    files = sources.spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(".docx")).alias("filename"), F.col("doc_id").alias("ordinal"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), decoded.alias("decoded"))
    return convert.documents(convert.bodies(files, store=False), "2024-01-01")


# The given texts have no letters, so of the metadata only names, hashes, counts and a stated version differ.
_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CONVERTED = rf"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text, {_STRIPPED.format("coalesce(text, '')")} AS src FROM documents),
body AS (SELECT *, {_STRIPPED.format("regexp_replace(src, '\n{3,}', chr(10) || chr(10), 'g')")} AS md FROM raw),
counted AS (SELECT *, length(md) AS n_md, CASE WHEN length(src) > 0 THEN length(src) ELSE length(md) END AS n_src, regexp_extract(src, '(?i)(?:Phiên bản|Version|Ver\.?)\s*[:\-]?\s*(\d+(?:\.\d+)+)', 1) AS version FROM body),
rated AS (SELECT *, CASE WHEN n_src > 0 THEN ((2000 * n_md + n_src) // (2 * n_src)) / 1000.0 ELSE 0.0 END AS ratio FROM counted),
whole AS (SELECT *, concat('---', chr(10), 'document_id: "DOC-', doc_id, '"', chr(10), 'source_file: "doc ', doc_id, '.docx"', chr(10), 'title: "doc ', doc_id, '"', chr(10), 'document_type: ""', chr(10), 'organization: "VNPT"', chr(10), 'unit: ""', chr(10),
  'version: "', version, '"', chr(10), 'document_status: ""', chr(10), 'document_number: ""', chr(10), 'issued_date: ""', chr(10), 'effective_date: ""', chr(10), 'supersedes: ""', chr(10), 'superseded_by: ""', chr(10), 'scope: ""', chr(10), 'language: "vi"', chr(10),
  'conversion_date: "2024-01-01"', chr(10), 'converter_version: "1.0.0"', chr(10), 'source_sha256: "', sha256(text), '"', chr(10), 'page_count: 1', chr(10), 'source_text_char_count: ', n_src, chr(10), 'markdown_text_char_count: ', n_md, chr(10),
  'text_retention_ratio: ', ratio, chr(10), '---', chr(10), chr(10), md) AS markdown FROM rated)
SELECT doc_id, 'DOC-' || doc_id AS document_id, CASE WHEN length(md) <= 20 OR ratio < 0.75 THEN 'FAIL' WHEN NOT regexp_matches(markdown, '(?m)^#{{1,6}}\s+') OR ratio < 0.9 THEN 'WARNING' ELSE 'PASS' END AS status, 0 AS n_sections,
  CAST(len(regexp_extract_all(regexp_replace(markdown, '{_PUNCT}', ' ', 'g'), '\S+')) AS BIGINT) AS word_count, CAST(length(markdown) AS BIGINT) AS character_count, sha256(markdown) AS markdown_sha256 FROM whole"""


@query(_CONVERTED)
def converted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = converted(spark, sf_dir)
    return found.select(F.col("ordinal").alias("doc_id"), "document_id", F.col("validation.status").alias("status"), F.size("sections").alias("n_sections"), "word_count", "character_count", F.sha2("markdown", 256).alias("markdown_sha256"))


@query(r"""
WITH d AS (SELECT length(regexp_replace(regexp_replace(coalesce(text, ''), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) > 20 AS ok, regexp_matches(coalesce(text, ''), '(?m)^#{1,6}\s+') AS headed FROM documents)
SELECT count(*) AS total_documents, count_if(ok)::BIGINT AS ready_count, count_if(NOT ok)::BIGINT AS failed_count, 0::BIGINT AS unvalidated_count, count_if(ok AND NOT headed)::BIGINT AS warning_count, count_if(ok) = 1 AS is_single_mode,
  CASE WHEN count_if(NOT ok) > 0 THEN 'FAIL' WHEN count_if(ok AND NOT headed) > 0 THEN 'WARNING' ELSE 'PASS' END AS overall_status FROM d""")
def knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package.summary(converted(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge_base(spark, sf_dir)


# The queries of readers, recognition, packages and streams add themselves.
from . import file_catalogue  # noqa: E402, F401
