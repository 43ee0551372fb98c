"""Decoders of file contents.

DOCX, XLSX and PDF are read with the standard library. Legacy formats and text
recognition need programs or libraries that may be absent: they are adapters
that can be registered; without one, a file gives a row with an ``error``. A DOCX or
XLSX that can't be read, or an empty DOCX, goes to a generic reader.

Every decoder turns bytes into the same record: kind, own_title, first_heading,
blocks (kind, style, text, rows) in document order, pages and error.
"""

from __future__ import annotations

import html
import importlib.util
import io
import posixpath
import re
import shutil
import subprocess
import tempfile
import threading
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import images, pdf
from .archives import Parts, zipped
from .files import LEGACY

BLOCK = "struct<kind:string,style:string,text:string,rows:array<array<string>>>"
PAGE = "struct<page_number:int,text_layer:string,max_image_area_ratio:double,image_bbox_error:boolean,image:binary>"
DECODED_ARROW = pa.struct([
    ("kind", pa.string()), ("own_title", pa.string()), ("first_heading", pa.string()),
    ("blocks", pa.list_(pa.struct([("kind", pa.string()), ("style", pa.string()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))]))),
    ("pages", pa.list_(pa.struct([("page_number", pa.int32()), ("text_layer", pa.string()), ("max_image_area_ratio", pa.float64()), ("image_bbox_error", pa.bool_()), ("image", pa.binary())]))),
    ("converted_via_legacy", pa.bool_()), ("repaired", pa.bool_()), ("error", pa.string()),
])
DECODED = f"struct<kind:string,own_title:string,first_heading:string,blocks:array<{BLOCK}>,pages:array<{PAGE}>,converted_via_legacy:boolean,repaired:boolean,error:string>"

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def record(kind: str, **values) -> dict:
    out = {"kind": kind, "own_title": "", "first_heading": "", "blocks": [], "pages": [], "converted_via_legacy": False, "repaired": False, "error": None}
    return out | values


def _xml(z: Parts, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z else None


#: Parts that many files of one origin share, as styles and relations, are read once if they are no longer than this.
SHARED = 1 << 16


def _shared(read: Callable[[ElementTree.Element | None], object]) -> Callable[[Parts, str], object]:
    """What ``read`` makes of a part (None if there is no such part). Callers don't change it."""
    parsed = lambda raw: read(ElementTree.fromstring(raw))
    again = lru_cache(32)(parsed)

    def of(z: Parts, name: str):
        if name not in z:
            return read(None)
        raw = z.read(name)
        return (again if len(raw) <= SHARED else parsed)(raw)

    return of


def _style_names(root: ElementTree.Element | None) -> dict[str, str]:
    return {} if root is None else {s.get(_STYLE_ID): name.get(_VAL, "") for s in root.iter(f"{W}style") if (name := s.find(f"{W}name")) is not None}


def _relations(root: ElementTree.Element | None) -> dict[str, str]:
    target = lambda t: t[1:] if t.startswith("/") else posixpath.normpath(posixpath.join("xl", t))
    return {r.get("Id"): target(r.get("Target")) for r in root}


def _sheets(root: ElementTree.Element | None) -> list[tuple[str, str]]:
    return [(s.get("name"), s.get(f"{R}id")) for s in root.iter(f"{S}sheet")]


_STYLE_ID, _VAL = f"{W}styleId", f"{W}val"
_T, _TAB, _BREAKS = f"{W}t", f"{W}tab", (f"{W}br", f"{W}cr")
_P, _PPR, _PSTYLE, _TABLE, _TR, _TC = f"{W}p", f"{W}pPr", f"{W}pStyle", f"{W}tbl", f"{W}tr", f"{W}tc"
_ROW, _C, _V, _F, _IT = f"{S}row", f"{S}c", f"{S}v", f"{S}f", f"{S}t"
_styles_of, _relations_of, _sheets_of = _shared(_style_names), _shared(_relations), _shared(_sheets)


def _paragraph(p: ElementTree.Element) -> str:
    out = []
    for e in p.iter():
        tag = e.tag
        if tag == _T:
            out.append(e.text or "")
        elif tag == _TAB:
            out.append("\t")
        elif tag in _BREAKS:
            out.append("\n")
    return "".join(out)


def _style(p: ElementTree.Element, styles: dict[str, str]) -> str:
    for own in p.findall(_PPR):
        if (ref := own.find(_PSTYLE)) is not None:
            return styles.get(ref.get(_VAL), ref.get(_VAL, ""))
    return ""


def docx(content: bytes) -> dict:
    """Paragraphs with style names and tables, in document order."""
    z = Parts(content)
    body = _xml(z, "word/document.xml").find(f"{W}body")
    core, styles = _xml(z, "docProps/core.xml"), _styles_of(z, "word/styles.xml")
    title = core.find("{http://purl.org/dc/elements/1.1/}title") if core is not None else None
    blocks, first = [], ""
    for e in body:
        if e.tag == _P:
            text = _paragraph(e).strip()
            style = _style(e, styles).lower()
            if text:
                blocks.append({"kind": "paragraph", "style": style, "text": text, "rows": None})
                if not first and "heading 1" in style:
                    first = text
        elif e.tag == _TABLE:
            rows = [["\n".join([_paragraph(p) for p in c.findall(_P)]).replace("\n", " ").strip() for c in r.findall(_TC)] for r in e.findall(_TR)]
            if rows:
                blocks.append({"kind": "table", "style": "", "text": None, "rows": rows})
    return record("docx", own_title=((title.text or "") if title is not None else "").strip(), first_heading=first, blocks=blocks)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx(content: bytes, include_formula: bool = False) -> dict:
    """Sheets in workbook order, with cached values (or formulas) as text; cells that are missing are ''."""
    z = Parts(content)
    book = _sheets_of(z, "xl/workbook.xml") if "xl/workbook.xml" in z else None
    rels, shared = _relations_of(z, "xl/_rels/workbook.xml.rels"), []
    if (root := _xml(z, "xl/sharedStrings.xml")) is not None:
        shared = ["".join([t.text or "" for t in si.iter(_IT)]) for si in root.findall(f"{S}si")]
    blocks = []
    for name, at in _sheets(None) if book is None else book:
        rows, last = [], 0
        for r in _xml(z, rels[at]).iter(_ROW):
            number = int(r.get("r", last + 1))
            rows += [[] for _ in range(number - last - 1)]
            last, row = number, []
            for c in r.findall(_C):
                if ref := c.get("r"):
                    row += [""] * (_column(ref) - len(row))
                kind, formula = c.get("t", "n"), c.find(_F) if include_formula else None
                if formula is not None:
                    row.append("=" + (formula.text or ""))
                elif kind == "inlineStr":
                    row.append("".join([t.text or "" for t in c.iter(_IT)]))
                else:
                    value = c.find(_V)
                    text = (value.text or "") if value is not None else ""
                    row.append(shared[int(text)] if kind == "s" and text else {"1": "True", "0": "False"}.get(text, text) if kind == "b" else text)
            rows.append(row)
        width = max(map(len, rows), default=0)
        blocks.append({"kind": "sheet", "style": "", "text": name, "rows": [row + [""] * (width - len(row)) for row in rows]})
    return record("xlsx", blocks=blocks)


def pdf_slices(content: bytes) -> Iterator[bytes]:
    """The whole, then parts from the last ``%PDF-`` marker backwards: a later complete file may be inside."""
    yield content
    at = content.rfind(b"%PDF-")
    while at > 0:
        yield content[at:]
        at = content.rfind(b"%PDF-", 0, at)


def pdf_with(open_pages: Callable[[bytes], list[dict]]) -> Callable[[bytes], dict]:
    """A PDF decoder from a function that reads pages (see PAGE) or raises; damaged files are tried part by part."""

    def decode(content: bytes) -> dict:
        error = "empty"
        for i, part in enumerate(pdf_slices(content)):
            try:
                if pages := open_pages(part):
                    return record("pdf", pages=pages, repaired=i > 0)
                error = "no pages"
            except Exception as e:  # noqa: BLE001  a part that can't be read is one to pass over
                error = str(e) or type(e).__name__
        return record("pdf", pages=[{"page_number": 1, "text_layer": "", "max_image_area_ratio": None, "image_bbox_error": None, "image": None}], error=error)

    return decode


def _opened(content: bytes) -> pdf.Opened | Exception:
    try:
        return pdf.Opened(content)
    except Exception as e:  # noqa: BLE001  said again where the pages are asked for
        return e


def _repaired(content: bytes) -> tuple[bytes, pdf.Opened | Exception, bool]:
    """A healthy file as it is; else the last healthy part that begins with a marker, else the file; opened, and whether it was exchanged."""
    found = whole = _opened(content)
    if isinstance(whole, Exception) or not whole.healthy():
        parts = pdf_slices(content)
        next(parts)
        for part in parts:
            found = _opened(part)
            if not isinstance(found, Exception) and found.healthy():
                return part, found, True
    return content, whole, False


def repaired_pdf(content: bytes) -> tuple[bytes, bool]:
    """A healthy file as it is; else the last healthy part that begins with a marker, else the file; and whether it was exchanged."""
    part, _, repaired = _repaired(content)
    return part, repaired


def pdf_file(content: bytes) -> dict:
    """Pages of a PDF file (see ``pdf``), repaired where need be. A file is parsed once for its health and its pages."""
    part, opened, repaired = _repaired(content)

    def pages(of: bytes) -> list[dict]:
        if of is not part:
            return pdf.open_pages(of)
        if isinstance(opened, Exception):
            raise opened
        return opened.pages()

    found = pdf_with(pages)(part)
    return found | {"repaired": found["repaired"] or repaired}


def _converted(program: list[str], content: bytes, ext: str, timeout: int) -> bytes:
    """What a program makes of a file: {in}, {out} and {dir} in its arguments are put in."""
    with tempfile.TemporaryDirectory() as d:
        source, target = Path(d, "in" + ext), Path(d, "in" + ext + "x")
        source.write_bytes(content)
        subprocess.run([a.format(**{"in": source, "out": target, "dir": d}) for a in program], check=True, timeout=timeout, capture_output=True)
        if not (made := target.read_bytes()):
            raise RuntimeError("empty result")
        return made


def xls_with_reader(content: bytes) -> bytes:
    """A legacy workbook, read by an installed library, as XLSX with inline text."""
    sheets = pd.read_excel(io.BytesIO(content), sheet_name=None, header=None)
    return xlsx_of({name: frame.fillna("").astype(str).values.tolist() for name, frame in sheets.items()})


def xlsx_parts(sheets: dict[str, list[list[str]]]) -> dict[str, str]:
    """The parts of a workbook of text cells, by name."""
    main, rel, esc = S[1:-1], R[1:-1], html.escape
    cell = lambda c: f'<c t="inlineStr"><is><t xml:space="preserve">{esc(c)}</t></is></c>'
    names = "".join(f'<sheet name="{esc(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>",
    }
    for i, rows in enumerate(sheets.values(), 1):
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{main}"><sheetData>' + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows) + "</sheetData></worksheet>"
    return parts


def xlsx_of(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook of text cells."""
    return zipped(xlsx_parts(sheets), again=frozenset(["xl/workbook.xml", "xl/_rels/workbook.xml.rels"]))


def legacy_with_office(content: bytes, ext: str, timeout: int = 120) -> tuple[bytes, str]:
    """A legacy file converted by an office program; failing that, a document by ``textutil``, a workbook by a library."""
    program = shutil.which("soffice") or shutil.which("libreoffice")
    routes: list[Callable[[], bytes]] = []
    if program:
        routes.append(lambda: _converted([program, "--headless", "--convert-to", ext[1:] + "x", "--outdir", "{dir}", "{in}"], content, ext, timeout))
    if ext == ".doc" and (other := shutil.which("textutil")):
        routes.append(lambda: _converted([other, "-convert", "docx", "-output", "{out}", "{in}"], content, ext, timeout))
    if ext == ".xls":
        routes.append(lambda: xls_with_reader(content))
    error = RuntimeError("no office program to convert legacy files")
    for route in routes:
        try:
            return route(), ext + "x"
        except Exception as e:  # noqa: BLE001  the next route is tried
            error = e
    raise error


def plain(content: bytes) -> dict:
    """Any other file as UTF-8 text."""
    return record("text", blocks=[{"kind": "paragraph", "style": "verbatim", "text": content.decode("utf-8", "replace"), "rows": None}])


def generic(content: bytes) -> dict:
    """Text of a file by what it holds: an Office file part by part (broken XML too), or text without control bytes; raises on other content."""
    if content.startswith(b"PK"):
        said = lambda tag, raw: html.unescape("".join(re.findall(rf"<(?:\w+:)?{tag}(?:\s[^>]*)?>([^<]*)</", raw)))
        z = Parts(content)
        read = lambda name: z.read(name).decode("utf-8", "replace")
        names = sorted(z.names, key=lambda n: (len(n), n))
        shared = [said("t", x) for n in names if n == "xl/sharedStrings.xml" for x in re.findall(r"<si>(.*?)</si>", read(n), re.S)]
        blocks = []
        for n in names:
            if n == "word/document.xml":
                lines = [t for p in re.split(r"</w:p>", read(n)) if (t := said("t", p).strip())]
                blocks += [{"kind": "paragraph", "style": "", "text": t, "rows": None} for t in lines]
            elif n.startswith("xl/worksheets/"):
                rows = []
                for r in re.findall(r"<row[^>]*>(.*?)</row>", read(n), re.S):
                    rows.append([])
                    for head, cell in re.findall(r"<c\b([^>]*)>(.*?)</c>", r, re.S):
                        value = said("v", cell)
                        at_shared = 't="s"' in head and value.isdigit() and int(value) < len(shared)
                        rows[-1].append(shared[int(value)] if at_shared else value or said("t", cell))
                width = max(map(len, rows), default=0)
                blocks.append({"kind": "sheet", "style": "", "text": Path(n).stem, "rows": [r + [""] * (width - len(r)) for r in rows]})
        return record("xlsx" if blocks and blocks[0]["kind"] == "sheet" else "docx", blocks=blocks)
    text = content.decode("utf-8")
    if re.search(r"[\x00-\x08\x0E-\x1F]", text):
        raise ValueError("no text")
    return plain(content)


def _absent(content: bytes) -> dict:
    raise RuntimeError("no decoder for this format is installed")


#: Decoder of each suffix; register others by adding to it or passing ``decoders``.
DECODERS: dict[str, Callable[[bytes], dict]] = {".docx": docx, ".xlsx": xlsx, ".pdf": pdf_file}
# The notes of files that went to the generic reader.
FALLBACK = {".docx": "DOCX native parser warning: {}; Using MarkItDown fallback.", ".xlsx": "Excel parser warning: {}"}


def decode_one(filename: str, content: bytes, decoders: dict[str, Callable[[bytes], dict]], legacy: Callable[[bytes, str], tuple[bytes, str]], fallback: Callable[[bytes], dict] = generic) -> dict:
    ext, via = Path(filename).suffix.lower(), False
    try:
        if ext in LEGACY:
            content, ext = legacy(content, ext)
            via = True
        if ext in FALLBACK:
            try:
                found = decoders[ext](content)
                if ext == ".docx" and not found["blocks"]:
                    found = fallback(content)
            except Exception as e:  # noqa: BLE001  the generic reader is next
                found = fallback(content) | {"error": FALLBACK[ext].format(str(e) or type(e).__name__)}
        else:
            found = decoders.get(ext, fallback)(content)
        return found | {"converted_via_legacy": via}
    except Exception as e:  # noqa: BLE001  a file that can't be read is a row with an error
        return record(ext.lstrip("."), error=str(e) or type(e).__name__)


#: Files, and bytes of them, whose records are held as objects at a time.
RECORDS, FILE_BYTES = 256, 8 << 20


def decoded_pieces(files: Iterable[tuple[str, bytes]], decode: Callable[[str, bytes], dict]) -> Iterator[pa.Array]:
    """Records of files (name, content) in order, as Arrow arrays of RECORDS files or FILE_BYTES of content each. No record outlives its piece."""
    records, size = [], 0
    for name, content in files:
        records.append(decode(name, content))
        size += len(content)
        if len(records) >= RECORDS or size >= FILE_BYTES:
            yield pa.array(records, DECODED_ARROW)
            records, size = [], 0
    yield pa.array(records, DECODED_ARROW)


def decode_files(files: DataFrame, decoders: dict[str, Callable[[bytes], dict]] | None = None, legacy: Callable[[bytes, str], tuple[bytes, str]] = legacy_with_office) -> DataFrame:
    """``files`` (filename, content, ...) with column ``decoded``. Records become Arrow piece by piece, so few exist as objects."""
    from pyspark.sql.functions import arrow_udf

    decoders = {**DECODERS, **(decoders or {})}

    @arrow_udf(DECODED)
    def run(filename: pa.Array, content: pa.Array) -> pa.Array:
        named = ((f.as_py(), bytes(c.as_py())) for f, c in zip(filename, content))
        return pa.concat_arrays(list(decoded_pieces(named, lambda f, c: decode_one(f, c, decoders, legacy))))

    return files.withColumn("decoded", run("filename", "content"))


def exploded_pages(found: DataFrame, *keep: str) -> DataFrame:
    """One row for each page of files with ``decoded``, after the columns to keep.

    Not a plain ``inline``: for one, the optimizer adds a filter on its input, with the
    decoder in it, and moves that below any repartition: all files would be decoded
    twice, the first time by as few tasks as the input has.
    """
    from pyspark.sql import functions as F

    return found.select(*keep, F.inline_outer("decoded.pages")).filter("page_number is not null")


def parse_words(tsv: str) -> tuple[str, float]:
    """Text, line by line, and confidence (0 to 1) from a table of recognised words.

    Confidence is the mean over words that aren't blank and have one; 1.0 without any.
    """
    rows = [r.split("\t") for r in tsv.splitlines()]
    at = {n: i for i, n in enumerate(rows[0])} if rows else {}
    lines, confs = {}, []
    for r in rows[1:]:
        word = r[at["text"]] if len(r) > at["text"] else ""
        if word.strip():
            lines.setdefault(tuple(int(r[at[k]]) for k in ("block_num", "par_num", "line_num")), []).append(word)
            if float(r[at["conf"]]) >= 0:
                confs.append(float(r[at["conf"]]))
    return "\n".join(" ".join(w) for _, w in sorted(lines.items())), round(sum(confs) / len(confs) / 100, 2) if confs else 1.0


def tesseract_program(image: bytes, lang: str = "vie+eng", psm: int = 3, oem: int = 1, timeout: int = 60) -> tuple[str, float]:
    """Text recognition by the command-line program, of the upright image without marks, in one call for text and confidence."""
    args = ["tesseract", "stdin", "stdout", "-l", lang, "--psm", str(psm), "--oem", str(oem), "tsv"]
    ready = images.without_marks(images.upright(image))
    return parse_words(subprocess.run(args, input=ready, check=True, timeout=timeout, capture_output=True).stdout.decode("utf-8", "replace"))


def parse_boxes(result) -> tuple[str, float]:
    """Text in reading order and mean confidence from recognised boxes, as dictionaries (a newer form) or nested lists (an older one).

    Blank texts are left out; a box of a dictionary with fewer than four numbers counts as (0, 0).
    """
    items: list[tuple[float, float, str, float]] = []
    if isinstance(result, list) and result and isinstance(result[0], dict):
        for page in result:
            boxes = page.get("rec_boxes", [])
            for i, (text, score) in enumerate(zip(page.get("rec_texts", []), page.get("rec_scores", []))):
                x, y = (float(boxes[i][0]), float(boxes[i][1])) if i < len(boxes) and len(boxes[i]) >= 4 else (0.0, 0.0)
                items.append((y, x, str(text).strip(), float(score)))
    elif isinstance(result, list) and result and isinstance(result[0], list):
        for line in result[0]:
            if line and len(line) > 1 and isinstance(line[1], (tuple, list)) and len(line[1]) > 1:
                x, y = (float(line[0][0][0]), float(line[0][0][1])) if line[0] else (0.0, 0.0)
                items.append((y, x, str(line[1][0]).strip(), float(line[1][1])))
    items = sorted((i for i in items if i[2]), key=lambda i: (round(i[0] / LINE) * LINE, i[1]))
    if not items:
        return "", 1.0
    return "\n".join(i[2] for i in items), round(sum(i[3] for i in items) / len(items), 2)


#: Height of a line of recognised boxes.
LINE = 14
_engines: dict[str, object] = {}
_lock = threading.Lock()


class Lazy:
    """An engine that each worker process starts once, when it is first asked; a pickled one takes none along.

    ``read`` turns the started engine and an image into text and confidence.
    """

    def __init__(self, name: str, start: Callable[[], object], read: Callable[[object, bytes], tuple[str, float]]):
        self.name, self.start, self.read = name, start, read

    def __call__(self, image: bytes) -> tuple[str, float]:
        if self.name not in _engines:
            with _lock:
                if self.name not in _engines:
                    _engines[self.name] = self.start()
        return self.read(_engines[self.name], image)


def _start_paddle():
    from paddleocr import PaddleOCR

    return PaddleOCR(use_doc_unwarping=False, use_textline_orientation=True, lang="vi")


def _read_paddle(started, image: bytes) -> tuple[str, float]:
    samples = images.read_png(image)
    samples = samples.repeat(3, 2) if samples.shape[2] == 1 else samples[:, :, :3]
    return parse_boxes(started.predict(samples) if hasattr(started, "predict") else started.ocr(samples))


#: Text recognition by name: image bytes to text and confidence (0 to 1).
ENGINES: dict[str, Callable[[bytes], tuple[str, float]]] = {"tesseract": tesseract_program} if shutil.which("tesseract") else {}
if importlib.util.find_spec("paddleocr"):
    ENGINES["paddleocr"] = Lazy("paddleocr", _start_paddle, _read_paddle)


def engine(name: str, engines: dict | None = None, default: str = "tesseract") -> Callable[[bytes], tuple[str, float]] | None:
    """The named engine; ``paddle`` is short for ``paddleocr``; an unknown name gives the default."""
    known = {**ENGINES, **(engines or {})}
    key = {"paddle": "paddleocr"}.get(name.strip().lower(), name.strip().lower())
    return known.get(key) or known.get(default)


def capabilities(spark: SparkSession) -> DataFrame:
    """One row: which decoders, engines and programs are there."""
    row = (sorted(k for k, v in DECODERS.items() if v is not _absent), sorted(ENGINES) or ["tesseract"], bool(shutil.which("soffice") or shutil.which("libreoffice")), bool(shutil.which("tesseract")))
    return spark.createDataFrame([row], "formats array<string>, ocr_engines array<string>, office boolean, tesseract boolean")
