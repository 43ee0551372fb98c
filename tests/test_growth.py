"""Work that must not grow faster than the input: how often, where and in which pieces it is done."""

import io
import re
import weakref
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pdf_files import simple

from folioforge import catalogue
from folioforge.functions import text as T
from folioforge.operators import cleaning, metadata, structure, tables
from folioforge.plans import package
from folioforge.sources import archives, decoders, pdf


@pytest.mark.parametrize("name", ["pdf_pages", "page_images"])
def test_files_are_decoded_once_and_by_all_tasks(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython [run(") == 1
    # Above the exchange that deals the rows out, not below it.
    assert plan.index("EvalPython [run(") < plan.index("RoundRobinPartitioning")


def test_package_files_in_pieces(spark, sf, monkeypatch):
    """Index, manifest and report are made in pieces of few documents and are end to end what they are as one row."""
    monkeypatch.setattr(package, "PIECE", 4)
    docs = catalogue.gated_documents(spark, sf).filter("doc_id < 80")
    now = "2024-01-01T00:00:00"
    pieces = {}
    for found in package.own_pieces(docs, now):
        for r in found.toLocalIterator():
            pieces.setdefault(r.path, []).append(bytes(r.content).decode())
    assert all(len(pieces[p]) > 1 for p in pieces if p != "README.txt")
    assert "".join(pieces["technical/manifest.json"]) == package.indented(package.manifest(docs, now)).first().content
    assert "".join(pieces["upload_to_ai/00_Master_Index.md"]) == package.master_index(docs, now).first().content
    assert "".join(pieces["technical/conversion_report.md"]) == package.conversion_report(docs).first().content
    for some in ("not validation.is_safe_for_ai", "false"):
        few = docs.filter(some)
        made = {}
        for r in (r for found in package.own_pieces(few, now) for r in found.toLocalIterator()):
            made[r.path] = made.get(r.path, "") + bytes(r.content).decode()
        assert made["technical/manifest.json"] == package.indented(package.manifest(few, now)).first().content
        assert made["technical/conversion_report.md"] == package.conversion_report(few).first().content


def test_pieces_are_one_file_of_an_archive():
    out = io.BytesIO()
    package.write_zip([{"path": "a", "part": 3, "content": b"x"}, {"path": "a", "part": 9, "content": b"y"}, {"path": "b", "part": None, "content": b"z"}, {"path": "c", "content": b""}], out)
    with zipfile.ZipFile(out) as z:
        assert [(i.filename, z.read(i)) for i in z.infolist()] == [("a", b"xy"), ("b", b"z"), ("c", b"")]


def test_letters_are_counted_as_the_patterns_do(spark):
    every = spark.createDataFrame([(chr(i),) for i in range(1, 0x3000)], "text string")
    marked, plain = f"(?iu)[{T.ACCENTED}]", f"[a-zA-Z{T.ACCENTED}Đ]"
    assert [r.text for r in every.filter((T.marked_letters(F.col("text")) != F.regexp_count("text", F.lit(marked))) | (T.plain_letters(F.col("text")) != F.regexp_count("text", F.lit(plain)))).collect()] == []
    found = every.agg(F.sum(T.marked_letters(F.col("text"))).alias("n"))
    assert found.first().n == 2 * len(T.ACCENTED) and "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rules_are_reached_by_a_string_that_they_need():
    """No text goes through the pattern of a test: a word of each rule is looked for instead, and each rule's own finds have it."""
    for pattern, _ in cleaning.corrections():
        word = cleaning.needed(pattern)
        assert len(word) > 1 and re.search(re.escape(word), pattern.replace("\\/", "/").replace("\\.", "."))
    for pattern, said in [(r"(?U)\bCHƯƠNG\s+\]V\b", "CHƯƠNG  ]V"), (r"(?U)\b1\)?7\s+lO\b", "17 lO"), (r"(?U)\b(?:TS\/|Ty|TS,|TiS)\s+1e\b", "Ty 1e"), (r"(?U)\bch[iI]t luarng\b", "chIt luarng"), (r"(?U)\./[^\s\n]*", "a ./x")]:
        assert cleaning.needed(pattern) in said


def test_batches_are_written_in_parts():
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * 9, None, b"", b"y" * 30, b"z"])], ["content"])
    parts = [p.column(0).to_pylist() for p in package.slices(batch, "content", rows=2, most=20)]
    assert parts == [[b"x" * 9, None], [b""], [b"y" * 30], [b"z"]]
    assert list(package.slices(batch.slice(0, 0), "content")) == []


def test_pdf_files_are_parsed_once(monkeypatch):
    parsed, file = [], pdf.File
    monkeypatch.setattr(pdf, "File", lambda data: parsed.append(len(data)) or file(data))
    found = decoders.decode_one("a.pdf", simple(["one", "two"]), decoders.DECODERS, None)
    assert [p["text_layer"] for p in found["pages"]] == ["one", "two"] and len(parsed) == 1


def test_parts_of_archives_are_those_of_zipfile():
    """What the short way reads, and what it leaves to ``zipfile``, has that module's contents and errors."""

    def made(packing: int, comment: bytes = b"", names: tuple[str, ...] = ("a.xml", "b/c.xml")) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", packing) as z:
            for i, n in enumerate(names):
                z.writestr(n, f"{n}{i} " * 50)
            z.comment = comment
        return out.getvalue()

    def said(read):
        try:
            return read()
        except Exception as e:
            return type(e), str(e)

    stored, packed = made(zipfile.ZIP_STORED), made(zipfile.ZIP_DEFLATED)
    at = packed.index(b"a.xml") + 8
    odd = [stored, packed, made(zipfile.ZIP_LZMA), made(8, b"note"), made(8, names=("ạ.xml", "a.xml")), made(8, names=()), b"junk" + packed, packed + b"junk", packed[:-30], b"PK", b"", packed[:at] + b"\xff\xff" + packed[at + 2 :], stored.replace(b"a.xml0 a", b"a.xml0 b", 1), stored.replace(b"a.xml", b"x.xml", 1)]
    odd.append(archives.zipped({"a.xml": "ạ" * 9, "b/c.xml": ""}))
    odd.append(archives.zipped({"a.xml": "x", "ạ": "y"}, deflate=False))
    for content in odd:
        theirs = lambda name, c=content: zipfile.ZipFile(io.BytesIO(c)).read(name)
        ours = lambda name, c=content: archives.Parts(c).read(name)
        for name in ("a.xml", "b/c.xml", "ạ.xml", "none"):
            assert said(lambda: ours(name)) == said(lambda: theirs(name))
        assert said(lambda c=content: archives.Parts(c).names) == said(lambda c=content: zipfile.ZipFile(io.BytesIO(c)).namelist())
    assert archives.Parts(stored).whole is None and archives.Parts(packed).whole is None


def test_shared_parts_are_parsed_once(monkeypatch):
    """Styles, relations and lists of sheets that come again in the next file are not parsed again."""
    book = lambda x: decoders.xlsx_of({"Một": [["a", x]], "Hai": []})
    one, two = book("b"), book("c")
    assert decoders.xlsx(one)["blocks"][0]["rows"] == [["a", "b"]]
    parsed, parse = [], decoders.ElementTree.fromstring
    monkeypatch.setattr(decoders.ElementTree, "fromstring", lambda raw: parsed.append(raw) or parse(raw))
    assert [(b["text"], b["rows"]) for b in decoders.xlsx(two)["blocks"]] == [("Một", [["a", "c"]]), ("Hai", [])]
    assert len(parsed) == 2  # the two sheets


def test_records_of_files_are_held_in_pieces(monkeypatch):
    """However many files a batch has, no more of their records are alive than a piece holds."""
    live, most = weakref.WeakSet(), []

    class Blocks(list):
        pass

    def decode(name: str, content: bytes) -> dict:
        blocks = Blocks([{"kind": "paragraph", "style": "", "text": f"{name} {len(content)}", "rows": None}])
        live.add(Counted(blocks))
        most.append(len(live))
        return decoders.record("docx", blocks=blocks)

    class Counted:
        def __init__(self, blocks: Blocks):
            blocks.own = self

        __hash__ = object.__hash__

    monkeypatch.setattr(decoders, "RECORDS", 16)
    monkeypatch.setattr(decoders, "FILE_BYTES", 100)
    sizes = [1] * 200 + [60, 60, 60] + [500] * 3 + [0] * 40
    pieces = list(decoders.decoded_pieces(((f"f{i}", b"x" * n) for i, n in enumerate(sizes)), decode))
    assert [b[0]["text"] for p in pieces for b in p.field("blocks").to_pylist()] == [f"f{i} {n}" for i, n in enumerate(sizes)]
    assert max(map(len, pieces)) == 16 and max(most) <= 17
    assert [len(p) for p in decoders.decoded_pieces([], decode)] == [0]


def test_cells_of_a_table_are_cleaned_once(spark):
    rows = spark.createDataFrame([([["a|b", None], ["c\nd"], None],), ([["", " "], ["x"]],), ([],), (None,)], "rows array<array<string>>")
    found = rows.select(tables.markdown_table(F.col("rows")).alias("md"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("\\|") == 1
    assert [r.md for r in found.collect()] == ["| a\\|b |  |\n| --- | --- |\n| c d |  |", "| Cột 1 | Cột 2 |\n| --- | --- |\n|  |  |\n| x |  |", "", ""]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_whole_conversion_reads_documents_once(spark, sf):
    """No branch for pages of PDF files is left for texts, and capitals for the document type are made once."""
    plan = _plan(catalogue.converted_documents(spark, sf))
    assert plan.count("Relation [") + plan.count("Relation[") == 1 and "Join" not in plan
    assert plan.count("upper(") < 20  # 238 before


def test_steps_over_whole_texts_are_done_once(spark):
    """Lines for anchors are cut once, not for each heading; words are counted, not listed; a text without blank ends is not walked by a trim."""
    said = ["", " \u3000", "a", " a\u2003b\u00a0c ", "#*|a|*", "x\U0001f600y \U0001f600", "\u1680\u3000\x1c", "a\u2028b\x85c`d`", "từ\x1fngữ [a](b)"]
    texts = spark.createDataFrame([(x,) for x in said], "text string")
    words = texts.select("text", T.word_count(F.col("text")).alias("n"))
    assert [r.n for r in words.collect()] == [len(re.sub(r"[#*`_~\[\]()><!|]", " ", r.text).split()) for r in words.collect()]
    assert "split(" not in _plan(words)
    ends = texts.select("text", T.strip_text(F.col("text")).alias("s"))
    assert [r.s for r in ends.collect()] == [x.strip() for x in said]
    anchored = spark.createDataFrame([("x\n# A\ny\n## B\n",)], "md string").select(structure.anchored(F.col("md"), structure.sections(F.col("md"))).alias("md"))
    assert anchored.first().md == 'x\n<a id="sec-a"></a>\n# A\ny\n<a id="sec-b"></a>\n## B\n'
    plan = _plan(spark.createDataFrame([("x",)], "md string").select(structure.anchored(F.col("md"), F.array().cast("array<struct<id:string>>")).alias("md")))
    assert plan.count("split(") == 1


def test_openings_and_types_behind_their_tests(spark):
    """Every heading and document type is found behind the cheap tests, in any place, and words inside others are none."""
    heads = ["QUYẾT ĐỊNH", "Quy chế", "bản cam kết", "NGUYÊN TẮC", "chính sách", "Chương IV", "PHẦN 2", "phụ lục 3", "Mục A.", "điều 5."]
    texts = spark.createDataFrame([(b + h,) for h in heads for b in ("", "x\n \u3000", "\n\n\t")] + [("x QUY CHẾ",), ("\r\u2028x",)], "text string")
    found = [r.t for r in texts.select(structure.format_structure(F.col("text")).alias("t")).collect()]
    assert ["#" in t for t in found] == [True] * 3 * len(heads) + [False] * 2
    words = [(name, p.removeprefix(r"^\s*").replace(r"\b", ""), p.startswith("^")) for name, patterns in metadata.TYPES for p in patterns]
    rows = spark.createDataFrame([(n, w, f"{'' if first else 'a b, '}{w}.", f"a{w}b") for n, w, first in words], "name string, word string, inside string, part string")
    kinds = {name for name, _ in metadata.TYPES}
    for r in rows.select("name", "word", metadata.document_type(F.lit("x"), F.col("inside")).alias("a"), metadata.document_type(F.lit("x"), F.col("part")).alias("b")).collect():
        assert r.a in kinds and (r.a == r.name or r.word.startswith(("QUY", "HƯỚNG", "HUONG")))
        assert r.b == ""
