"""Preparation of page images, engines and readers of last resort."""

import io
import pickle
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pdf_files import simple

from folioforge.sources import decoders, images, pdf


def filtered(samples, kinds):
    """A PNG whose rows are coded with the filters given."""
    h, w, c = samples.shape
    rows, before = b"", np.zeros((w, c), int)
    for y in range(h):
        kind, row = kinds[y % len(kinds)], samples[y].astype(int)
        left = np.vstack([np.zeros((1, c), int), row[:-1]])
        corner = np.vstack([np.zeros((1, c), int), before[:-1]])
        p = left + before - corner
        near = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        coded = row - [0, left, before, (left + before) // 2, near][kind]
        rows += bytes([kind]) + (coded & 255).astype(np.uint8).tobytes()
        before = row
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_round_trips(channels):
    samples = np.random.default_rng(channels).integers(0, 256, (11, 7, channels)).astype(np.uint8)
    assert (images.read_png(images.write_png(samples)) == samples).all()
    assert (images.read_png(filtered(samples, [0, 1, 2, 3, 4])) == samples).all()


def test_marks_go_and_ink_stays():
    shades = np.array([[[0], [149], [165], [166], [255]]], np.uint8)
    assert images.read_png(images.without_marks(images.write_png(shades))).ravel().tolist() == [0, 0, 0, 255, 255]
    colours = np.array([[[255, 0, 0], [200, 200, 200]]], np.uint8)
    assert images.read_png(images.without_marks(images.write_png(colours))).ravel().tolist() == [0, 255]
    assert images.without_marks(b"\xff\xd8 jpeg") == b"\xff\xd8 jpeg"


def test_pages_are_turned_upright():
    page = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    turned = images.read_png(images.upright(images.write_png(page), lambda i: (90, 2.0)))
    assert turned[:, :, 0].tolist() == [[3, 0], [4, 1], [5, 2]]
    for found in [(0, 9.0), (90, 1.9), (45, 9.0)]:
        assert images.upright(images.write_png(page), lambda i, f=found: f) == images.write_png(page)
    seen = []
    images.upright(images.write_png(np.zeros((10, 3200, 1), np.uint8)), lambda i: (seen.append(images.read_png(i).shape), (0, 0.0))[1])
    assert max(seen[0]) <= images.OSD_SIDE
    assert images.upright(b"no image", lambda i: 1 / 0) == b"no image"


def test_boxes_of_both_forms():
    new = [{"rec_texts": ["right", " ", "left", "low"], "rec_scores": [0.5, 0.1, 1.0, 0.6], "rec_boxes": [[50, 3, 60, 9], [0, 0, 1, 1], [2, 4, 9, 9], [1]]}]
    assert decoders.parse_boxes(new) == ("low\nleft\nright", 0.7)
    old = [[[[[50, 3], [60, 3]], ("right", 0.5)], [[], ("first", 1.0)], [[[2, 4]], ("left", 0.9)], None, [[[0, 40]], "odd"], [[[0, 40]], ["last", 0.6]]]]
    assert decoders.parse_boxes(old) == ("first\nleft\nright\nlast", 0.75)
    assert decoders.parse_boxes([]) == decoders.parse_boxes(None) == decoders.parse_boxes([[]]) == ("", 1.0)


STARTED = []


def start():
    STARTED.append(1)
    return "engine"


def read(engine, image):
    return f"{engine} {image!r}", 1.0


def test_engines_start_once_and_late():
    lazy = decoders.Lazy("counted", start, read)
    again = pickle.loads(pickle.dumps(lazy))
    assert not STARTED
    assert [lazy(b"a"), again(b"b"), lazy(b"c")] == [("engine b'a'", 1.0), ("engine b'b'", 1.0), ("engine b'c'", 1.0)] and len(STARTED) == 1


def decode(name, content):
    return decoders.decode_one(name, content, decoders.DECODERS, decoders.legacy_with_office)


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


def test_generic_reader_takes_over():
    broken = decode("a.docx", zipped(word__document_xml="<w:document><w:p><w:t>One &amp; two</w:t></w:p><w:p><w:r><w:t xml:space='preserve'>thr</w:t><w:t>ee</w:t></w:p>"))
    assert [b["text"] for b in broken["blocks"]] == ["One & two", "three"] and broken["error"].startswith("DOCX native parser warning: ")
    book = decode("a.xlsx", zipped(xl__sharedStrings_xml="<sst><si><t>shared</t></si></sst>", xl__worksheets__sheet1_xml='<worksheet><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2</v></c></row><row r="2"></row><row r="3"><c t="inlineStr"><is><t>x</t></is></c></row>'))
    assert book["kind"] == "xlsx" and book["blocks"][0]["rows"] == [["shared", "2"], ["", ""], ["x", ""]] and book["error"].startswith("Excel parser warning: ")
    assert decode("a.docx", b"plain text")["blocks"][0]["text"] == "plain text"
    assert decode("a.docx", b"\x00\xff")["error"] and not decode("a.docx", b"\x00\xff")["blocks"]
    assert decode("note.md", "é".encode())["blocks"][0]["text"] == "é"


def test_legacy_routes(monkeypatch):
    monkeypatch.setattr(decoders.shutil, "which", lambda name: None)
    assert "no office program" in decode("a.doc", b"x")["error"]
    assert decode("a.xls", b"x")["error"]
    monkeypatch.setattr(decoders, "xls_with_reader", lambda content: decoders.xlsx_of({"Lá & một": [["a", "b<"], ["", "c"]]}))
    found = decode("a.xls", b"x")
    assert found["converted_via_legacy"] and found["blocks"] == [{"kind": "sheet", "style": "", "text": "Lá & một", "rows": [["a", "b<"], ["", "c"]]}]


def test_pdf_files_are_decoded_and_repaired():
    good, white = simple(["one\ntwo"]), simple(["a"], image=bytes([255] * 4))
    assert [p["text_layer"] for p in decode("a.pdf", good)["pages"]] == ["one\ntwo"] and not decode("a.pdf", good)["repaired"]
    joined = b"junk" * 600 + good
    assert not pdf.healthy(joined)
    assert decode("a.PDF", joined)["repaired"] and decode("a.PDF", joined)["pages"][0]["text_layer"] == "one\ntwo"
    assert decode("a.pdf", white)["pages"][0]["text_layer"] == "a" and not decode("a.pdf", white)["repaired"]
    assert decode("a.pdf", b"nothing")["error"] and decode("a.pdf", b"nothing")["pages"][0]["text_layer"] == ""
