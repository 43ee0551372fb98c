"""Document structure: line classes, headings, section ids and pages.

A document's lines are walked in order by one fold over the array of lines, so a
document never leaves its row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, lines, slugify, strip

# Openings of administrative headings: pattern, heading mark, length below which it holds (0: any).
HEADINGS = [
    (r"(?iuU)^(QUYẾT ĐỊNH|QUY CHẾ|QUY ĐỊNH|BẢN CAM KẾT|NGUYÊN TẮC|CHÍNH SÁCH)\b", "#", 120),
    (r"(?iuU)^(CHƯƠNG|PHẦN)\s+([IVXLCDM]+|\d+)\b", "##", 0),
    (r"(?iuU)^Phụ\s+lục\s*([IVXLCDM]+|\d+|:)?\b", "##", 80),
    (r"(?iuU)^Mục\s+([IVXLCDM]+|\d+|[A-Z])[.:\s]", "###", 0),
    (r"(?iuU)^Điều\s+\d+[.:\s\-]", "###", 0),
]
#: What a text with any such opening has at the start of a line.
OPENS = r"(?iuUdm)^[\s\x1C-\x1F&&[^\n]]*+(?:QUY|BẢN|NGUYÊN|CHÍNH|CHƯƠNG|PHẦN|PHỤ|MỤC|ĐIỀU)"
PAGE_MARK = r"(?i)<!--\s*(?:source_page|Page)[\s:]*(\d+)[^>]*-->"
HEADING = r"(?d)^(#{1,6})(?U:\s)+(.+)$"


def heading_mark(line: Column) -> Column:
    """'#', '##' or '###' for a line that opens a heading, else ''."""
    return _mark(strip(line))


def _mark(s: Column) -> Column:
    """:func:`heading_mark` of a line without outer blanks."""
    out = F.when(s.startswith("#") | s.startswith("<!--") | s.startswith(">") | (s == ""), "")
    for pattern, mark, below in HEADINGS:
        fits = s.rlike(pattern)
        out = out.when(fits & (F.length(s) < below) if below else fits, mark)
    return out.otherwise("")


def format_structure(text: Column) -> Column:
    """Administrative headings become Markdown headings between blank lines."""

    # In lambdas every use of an expression is a computation, so each step is one pass of its own.
    stripped = F.transform(lines(text), lambda line: F.struct(line.alias("line"), strip(line).alias("s")))
    marked = F.transform(stripped, lambda x: F.struct(x["line"].alias("line"), x["s"].alias("s"), _mark(x["s"]).alias("mark")))
    made = F.transform(marked, lambda x: F.when(x["mark"] == "", x["line"]).otherwise(F.concat(F.lit("\n"), x["mark"], F.lit(" "), x["s"], F.lit("\n"))))
    # Lines are looked at one by one only in texts that have an opening.
    joined = F.when(text.rlike(OPENS), F.array_join(made, "\n")).otherwise(text)
    return let(joined, lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, "\n{3,}", "\n\n")).otherwise(t))


def page_of(line: Column) -> Column:
    """Page number of a page marker in the line, else null."""
    return F.when(line.contains("<!--"), F.regexp_extract(line, PAGE_MARK, 1).try_cast("int"))


def heading_parts(line: Column) -> tuple[Column, Column]:
    """Level (0: no heading) and title without tags."""
    level = F.when(line.startswith("#"), F.length(F.regexp_extract(line, HEADING, 1))).otherwise(0)
    return level, F.when(line.startswith("#"), strip(F.regexp_replace(F.regexp_extract(line, HEADING, 2), "<[^>]+>", ""))).otherwise("")


def unique_ids(slugs: Column) -> Column:
    """Ids in order: ``sec-`` and the slug; a used one gets the first free number from 2 on."""
    empty = F.array().cast("array<string>")

    def add(used: Column, slug: Column) -> Column:
        base = F.concat(F.lit("sec-"), slug)
        names = F.concat(F.array(base), F.transform(F.sequence(F.lit(2), F.size(used) + 2), lambda i: F.concat(base, F.lit("-"), i.cast("string"))))
        free = F.when(F.array_contains(used, base), F.get(F.array_except(names, used), F.lit(0))).otherwise(base)
        return F.concat(used, F.array(free))

    return F.aggregate(slugs, empty, add)


SECTION = "id string, heading string, level int, source_page_start int, source_page_end int"


def sections(markdown: Column) -> Column:
    """Array of sections of a formatted text: id, heading, level and pages, in order."""
    # Only lines with a page mark or a heading matter; the others are left out before the fold.
    rows = F.filter(lines(markdown), lambda line: line.startswith("#") | line.contains("<!--"))
    rows = F.transform(rows, lambda line: F.struct(page_of(line).alias("page"), heading_parts(line)[0].alias("level"), heading_parts(line)[1].alias("title")))
    none = F.array().cast("array<struct<level:int,title:string,page:int>>")

    def walk(acc: Column, row: Column) -> Column:
        page = F.coalesce(row["page"], acc["page"])
        found = F.array(F.struct(row["level"].alias("level"), row["title"].alias("title"), page.alias("page")))
        return F.struct(page.alias("page"), F.when(row["level"] > 0, F.concat(acc["found"], found)).otherwise(acc["found"]).alias("found"))

    walked = F.aggregate(rows, F.struct(F.lit(1).alias("page"), none.alias("found")), walk)
    named = F.transform(F.array(walked), lambda w: F.struct(w["page"].alias("page"), w["found"].alias("found"), unique_ids(F.transform(w["found"], lambda s: slugify(s["title"]))).alias("ids")))

    def finish(w: Column) -> Column:
        end = lambda s, i: F.greatest(s["page"], F.coalesce(F.get(w["found"], i + 1)["page"], w["page"]))
        return F.transform(w["found"], lambda s, i: F.struct(F.get(w["ids"], i).alias("id"), s["title"].alias("heading"), s["level"].alias("level"), s["page"].alias("source_page_start"), end(s, i).alias("source_page_end")))

    return F.transform(named, finish)[0]


def anchored(markdown: Column, found: Column) -> Column:
    """The text with an anchor line before every heading, ids taken from ``found`` in order."""
    cut = F.transform(lines(markdown), lambda line: F.struct(line.alias("line"), heading_parts(line)[0].alias("level"), heading_parts(line)[1].alias("title")))

    # The text between two headings goes with the one before it: heading lines cut the lines into parts. Lines and places are bound once, not for every heading.
    def whole(parted: Column, places: Column) -> Column:
        def part(i: Column, n: Column) -> Column:
            head = F.get(parted, i)
            anchor = F.concat(F.lit('<a id="'), F.get(found, n)["id"], F.lit('"></a>\n'), F.repeat(F.lit("#"), head["level"]), F.lit(" "), head["title"])
            rest = F.transform(F.slice(parted, i + 2, F.coalesce(F.get(places, n + 1), F.size(parted)) - i - 1), lambda x: x["line"])
            return F.array_join(F.concat(F.array(anchor), rest), "\n")

        before = F.transform(F.slice(parted, 1, F.coalesce(F.get(places, F.lit(0)), F.size(parted))), lambda x: x["line"])
        return F.array_join(F.concat(F.when(F.size(before) > 0, F.array(F.array_join(before, "\n"))).otherwise(F.array().cast("array<string>")), F.transform(places, part)), "\n")

    headed = markdown.startswith("#") | markdown.contains("\n#")
    places = lambda parted: F.filter(F.transform(parted, lambda x, i: F.when(x["level"] > 0, i)), lambda i: i.isNotNull())
    return F.when(headed, let(cut, lambda parted: let(places(parted), lambda at: whole(parted, at)))).otherwise(markdown)
