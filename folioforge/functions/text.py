"""Text expressions. Whitespace, words and case follow Unicode; missing text is ''.

Every function takes and returns a Column and stays inside code generation,
except NFC normalisation, which Spark has no expression for.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented letters and their plain forms, letter by letter.
ACCENTED = "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
PLAIN = "aaaaaaaaaaaaaaaaadeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyy"

#: What counts as a blank in Python's strip() and split() but not in Java's Unicode \s.
BLANK = r"[\s\x1C-\x1F]"


#: All of these characters: Unicode whitespace and the ASCII separators.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode whitespace at both ends; for names and lines."""
    return F.trim(c, F.lit(BLANKS))


def strip_text(c: Column) -> Column:
    """:func:`strip` for whole texts: a trim walks all characters, so only texts with a blank end have it."""

    def trimmed(text: Column) -> Column:
        blank = F.exists(F.array(*map(F.lit, BLANKS)), lambda b: text.startswith(b) | text.endswith(b))
        return F.when(blank, strip(text)).otherwise(text)

    return let(c, trimmed)


def rstrip(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"[{chars}]+$", "")


def first_nonempty(*cols: Column) -> Column:
    """The first of the columns that is not '' (or null), else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stem(filename: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix, a trailing dot is none."""
    return F.regexp_replace(filename, r"(?s)(?<=.)\.[^.]+$", "")


def suffix(filename: Column) -> Column:
    """Last suffix in small letters, with its dot."""
    return F.lower(F.regexp_extract(filename, r"(?s)^.+(\.[^.]+)$", 1))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


#: Every Unicode line end.
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"


def first_lines(text: Column, n: int) -> Column:
    """At most n lines from the start; the rest is not split."""
    return F.slice(F.split(text, BREAK, n + 1), 1, n)


def all_lines(text: Column) -> Column:
    """Lines at every Unicode line end; a final line end opens no line."""
    parts = F.split(text, BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def replace_all(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered regular-expression rules, one after the other."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def unify_breaks(text: Column) -> Column:
    """Without byte order marks and NULs; every line end is a line feed; null becomes ''."""
    clean = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\ufeff")), F.lit("\x00"))
    return F.when(text.contains("\r"), F.regexp_replace(clean, "\r\n?", "\n")).otherwise(clean)


def normalize_encoding(df: DataFrame, *texts: str) -> DataFrame:
    """Columns with clean line ends, in NFC. Only texts with a character that composition can touch go to Python; for the others it gets nulls."""
    clean = df.withColumns({t: unify_breaks(F.col(t)) for t in texts})

    @F.pandas_udf("string")
    def nfc(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    other = lambda t: F.when(F.col(t).rlike(r"[^\x00-\u02ff]"), F.col(t))
    return clean.withColumns({t: F.coalesce(nfc(other(t)), F.col(t)) for t in texts})


def slugify(text: Column) -> Column:
    """Small ASCII slug; letters of other scripts stay; '' becomes 'section'."""
    s = F.translate(strip(F.lower(text)), ACCENTED, PLAIN)
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w]+", "-"), "^-+|-+$", "")
    return first_nonempty(s, F.lit("section"))


def clean_boundaries(markdown: Column) -> Column:
    """At most two blank lines in a row, none at the ends."""
    return strip_text(F.when(markdown.contains("\n" * 4), F.regexp_replace(markdown, "\n{4,}", "\n\n\n")).otherwise(markdown))


_TIME = r"\b\d{1,2}:\d{2}\s+\d{1,2}/\d{1,2}/\d{2,4}\b"
_STAMP = r"(?:[_\s]*\d{1,2}:\d{2}(?:\s+\d{1,2}/\d{1,2}/\d{2,4})?)?"


def strip_watermark(text: Column, own: list[str] | None = None) -> Column:
    """Without e-mail stamps and times; ``own`` lists further patterns to drop up to the end of their line."""
    rules = [rf"(?iU)[a-zA-Z0-9_.+-]+@[a-zA-Z0-9.-]+(?:\.[a-zA-Z0-9-]+)*{_STAMP}", f"(?U){_TIME}", *[rf"(?iu){p}[^\n]*" for p in own or []]]
    return strip(replace_all(F.coalesce(text, F.lit("")), [(r, "") for r in rules]))


def dense_chars(text: Column) -> Column:
    """Characters other than whitespace."""
    return F.length(F.regexp_replace(text, rf"(?U){BLANK}+", "")).cast("long")


def _count_of(text: Column, letters: str) -> Column:
    """How many characters are among the letters, by a table: a class of so many letters is tried letter by letter."""
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def marked_letters(text: Column) -> Column:
    """Letters with marks, in either case."""
    return _count_of(text, ACCENTED + ACCENTED.upper())


def plain_letters(text: Column) -> Column:
    """ASCII letters, small letters with marks, and capital D with stroke."""
    return _count_of(text, string.ascii_letters + ACCENTED + "Đ")


#: Characters between words, as a class of a pattern: Markdown punctuation and whitespace of one byte in Latin-1, for which a class is a table. All other whitespace becomes spaces first.
BETWEEN = r"#*`_~\[\]()><!|" + "".join(c for c in BLANKS if c < "\u0100")
WIDE = "".join(c for c in BLANKS if c >= "\u0100")


def word_count(markdown: Column) -> Column:
    """Words of the text without Markdown punctuation. What is counted is the text of their first characters, made in one pass without an array of words."""
    text = F.when(markdown.rlike("[\u1680\u2000-\u3000]"), F.translate(markdown, WIDE, " " * len(WIDE))).otherwise(markdown)
    return F.length(F.regexp_replace(text, rf"^[{BETWEEN}]++|([^{BETWEEN}])[^{BETWEEN}]*+[{BETWEEN}]*+", "$1")).cast("long")


def html_escape(text: Column) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")], text)
