"""Cleaning of recognised text: stray lines and misread terms."""

from __future__ import annotations

import re
from functools import cache, reduce
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _STAMP, _TIME, lines, replace_all, strip

# Short lines that are words.
KEPT_SHORT = ["do", "tm", "iv", "iii", "ii", "i", "dl", "ul"]


@cache
def corrections() -> list[tuple[str, str]]:
    """Ordered rules as Java patterns and replacements."""
    rows = (resources.files("folioforge.rules") / "corrections.tsv").read_text(encoding="utf-8").splitlines()
    rules = [r.split("\t") for r in rows if r and not r.startswith("#")]
    return [(f"(?U){p}", r.replace("\\", "\\\\").replace("$", "\\$")) for p, r in rules] + [(r"(?U)\./[^\s\n]*", "./.")]


def clean_artifacts(text: Column) -> Column:
    """Without e-mail stamps, times, page indicators and stray symbols; lines that become blank go."""

    def stamped(line: Column) -> Column:
        rules = [(rf"(?iU)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}{_STAMP}", ""), (f"(?U){_TIME}", "")]
        return F.when(line.contains("@"), replace_all(line, rules)).when(line.contains(":"), replace_all(line, rules[1:])).otherwise(line)

    def keep(line: Column) -> Column:
        s = strip(line)
        symbols = s.rlike(r"(?U)^[#@&~`^_\-|/\\\s:.,+*%<>=]+$") & (F.length(s) < 25)
        token = s.rlike(r"^[a-zA-Z0-9@_`~^|\\/]{1,3}$") & ~F.lower(s).isin(KEPT_SHORT)
        return ~((s == "") | s.rlike(r"(?U)^\d+/\d+$") | symbols | token)

    return F.array_join(F.filter(F.transform(lines(F.coalesce(text, F.lit(""))), stamped), keep), "\n")


#: Rules that one test guards.
GROUP = 5


def needed(pattern: str) -> str:
    """The longest string that is in every text in which a pattern of the rules occurs."""
    parts = re.split(r"\\[sb][+*]?|\[[^\]]*\][+*?]?|\(\?:[^)]*\)[+*?]?|\\[()\]]\??|[^\\]\?|\\(?=[./])", pattern.removeprefix("(?U)"))
    return max(parts, key=len)


def correct_terms(df: DataFrame, text: str, out: str | None = None) -> DataFrame:
    """Ordered corrections of misread terms.

    The rules come in groups. A text that has no word of a group's patterns can't be
    changed by it, so the others alone go through its rules. Each group's result is a
    column, so it is worked out once.
    """
    out, rules = out or text, corrections()
    d = df.withColumn(out, F.coalesce(F.col(text), F.lit("")))
    for at in range(0, len(rules), GROUP):
        group = rules[at : at + GROUP]
        some = reduce(lambda a, b: a | b, [F.col(out).contains(w) for w in dict.fromkeys(needed(p) for p, _ in group)])
        d = d.withColumn(out, F.when(some, replace_all(F.col(out), group)).otherwise(F.col(out)))
    return d


def process_recognised(df: DataFrame, text: str, out: str | None = None) -> DataFrame:
    """Artifacts cleaned, then terms corrected."""
    out = out or text
    return correct_terms(df.withColumn(out, clean_artifacts(F.col(text))), out)
