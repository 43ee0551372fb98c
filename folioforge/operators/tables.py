"""Markdown tables from ragged grids of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, strip


def clean_cell(cell: Column) -> Column:
    c = F.translate(F.coalesce(cell, F.lit("")), "\n\r", "  ")
    return strip(F.replace(c, F.lit("|"), F.lit("\\|")))


def drop_empty_rows(rows: Column) -> Column:
    """Rows that have a cell with more than blanks."""
    return F.filter(rows, lambda r: F.exists(r, lambda c: strip(F.coalesce(c, F.lit(""))) != ""))


def markdown_table(rows: Column) -> Column:
    """Header, rule and data rows; an all-empty first row gets numbered column names and stays as data."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))

    # In lambdas every use of an expression is a computation: cells, width, rows and the test of the first row are bound once.
    def table(padded: Column, width: Column) -> Column:
        def whole(empty: Column) -> Column:
            header = F.when(empty, F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("Cột "), i.cast("string")))).otherwise(F.get(padded, F.lit(0)))
            body = F.when(empty, padded).otherwise(F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(0))))
            return F.array_join(F.concat(F.array(line(header), line(F.array_repeat(F.lit("---"), width))), F.transform(body, line)), "\n")

        return let(F.forall(F.get(padded, F.lit(0)), lambda c: c == ""), whole)

    def sized(clean: Column, width: Column) -> Column:
        padded = F.transform(clean, lambda r: F.when(F.size(r) == width, r).otherwise(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
        return F.when(width > 0, let(padded, lambda p: table(p, width))).otherwise("")

    return let(F.transform(rows, lambda r: F.transform(r, clean_cell)), lambda clean: let(F.coalesce(F.array_max(F.transform(clean, F.size)), F.lit(0)), lambda width: sized(clean, width)))
