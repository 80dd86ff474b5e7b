"""Tables inside blocks: one canonical grid from rows or from cells with spans, its shape and its content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A table as a reading gives it: rows of texts, or cells with their place and span; either may be null.
TABLE = (
    "struct<headers: array<string>, matrix: array<array<string>>, "
    "cells: array<struct<row: int, col: int, row_span: int, col_span: int, text: string>>>"
)
_PLACED = "array<struct<row: int, col: int, text: string>>"
#: Most places that one cell may span; wider spans are an error of the reading and count as one place.
WIDEST = 1000


def placed(table: Column) -> Column:
    """Every place of the grid with its text, by row and column from 0; null without rows and cells.

    A merged cell has its text in each place that it spans; where cells overlap, the smallest text counts. Rows win
    over cells where a reading gives both. A null text is an empty one, a null place is 0 and a null span 1.
    """
    by_rows = F.flatten(F.transform(table["matrix"], lambda row, i: F.transform(
        F.coalesce(row, F.array().cast("array<string>")), lambda text, j: F.struct(i.alias("row"), j.alias("col"), F.coalesce(text, F.lit("")).alias("text")))))

    def spanned(cell: Column) -> Column:
        at = [F.coalesce(cell[c], F.lit(0)) for c in ("row", "col")]
        span = [F.when(F.coalesce(cell[c], F.lit(1)).between(1, WIDEST), F.coalesce(cell[c], F.lit(1))).otherwise(1) for c in ("row_span", "col_span")]
        down, right = (F.sequence(F.lit(0), s - 1) for s in span)
        text = F.coalesce(cell["text"], F.lit(""))
        return F.flatten(F.transform(down, lambda i: F.transform(right, lambda j: F.struct((at[0] + i).alias("row"), (at[1] + j).alias("col"), text.alias("text")))))

    def once(cells: Column) -> Column:
        ordered = F.array_sort(cells)
        fresh = lambda x, i: (i == 0) | (F.struct(x["row"], x["col"]) != F.struct(F.get(ordered, i - 1)["row"], F.get(ordered, i - 1)["col"]))
        return F.filter(ordered, fresh)

    by_cells = once(F.flatten(F.transform(table["cells"], spanned)))
    return F.coalesce(by_rows, by_cells).cast(_PLACED)


def shape(table: Column) -> Column:
    """struct(rows, cols) of the grid: empty rows count as rows; null without a grid."""
    cells = placed(table)
    last = lambda c: F.coalesce(F.array_max(cells[c]) + 1, F.lit(0))
    rows = F.when(table["matrix"].isNotNull(), F.size(table["matrix"])).otherwise(last("row"))
    return F.when(cells.isNotNull(), F.struct(rows.alias("rows"), last("col").alias("cols")))


def content(table: Column) -> Column:
    """The grid as one text that is equal for equal grids, whether they were given as rows or as cells; '' without one."""
    cell = lambda z: F.concat_ws("\x1f", z["row"], z["col"], z["text"])
    return F.coalesce(F.array_join(F.transform(placed(table), cell), "\x1e"), F.lit(""))


def table_conflict(left: Column, right: Column) -> Column:
    """Why two tables differ: their shape, or else their content; null if they agree."""
    differ = content(left) != content(right)
    return F.when(~shape(left).eqNullSafe(shape(right)), "table_shape_conflict").when(differ, "table_content_conflict")


def row_shape(rows: DataFrame, keys: Sequence[str], cells: Column) -> DataFrame:
    """(keys, n_rows, n_cols) of tables that have a row of this table for each of theirs: sums and maxima only."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.coalesce(F.size(cells), F.lit(0))).alias("n_cols"))
