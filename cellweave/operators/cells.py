"""Steps on tables as single cells, for tables whose rows may be as long as other tables.

A transposed long table has few rows of very many cells. Here a table is
`(table_id, row_ix, col_ix, cell)`, `col_ix` dense from 0 within a row, so that
no row is ever one value: not when it is transposed, nor in the steps that
follow. Rows without cells have no place in this form and vanish, as they have
none in what is read back; `reshape.transpose` still sees them as columns of
empty cells, since it starts from rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import text
from cellweave.operators.grouping import EmptyColumn, RowGrouper, assign_groups
from cellweave.tables import Layout, Running, layout_of, ordered_items, running

CELL_COLUMNS = ["table_id", "row_ix", "col_ix", "cell"]
CellStep = Callable[[DataFrame], DataFrame]


def row_sizes(cells: DataFrame) -> DataFrame:
    """`(table_id, row_ix, size)` of the rows."""
    return cells.groupBy("table_id", "row_ix").agg((F.max("col_ix") + 1).alias("size"))


def clean(cells: DataFrame) -> DataFrame:
    return cells.withColumn("cell", text.clean_text(F.col("cell")))


def transpose(cells: DataFrame) -> DataFrame:
    """Columns become rows; short rows are filled up with empty cells."""
    sizes = row_sizes(cells)
    widths = sizes.groupBy("table_id").agg(F.max("size").alias("width"))
    missing = sizes.join(widths, "table_id").filter("size < width").select(
        "table_id", "row_ix", F.explode(F.sequence("size", F.col("width") - 1)).alias("col_ix"), F.lit("").alias("cell")
    )
    ranked = running(sizes, {"rank": Running("sum", F.lit(1).cast("bigint"), inclusive=False)}, layout_of(sizes))
    whole = cells.select(*CELL_COLUMNS).unionByName(missing).join(ranked.select("table_id", "row_ix", "rank"), ["table_id", "row_ix"])
    return whole.select("table_id", F.col("col_ix").alias("row_ix"), F.col("rank").alias("col_ix"), "cell")


def wrap_row_every_n(cells: DataFrame, columns: int) -> DataFrame:
    """Read all cells in order and start a new row after every `columns` of them: arithmetic on where each row starts."""
    sizes = row_sizes(cells)
    starts = running(sizes, {"start": Running("sum", F.col("size"), inclusive=False)}, layout_of(sizes))
    at = F.col("start") + F.col("col_ix")
    return cells.join(starts.select("table_id", "row_ix", "start"), ["table_id", "row_ix"]).select(
        "table_id", F.floor(at / columns).alias("row_ix"), (at % columns).alias("col_ix"), "cell"
    )


def fold_rows(cells: DataFrame, group_by: list[RowGrouper]) -> DataFrame:
    """Merge each group of rows into one: per column, its filled cells joined by a space.

    Groups are found on a row per table row, with the one cell that tells.
    """
    heads = [g.column_index for g in group_by if isinstance(g, EmptyColumn)]
    keys = ["table_id", "row_ix"]
    wide = max(heads, default=-1) + 1
    picked = [F.coalesce(F.max(F.when(F.col("col_ix") == c, F.col("cell"))), F.lit("")) for c in range(wide)]
    rows = cells.groupBy(*keys).agg(F.array(*picked).cast("array<string>").alias("cells"))
    grouped = assign_groups(rows, group_by, layout_of(rows)).select(*keys, "group_ix")
    placed = cells.join(grouped, keys)
    columns = placed.groupBy("table_id", "group_ix", "col_ix").agg(F.count("*").alias("n"))
    longest = columns.agg(F.max("n")).first()[0] or 0
    folded = ordered_items(placed, ["table_id", "group_ix", "col_ix"], "row_ix", F.col("cell"), Layout(longest > 1 << 14))
    return folded.select(
        "table_id", F.col("group_ix").alias("row_ix"), "col_ix", F.array_join(F.filter("items", lambda c: c != ""), " ").alias("cell")
    )


def expand_column_on_regex(cells: DataFrame, column: int, pattern: str, on_match: list[str], default: list[str]) -> DataFrame:
    """Replace a cell by templates filled from a full match, else by `default`; cells after it move."""
    cell = F.col("cell")
    fill = lambda templates, p: F.array(*[text.expand_template(t, p, cell) for t in templates]).cast("array<string>")
    matches = F.coalesce(cell.rlike(text.full_match(pattern)), F.lit(False))
    here = cells.filter(F.col("col_ix") == column).withColumn("matches", matches)
    filled = F.when(F.col("matches"), fill(on_match, pattern)).otherwise(fill(default, r"(?s:.*)"))
    new = here.select("table_id", "row_ix", F.posexplode(filled).alias("at", "cell")).select(
        "table_id", "row_ix", (F.col("at") + column).cast("bigint").alias("col_ix"), "cell"
    )
    shift = F.when(F.col("matches"), len(on_match) - 1).otherwise(len(default) - 1)
    moved = cells.filter(F.col("col_ix") > column).join(here.select("table_id", "row_ix", shift.alias("shift")), ["table_id", "row_ix"])
    moved = moved.select("table_id", "row_ix", (F.col("col_ix") + F.col("shift")).alias("col_ix"), "cell")
    return cells.filter(F.col("col_ix") < column).select(*CELL_COLUMNS).unionByName(new).unionByName(moved)


def prepend_row(cells: DataFrame, row: list[str]) -> DataFrame:
    """Put a literal row first in every table that has cells."""
    first = cells.select("table_id").distinct().select(
        "table_id", F.lit(0).cast("bigint").alias("row_ix"), F.posexplode(F.array(*[F.lit(c) for c in row]).cast("array<string>")).alias("col_ix", "cell")
    )
    below = cells.select("table_id", (F.col("row_ix") + 1).alias("row_ix"), "col_ix", "cell")
    return below.unionByName(first.withColumn("col_ix", F.col("col_ix").cast("bigint")))
