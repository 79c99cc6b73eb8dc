"""Reshaping steps over tables in the form of `cellweave.tables`.

A step is a function `(df, layout) -> df`. `sequence` runs several of them as
one plan. Row-local steps (`row_local`) are plain projections on `cells` and
keep `row_ix`; the others keep `row_ix` unique and in order, not dense. Steps
that may give a table more rows than it had are marked `lengthens`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import text
from cellweave.operators import cells as flat
from cellweave.operators.grouping import RowGrouper, assign_groups
from cellweave.session import written
from cellweave.tables import CHUNK, CHUNK_BITS, TABLE_COLUMNS, Layout, Running, in_chunks, layout_of, routes, running, to_cells

Step = Callable[[DataFrame, Layout], DataFrame]


def concat_portions(df: DataFrame) -> DataFrame:
    """Portions of each table one after the other, by `part_ix`.

    Pure arithmetic: a portion has fewer than 2**32 rows. A larger `row_ix`
    fails the run, since rows of two portions would be mixed.
    """
    row = F.when(F.col("row_ix").between(0, (1 << 32) - 1), F.col("row_ix")).otherwise(
        F.raise_error(F.concat(F.lit("row "), "row_ix", F.lit(" of table "), "table_id", F.lit(" does not fit in a portion"))).cast("bigint")
    )
    return df.select(
        "table_id", (F.shiftleft(F.col("part_ix").cast("bigint"), 32) + row).alias("row_ix"), "cells"
    )


def sequence(
    df: DataFrame, steps: list[Step], clean: bool = True, layout: Layout | None = None
) -> DataFrame:
    """Concatenated tables through the steps in order, then cleaned cells.

    Rows are counted per table before the first step that needs to know how long
    tables are, and again where a step in between may have made them longer: what
    it gave is written out first, so that counting does not work it out twice.
    Each table takes its own route: long ones the one over chunks, all others the
    one exchange they share, however long a few may be. With a `layout`, all
    tables take the route it names.
    """
    done = _routed(df.select(*TABLE_COLUMNS), steps, layout, CHUNK_BITS if layout is None else layout.bits)
    return clean_rows()(done, layout) if clean else done


def _routed(df: DataFrame, steps: list[Step], layout: Layout | None, bits: int) -> DataFrame:
    longer = False
    for i, step in enumerate(steps):
        if not getattr(step, "row_local", False):
            if longer and layout is not None and not layout.chunked:
                df, layout = written(df), None
            if layout is None:
                found = routes(df, bits)
                if len(found) > 1:
                    done = [_routed(part, steps[i:], known, bits) for part, known in found]
                    return done[0].unionByName(done[1])
                ((df, layout),) = found
            longer = False
            if layout.chunked and i + 1 < len(steps) and CHUNK not in df.columns:
                # Written once, here, and dealt out once; what follows writes totals only, as long as it keeps the chunks.
                df = in_chunks(written(df), layout)
        df = step(df, layout)
        longer = longer or getattr(step, "lengthens", False)
    return df.select(*TABLE_COLUMNS)


def sequence_cells(df: DataFrame, steps: list[Step], clean: bool = True, layout: Layout | None = None) -> DataFrame:
    """As `sequence`, but as single cells `(table_id, row_ix, col_ix, cell)`.

    From the first transposition of tables that may be long on, steps work on
    cells, so no row of a transposed table is ever one value. What follows it
    must know cells: `transpose`, `wrap_row_every_n`, `fold_rows`,
    `expand_column_on_regex`, `prepend_row`.
    """
    turns = next((i for i, s in enumerate(steps) if getattr(s, "turns", False)), len(steps))
    unknown = [i for i, s in enumerate(steps) if i >= turns and not hasattr(s, "on_cells")]
    if unknown:
        raise ValueError(f"steps {unknown} do not work on single cells")
    rows = sequence(df, steps[:turns], clean=False, layout=layout)
    if turns < len(steps):
        rows = written(rows)
        found = transpose_cells(rows)
        for step in steps[turns + 1 :]:
            # Each step reads its input twice or more: for row sizes, and for the cells.
            found = step.on_cells(written(found))
    else:
        found = to_cells(rows)
    return flat.clean(found) if clean else found


def _row_local(change: Callable[[Column], Column]) -> Step:
    def step(df: DataFrame, layout: Layout) -> DataFrame:
        return df.withColumn("cells", change(F.col("cells")))

    step.row_local = True
    return step


def _strings(values: list[Column]) -> Column:
    return F.array(*values).cast("array<string>")


def _before(cells: Column, column: int) -> Column:
    return F.slice(cells, 1, column)


def _after(cells: Column, column: int) -> Column:
    return F.slice(cells, column + 2, F.greatest(F.size(cells) - F.lit(column + 1), F.lit(0)))


def clean_rows() -> Step:
    return _row_local(text.clean_cells)


def expand_column_on_regex(column: int, pattern: str, on_match: list[str], default: list[str]) -> Step:
    """Replace a cell by templates filled from a full match, else by `default`.

    Rows without the column stay as they are.
    """

    def change(cells: Column) -> Column:
        cell = F.get(cells, F.lit(column))
        matched = _strings([text.expand_template(t, pattern, cell) for t in on_match])
        other = _strings([text.expand_template(t, r"(?s:.*)", cell) for t in default])
        filled = F.when(cell.rlike(text.full_match(pattern)), matched).otherwise(other)
        return F.when(F.size(cells) <= column, cells).otherwise(
            F.concat(_before(cells, column), filled, _after(cells, column))
        )

    step = _row_local(change)
    step.on_cells = lambda cells: flat.expand_column_on_regex(cells, column, pattern, on_match, default)
    return step


def join_columns(from_: int | None = None, to: int | None = None, delim: str = "") -> Step:
    """Join the cells `[from_, to)` into one; rows the range misses stay as they are."""

    def change(cells: Column) -> Column:
        size = F.size(cells)
        start = F.least(F.lit(from_ or 0), size)
        end = size if to is None else F.least(F.lit(to), size)
        joined = F.array_join(F.slice(cells, start + 1, F.greatest(end - start, F.lit(0))), delim)
        return F.when(start >= end, cells).otherwise(
            F.concat(
                F.slice(cells, F.lit(1), start),
                F.array(joined),
                F.slice(cells, end + 1, F.greatest(size - end, F.lit(0))),
            )
        )

    return _row_local(change)


def split_column(column: int, pattern: str) -> Step:
    """Replace a cell by its parts between matches of `pattern`."""

    def change(cells: Column) -> Column:
        parts = F.split(F.get(cells, F.lit(column)), f"(?U){text.java_pattern(pattern)}", -1)
        return F.when(F.size(cells) <= column, cells).otherwise(
            F.concat(_before(cells, column), parts, _after(cells, column))
        )

    return _row_local(change)


def prepend_row(row: list[str], tables: DataFrame | None = None) -> Step:
    """Put a literal row first in every table.

    `tables` is the work list, a DataFrame with `table_id`; it names tables
    that have no rows as well. Without it, the tables seen in the data are used.
    """

    def step(df: DataFrame, layout: Layout) -> DataFrame:
        first = _strings([F.lit(c) for c in row])
        if tables is None and not layout.chunked:
            # The first row of each table brings the new one along.
            ranked = running(df, {"_rank": Running("sum", F.lit(1).cast("bigint"), inclusive=False)}, layout)
            old = F.struct((F.col("row_ix") + 1).alias("row_ix"), "cells")
            new = F.struct(F.lit(0).cast("bigint").alias("row_ix"), first.alias("cells"))
            both = F.when(F.col("_rank") == 0, F.array(new, old)).otherwise(F.array(old))
            return ranked.select("table_id", F.inline(both))
        headers = (df if tables is None else tables).select(
            "table_id", F.lit(0).cast("bigint").alias("row_ix"), first.alias("cells")
        ).distinct()
        return df.select("table_id", (F.col("row_ix") + 1).alias("row_ix"), "cells").unionByName(headers)

    step.row_local = tables is not None
    step.on_cells = lambda cells: flat.prepend_row(cells, row)
    step.for_tables = lambda listed: prepend_row(row, listed if tables is None else tables)
    return step


def fold_rows(group_by: list[RowGrouper]) -> Step:
    """Merge each group of rows into one: per column, its filled cells joined by a space."""

    def step(df: DataFrame, layout: Layout) -> DataFrame:
        grouped = assign_groups(df, group_by, layout)
        if layout.chunked:
            # Folding is associative: fold within a chunk first, so that a
            # group that spans chunks arrives as one row per chunk.
            grouped = grouped if CHUNK in grouped.columns else grouped.withColumn(CHUNK, F.shiftright("row_ix", layout.bits))
            grouped = _fold(grouped, ["table_id", "group_ix", CHUNK])
        return _fold(grouped, ["table_id", "group_ix"]).select(
            "table_id", F.col("group_ix").alias("row_ix"), "cells"
        )

    step.on_cells = lambda cells: flat.fold_rows(cells, group_by)
    return step


def _fold(df: DataFrame, by: list[str]) -> DataFrame:
    rows = df.groupBy(*by).agg(
        F.min("row_ix").alias("row_ix"),
        F.array_sort(F.collect_list(F.struct("row_ix", "cells"))).alias("rows"),
    )
    width = F.array_max(F.transform("rows", lambda r: F.size(r["cells"])))
    column = lambda i: F.array_join(
        F.filter(F.transform("rows", lambda r: F.get(r["cells"], i)), lambda c: c != ""), " "
    )
    folded = F.transform(F.sequence(F.lit(0), width - 1), column)
    return rows.select(
        *by,
        "row_ix",
        F.when(F.size("rows") == 1, F.col("rows")[0]["cells"])
        .when(width == 0, F.array().cast("array<string>"))
        .otherwise(folded)
        .alias("cells"),
    )


def transpose() -> Step:
    """Columns become rows; short rows are filled up with empty cells.

    An output row is as long as its input table, so it must fit in memory. For
    longer tables use `transpose_cells`, which needs no arrays.
    """

    def step(df: DataFrame, layout: Layout) -> DataFrame:
        widths = df.groupBy("table_id").agg(F.max(F.size("cells")).alias("width"))
        if layout.chunked:
            df = df if CHUNK in df.columns else df.withColumn(CHUNK, F.shiftright("row_ix", layout.bits))
            blocks = _columns_of(df.join(widths, "table_id"), ["table_id", CHUNK], F.first("width"))
            return (
                blocks.groupBy("table_id", "row_ix")
                .agg(F.array_sort(F.collect_list(F.struct("_chunk", "cells"))).alias("parts"))
                .select("table_id", "row_ix", F.flatten(F.transform("parts", lambda p: p["cells"])).alias("cells"))
            )
        return _columns_of(df, ["table_id"], F.max(F.size("cells"))).select(*TABLE_COLUMNS)

    step.turns, step.on_cells = True, flat.transpose
    step.lengthens = True
    return step


def _columns_of(df: DataFrame, by: list[str], width: Column) -> DataFrame:
    rows = df.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("row_ix", "cells"))).alias("rows"), width.alias("width")
    )
    column = lambda i: F.transform("rows", lambda r: F.coalesce(F.get(r["cells"], i), F.lit("")))
    columns = F.transform(F.sequence(F.lit(0), F.col("width") - 1), column)
    return (
        rows.filter("width > 0")
        .select(*by, F.posexplode(columns).alias("row_ix", "cells"))
        .withColumn("row_ix", F.col("row_ix").cast("bigint"))
    )


def transpose_cells(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Transpose straight to `(table_id, row_ix, col_ix, cell)`, for tables of any length."""
    layout = layout or layout_of(df)
    widths = df.groupBy("table_id").agg(F.max(F.size("cells")).alias("width"))
    ranked = running(df, {"rank": Running("sum", F.lit(1).cast("bigint"), inclusive=False)}, layout)
    return (
        ranked.join(widths.filter("width > 0"), "table_id")
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
        .select(
            "table_id",
            F.col("at").cast("bigint").alias("row_ix"),
            F.col("rank").alias("col_ix"),
            F.coalesce(F.get("cells", F.col("at")), F.lit("")).alias("cell"),
        )
    )


def wrap_row_every_n(columns: int) -> Step:
    """Read all cells in order and start a new row after every `columns` of them."""
    if columns < 1:
        raise ValueError(f"columns must be at least 1, but is {columns}")

    def step(df: DataFrame, layout: Layout) -> DataFrame:
        size = F.size("cells")
        placed = running(
            df.filter(size > 0), {"start": Running("sum", size.cast("bigint"), inclusive=False)}, layout
        )
        # The piece of this row that falls into output row k.
        end = F.col("start") + size
        first_row = F.floor(F.col("start") / columns)
        pieces = placed.withColumn("k", F.explode(F.sequence(first_row, F.floor((end - 1) / columns))))
        from_ = F.greatest(F.col("k") * columns - F.col("start"), F.lit(0)).cast("int")
        to = F.least((F.col("k") + 1) * columns - F.col("start"), size).cast("int")
        return (
            pieces.select(
                "table_id", "k", "start", F.slice("cells", from_ + 1, to - from_).alias("cells")
            )
            .groupBy("table_id", "k")
            .agg(F.array_sort(F.collect_list(F.struct("start", "cells"))).alias("parts"))
            .select(
                "table_id",
                F.col("k").alias("row_ix"),
                F.flatten(F.transform("parts", lambda p: p["cells"])).alias("cells"),
            )
        )

    step.on_cells = lambda cells: flat.wrap_row_every_n(cells, columns)
    step.lengthens = True
    return step
