"""Groups of consecutive rows, for folding.

A list of groupers takes rows in order: each takes what it needs and leaves the
rest to the next, and rows left at the end are groups of their own. Since
`EmptyColumn` and `AllRows` take everything left, a list comes down to a prefix
of fixed counts followed by at most one of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.tables import Layout, Running, running


@dataclass(frozen=True)
class StaticRowCounts:
    """Groups of the given numbers of rows."""

    row_counts: tuple[int, ...]


@dataclass(frozen=True)
class EmptyColumn:
    """A row starts a group where the cell is filled, and continues one where it is empty."""

    column_index: int


@dataclass(frozen=True)
class AllRows:
    """One group of all rows left."""


RowGrouper = StaticRowCounts | EmptyColumn | AllRows


def reduce_groupers(groupers: list[RowGrouper]) -> tuple[list[int], EmptyColumn | AllRows | None]:
    """The fixed counts up front, and the grouper that takes the rest."""
    counts: list[int] = []
    for grouper in groupers:
        if not isinstance(grouper, StaticRowCounts):
            return counts, grouper
        counts.extend(n for n in grouper.row_counts if n > 0)
    return counts, None


def assign_groups(df: DataFrame, groupers: list[RowGrouper], layout: Layout) -> DataFrame:
    """Add `group_ix`: equal for the rows of a group, and rising with the row order."""
    counts, rest = reduce_groupers(groupers)
    ends = list(accumulate(counts))
    prefix = ends[-1] if ends else 0

    values = {}
    if ends:
        values["_rank"] = Running("sum", F.lit(1).cast("bigint"), inclusive=False)
    if isinstance(rest, EmptyColumn):
        filled = F.coalesce(F.get("cells", F.lit(rest.column_index)), F.lit("")) != ""
        values["_heads"] = Running("sum", F.when(filled, 1).otherwise(0).cast("bigint"))

    # The groups of the rest are told apart by the number of filled cells so
    # far: filled cells in the prefix only add the same to all of them.
    if isinstance(rest, EmptyColumn):
        group = prefix + F.col("_heads")
    elif isinstance(rest, AllRows):
        group = F.lit(prefix).cast("bigint")
    else:
        group = prefix + F.col("row_ix")

    df = running(df, values, layout) if values else df
    for start, end in reversed(list(zip([0, *ends], ends))):
        group = F.when(F.col("_rank") < end, F.lit(start).cast("bigint")).otherwise(group)
    return df.withColumn("group_ix", group).drop(*values)
