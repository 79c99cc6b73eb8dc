"""User functions on whole tables, in Python, one call per table.

The function sees a whole table, so each table must fit in a task's memory. A
task reads its tables one after the other. A function that fails for a table
gives that table an error, and the others their rows. For longer tables write
the job with the steps of `reshape` and `sections`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import cut_lineage, ship_package

Rows = list[list[str]]
OUTCOME = "table_id string, row_ix bigint, cells array<string>, error string"


def check_rows(rows: Rows) -> None:
    """Raise a `TypeError` that names the first place where a result is not a list of lists of strings."""

    def misfits():
        yield "the table", rows, list
        for i, row in enumerate(rows):
            yield f"row {i}", row, list
            for j, cell in enumerate(row):
                yield f"row {i}, cell {j}", cell, str

    for place, found, kind in misfits():
        if not isinstance(found, kind):
            raise TypeError(f"{place} must be a {kind.__name__}, not a {type(found).__name__}")


def concat_tables(portions: list[Rows]) -> Rows:
    """Helper for user functions: all portions one after the other."""
    return [row for portion in portions for row in portion]


def _tables(batches: Iterator[pa.RecordBatch], part: str) -> Iterator[tuple[str, dict[object, Rows]]]:
    """Each table with its parts in order, from rows that are sorted by table, part and row; one table is held at a time."""
    held, parts = None, {}
    for batch in batches:
        for table_id, name, cells in zip(*(batch[c].to_pylist() for c in ("table_id", part, "cells"))):
            if table_id != held:
                if held is not None:
                    yield held, parts
                held, parts = table_id, {}
            parts.setdefault(name, []).append(cells)
    if held is not None:
        yield held, parts


def _outcomes(df: DataFrame, part: str, call: Callable[[dict[object, Rows]], Rows]) -> tuple[DataFrame, DataFrame]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_id, parts in _tables(batches, part):
            try:
                rows = call(parts)
                check_rows(rows)
                made = {"row_ix": list(range(len(rows))), "cells": rows, "error": [None] * len(rows)}
            except Exception as failed:  # whatever a user's function raises is that table's outcome
                made = {"row_ix": [None], "cells": [None], "error": [f"{type(failed).__name__}: {failed}"]}
            kinds = (pa.int64(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([table_id] * len(made["error"]), pa.string()), *[pa.array(v, k) for v, k in zip(made.values(), kinds)]],
                names=["table_id", *made],
            )

    ship_package(df.sparkSession)
    placed = df.select("table_id", part, "row_ix", "cells").repartition("table_id").sortWithinPartitions("table_id", part, "row_ix")
    # Written once, so that no function runs twice for its rows and its errors.
    done = cut_lineage(placed.mapInArrow(run, OUTCOME))
    return (
        done.filter(F.col("error").isNull()).select("table_id", "row_ix", "cells"),
        done.filter(F.col("error").isNotNull()).select("table_id", "error"),
    )


def table_function(df: DataFrame, fn: Callable[[list[Rows]], Rows]) -> tuple[DataFrame, DataFrame]:
    """Run `fn` on the portions of each table. Gives the rows, not cleaned, and `(table_id, error)` of the tables it failed for."""
    return _outcomes(df, "part_ix", lambda parts: fn(list(parts.values())))


def named_inputs_function(inputs: dict[str, DataFrame], fn: Callable[..., Rows]) -> tuple[DataFrame, DataFrame]:
    """Run `fn(**tables)` per table id over several inputs, names in sorted order. Gives rows and errors as `table_function` does.

    An input without rows for a table id is passed as an empty table.
    """
    names = sorted(inputs)
    tagged = None
    for name in names:
        one = inputs[name].select("table_id", "row_ix", "cells", F.lit(name).alias("name"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return _outcomes(tagged, "name", lambda parts: fn(**{n: parts.get(n, []) for n in names}))
