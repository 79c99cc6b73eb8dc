"""Cutting a table's lines into sections at marker lines.

A section machine is an automaton of a few states (`automata`): one pass gives
each line its state, its section and its item, and no table has to sit in one
task. Lines come as `(table_id, row_ix, line)`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.text import clean_edges, join_cells, join_filled_cells
from cellweave.operators.automata import Automaton, transduce
from cellweave.tables import Layout, Running, in_order, ordered_items, running

# How bullets, items, pairs and title words look.
BULLET = "• "
ITEM_PATTERN = r"(?d)• ([^:]+): (.+)"
PAIR_PATTERN = r"([^,\d]+)(\d+)"
TITLE_WORD = "[A-Z][a-z]+"


def lines_of(df: DataFrame, keep_empty_cells: bool = True) -> DataFrame:
    """Rows as lines, cells joined by a space."""
    line = join_cells(F.col("cells")) if keep_empty_cells else join_filled_cells(F.col("cells"))
    return df.select("table_id", "row_ix", line.alias("line"))


def _joined(items: Column, kind: str) -> Column:
    lines = F.transform(F.filter(items, lambda x: x["kind"] == kind), lambda x: x["line"])
    return F.array_join(lines, " ")


# In a description a heading is ordinary text, and so is a second list marker in a list.
SUFFIX_SECTIONS = Automaton(
    states=("outside", "description", "list"),
    moves={
        "heading": {"outside": ("description", "section_ix"), "list": ("description", "section_ix")},
        "list": {"description": "list"},
    },
    last=("section_ix",),
)


def suffix_sections(lines: DataFrame, suffix: str, list_marker: str, layout: Layout) -> DataFrame:
    """Sections named by lines that end in `suffix`, each a description and a list.

    The list starts at a line equal to `list_marker`. A heading counts only
    before the first section or within a list: in a description it is ordinary
    text. Lines before the first section are dropped.
    Gives `(table_id, section_ix, name, description, list_text)`.
    """
    line = F.col("line")
    is_heading = line.endswith(suffix) & (F.length(line) > len(suffix))
    symbol = F.when(is_heading, "heading").when(line == list_marker, "list")
    walked = transduce(lines, symbol, SUFFIX_SECTIONS, layout)
    # The marker that opens a list is no part of it.
    opens_list = (F.col("before") == "description") & (F.col("after") == "list")
    placed = walked.filter(F.col("section_ix").isNotNull() & ~opens_list)
    kind = F.when(F.col("row_ix") == F.col("section_ix"), "name").otherwise(F.col("after"))
    found = ordered_items(
        placed, ["table_id", "section_ix"], "row_ix", F.struct(kind.alias("kind"), "line"), layout
    )
    name = F.get(F.filter("items", lambda x: x["kind"] == "name"), F.lit(0))["line"]
    return found.select(
        "table_id",
        "section_ix",
        F.left(name, F.length(name) - len(suffix)).alias("name"),
        _joined(F.col("items"), "description").alias("description"),
        _joined(F.col("items"), "list").alias("list_text"),
    )


def name_level_pairs(list_text: Column) -> Column:
    """`Admin 1, Vacc Suit 0` as an array of `(name, level)`."""
    pair = F.lit(PAIR_PATTERN)
    names = F.regexp_extract_all(list_text, pair, F.lit(1))
    levels = F.regexp_extract_all(list_text, pair, F.lit(2))
    return F.zip_with(
        names,
        levels,
        lambda n, v: F.struct(clean_edges(n).alias("name"), v.try_cast("bigint").alias("level")),
    )


def is_title_heading(line: Column, except_line: str) -> Column:
    """One or two words, each holding a capital followed by a small letter."""
    words = F.split(line, " ", -1)
    return (
        F.size(words).between(1, 2)
        & (line != except_line)
        & F.forall(words, lambda w: w.rlike(TITLE_WORD))
    )


# Between items: after the list marker, or after a line that ended an item.
TITLE_SECTIONS = Automaton(
    states=("outside", "description", "between", "item"),
    moves={
        "heading": {s: ("description", "section_ix") for s in ("outside", "description", "between", "item")},
        "list": {"description": "between"},
        "bullet": {"between": ("item", "item_ix"), "item": ("item", "item_ix")},
        "bullet with colon": {"description": "outside", "between": ("item", "item_ix"), "item": ("item", "item_ix")},
        "colon": {"description": "outside", "item": "between"},
    },
    last=("section_ix", "item_ix"),
)


def title_sections(lines: DataFrame, list_marker: str, layout: Layout) -> DataFrame:
    """Mark each line below a title heading with its section, state and item.

    A section is a description up to the first `list_marker` line or line with a
    colon. After `list_marker` come bulleted items with continuation lines; a
    colon line that is no bullet ends the item. If a colon line comes first, the
    rest of the section is ignored.

    Adds `section_ix`, `item_ix` and `part`: `name`, `description`, `item` or null.
    """
    line = F.col("line")
    symbol = (
        F.when(is_title_heading(line, list_marker), "heading")
        .when(line == list_marker, "list")
        .when(line.startswith(BULLET), F.when(line.contains(":"), "bullet with colon").otherwise("bullet"))
        .when(line.contains(":"), "colon")
    )
    walked = transduce(lines, symbol, TITLE_SECTIONS, layout).filter("section_ix is not null")
    in_item = F.col("after") == "item"
    part = F.when(F.col("row_ix") == F.col("section_ix"), "name").when(F.col("after").isin("description", "item"), F.col("after"))
    return walked.select("table_id", "row_ix", "line", "section_ix", part.alias("part"), F.when(in_item, F.col("item_ix")).alias("item_ix"))


def section_records(marked: DataFrame, layout: Layout) -> DataFrame:
    """`(table_id, section_ix, name, description)` of marked lines."""
    kept = marked.filter("part in ('name', 'description')")
    found = ordered_items(
        kept, ["table_id", "section_ix"], "row_ix", F.struct(F.col("part").alias("kind"), "line"), layout
    )
    return found.select(
        "table_id",
        "section_ix",
        _joined(F.col("items"), "name").alias("name"),
        _joined(F.col("items"), "description").alias("description"),
    )


def section_items(marked: DataFrame, layout: Layout) -> DataFrame:
    """`(table_id, section_ix, item_ix, text, name, description)` of marked lines.

    An item that is not `• name: description` has null name and description.
    """
    found = ordered_items(
        marked.filter("part = 'item'"), ["table_id", "section_ix", "item_ix"], "row_ix", F.col("line"), layout
    )
    whole = F.array_join("items", " ")
    field = lambda g: F.when(whole.rlike(ITEM_PATTERN), F.regexp_extract(whole, ITEM_PATTERN, g))
    return found.select(
        "table_id",
        "section_ix",
        "item_ix",
        whole.alias("text"),
        field(1).alias("name"),
        field(2).alias("description"),
    )


def sparse_rows(
    parents: DataFrame, parent_cells: list[Column], children: DataFrame, child_cells: list[Column]
) -> DataFrame:
    """Parent rows, each followed by its child rows, as one table.

    Parents have `(table_id, section_ix)`, children `(table_id, section_ix, child_ix)`.
    """
    strings = lambda cells: F.array(*cells).cast("array<string>").alias("cells")
    rows = parents.select("table_id", "section_ix", F.lit(-1).cast("bigint").alias("child_ix"), strings(parent_cells))
    rows = rows.unionByName(children.select("table_id", "section_ix", "child_ix", strings(child_cells)))
    return in_order(rows, ("table_id",), [F.col("section_ix"), F.col("child_ix")]).select(
        "table_id", "row_ix", "cells"
    )


def _set_cell(cells: Column, column: int, value: Column) -> Column:
    return F.transform(cells, lambda c, i: F.when(i == column, value).otherwise(c))


def ditto_fill(df: DataFrame, column: int, layout: Layout) -> DataFrame:
    """An empty cell takes the last filled one above it."""
    cell = F.get("cells", F.lit(column))
    filled = running(df, {"_above": Running("last", F.nullif(cell, F.lit("")))}, layout)
    return filled.withColumn(
        "cells", _set_cell(F.col("cells"), column, F.coalesce("_above", F.lit("")))
    ).drop("_above")


def append_next_row(df: DataFrame, at: int, column: int, layout: Layout) -> DataFrame:
    """Move the cell of row `at + 1` to the end of the one in row `at`."""
    cell = F.get("cells", F.lit(column))
    ranked = running(df, {"_rank": Running("sum", F.lit(1).cast("bigint"), inclusive=False)}, layout)
    paired = running(ranked, {"_next": Running("last", cell, inclusive=False)}, layout, reverse=True)
    return paired.withColumn(
        "cells",
        F.when(
            (F.col("_rank") == at) & F.col("_next").isNotNull(),
            _set_cell(F.col("cells"), column, F.concat(cell, F.lit(" "), F.col("_next"))),
        )
        .when(F.col("_rank") == at + 1, _set_cell(F.col("cells"), column, F.lit("")))
        .otherwise(F.col("cells")),
    ).drop("_rank", "_next")
