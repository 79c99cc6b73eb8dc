"""Ragged CSV tables, read and written without putting a file into one task."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import text
from cellweave.operators.automata import Automaton, transduce
from cellweave.session import written
from cellweave.tables import Layout, layout_of, ordered_items


def _bytes_setting(spark: SparkSession, name: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", spark.conf.get(name).lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def _file_lines(spark: SparkSession, reader: DataFrame, *keys: Column) -> DataFrame:
    """Lines with an order-correct `row_ix` per file, without a shuffle or a second read.

    A file is cut into blocks of at least `floor` bytes, so the start of a block
    divided by that numbers the blocks; the place in the task's input, at most
    33 bits, orders the lines of a block.
    """
    settings = [_bytes_setting(spark, f"spark.sql.files.{name}") for name in ("maxPartitionBytes", "openCostInBytes")]
    floor = max(1, min(settings))
    block = F.floor(F.col("_metadata.file_block_start") / floor)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return reader.select(*keys, F.col("value").alias("line"), (F.shiftleft(block, 33) + place).alias("row_ix"))


# A line in the state "open" begins within a quoted cell. Its symbol says whether it
# ends within one, if it begins a record ("+" or "-") and if it does not.
RECORD_LINES = Automaton(
    states=("between", "open"),
    moves={
        f"{new}{within}": {"between": ("open" if new == "+" else "between", "record"), "open": "open" if within == "+" else "between"}
        for new in "+-"
        for within in "+-"
    },
    counts=("record",),
)


def _records(lines: DataFrame, layout: Layout, keys: tuple[str, ...]) -> DataFrame:
    """Lines to rows of cells, numbered from 0 per key.

    A line break inside quotes belongs to the cell. Whether a line is inside
    quotes depends on all lines before it, also on bare quotes in unquoted cells,
    so lines are symbols of an automaton of two states.
    """
    line = F.col("line")
    left_open = lambda text_: F.when(text.csv_leaves_open(text_), "+").otherwise("-")
    within = F.when(line.contains('"'), left_open(F.concat(F.lit('"'), line))).otherwise("+")
    walked = transduce(lines, F.concat(left_open(line), within), RECORD_LINES, layout, keys)
    whole = ordered_items(walked, [*keys, "record"], "row_ix", line, layout)
    record = F.regexp_replace(F.array_join("items", "\n"), r"\r\z", "")
    return whole.select(*keys, (F.col("record") - 1).alias("row_ix"), text.csv_cells(record).alias("cells"))


def read_csv_tables(spark: SparkSession, path: str, layout: Layout | None = None) -> DataFrame:
    """Each CSV file as one table, named by its path; ragged rows and empty rows are kept.

    A quote is one only at the start of a cell; elsewhere in an unquoted cell it
    is text. A quoted cell that is never closed reaches to the end of the file.
    """
    reader = spark.read.option("lineSep", "\n").text(path)
    lines = _file_lines(spark, reader, F.col("_metadata.file_path").alias("table_id"))
    return _records(lines, layout or layout_of(lines), ("table_id",))


def read_csv_body(spark: SparkSession, path: str, layout: Layout | None = None) -> DataFrame:
    """As `read_csv_tables`, but the first row of each file is taken as header and dropped."""
    return read_csv_tables(spark, path, layout).filter("row_ix > 0")


def written_lines(spark: SparkSession, path: str) -> DataFrame:
    """`(value, table_id)`: the lines of tables written by `write_csv_tables`, in no order."""
    return spark.read.schema("value string, table_id string").option("lineSep", "\n").text(path)


def read_written_tables(
    spark: SparkSession, path: str, layout: Layout | None = None, only: str | None = None
) -> DataFrame:
    """Tables written by `write_csv_tables`, or `only` one of them, as portions: each part file is one."""
    reader = written_lines(spark, path)
    if only is not None:
        reader = reader.filter(F.col("table_id") == only)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    keys = ("table_id", "part_ix")
    lines = _file_lines(spark, reader, F.col("table_id"), part.alias("part_ix"))
    rows = _records(lines, layout or layout_of(lines, keys), keys)
    return rows.select("table_id", "part_ix", F.lit(None).cast("int").alias("page"), "row_ix", "cells")


def csv_lines(df: DataFrame) -> DataFrame:
    return df.select("table_id", "row_ix", text.csv_line(F.col("cells")).alias("value"))


def write_csv_tables(df: DataFrame, path: str) -> None:
    """One folder of CSV text per table, lines in order, CRLF line ends.

    Rows are ranged over `(table_id, row_ix)`: a small table is one file, a long
    one several whose names are in order. Tables of an earlier run are replaced
    where they are written again and stay otherwise.
    """
    (
        csv_lines(df)
        .repartitionByRange("table_id", "row_ix")
        .sortWithinPartitions("table_id", "row_ix")
        .select("table_id", "value")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("lineSep", "\r\n")
        .partitionBy("table_id")
        .text(path)
    )


def table_json(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Each table as one JSON array of arrays of strings: `(table_id, json)`.

    One value per table is the format, so a table must fit in memory here.
    """
    rows = ordered_items(df, ["table_id"], "row_ix", F.col("cells"), layout or layout_of(df))
    return rows.select("table_id", F.to_json("items").alias("json"))


def write_json_tables(df: DataFrame, path: str, layout: Layout | None = None) -> None:
    """JSON lines with `table_id` and `rows`, one line per table."""
    rows = ordered_items(df, ["table_id"], "row_ix", F.col("cells"), layout or layout_of(df))
    rows.withColumnRenamed("items", "rows").write.json(path)


def read_json_tables(spark: SparkSession, path: str) -> DataFrame:
    """Rows of tables written by `write_json_tables`."""
    df = spark.read.schema("table_id string, rows array<array<string>>").json(path)
    return df.select("table_id", F.posexplode("rows").alias("row_ix", "cells")).withColumn(
        "row_ix", F.col("row_ix").cast("bigint")
    )


def check_table_json(df: DataFrame, json: str = "json") -> DataFrame:
    """Add `error`: null where the JSON is an array of arrays of strings, else what is wrong and where."""
    # How an error says what was wanted, and the names of kinds below.
    want = "want Array[Array[string]], got "
    value = F.try_parse_json(json)
    kind = lambda v: _json_type(F.schema_of_variant(v))
    rows = F.try_variant_get(value, "$", "array<variant>")
    cells = lambda row: F.try_variant_get(row, "$", "array<variant>")
    in_row = lambda row, i: F.transform(
        F.coalesce(cells(row), F.array().cast("array<variant>")),
        lambda c, j: F.when(
            kind(c) != "string",
            F.concat(F.lit(want + ".["), i.cast("string"), F.lit("]["), j.cast("string"), F.lit("] with type "), kind(c)),
        ),
    )
    row_error = lambda row, i: F.when(
        kind(row) != "Array",
        F.concat(F.lit(want + ".["), i.cast("string"), F.lit("] with type "), kind(row)),
    ).otherwise(F.get(F.array_compact(in_row(row, i)), F.lit(0)))
    error = (
        F.when(value.isNull(), F.lit("not JSON"))
        .when(kind(value) != "Array", F.concat(F.lit(want + ". with type "), kind(value)))
        .otherwise(F.get(F.array_compact(F.transform(rows, row_error)), F.lit(0)))
    )
    return df.withColumn("error", error)


def _json_type(schema: Column) -> Column:
    return (
        F.when(schema.startswith("ARRAY"), "Array")
        .when(schema.startswith("OBJECT"), "Object")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null")
        .otherwise("number")
    )


def json_to_rows(df: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """Rows of the well-formed tables, and `(table_id, error)` of the others."""
    checked = check_table_json(df, json)
    rows = checked.filter("error is null").select(
        "table_id", F.posexplode(F.from_json(json, "array<array<string>>")).alias("row_ix", "cells")
    )
    return (
        rows.withColumn("row_ix", F.col("row_ix").cast("bigint")),
        checked.filter("error is not null").select("table_id", "error"),
    )


# Of the boxed cells only the text is read.
RECOGNISED = "array<array<struct<text:string>>>"


def flatten_recognised(df: DataFrame, json: str = "data") -> DataFrame:
    """Recogniser output, rows of cells with boxes, to rows of cell texts.

    Keeps the other columns and adds `(row_ix, cells)`.
    """
    return df.select(
        *[c for c in df.columns if c != json],
        F.posexplode(F.from_json(json, RECOGNISED)).alias("row_ix", "boxes"),
    ).select(
        *[c for c in df.columns if c != json],
        F.col("row_ix").cast("bigint").alias("row_ix"),
        F.transform("boxes", lambda b: b["text"]).alias("cells"),
    )


def read_portions(items: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Portions of tables from recognised items and the regions that name them.

    `items` are boxes with recogniser JSON in `data`; `regions` are boxes with
    `(region_id, table_id, part_ix)`. A region takes the one item it holds;
    regions with none or several come back as `(table_id, error)`.
    """
    from cellweave.operators.regions import count_in_regions, match_outcomes

    boxes = items.select("item_id", "doc", "page", "method", "left", "top", "right", "bottom")
    # Of a single item the smallest id is its own, so pairs are not needed.
    counts = written(count_in_regions(boxes, regions))
    counted = match_outcomes(regions, counts)
    names = regions.select("region_id", "table_id", "part_ix")
    portions = flatten_recognised(
        counts.filter("tables = 1")
        .select("region_id", "item_id")
        .join(names.hint("merge"), "region_id")
        .join(items.select("item_id", "page", "data").hint("merge"), "item_id")
        .select("table_id", "part_ix", "page", "data")
    )
    errors = counted.filter("tables <> 1").join(names.hint("merge"), "region_id").select("table_id", F.col("outcome").alias("error"))
    return portions, errors
