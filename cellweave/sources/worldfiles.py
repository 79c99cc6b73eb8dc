"""Readers of keyed text files: worlds, overrides, illegality and the index."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import codes, text
from cellweave.plans.records import by_header, unparsed, worlds_from_csv, worlds_from_sector
from cellweave.sources.csvtables import read_csv_tables
from cellweave.tables import in_order

INDEX_COLUMNS = ["table_path", "pages", "tags"]


def read_keyed_csv(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """CSV files with titles, strings only; a blank cell is null.

    Columns go by title, so files may have them in different orders; quoted line
    breaks are kept. `place` adds `_place`, which orders the rows of a file.
    """
    rows = read_csv_tables(spark, path)
    # One row per column of the files.
    titles = rows.filter("row_ix = 0").select(F.posexplode("cells").alias("at", "title")).groupBy("title").agg(F.min("at").alias("at"))
    names = [r.title for r in titles.orderBy("at", "title").collect() if r.title]
    keyed = by_header(rows, names).toDF("_file", "_row", *names)
    cells = [F.when(F.col(_quoted(c)) != "", F.col(_quoted(c))).alias(c) for c in names]
    return keyed.select(*cells, *([F.struct("_file", "_row").alias("_place")] if place else []))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _place() -> Column:
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    return at.alias("_place")


def _keyed(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Rows of a keyed CSV with their `_place`, where they are not read yet."""
    return source if isinstance(source, DataFrame) else read_keyed_csv(spark, source, place=True)


def read_sector_tsv(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """Tab separated, no quoting, blank lines skipped."""
    df = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return df.select("*", _place()) if place else df


WORLD_SOURCES = {
    "csv": lambda spark, path: worlds_from_csv(read_keyed_csv(spark, path, place=True)),
    "sector_tsv": lambda spark, path: worlds_from_sector(read_sector_tsv(spark, path, place=True)),
}


def read_worlds(spark: SparkSession, source: str, path: str) -> DataFrame:
    if source not in WORLD_SOURCES:
        raise ValueError(f"unknown world data source {source!r}, want one of {sorted(WORLD_SOURCES)}")
    return WORLD_SOURCES[source](spark, path).drop("_place")


def read_numbered_worlds(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Worlds with `world_ix`, their place in the file."""
    if source not in WORLD_SOURCES:
        raise ValueError(f"unknown world data source {source!r}, want one of {sorted(WORLD_SOURCES)}")
    return in_order(WORLD_SOURCES[source](spark, path), (), [F.col("_place")], "world_ix").drop("_place")


def world_faults(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Worlds whose profile or location is there but malformed, with the columns in `bad`."""
    df, place = (read_keyed_csv(spark, path), "Location") if source == "csv" else (read_sector_tsv(spark, path), "Hex")
    return unparsed(df, {"UWP": codes.parse_profile, place: codes.parse_location})


def override_faults(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Overrides with a malformed value, with the columns in `bad`."""
    parsers = {
        "Available": text.parse_bool, "Purchase DM": text.parse_int, "Sale DM": text.parse_int, "Illegal": text.parse_bool,
    }
    return unparsed(_keyed(spark, path), parsers)


def illegality_faults(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Rows with a malformed law level, with the column in `bad`."""
    return unparsed(_keyed(spark, path), {"Illegal law level": text.parse_int})


def _last_per_key(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """The last row of each key in file order, by `_place`."""
    latest = F.max_by(F.struct(*[v.alias(n) for n, v in values.items()]), F.col("_place"))
    return df.groupBy(*keys).agg(latest.alias("v")).select(*keys, "v.*")


def read_overrides(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Overrides per location and good; a blank cell overrides nothing."""
    df = _keyed(spark, path).withColumnsRenamed({"Location": "location", "D66": "d66"})
    return _last_per_key(
        df,
        ["location", "d66"],
        {
            "available": text.parse_bool(F.col("Available")),
            "purchase_dm": text.parse_int(F.col("Purchase DM")),
            "sale_dm": text.parse_int(F.col("Sale DM")),
            "illegal": text.parse_bool(F.col("Illegal")),
        },
    )


def read_illegality(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """The lowest law level at which a good is illegal."""
    df = _keyed(spark, path).withColumnRenamed("D66", "d66")
    return _last_per_key(df, ["d66"], {"illegal_level": text.parse_int(F.col("Illegal law level"))})


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of written tables: pages and tags come as arrays, other columns stay.

    `path` is a CSV file, or a folder of `write_index`, of which the last version is read.
    """
    lines = spark.read.text(path)
    if "run" in lines.columns:
        path = f"{path}/run={lines.agg(F.max('run')).first()[0]}"
    return parse_index(read_keyed_csv(spark, path))


def parse_index(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "pages": F.transform(text.split_list(F.col("pages")), lambda p: p.cast("int")),
            "tags": text.split_list(F.col("tags")),
        }
    )


def format_index(df: DataFrame) -> DataFrame:
    """Index rows as text: pages and tags sorted and joined by `;`."""
    others = sorted(c for c in df.columns if c not in INDEX_COLUMNS)
    joined = lambda c: F.array_join(F.array_sort(c), ";").alias(c)
    return df.select("table_path", joined("pages"), joined("tags"), *others)


def write_index(df: DataFrame, path: str) -> None:
    """A new version in the folder `path`; `df` may read an older one, which stays."""
    format_index(df).write.option("header", True).option("escape", '"').csv(f"{path}/run={time.time_ns()}")
