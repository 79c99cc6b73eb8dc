"""The two jobs a user runs: extract tables, and report on trade."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import catalog as cat
from cellweave.operators.reshape import Step, concat_portions
from cellweave.plans import extraction, records, trade
from cellweave.session import cut_lineage
from cellweave.sources import csvtables, worldfiles
from cellweave.tables import in_order

# Tags of the tables the trade report reads.
GOODS_TAGS = ["type/trade-good"]
CODES_TAGS = ["type/trade-code"]


@dataclass(frozen=True)
class TradeJob:
    """What to report on, and how; paths are files or folders Spark can read."""

    index: str
    tables: str
    world_source: str
    worlds: str
    illegality: str | None = None
    overrides: str | None = None
    ignore_unknown: list[str] = field(default_factory=list)
    formats: trade.Formats = trade.Formats()
    #: `tables` is the folder that `extract_tables` wrote, not one of CSV files.
    extracted: bool = False
    output: str = "csv"
    headers: bool = True
    key: bool = True
    explanation: bool = True


def _tagged_table(spark: SparkSession, job: TradeJob, tags: list[str], columns: list[str]) -> DataFrame:
    """The one table with these tags, keyed by its titles."""
    index = worldfiles.read_index(spark, job.index)
    path = cat.only_row(cat.with_all_tags(index, tags), ", ".join(tags)).first().table_path
    if job.extracted:
        name = path.removesuffix(cat.OUTPUT_SUFFIX)
        return records.by_header(_renumbered(csvtables.read_written_tables(spark, job.tables, only=name)), columns)
    return records.by_header(csvtables.read_csv_tables(spark, f"{job.tables}/{path}"), columns)


def _renumbered(portions: DataFrame) -> DataFrame:
    """Portions as tables whose rows are numbered from 0: the first part file has the titles."""
    rows = concat_portions(portions)
    return in_order(rows.withColumnRenamed("row_ix", "place"), ("table_id",), [F.col("place")], "row_ix").drop("place")


def _refuse(faults: DataFrame, what: str, name: str) -> None:
    """Fail where there are malformed records, and show the first of them."""
    shown = [f"{r[name]} ({', '.join(r.bad)})" for r in faults.select(name, "bad").limit(20).collect()]
    if shown:
        raise ValueError(f"malformed {what}: {'; '.join(shown)}")


def trade_report(spark: SparkSession, job: TradeJob) -> DataFrame:
    """The report as `(block, line_ix, line)`; write it with `write_report`.

    A malformed good, world, law level or override fails the run: it would get
    a number that looks right. All of them are in the `..._faults` frames.
    """
    goods_rows = cut_lineage(_tagged_table(spark, job, GOODS_TAGS, records.GOODS_COLUMNS))
    _refuse(records.goods_faults(goods_rows), "goods", "D66")
    goods = records.trade_goods(goods_rows)
    goods = cut_lineage(goods.withColumnRenamed("row_ix", "good_ix").drop("table_id"))
    criteria = ["Classification", "Code", *records.CRITERIA_COLUMNS]
    codes = records.trade_codes(_tagged_table(spark, job, CODES_TAGS, criteria))

    unknown_ok = "trade-codes" in job.ignore_unknown
    numbered = worldfiles.read_numbered_worlds(spark, job.world_source, job.worlds)
    _refuse(worldfiles.world_faults(spark, job.world_source, job.worlds), "worlds", "Name")
    worlds = cut_lineage(trade.world_views(numbered, codes, unknown_ok))

    if job.illegality:
        laws = cut_lineage(worldfiles.read_keyed_csv(spark, job.illegality, place=True))
        _refuse(worldfiles.illegality_faults(spark, laws), "law levels", "D66")
        illegality = worldfiles.read_illegality(spark, laws)
    else:
        illegality = spark.createDataFrame([], "d66 string, illegal_level bigint")
    if job.overrides:
        given = cut_lineage(worldfiles.read_keyed_csv(spark, job.overrides, place=True))
        _refuse(worldfiles.override_faults(spark, given), "overrides", "Location")
        overrides = worldfiles.read_overrides(spark, given)
    else:
        overrides = spark.createDataFrame(
            [], "location string, d66 string, available boolean, purchase_dm bigint, sale_dm bigint, illegal boolean"
        )
    trades = trade.calculate_trades(goods, worlds, illegality, overrides)
    if job.output == "csv":
        return trade.csv_report(goods, worlds, trades, job.formats, job.headers, job.key, job.explanation)
    if job.output == "asciidoc":
        return trade.asciidoc_report(goods, worlds, trades, job.formats, job.key, job.explanation)
    raise ValueError(f"unknown output {job.output!r}, want csv or asciidoc")


def write_report(report: DataFrame, path: str) -> None:
    """Text files whose names are in the order of the lines."""
    report.orderBy("block", "line_ix").select(F.col("line").alias("value")).write.text(path)


def extract_tables(
    catalog: DataFrame,
    portions: DataFrame,
    index: DataFrame,
    transforms: dict[str, extraction.Transform],
    choice: extraction.Choice,
    out: str,
    errors: DataFrame | None = None,
    page_offset: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Extract the chosen tables to CSV below `out/tables`; gives the new index, written to `out/index`, and the outcomes.

    `portions` has `table_id` equal to catalog paths. `errors` `(table_id, error)`
    are reading errors of tables; the other tables are extracted all the same, and
    so they are where a user's function fails for some.
    `trade_report` reads both folders, with `extracted`. A later run adds tables
    to them, or replaces those that the choice overwrites.
    """
    spark = catalog.sparkSession
    errors = errors if errors is not None else spark.createDataFrame([], "table_id string, error string")
    work = cut_lineage(extraction.work_list(catalog, index, choice))
    errors = cut_lineage(errors.unionByName(extraction.unknown_transforms(work, transforms)))
    sound = work.join(errors.select(F.col("table_id").alias("path")), "path", "left_anti")
    # Written before it is ranged into files, which reads it twice, and to know which tables came out.
    extracted, failed = extraction.extract(sound, portions, transforms)
    extracted, errors = cut_lineage(extracted), errors.unionByName(failed)
    csvtables.write_csv_tables(extracted, f"{out}/tables")
    written = extracted.select("table_id").distinct()
    indexed = sound.join(written.select(F.col("table_id").alias("path")), "path", "left_semi")
    worldfiles.write_index(cat.upsert_index(index, extraction.index_rows(indexed, portions, page_offset)), f"{out}/index")
    return worldfiles.read_index(spark, f"{out}/index"), extraction.run_outcomes(work, written, errors)
