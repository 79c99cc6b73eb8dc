"""An extraction run: choose tables of a catalog, reshape their portions, write them, update the index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators import catalog as cat
from cellweave.operators.reshape import Step, concat_portions, sequence
from cellweave.operators.userfn import Rows, table_function
from cellweave.session import scratch_path
from cellweave.tables import Layout


@dataclass(frozen=True)
class Choice:
    with_tags: list[str] = field(default_factory=list)
    without_tags: list[str] = field(default_factory=list)
    overwrite: bool = False


def work_list(catalog: DataFrame, index: DataFrame, choice: Choice) -> DataFrame:
    """`(path, out_path, tags, transform)` of the tables to extract."""
    cat.check_tag_lists(choice.with_tags, choice.without_tags)
    tables = cat.enabled(cat.inherit_tags(catalog))
    tables = cat.without_tags(cat.with_any_tag(tables, choice.with_tags), choice.without_tags)
    return cat.without_outputs(cat.output_paths(tables), index, choice.overwrite)


#: Steps, or a function on the portions of a table (`userfn`).
Transform = list[Step] | Callable[[list[Rows]], Rows]


def extract(
    work: DataFrame, portions: DataFrame, transforms: dict[str, Transform], layout: Layout | None = None
) -> tuple[DataFrame, DataFrame]:
    """Reshape the chosen tables: one plan per transform, shared by its tables. Gives their rows, and `(table_id, error)`.

    Tables without a transform are concatenated as they are; those with one that
    is not in `transforms` give nothing (see `unknown_transforms`). A user's
    function that fails gives its table an error, the others their rows. The
    chosen rows are written once, by transform, so each plan reads its own tables only.
    """
    listed = work.select(F.col("path").alias("table_id"), "transform")
    spark, path = work.sparkSession, scratch_path(work.sparkSession, "chosen")
    chosen = portions.join(listed, "table_id").select("table_id", "part_ix", "row_ix", "cells", "transform")
    chosen.write.partitionBy("transform").parquet(path)
    chosen = spark.read.schema(chosen.schema).parquet(path)
    # One row per transform, of which there are as many as the caller has named.
    used = {r.transform for r in listed.select("transform").distinct().collect()}
    parts, failed = [], [spark.createDataFrame([], "table_id string, error string")]
    for name in sorted(used & set(transforms)):
        own, rows = listed.filter(F.col("transform") == name).select("table_id"), chosen.filter(F.col("transform") == name)
        if callable(transforms[name]):
            made, errors = table_function(rows, transforms[name])
            parts.append(made)
            failed.append(errors)
            continue
        steps = [s.for_tables(own) if hasattr(s, "for_tables") else s for s in transforms[name]]
        parts.append(sequence(concat_portions(rows), steps, layout=layout))
    done = reduce(DataFrame.unionByName, parts, concat_portions(chosen.filter("transform is null")))
    return done, reduce(DataFrame.unionByName, failed)


def unknown_transforms(work: DataFrame, transforms: dict[str, list[Step]]) -> DataFrame:
    """`(table_id, error)` of the tables whose transform is not there."""
    unknown = work.filter(F.col("transform").isNotNull() & ~F.col("transform").isin(list(transforms)))
    return unknown.select(F.col("path").alias("table_id"), F.format_string("unknown transform %s", "transform").alias("error"))


def index_rows(work: DataFrame, portions: DataFrame, page_offset: int = 1) -> DataFrame:
    """Index rows of the tables of the work list; one without portions has no pages."""
    pages = cat.pages_of(portions, page_offset).withColumnRenamed("table_id", "path")
    return work.join(pages, "path", "left").select(
        F.col("out_path").alias("table_path"), F.coalesce("pages", F.array().cast("array<int>")).alias("pages"), "tags"
    )


def run_outcomes(work: DataFrame, written: DataFrame, errors: DataFrame) -> DataFrame:
    """Per table of the work list: written, or what went wrong."""
    return cat.outcomes(work.select(F.col("path").alias("table_id")), written, errors)
