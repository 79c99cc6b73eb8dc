"""The table form all operators share, and ordered running values over it.

A DataFrame of tables has one row per table row:

    (table_id STRING, row_ix BIGINT, cells ARRAY<STRING>)

`row_ix` is the order. It is unique within a table and not negative; it need
not be dense. `cells` is ragged and holds no nulls. Portions of a table carry
`part_ix` and `page` as well until they are concatenated.

One table may hold a large share of all rows, so no operator may put a whole
table into one task without knowing that it is small. `layout_of` counts rows
per table; where every table fits in a chunk, one exchange on `table_id` serves
all steps, otherwise running values are built chunk by chunk (`running`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.session import cut_lineage, written

PORTION_SCHEMA = T.StructType(
    [
        T.StructField("table_id", T.StringType(), False),
        T.StructField("part_ix", T.IntegerType(), False),
        T.StructField("page", T.IntegerType(), True),
        T.StructField("row_ix", T.LongType(), False),
        T.StructField("cells", T.ArrayType(T.StringType(), False), False),
    ]
)
TABLE_COLUMNS = ["table_id", "row_ix", "cells"]

CHUNK_BITS = 14
#: The column that marks rows as dealt by (key, chunk).
CHUNK = "_chunk"


@dataclass(frozen=True)
class Layout:
    """How rows of a table may be grouped in tasks.

    `chunked=False` states that every table was counted and has at most
    2**bits rows. `chunked=True` promises nothing about table sizes.
    """

    chunked: bool = True
    bits: int = CHUNK_BITS


def layout_of(df: DataFrame, keys: tuple[str, ...] = ("table_id",), bits: int = CHUNK_BITS) -> Layout:
    """Count rows per table (pre-aggregated, keys only) and pick the layout."""
    longest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return Layout(chunked=(longest or 0) > (1 << bits), bits=bits)


#: So many ids of long tables are sent to all tasks at most; beyond, all tables take the route of the long ones.
LISTED_TABLES = 100_000


def routes(df: DataFrame, bits: int = CHUNK_BITS) -> list[tuple[DataFrame, Layout]]:
    """The tables by their length: those of at most 2**bits rows, and the longer ones."""
    counts = df.groupBy("table_id").agg((F.count("*") > (1 << bits)).alias("long"))
    tables, n_long = counts.agg(F.count("*"), F.count_if("long")).first()
    short, chunked = Layout(chunked=False, bits=bits), Layout(chunked=True, bits=bits)
    if not n_long:
        return [(df, short)]
    if n_long == tables or n_long > LISTED_TABLES:
        return [(df, chunked)]
    # Counted just now to be few.
    long = F.broadcast(cut_lineage(counts.filter("long").select("table_id")))
    return [(df.join(long, "table_id", "left_anti"), short), (df.join(long, "table_id", "left_semi"), chunked)]


def routed(df: DataFrame, work: Callable[[DataFrame, Layout], DataFrame], bits: int = CHUNK_BITS) -> DataFrame:
    """`work` on tables of any length, each by its own route: a few long tables do not take the short ones along."""
    return reduce(DataFrame.unionByName, [work(part, layout) for part, layout in routes(df, bits)])


@dataclass(frozen=True)
class Running:
    """A running value along the row order: `sum`, `max` or `last` (non-null).

    `inclusive=False` leaves the current row out, so `last` becomes a lag.
    """

    kind: str
    value: Column
    inclusive: bool = True


def in_chunks(df: DataFrame, layout: Layout, keys: tuple[str, ...] = ("table_id",), order: str = "row_ix") -> DataFrame:
    """Rows dealt and sorted by (key, chunk) once; the column `_chunk` says so to `running`.

    A chunk is a range of 2**bits values of the order column. Running values over
    such rows need no further exchange, and as long as `_chunk` is kept, several
    of them, and folds within chunks, follow each other on the same partitions.
    """
    placed = df.withColumn(CHUNK, F.shiftright(order, layout.bits))
    return placed.repartition(*keys, CHUNK).sortWithinPartitions(*keys, CHUNK, order)


def running(
    df: DataFrame,
    values: dict[str, Running],
    layout: Layout,
    keys: tuple[str, ...] = ("table_id",),
    order: str = "row_ix",
    reverse: bool = False,
) -> DataFrame:
    """Add running values per key in row order.

    Small tables: one window per table. Otherwise the order column is cut into
    chunks of 2**bits values, hence at most as many rows. A window per
    (key, chunk) gives the local running values; what came before a chunk is
    the running value over the chunk totals, worked out in the same way, so no
    window ever holds more than 2**bits rows, however sparse the order is.

    Rows from `in_chunks` stay where they are, and only the totals are written:
    one row per chunk. Other rows are written first, since they are read for the
    totals and for the rows, and dealt out for the windows.
    """
    if not layout.chunked:
        return _running_within(df, values, keys, order, reverse)

    chunk_keys = (*keys, CHUNK)
    if CHUNK in df.columns:
        read = placed = df
    else:
        read = written(df).withColumn(CHUNK, F.shiftright(order, layout.bits))
        placed = in_chunks(read.drop(CHUNK), layout, keys, order)
    local = _running_within(placed, {f"_local_{n}": v for n, v in values.items()}, chunk_keys, order, reverse)

    totals = cut_lineage(
        read.groupBy(*chunk_keys).agg(*[_total(v, order, reverse).alias(f"_total_{n}") for n, v in values.items()])
    ).withColumnRenamed(CHUNK, "_at")
    before = running(
        totals,
        {f"_before_{n}": Running(v.kind, F.col(f"_total_{n}"), inclusive=False) for n, v in values.items()},
        layout_of(totals, keys, layout.bits),
        keys,
        order="_at",
        reverse=reverse,
    ).select(*keys, F.col("_at").alias(CHUNK), *[f"_before_{n}" for n in values])

    joined = local.join(before, list(chunk_keys), "left")
    for name, v in values.items():
        here, earlier = F.col(f"_local_{name}"), F.col(f"_before_{name}")
        if v.kind == "sum":
            merged = here + F.coalesce(earlier, F.lit(0))
        elif v.kind == "max":
            merged = F.greatest(here, earlier)
        else:
            merged = F.coalesce(here, earlier)
        joined = joined.withColumn(name, merged).drop(f"_local_{name}", f"_before_{name}")
    return joined if CHUNK in df.columns else joined.drop(CHUNK)


def _running_within(df, values, keys, order, reverse):
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if reverse else F.asc(order))
    columns = []
    for name, v in values.items():
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if v.inclusive else -1)
        if v.kind == "sum":
            value = F.coalesce(F.sum(v.value).over(frame), F.lit(0))
        elif v.kind == "max":
            value = F.max(v.value).over(frame)
        elif v.kind == "last":
            value = F.last(v.value, ignorenulls=True).over(frame)
        else:
            raise ValueError(f"unknown running value {v.kind!r}")
        columns.append(value.alias(name))
    return df.select("*", *columns)


def _total(v: Running, order: str, reverse: bool) -> Column:
    if v.kind == "sum":
        return F.sum(v.value)
    if v.kind == "max":
        return F.max(v.value)
    where = F.when(v.value.isNotNull(), F.col(order))
    return F.min_by(v.value, where) if reverse else F.max_by(v.value, where)


def renumber(df: DataFrame, layout: Layout, keys: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """Make `row_ix` dense, starting at 0."""
    ranked = running(df, {"_rank": Running("sum", F.lit(1).cast("bigint"), inclusive=False)}, layout, keys)
    return ranked.withColumn("row_ix", F.col("_rank")).drop("_rank")


def in_order(
    df: DataFrame,
    keys: tuple[str, ...],
    order: list[Column],
    name: str = "row_ix",
    layout: Layout | None = None,
) -> DataFrame:
    """Number rows within `keys` by any sort order, 0-based and dense.

    `order` must decide every tie. Small groups take a plain window. Otherwise
    one global sort spreads even a single hot key over many tasks, the sorted
    rows get increasing ids, and those are made dense chunk by chunk.
    """
    layout = layout or layout_of(df, keys)
    if not layout.chunked:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    return in_order_sorted(df, keys, order, layout, name)


def in_order_sorted(
    df: DataFrame, keys: tuple[str, ...], order: list[Column], layout: Layout, name: str = "row_ix"
) -> DataFrame:
    """`in_order` for groups of any size: one sort, written once, and a row per group and sorted part."""
    place, part = "_place", "_part"
    placed = df.orderBy(*[F.col(k) for k in keys], *order).withColumn(place, F.monotonically_increasing_id())
    # Written once: the places must not change. A group's rows follow each other, over one or more sorted parts.
    placed = written(placed.withColumn(part, F.shiftright(place, 33)))
    marked = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_key{i}") for i, k in enumerate(keys)]
    nulls = [F.col(k).isNull().alias(f"_null{i}") for i, k in enumerate(keys)]
    names = [*[f"_key{i}" for i in range(len(keys))], *[f"_null{i}" for i in range(len(keys))]]
    rows = placed.select("*", *marked, *nulls)
    totals = cut_lineage(rows.groupBy(*names, part).agg(F.min(place).alias("_first"), F.count("*").alias("_rows")))
    # A group has at most one row per sorted part here.
    earlier = Window.partitionBy(*names).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    joined = rows.join(totals.select(*names, part, shift), [*names, part])
    return joined.withColumn(name, F.col(place) + F.col("_shift")).drop(*names, place, part, "_shift")


def to_cells(df: DataFrame) -> DataFrame:
    """Flat form `(table_id, row_ix, col_ix, cell)`; rows without cells vanish."""
    return df.select("table_id", "row_ix", F.posexplode("cells").alias("col_ix", "cell")).withColumn(
        "col_ix", F.col("col_ix").cast("bigint")
    )


def ordered_items(df: DataFrame, by: list[str], order: str, value: Column, layout: Layout) -> DataFrame:
    """Collect `value` per group as an array `items` in row order.

    For values whose result is one record per group anyway (a folded row, the
    text of a section). Unless tables are small, each chunk is collected first.
    """
    item = F.struct(F.col(order).alias("at"), value.alias("v"))
    pick = lambda c: F.transform(F.array_sort(c), lambda x: x["v"])
    if not layout.chunked:
        return df.groupBy(*by).agg(F.collect_list(item).alias("items")).withColumn("items", pick("items"))
    parts = (
        df.withColumn("_chunk", F.shiftright(order, layout.bits))
        .groupBy(*by, "_chunk")
        .agg(F.collect_list(item).alias("items"))
        .withColumn("items", pick("items"))
    )
    return (
        parts.groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("_chunk", "items"))).alias("parts"))
        .select(*by, F.flatten(F.transform("parts", lambda p: p["items"])).alias("items"))
    )
