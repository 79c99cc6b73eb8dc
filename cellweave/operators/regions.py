"""Boxes on pages: which items lie in which region, and reading order.

Boxes are `(doc, page, method, left, top, right, bottom)` in 1/4096 points,
origin top left. Joins go over grid cells, so that even a page that holds a
large share of all boxes is spread out. There are a few grids, fine to coarse;
a box lives in the finest one where it covers only a few cells, hence a box
costs a bounded number of rows whatever its size.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.session import cut_lineage, written
from cellweave.tables import CHUNK, Running, in_chunks, in_order, layout_of, running

# Fraction of a point that is told apart, and the vertical
# distance in points from which two boxes are on different lines.
POINT = 4096
LINE_DISTANCE = 50.0
COLUMN_SPLIT = 200.0

# Cell sizes in points; the last grid is a single cell.
GRID_POINTS = (32, 256, 2048)
SPAN = 4
PAGE_KEYS = ["doc", "page", "method"]
CELL_KEYS = [*PAGE_KEYS, "grid", "cx", "cy"]


def quantise(points: Column) -> Column:
    return F.round(points * POINT).cast("bigint")


def with_size(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "width": F.col("right") - F.col("left"),
            "height": F.col("bottom") - F.col("top"),
            "valid": (F.col("left") <= F.col("right")) & (F.col("top") <= F.col("bottom")),
        }
    )


def _grid() -> Column:
    """The finest grid where the box covers at most SPAN + 1 cells each way."""
    side = F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"))
    grid = F.lit(len(GRID_POINTS))
    for n, points in reversed(list(enumerate(GRID_POINTS))):
        grid = F.when(side <= SPAN * points * POINT, n).otherwise(grid)
    return grid


def _cell(value: Column, grid: int) -> Column:
    if grid == len(GRID_POINTS):
        return F.lit(0).cast("bigint")
    return F.floor(value / (GRID_POINTS[grid] * POINT))


def _cell_in(value: Column, grid: Column) -> Column:
    cell = _cell(value, len(GRID_POINTS))
    for n in range(len(GRID_POINTS)):
        cell = F.when(grid == n, _cell(value, n)).otherwise(cell)
    return cell


def _covered(df: DataFrame, grid: Column) -> DataFrame:
    """One row per cell the box covers in `grid`."""
    span = lambda lo, hi: F.sequence(_cell_in(F.col(lo), F.col("grid")), _cell_in(F.col(hi), F.col("grid")))
    return (
        df.withColumn("grid", grid)
        .withColumn("cx", F.explode(span("left", "right")))
        .withColumn("cy", F.explode(span("top", "bottom")))
    )


#: Pages of at most so many regions are one cell: all their boxes are compared.
PAGE_REGIONS = 64


def _with_own_grid(regions: DataFrame, *sides: DataFrame) -> list[DataFrame]:
    """The sides with `own_grid`, the finest grid their boxes are in: the single cell where a page holds few regions."""
    crowded = written(
        regions.groupBy(*PAGE_KEYS).agg((F.count("*") > PAGE_REGIONS).alias("crowded")).filter("crowded")
    )
    # A row per page of very many regions.
    crowded = F.broadcast(crowded) if crowded.count() <= LISTED_CELLS else crowded.hint("merge")
    own = F.when(F.col("crowded"), _grid()).otherwise(len(GRID_POINTS)).alias("own_grid")
    return [side.join(crowded, PAGE_KEYS, "left").select(*side.columns, own) for side in sides]


def _grids_from_own() -> Column:
    return F.explode(F.sequence("own_grid", F.lit(len(GRID_POINTS))))


#: Rows of a cell that one task takes; cells with more are split.
CELL_ROWS = 20_000
#: So many split cells are sent to all tasks at most; beyond, they are joined.
LISTED_CELLS = 100_000
#: Rows that one task of a join over cells sorts, about.
TASK_ROWS = 500_000


def _dealt(keys: list[str], *sides: DataFrame) -> list[DataFrame]:
    """The sides of a join dealt by its keys, over so many tasks that each sorts some TASK_ROWS rows.

    Rows of boxes compress so well that adaptive execution, which goes by compressed size, would put a
    share of all rows into one task. Few rows are left to it.
    """
    rows = sum(side.count() for side in sides)
    if rows <= TASK_ROWS:
        return [*sides]
    tasks = max(ceil(rows / TASK_ROWS), sides[0].sparkSession.sparkContext.defaultParallelism)
    return [side.repartition(tasks, *keys) for side in sides]


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A sorted join: sides that are exploded, compressed or checkpointed look far smaller than they are, so none is sent whole."""
    return left.join(right.hint("merge"), keys, how)


def _in_occupied(rows: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows in cells that `others` are in as well, cells of very many rows split, with copies of the others for each part.

    Gives both sides and the keys to join them on.
    """
    rows, others = _dealt(CELL_KEYS, rows, others)
    rows = _joined(rows, others.select(*CELL_KEYS), CELL_KEYS, "left_semi")
    counts = rows.groupBy(*CELL_KEYS).agg(F.count("*").alias("n")).filter(F.col("n") > CELL_ROWS)
    split = cut_lineage(counts.select(*CELL_KEYS, F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts")))
    n_split = split.count()
    if not n_split:
        return rows, others, CELL_KEYS
    split = F.broadcast(split) if n_split <= LISTED_CELLS else split.hint("merge")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in CELL_KEYS]), parts).cast("int")
    copies = F.explode(F.sequence(F.lit(0), parts - 1))
    part = lambda side, number: side.join(split, CELL_KEYS, "left").withColumn("part", number).drop("parts")
    keys = [*CELL_KEYS, "part"]
    return *_dealt(keys, part(rows, own), part(others, copies)), keys


def items_in_regions(items: DataFrame, regions: DataFrame) -> DataFrame:
    """Pairs of an item and a region that holds it on all four sides.

    A region is entered in every cell it covers in its grid; an item, no larger
    than its region, is looked up by its top left corner, so no pair comes twice.
    Items go only to cells that hold regions, and cells of very many items are split.
    """
    regions = regions.filter("left <= right and top <= bottom")
    columns = items.columns
    items, regions = _with_own_grid(regions, items, regions)
    corner = (
        items.withColumn("grid", _grids_from_own())
        .withColumn("cx", _cell_in(F.col("left"), F.col("grid")))
        .withColumn("cy", _cell_in(F.col("top"), F.col("grid")))
    )
    inside = _covered(regions, F.col("own_grid")).select(
        *CELL_KEYS, "region_id", *[F.col(c).alias(f"r_{c}") for c in ("left", "top", "right", "bottom")]
    )
    corner, inside, keys = _in_occupied(corner, inside)
    return (
        _joined(corner, inside, keys)
        .filter("left >= r_left and right <= r_right and top >= r_top and bottom <= r_bottom")
        .select(*columns, "region_id")
    )


def overlapping(regions: DataFrame) -> DataFrame:
    """Pairs `(doc, page, method, region_a, region_b)` that overlap or touch, a before b.

    The box in the finer grid is looked up in the grid of the coarser one. A
    pair that meets in several cells is kept only in the one that holds the top
    left corner of the common area. Boxes go only to coarser cells that are the
    own ones of others, and cells of very many boxes are split.
    """
    boxes = regions.filter("left <= right and top <= bottom").select(*PAGE_KEYS, "region_id", "left", "top", "right", "bottom", _grid().alias("size"))
    (boxes,) = _with_own_grid(boxes, boxes)
    names = ["region_id", "left", "top", "right", "bottom", "size"]
    hosts = _covered(boxes, F.col("own_grid")).select(*CELL_KEYS, *[F.col(c).alias(f"h_{c}") for c in names])
    guests = _covered(boxes, _grids_from_own()).select(*CELL_KEYS, *[F.col(c).alias(f"g_{c}") for c in names])
    guests, hosts, keys = _in_occupied(guests, hosts)
    corner_x, corner_y = F.greatest("h_left", "g_left"), F.greatest("h_top", "g_top")
    return (
        _joined(hosts, guests, keys)
        .filter("h_left <= g_right and g_left <= h_right and h_top <= g_bottom and g_top <= h_bottom")
        .filter("g_size < h_size or (g_size = h_size and g_region_id < h_region_id)")
        .filter((_cell_in(corner_x, F.col("grid")) == F.col("cx")) & (_cell_in(corner_y, F.col("grid")) == F.col("cy")))
        .select(
            *PAGE_KEYS,
            F.least("h_region_id", "g_region_id").alias("region_a"),
            F.greatest("h_region_id", "g_region_id").alias("region_b"),
        )
    )


#: Cell sides of the counting grids in points, each 8 times the one before; above the last a page is one cell.
LEVEL_POINTS = (0.5, 4, *GRID_POINTS)
#: Cells of at most so many boxes are not divided further but looked at box by box.
LEAF_BOXES = 64


def _level_cell(value: Column, level: Column) -> Column:
    """The cell of a counting grid, 0 in the last, which is the page."""
    cell = F.lit(0).cast("bigint")
    for n, points in enumerate(LEVEL_POINTS):
        cell = F.when(level == n, F.floor(value / int(points * POINT))).otherwise(cell)
    return cell


def count_in_regions(items: DataFrame, regions: DataFrame) -> DataFrame:
    """`(region_id, tables, item_id)`: how many items each region holds, and the smallest of their ids (null without any).

    As counting the pairs of `items_in_regions` would give, without building them. Equal boxes are one row with a
    count. Cells of a few nested grids have the number of boxes whose top left corner they hold, their smallest id
    and the span of their sides, apart by the size of boxes. Cells of more than LEAF_BOXES boxes are divided, and
    only they, so a box is counted no further down than it has to be. A region takes a cell whose span lies within
    it whole and one whose span lies beyond it not at all; it goes down into the others, to the boxes of undivided
    cells, which alone are compared. So work follows the borders of regions, not their area.
    """
    sides = ("left", "top", "right", "bottom")
    (dealt,) = _dealt([*PAGE_KEYS, *sides], items)
    boxes = written(
        dealt.groupBy(*PAGE_KEYS, *sides)
        .agg(F.count("*").alias("n"), F.min("item_id").alias("item_id"))
        .withColumn("kind", _grid())
    )
    top = len(LEVEL_POINTS)
    rect = [f"r_{c}" for c in sides]
    valid = regions.filter("left <= right and top <= bottom")
    side = F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"))
    # The level where the region covers two cells each way at most.
    first = F.lit(top)
    for n, points in reversed(list(enumerate(LEVEL_POINTS))):
        first = F.when(side <= int(points * POINT), n).otherwise(first)
    span = lambda lo, hi: F.sequence(_level_cell(F.col(lo), F.col("level")), _level_cell(F.col(hi), F.col("level")))
    # A region starts from its first level, and above it from cells that are not divided. A box is no larger than
    # the region that holds it. `grid` is the size of boxes and the level of the cell in one number.
    starts = written(
        valid.withColumn("first", first)
        .withColumn("level", F.explode(F.sequence("first", F.lit(top))))
        .withColumn("cx", F.explode(span("left", "right")))
        .withColumn("cy", F.explode(span("top", "bottom")))
        .withColumn("kind", F.explode(F.sequence(F.lit(0), _grid())))
        .withColumn("grid", F.col("kind") * 16 + F.col("level"))
        .select(
            *CELL_KEYS, "level", (F.col("level") == F.col("first")).alias("own"), "region_id",
            *[F.col(c).alias(r) for c, r in zip(sides, rect)],
        )
    )
    inside = F.expr("least_left >= r_left and most_right <= r_right and least_top >= r_top and most_bottom <= r_bottom")
    beyond = F.expr("most_left < r_left or least_right > r_right or most_top < r_top or least_bottom > r_bottom")
    open_, settled, leaves, placed = None, [], [], []
    for level in range(top, -1, -1):
        here = boxes.withColumns(
            {
                "grid": F.col("kind") * 16 + level,
                "cx": _level_cell(F.col("left"), F.lit(level)),
                "cy": _level_cell(F.col("top"), F.lit(level)),
            }
        )
        cells = written(
            here.groupBy(*CELL_KEYS)
            .agg(
                F.sum("n").alias("n"),
                F.count("*").alias("boxes"),
                F.min("item_id").alias("item_id"),
                *[F.min(c).alias(f"least_{c}") for c in sides],
                *[F.max(c).alias(f"most_{c}") for c in sides],
            )
            .withColumn("divided", (F.col("boxes") > LEAF_BOXES) & F.lit(level > 0))
            .drop("boxes")
        )
        begun = starts.filter(F.col("level") == level).drop("level")
        met = _joined(*_dealt(CELL_KEYS, begun, cells), CELL_KEYS).filter("own or not divided").drop("own")
        if open_ is not None:
            parent = [F.lit(0).cast("bigint") if level + 1 == top else F.shiftright(c, 3) for c in ("cx", "cy")]
            within = cells.withColumns(dict(zip(("_px", "_py"), parent)))
            entered = open_.select(
                *PAGE_KEYS, (F.col("grid") - 1).alias("grid"), F.col("cx").alias("_px"), F.col("cy").alias("_py"), "region_id", *rect
            )
            keys = [*PAGE_KEYS, "grid", "_px", "_py"]
            met = met.unionByName(_joined(*_dealt(keys, entered, within), keys).drop("_px", "_py"))
        state = F.when(inside, "whole").when(~beyond, F.when(F.col("divided"), "open").otherwise("leaf"))
        met = written(met.select(*CELL_KEYS, "region_id", *rect, "n", "item_id", state.alias("state")).filter("state is not null"))
        settled.append(met.filter("state = 'whole'").select("region_id", "n", "item_id"))
        leaves.append(met.filter("state = 'leaf'").drop("n", "item_id", "state"))
        open_ = met.filter("state = 'open'")
        divided = cells.filter("divided").select(*CELL_KEYS, "divided")
        n_divided = divided.count()
        if not n_divided:
            placed.append(here)
            break
        divided = F.broadcast(divided) if n_divided <= LISTED_CELLS else divided.hint("merge")
        dealt = here if n_divided <= LISTED_CELLS else _dealt(CELL_KEYS, here)[0]
        here = written(dealt.join(divided, CELL_KEYS, "left"))
        placed.append(here.filter("divided is null").drop("divided"))
        boxes = here.filter("divided").drop("divided", "grid", "cx", "cy")
    looked_at = reduce(DataFrame.unionByName, leaves)
    corner, looked_at, keys = _in_occupied(reduce(DataFrame.unionByName, placed).drop("kind"), looked_at)
    single = (
        _joined(corner, looked_at, keys)
        .filter("left >= r_left and right <= r_right and top >= r_top and bottom <= r_bottom")
        .select("region_id", "n", "item_id")
    )
    counts = (
        reduce(DataFrame.unionByName, [*settled, single])
        .groupBy("region_id")
        .agg(F.sum("n").alias("tables"), F.min("item_id").alias("item_id"))
    )
    tables = F.coalesce("tables", F.lit(0)).cast("bigint").alias("tables")
    return _joined(regions.select("region_id"), counts, ["region_id"], "left").select("region_id", tables, "item_id")


def match_counts(regions: DataFrame, matches: DataFrame) -> DataFrame:
    """`(region_id, tables, outcome)` of regions by their pairs with items."""
    return match_outcomes(regions, matches.groupBy("region_id").agg(F.count("*").alias("tables")))


def match_outcomes(regions: DataFrame, counts: DataFrame) -> DataFrame:
    """`(region_id, tables, outcome)`: a region wants exactly one item."""
    tables = F.coalesce("tables", F.lit(0)).cast("bigint")
    return _joined(regions.select("region_id"), counts, ["region_id"], "left").select(
        "region_id",
        tables.alias("tables"),
        F.when(tables == 0, "no table in region")
        .when(tables == 1, "ok")
        .otherwise(F.format_string("multiple (%d) tables in region", tables))
        .alias("outcome"),
    )


def batch_sizes(regions: DataFrame) -> DataFrame:
    """How many regions are read together: those of one page and method."""
    return regions.groupBy(*PAGE_KEYS).agg(F.count("*").alias("regions"))


def non_overlapping_batches(regions: DataFrame) -> DataFrame:
    """Number the batches of each page so that no two regions of a batch overlap.

    Gives `(region_id, batch)`. Any order of the regions will do: they are taken
    in the order of a hash, and each gets the lowest batch without an earlier
    region it overlaps. All regions whose earlier neighbours are settled get
    theirs in the same round, so with the hashed order a long row of boxes, each
    overlapping the next, takes few rounds. A round writes the regions it has
    settled and no others, so over all rounds each region is written once.
    """
    rank = lambda c: F.struct(F.md5(F.col(c).cast("string").cast("binary")), F.col(c))
    first = rank("region_a") < rank("region_b")
    pairs = overlapping(regions).select(
        F.when(first, F.col("region_a")).otherwise(F.col("region_b")).alias("earlier"),
        F.when(first, F.col("region_b")).otherwise(F.col("region_a")).alias("region_id"),
    )
    pairs = cut_lineage(pairs)
    every = regions.select("region_id").distinct()
    settled = every.limit(0).withColumn("batch", F.lit(None).cast("bigint"))
    while True:
        earlier = (
            _joined(pairs, settled.withColumnRenamed("region_id", "earlier"), ["earlier"], "left")
            .groupBy("region_id")
            .agg(F.max(F.col("batch").isNull()).alias("waits"), F.collect_set("batch").alias("used"))
        )
        waiting = _joined(_joined(every, settled, ["region_id"], "left_anti"), earlier, ["region_id"], "left")
        upto = F.sequence(F.lit(0).cast("bigint"), F.size("used").cast("bigint"))
        free = F.coalesce(F.array_min(F.array_except(upto, F.col("used"))), F.lit(0)).cast("bigint")
        new = cut_lineage(waiting.filter(~F.coalesce("waits", F.lit(False))).select("region_id", free.alias("batch")))
        if not new.head(1):
            return settled
        settled = settled.unionByName(new)


def reading_order(df: DataFrame, group: str) -> DataFrame:
    """Number boxes `(group, page, x, y, region_id)` by page, line and x.

    A new line starts where a box is 50 points or more below the one before it.
    """
    layout = layout_of(df, (group,))
    # Of groups of any size this alone writes rows; the rest follows from them.
    placed = in_order(
        df, (group,), [F.col("page"), F.col("y"), F.col("x"), F.col("region_id")], "by_height", layout
    )
    if layout.chunked:
        placed = in_chunks(placed, layout, (group,), "by_height")
    above = running(
        placed, {"above": Running("last", F.struct("page", "y"), False)}, layout, (group,), order="by_height"
    )
    new_line = (
        F.col("above").isNull()
        | (F.col("above.page") != F.col("page"))
        | (F.col("y") - F.col("above.y") >= LINE_DISTANCE)
    )
    # A line is a run of boxes by height, so its boxes take the places from its first one on.
    lines = running(
        above,
        {"line": Running("sum", F.when(new_line, 1).otherwise(0)), "begin": Running("last", F.when(new_line, F.col("by_height")))},
        layout,
        (group,),
        order="by_height",
    ).drop(CHUNK)
    within = in_order(lines, (group, "line"), [F.col("x"), F.col("by_height")], "in_line")
    return within.withColumn("position", F.col("begin") + F.col("in_line")).drop("above", "by_height", "begin", "in_line")


def two_column_order(df: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Number boxes with the left column first, then by height.

    Groups on more than one page come back as errors `(group, pages)`.
    """
    pages = df.select(group, "page").distinct().groupBy(group).agg(F.count("*").alias("pages"))
    one_page = df.join(pages.filter("pages = 1").select(group), group, "left_semi")
    placed = in_order(
        one_page, (group,), [F.col("x") >= COLUMN_SPLIT, F.col("y"), F.col("region_id")], "position"
    )
    return placed, pages.filter("pages > 1")
