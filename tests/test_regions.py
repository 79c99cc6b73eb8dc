"""Region joins and reading order against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave import tables
from cellweave.operators import regions as reg
from cellweave.session import cut_lineage

BOX = "doc string, page int, method string, left bigint, top bigint, right bigint, bottom bigint"


def boxes(seed, n, sizes):
    """Boxes in points of very different sizes, some with negative places, some inverted."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.uniform(-100, 600), rng.uniform(-100, 800)
        size = rng.choice(sizes)
        w, h = rng.uniform(-1, size), rng.uniform(0, size)
        q = [round(v * 4096) for v in (x, y, x + w, y + h)]
        out.append((i, "d", rng.randint(1, 2), "stream", *q))
    return out


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} int, {BOX}")


def inside(i, r):
    return i[1:4] == r[1:4] and r[4] <= r[6] and r[5] <= r[7] and i[4] >= r[4] and i[5] >= r[5] and i[6] <= r[6] and i[7] <= r[7]


def overlap(a, b):
    return a[1:4] == b[1:4] and a[4] <= b[6] and b[4] <= a[6] and a[5] <= b[7] and b[5] <= a[7]


@pytest.mark.parametrize("seed", [1, 2])
def test_joins(spark, seed):
    items = boxes(seed, 300, [1, 5, 60])
    regions = boxes(seed + 10, 120, [20, 150, 900, 30000])
    found = reg.items_in_regions(frame(spark, items, "item_id"), frame(spark, regions, "region_id"))
    got = sorted((r.item_id, r.region_id) for r in found.collect())
    assert got == sorted((i[0], r[0]) for i in items for r in regions if inside(i, r))
    pairs = sorted((r.region_a, r.region_b) for r in reg.overlapping(frame(spark, regions, "region_id")).collect())
    right = [r for r in regions if r[4] <= r[6] and r[5] <= r[7]]
    assert pairs == sorted((a[0], b[0]) for a in right for b in right if a[0] < b[0] and overlap(a, b))


@pytest.mark.parametrize("leaf", [1, 64])
def test_counts(spark, monkeypatch, leaf):
    """Counts and smallest ids of all regions, with boxes of every size, repeated and inverted ones, and any division of cells."""
    monkeypatch.setattr(reg, "LEAF_BOXES", leaf)
    items = boxes(4, 260, [1, 5, 60, 700, 9000])
    items += [(1000 + n, *items[n % 40][1:]) for n in range(120)]
    regions = boxes(14, 90, [3, 20, 150, 900, 4000, 30000])
    got = reg.count_in_regions(frame(spark, items, "item_id"), frame(spark, regions, "region_id")).collect()
    want = {r[0]: [i[0] for i in items if inside(i, r)] for r in regions}
    assert {(r.region_id, r.tables, r.item_id) for r in got} == {(k, len(v), min(v, default=None)) for k, v in want.items()}
    assert len(got) == len(regions) and any(len(v) > 50 for v in want.values())
    none = reg.count_in_regions(frame(spark, [], "item_id"), frame(spark, regions, "region_id")).collect()
    assert {(r.tables, r.item_id) for r in none} == {(0, None)} and len(none) == len(regions)
    assert not reg.count_in_regions(frame(spark, items, "item_id"), frame(spark, [], "region_id")).collect()


def test_counts_without_pairs(spark, monkeypatch):
    """Large regions over many items of one page: what is joined follows their borders."""
    looked = []
    real = reg._in_occupied

    def spy(rows, others):
        found = real(rows, others)
        looked.append(found[0].join(found[1], found[2]).count())
        return found

    monkeypatch.setattr(reg, "_in_occupied", spy)
    box = lambda x, y, w, h: (x * 4096, y * 4096, (x + w) * 4096, (y + h) * 4096)
    items = spark.range(60000).selectExpr(
        "cast(id as int) item_id", "'d' doc", "1 page", "'m' method", "id % 300 * 4096 left", "id div 300 * 4096 top",
        "(id % 300 + 1) * 4096 right", "(id div 300 + 1) * 4096 bottom",
    )
    areas = frame(spark, [(i, "d", 1, "m", *box(i, i, 250, 150)) for i in range(20)], "region_id")
    got = reg.count_in_regions(items, areas).collect()
    assert {(r.region_id, r.tables, r.item_id) for r in got} == {(i, 250 * 150, i * 300 + i) for i in range(20)}
    assert looked[0] < 20 * 250 * 150 / 4


def test_batches(spark):
    regions = boxes(3, 40, [50, 200])
    got = {r.region_id: r.batch for r in reg.non_overlapping_batches(frame(spark, regions, "region_id")).collect()}
    assert sorted(got) == [r[0] for r in regions]
    right = [r for r in regions if r[4] <= r[6] and r[5] <= r[7]]
    for a in right:
        near = {got[b[0]] for b in right if a[0] != b[0] and overlap(a, b)}
        assert got[a[0]] not in near
        # No lower batch would have done: each holds a box in the way.
        assert set(range(got[a[0]])) <= near


def test_three_boxes(spark):
    rows = [(i, "d", 1, "stream", *[v * 4096 for v in box]) for i, box in enumerate([(5, 5, 10, 10), (7, 7, 12, 12), (5, 20, 10, 25)])]
    regions = frame(spark, rows, "region_id")
    assert [tuple(r)[3:] for r in reg.overlapping(regions).collect()] == [(0, 1)]
    got = {r.region_id: r.batch for r in reg.non_overlapping_batches(regions).collect()}
    assert got[0] != got[1] and got[2] == 0


def test_cardinality(spark):
    regions = frame(spark, [(i, "d", 1, "stream", 0, 0, 10, 10) for i in range(3)], "region_id")
    matches = spark.createDataFrame([(1, 7), (2, 8), (2, 9)], "region_id int, item_id int")
    assert sorted(tuple(r) for r in reg.match_counts(regions, matches).collect()) == [
        (0, 0, "no table in region"), (1, 1, "ok"), (2, 2, "multiple (2) tables in region"),
    ]


def test_quantise(spark):
    df = spark.createDataFrame([(0.0001,), (1.0,), (-0.5 / 4096,), (0.5 / 4096,)], "v double")
    assert [r.q for r in df.select(reg.quantise(F.col("v")).alias("q")).collect()] == [0, 4096, -1, 1]


def test_reading_order(spark):
    rows = [(0, 1, 300.0, 100.0), (1, 1, 10.0, 140.0), (2, 1, 10.0, 190.0), (3, 1, 5.0, 239.0), (4, 2, 0.0, 0.0), (5, 1, 400.0, 400.0), (6, 1, 90.0, 449.9)]
    df = spark.createDataFrame([("g", *r[1:], r[0]) for r in rows], "grp string, page int, x double, y double, region_id int")
    got = [(r.region_id, r.line) for r in reg.reading_order(df, "grp").orderBy("position").collect()]
    # 190 is 50 below 140, so it starts a line; 239 does not.
    assert got == [(1, 1), (0, 1), (3, 2), (2, 2), (6, 3), (5, 3), (4, 4)]


def test_two_columns(spark):
    rows = [("g", 1, 300.0, 5.0, 0), ("g", 1, 50.0, 90.0, 1), ("g", 1, 200.0, 1.0, 2), ("h", 1, 0.0, 0.0, 3), ("h", 2, 0.0, 0.0, 4)]
    df = spark.createDataFrame(rows, "grp string, page int, x double, y double, region_id int")
    placed, errors = reg.two_column_order(df, "grp")
    assert [r.region_id for r in placed.orderBy("position").collect()] == [1, 2, 0]
    assert list(map(tuple, errors.collect())) == [("h", 2)]


def test_reading_order_writes_rows_once(spark, monkeypatch):
    """Groups of any size: the sorted boxes are written, else only totals."""
    boxes = spark.range(3000).selectExpr("'g' g", "id % 3 page", "cast(id * 7919 % 700 as double) x", "cast(id * 104729 % 5000 as double) y", "id region_id")
    whole = {r.region_id: r.position for r in reg.reading_order(boxes, "g").collect()}
    rows = []

    def spy_on(write):
        def spy(df):
            done = write(df)
            rows.append(done.count())
            return done

        return spy

    for name in ("cut_lineage", "written"):
        monkeypatch.setattr(tables, name, spy_on(getattr(tables, name)))
    monkeypatch.setattr(reg, "layout_of", lambda df, keys: tables.Layout(True, bits=5))
    got = {r.region_id: r.position for r in reg.reading_order(boxes, "g").collect()}
    assert got == whole and sorted(got.values()) == list(range(3000))
    assert sum(n >= 3000 for n in rows) == 1


def test_hot_cells_are_split(spark, monkeypatch):
    """All boxes on one page, most in one cell: split, no task takes more than three times the rows of the median one."""
    monkeypatch.setattr(reg, "CELL_ROWS", 200)
    rng = random.Random(6)
    box = lambda x, y, w, h: (int(x * 4096), int(y * 4096), int((x + w) * 4096), int((y + h) * 4096))
    items = [("d", 1, "m", *box(rng.uniform(100, 120), rng.uniform(100, 120), 1, 1), i) for i in range(6000)]
    areas = [("d", 1, "m", *box(rng.uniform(90, 110), rng.uniform(90, 110), 25, 25), f"r{i}") for i in range(12)]
    boxes = "doc string, page int, method string, left bigint, top bigint, right bigint, bottom bigint"
    items_df, areas_df = spark.createDataFrame(items, boxes + ", item_id int"), spark.createDataFrame(areas, boxes + ", region_id string")
    got = {(r.item_id, r.region_id) for r in reg.items_in_regions(items_df, areas_df).collect()}
    want = {(i[7], a[7]) for i in items for a in areas if i[3] >= a[3] and i[4] >= a[4] and i[5] <= a[5] and i[6] <= a[6]}
    assert got == want
    corner = items_df.withColumn("grid", F.lit(2)).withColumn("cx", F.lit(0).cast("bigint")).withColumn("cy", F.lit(0).cast("bigint"))
    rows, others, keys = reg._in_occupied(corner, corner.limit(3))
    sizes = sorted(r["count"] for r in rows.groupBy(*keys).count().collect())
    assert len(sizes) == 30 and sizes[-1] <= 3 * sizes[len(sizes) // 2] and others.count() == 90
    few = reg._in_occupied(corner, corner.limit(3).withColumn("cx", F.lit(7).cast("bigint")))[0]
    assert few.count() == 0  # nothing goes where no region is


def test_a_region_is_written_once(spark, monkeypatch):
    """Rounds write what they settle: regions and pairs once each."""
    written = []

    def spy(df):
        done = cut_lineage(df)
        written.append(done.count())
        return done

    boxes = [("d", 1, "m", 4096 * 10 * i, 0, 4096 * (10 * i + 15), 4096, f"r{i}") for i in range(300)]
    df = spark.createDataFrame(boxes, "doc string, page int, method string, left bigint, top bigint, right bigint, bottom bigint, region_id string")
    monkeypatch.setattr(reg, "cut_lineage", spy)
    got = {r.region_id: r.batch for r in reg.non_overlapping_batches(df).collect()}
    assert len(got) == 300 and all(got[f"r{i}"] != got[f"r{i + 1}"] for i in range(299))
    assert sum(written) == 300 + 299


def _broadcast_on(df, key):
    """Joins of a plan that send a side whole to all tasks, on `key`."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [line for line in plan.splitlines() if "BroadcastHashJoin" in line and f"{key}#" in line]


def test_sides_of_joins_are_not_sent_whole(spark, monkeypatch):
    """Boxes look small to the planner before they are exploded; neither they nor pairs nor settled regions go through the driver."""
    regions = frame(spark, boxes(5, 60, [20, 150, 900]), "region_id")
    assert not _broadcast_on(reg.overlapping(regions), "cx")
    assert not _broadcast_on(reg.items_in_regions(frame(spark, boxes(6, 60, [5]), "item_id"), regions), "cx")
    seen = []

    def spy(df):
        seen.extend(_broadcast_on(df, "region_id") + _broadcast_on(df, "earlier") + _broadcast_on(df, "cx"))
        return cut_lineage(df)

    monkeypatch.setattr(reg, "cut_lineage", spy)
    assert reg.non_overlapping_batches(regions).count() == 60 and not seen


def test_tasks_of_joins_take_bounded_rows(spark, monkeypatch):
    """However well rows compress, a task of a join over cells takes some TASK_ROWS, and on pages of few regions an item is one row."""
    monkeypatch.setattr(reg, "TASK_ROWS", 500, raising=False)
    sizes = []
    real = reg._in_occupied

    def spy(rows, others):
        found = real(rows, others)
        sizes.extend(r["count"] for r in found[0].groupBy(F.spark_partition_id()).count().collect())
        return found

    monkeypatch.setattr(reg, "_in_occupied", spy)
    items = spark.range(6000).selectExpr(
        "cast(id as int) item_id", "'d' doc", "cast(id % 300 as int) page", "'m' method", "id * 4096 % 999424 left", "id * 4096 % 999424 top",
        "id * 4096 % 999424 + 4096 right", "id * 4096 % 999424 + 4096 bottom",
    )
    areas = [(i, "d", i, "m", 0, 0, 2000 * 4096, 2000 * 4096) for i in range(300)]
    assert reg.items_in_regions(items, frame(spark, areas, "region_id")).count() == 6000
    assert sum(sizes) == 6000 and max(sizes) <= 3 * 500


def test_crowded_and_other_pages(spark, monkeypatch):
    """Pages of many regions go over cells, others are one cell; the pairs are the same."""
    areas, items = boxes(21, 90, [20, 150, 900, 30000]), boxes(22, 200, [1, 5, 60])
    areas += [(500 + n, *areas[n][1:]) for n in range(10)]
    for most in (0, 40, 1000):
        monkeypatch.setattr(reg, "PAGE_REGIONS", most, raising=False)
        got = reg.items_in_regions(frame(spark, items, "item_id"), frame(spark, areas, "region_id")).collect()
        assert sorted((r.item_id, r.region_id) for r in got) == sorted((i[0], r[0]) for i in items for r in areas if inside(i, r))
        right = [r for r in areas if r[4] <= r[6] and r[5] <= r[7]]
        pairs = sorted((r.region_a, r.region_b) for r in reg.overlapping(frame(spark, areas, "region_id")).collect())
        assert pairs == sorted((a[0], b[0]) for a in right for b in right if a[0] < b[0] and overlap(a, b))


def test_cells_are_counted_no_further_than_needed(spark, monkeypatch):
    """On pages of few boxes only the pages are counted, and each box is looked up in one cell."""
    rows = []
    real = reg.written

    def spy(df):
        done = real(df)
        rows.append(done.count())
        return done

    monkeypatch.setattr(reg, "written", spy)
    items = spark.range(1800).selectExpr(
        "cast(id as int) item_id", "'d' doc", "cast(id % 60 as int) page", "'m' method", "id * 7919 % 1999999 left", "id * 104729 % 1999999 top",
        "id * 7919 % 1999999 + 4096 right", "id * 104729 % 1999999 + 4096 bottom",
    )
    areas = frame(spark, [(i, "d", i, "m", 0, 0, 300 * 4096, 300 * 4096) for i in range(60)], "region_id")
    got = {r.region_id: r.tables for r in reg.count_in_regions(items, areas).collect()}
    want = {r.region_id: r["count"] for r in reg.items_in_regions(items, areas).groupBy("region_id").count().collect()}
    assert got == {i: want.get(i, 0) for i in range(60)} and sum(got.values()) > 300
    assert sum(rows) < 2 * 1800
