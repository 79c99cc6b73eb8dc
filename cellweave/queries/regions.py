"""Boxes made from orders (items) and parts (regions), about as many per page at any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import regions as reg
from cellweave.queries import Query
from cellweave.queries.inputs import load
from cellweave.sources.csvtables import read_portions

ITEM_BOX = """o_orderkey AS item_id, 'd' AS doc, o_custkey // 30 AS page, 'stream' AS method,
    CAST(floor(o_totalprice) AS BIGINT) % 500 + 0.3 AS x1, o_orderkey * 7 % 700 + 0.0 AS y1,
    CAST(floor(o_totalprice) AS BIGINT) % 500 + 0.3 + o_orderkey % 13 AS x2, o_orderkey * 7 % 700 + 1.7 + o_custkey % 11 AS y2"""

REGION_BOX = """p_partkey AS region_id, 'd' AS doc, p_partkey // 40 AS page, 'stream' AS method,
    p_size * 9 - 20.5 AS x1, p_partkey * 37 % 600 + 0.1 AS y1,
    p_size * 9 + p_partkey * 13 % 280 + CASE WHEN p_partkey % 50 = 0 THEN 3000 ELSE 0 END AS x2,
    p_partkey * 37 % 600 + 30.0 + p_partkey * 7 % 200 AS y2"""

QUANTISED = "SELECT *, " + ", ".join(
    f"CAST(round({c} * 4096) AS BIGINT) AS {name}" for c, name in [("x1", "lft"), ("y1", "tp"), ("x2", "rgt"), ("y2", "btm")]
)
ITEMS_SQL = f"items AS ({QUANTISED} FROM (SELECT {ITEM_BOX} FROM orders))"
REGIONS_SQL = f"regions AS ({QUANTISED} FROM (SELECT {REGION_BOX} FROM part))"
INSIDE = "i.page = r.page AND i.lft >= r.lft AND i.rgt <= r.rgt AND i.tp >= r.tp AND i.btm <= r.btm"
OVERLAP = "a.page = b.page AND a.lft <= b.rgt AND b.lft <= a.rgt AND a.tp <= b.btm AND b.tp <= a.btm"


def _boxes(df, box: str):
    df = df.selectExpr(*_split_columns(box.replace("//", "div").replace("0.3", "0.3D")))
    sides = {"left": "x1", "top": "y1", "right": "x2", "bottom": "y2"}
    return df.withColumns({side: reg.quantise(F.col(c).cast("double")) for side, c in sides.items()})


def _split_columns(text: str) -> list[str]:
    """Split a select list at commas outside brackets."""
    parts, depth = [""], 0
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += ch
    return parts


def items(spark, d):
    return _boxes(load(spark, d, "orders"), ITEM_BOX)


def regions(spark, d):
    return _boxes(load(spark, d, "part"), REGION_BOX)


BOX = ["doc", "page", "method", "left", "top", "right", "bottom"]


def contained(spark, d):
    found = reg.items_in_regions(items(spark, d).select("item_id", *BOX), regions(spark, d).select("region_id", *BOX))
    return found.select("region_id", "item_id")


def overlaps(spark, d):
    return reg.overlapping(regions(spark, d).select("region_id", *BOX)).select("region_a", "region_b")


def cardinality(spark, d):
    areas = regions(spark, d).select("region_id", *BOX)
    return reg.match_outcomes(areas, reg.count_in_regions(items(spark, d).select("item_id", *BOX), areas))


def batch_sizes(spark, d):
    return reg.batch_sizes(regions(spark, d))


def batches(spark, d):
    return reg.non_overlapping_batches(regions(spark, d).select("region_id", *BOX))


def sizes(spark, d):
    return reg.with_size(items(spark, d)).select("item_id", "left", "top", "width", "height", "valid")


def _placed_regions(spark, d, per_group: int):
    return regions(spark, d).selectExpr(f"region_id div {per_group} AS grp", "page", "x1 AS x", "y1 AS y", "region_id")


def reading_order(spark, d):
    return reg.reading_order(_placed_regions(spark, d, 400), "grp").select("grp", "region_id", "line", "position")


def two_columns(spark, d):
    return reg.two_column_order(_placed_regions(spark, d, 60), "grp")[0].select("grp", "region_id", "position")


def two_columns_errors(spark, d):
    return reg.two_column_order(_placed_regions(spark, d, 60), "grp")[1]


def _portion_inputs(spark, d):
    """Order boxes with recogniser JSON of one row of two cells, and regions naming tables."""
    data = "concat('[[{\"text\":\"', item_id, '\"},{\"text\":\"p', page, '\"}],[{\"text\":\"\"}]]')"
    boxes = items(spark, d).withColumn("data", F.expr(data))
    named = regions(spark, d).withColumns(
        {"table_id": F.concat(F.lit("t"), F.expr("region_id div 4")), "part_ix": F.expr("cast(region_id % 4 as int)")}
    )
    return boxes, named


def portions(spark, d):
    found, _ = read_portions(*_portion_inputs(spark, d))
    return found.select("table_id", "part_ix", "page", "row_ix", F.array_join("cells", "|").alias("line"))


def portion_errors(spark, d):
    return read_portions(*_portion_inputs(spark, d))[1]


COUNTS_SQL = f"""counts AS (SELECT r.region_id, count(i.item_id) AS tables, min(i.item_id) AS item_id, any_value(r.page) AS page
    FROM regions r LEFT JOIN items i ON {INSIDE} GROUP BY r.region_id)"""
OUTCOME = """CASE tables WHEN 0 THEN 'no table in region' WHEN 1 THEN 'ok'
    ELSE 'multiple (' || tables || ') tables in region' END"""

QUERIES = {
    "p1_items_in_regions": Query(
        contained, f"WITH {ITEMS_SQL}, {REGIONS_SQL} SELECT r.region_id, i.item_id FROM regions r JOIN items i ON {INSIDE}"
    ),
    "p2_overlapping_regions": Query(
        overlaps,
        f"""WITH {REGIONS_SQL} SELECT a.region_id AS region_a, b.region_id AS region_b
FROM regions a JOIN regions b ON {OVERLAP} AND a.region_id < b.region_id""",
    ),
    "p3_match_cardinality": Query(
        cardinality, f"WITH {ITEMS_SQL}, {REGIONS_SQL}, {COUNTS_SQL} SELECT region_id, tables, {OUTCOME} AS outcome FROM counts"
    ),
    "p4_batches_by_page": Query(
        batch_sizes, f"WITH {REGIONS_SQL} SELECT doc, page, method, count(*) AS regions FROM regions GROUP BY doc, page, method"
    ),
    "p5_non_overlapping_batches": Query(
        batches,
        f"""WITH RECURSIVE {REGIONS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY md5(CAST(region_id AS VARCHAR)), region_id) AS r FROM regions),
walk AS (
    SELECT *, CAST(0 AS BIGINT) AS batch,
           [{{'batch': CAST(0 AS BIGINT), 'lft': lft, 'tp': tp, 'rgt': rgt, 'btm': btm}}] AS placed
    FROM ranked WHERE r = 1
    UNION ALL
    SELECT * REPLACE (list_append(placed, {{'batch': batch, 'lft': lft, 'tp': tp, 'rgt': rgt, 'btm': btm}}) AS placed) FROM (
        SELECT b.*, list_min(list_filter(range(len(a.placed) + 1), lambda k: NOT list_contains(list_transform(list_filter(a.placed,
               lambda p: p.lft <= b.rgt AND b.lft <= p.rgt AND p.tp <= b.btm AND b.tp <= p.btm), lambda p: p.batch), k))) AS batch, a.placed
        FROM walk a JOIN ranked b ON b.page = a.page AND b.r = a.r + 1))
SELECT region_id, batch FROM walk""",
    ),
    "p6_quantised_boxes": Query(
        sizes,
        f"""WITH {ITEMS_SQL} SELECT item_id, lft AS left, tp AS top, rgt - lft AS width, btm - tp AS height,
       lft <= rgt AND tp <= btm AS valid FROM items""",
    ),
    "p7_reading_order": Query(
        reading_order,
        f"""WITH {REGIONS_SQL}, placed AS (SELECT region_id // 400 AS grp, page, x1 AS x, y1 AS y, region_id FROM regions),
gaps AS (SELECT *, lag(page) OVER w IS DISTINCT FROM page OR y - lag(y) OVER w >= 50 AS new_line FROM placed
         WINDOW w AS (PARTITION BY grp ORDER BY page, y, x, region_id)),
lines AS (SELECT *, CAST(sum(CASE WHEN new_line THEN 1 ELSE 0 END) OVER w AS BIGINT) AS line FROM gaps
          WINDOW w AS (PARTITION BY grp ORDER BY page, y, x, region_id))
SELECT grp, region_id, line, row_number() OVER (PARTITION BY grp ORDER BY line, x, y, region_id) - 1 AS position FROM lines""",
    ),
    "p8_two_column_order": Query(
        two_columns,
        f"""WITH {REGIONS_SQL}, placed AS (SELECT region_id // 60 AS grp, page, x1 AS x, y1 AS y, region_id FROM regions)
SELECT grp, region_id, row_number() OVER (PARTITION BY grp ORDER BY x >= 200, y, region_id) - 1 AS position FROM placed
WHERE grp IN (SELECT grp FROM placed GROUP BY grp HAVING count(DISTINCT page) = 1)""",
    ),
    "p8_two_column_errors": Query(
        two_columns_errors,
        f"""WITH {REGIONS_SQL} SELECT region_id // 60 AS grp, count(DISTINCT page) AS pages FROM regions GROUP BY grp
HAVING count(DISTINCT page) > 1""",
    ),
    "s9_portions_in_regions": Query(
        portions,
        f"""WITH {ITEMS_SQL}, {REGIONS_SQL}, {COUNTS_SQL}
SELECT 't' || (region_id // 4) AS table_id, region_id % 4 AS part_ix, page, CAST(n.i AS BIGINT) AS row_ix,
       CASE n.i WHEN 0 THEN item_id || '|p' || page ELSE '' END AS line
FROM counts, (VALUES (0), (1)) n(i) WHERE tables = 1""",
    ),
    "s9_portion_errors": Query(
        portion_errors,
        f"""WITH {ITEMS_SQL}, {REGIONS_SQL}, {COUNTS_SQL}
SELECT 't' || (region_id // 4) AS table_id, {OUTCOME} AS error FROM counts WHERE tables <> 1""",
    ),
}
