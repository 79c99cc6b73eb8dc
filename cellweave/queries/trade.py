"""The trade table over suppliers (worlds) and kinds of parts (goods).

Goods are the pairs of brand and type of `part`, some 150 at any size; worlds
are suppliers with the classes of the brands they sold much of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.plans import records, trade
from cellweave.queries import Query
from cellweave.queries.catalog import SUPPLIER_BRANDS, brand_codes, supplier_brands
from cellweave.queries.inputs import load
from cellweave.tables import Layout, in_order

FORMATS = trade.Formats(common="*{}*", unavailable="({})", illegal="!{}", legal="{}")


def goods_rows(spark, d) -> DataFrame:
    """Goods as string columns, the way a table reader gives them."""
    kinds = (
        load(spark, d, "part")
        .groupBy("p_brand", "p_type")
        .agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.min("p_retailprice").alias("low_price"))
        .selectExpr("*", "cast(substring(p_brand, 7) as int) AS b", "cast(floor(low_price * 10) as bigint) AS price")
    )
    return kinds.selectExpr(
        "concat(b, '-', left(p_type, 2)) AS D66",
        "concat(p_type, ', ', p_brand) AS Type",
        "CASE WHEN b % 8 = 0 THEN 'All' ELSE concat('Class ', b % 7, ' ,  Class ', hi % 7) END AS Availability",
        "concat(lo, 'D x ', hi) AS Tons",
        "CASE WHEN b % 11 = 5 THEN NULL WHEN b % 5 = 0 THEN concat('MCr', lo) ELSE concat('Cr', price) END AS `Base Price`",
        "concat('Class ', b % 7, ' +', lo % 9, ', Class ', (b + 3) % 7, ' -', hi % 9 + 1, ',Class ', (b + lo) % 7, ' +1') AS `Purchase DM`",
        "concat('Class ', (b + 1) % 7, ' +', hi % 6) AS `Sale DM`",
        "concat(p_brand, ' things') AS Examples",
        "b", "lo", "hi",
    )


GOODS_SQL = """kinds AS (
    SELECT p_brand, p_type, CAST(substr(p_brand, 7) AS INT) AS b, min(p_size) AS lo, max(p_size) AS hi,
           CAST(floor(min(p_retailprice) * 10) AS BIGINT) AS price FROM part GROUP BY p_brand, p_type),
goods AS (
    SELECT *, b || '-' || left(p_type, 2) AS d66, p_type || ', ' || p_brand AS name, b % 11 <> 5 AS has_properties,
           lo || 'D x ' || hi AS tons, CASE WHEN b % 5 = 0 THEN lo * 1000000 ELSE price END AS base_price,
           CASE WHEN b % 8 = 0 THEN ['All'] ELSE ['Class ' || (b % 7), 'Class ' || (hi % 7)] END AS availability FROM kinds),
purchase AS (
    SELECT d66, class, arg_max(dm, n) AS dm FROM (
        SELECT d66, 'Class ' || (b % 7) AS class, lo % 9 AS dm, 1 AS n FROM goods
        UNION ALL SELECT d66, 'Class ' || ((b + 3) % 7), -(hi % 9 + 1), 2 FROM goods
        UNION ALL SELECT d66, 'Class ' || ((b + lo) % 7), 1, 3 FROM goods) GROUP BY d66, class),
sale AS (SELECT d66, 'Class ' || ((b + 1) % 7) AS class, hi % 6 AS dm FROM goods)"""


def goods(spark, d) -> DataFrame:
    return records.trade_goods(goods_rows(spark, d))


def worlds_csv_rows(spark, d) -> DataFrame:
    """Worlds as string columns Location, Name, UWP, Trade Codes, plus the supplier key."""
    return supplier_brands(spark, d).select(
        "s_suppkey",
        F.expr("lpad(cast(s_suppkey % 10000 as string), 4, '0')").alias("Location"),
        F.col("s_name").alias("Name"),
        F.expr(
            "concat(substring('ABCDEX', s_nationkey % 6 + 1, 1), s_suppkey % 10, 'A', 5, s_nationkey % 9, 'B', s_nationkey % 10, '-', s_suppkey % 7)"
        ).alias("UWP"),
        F.array_join(F.array_sort("codes"), ":").alias("Trade Codes"),
    )


def world_records(spark, d) -> DataFrame:
    """World records, with the supplier key as `world_ix`."""
    named = worlds_csv_rows(spark, d)
    key = F.regexp_extract("name", r"#0*(\d+)\z", 1).cast("bigint")
    return records.worlds_from_csv(named).withColumn("world_ix", key)


def worlds(spark, d) -> DataFrame:
    return trade.world_views(world_records(spark, d), brand_codes(spark, d), ignore_unknown=True)


WORLDS_SQL = f"""{SUPPLIER_BRANDS},
worlds AS (SELECT s_suppkey AS world_ix, lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') AS location, s_nationkey % 10 AS law FROM supplier),
classes AS (SELECT DISTINCT s_suppkey AS world_ix, classification AS class FROM brands JOIN codes USING (code))"""


def illegality(spark, d) -> DataFrame:
    return goods_rows(spark, d).filter("b % 3 = 0").selectExpr("D66 AS d66", "cast(lo % 10 as bigint) AS illegal_level")


def overrides(spark, d) -> DataFrame:
    """One for each place and kind of good of which at least half of the sales were returned."""
    line = load(spark, d, "lineitem")
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    sold = (
        line.select("l_suppkey", "l_partkey", "l_linenumber", "l_returnflag")
        .join(part, "l_partkey")
        .selectExpr(
            "lpad(cast(l_suppkey % 10000 as string), 4, '0') AS location",
            "concat(cast(substring(p_brand, 7) as int), '-', left(p_type, 2)) AS d66",
            "l_linenumber",
            "CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS back",
        )
    )
    counted = sold.groupBy("location", "d66").agg(
        F.max("l_linenumber").alias("m"), F.count("*").alias("n"), F.sum("back").alias("back")
    )
    return counted.filter("back * 2 >= n").selectExpr(
        "location", "d66",
        "CASE m % 3 WHEN 0 THEN true WHEN 1 THEN false END AS available",
        "CASE WHEN m % 4 = 1 THEN cast(m as bigint) END AS purchase_dm",
        "CASE WHEN n > 1 THEN cast(-n as bigint) END AS sale_dm",
        "CASE m % 5 WHEN 0 THEN true WHEN 1 THEN false END AS illegal",
    )


OVERRIDES_SQL = """overrides AS (
    SELECT location, d66, CASE m % 3 WHEN 0 THEN true WHEN 1 THEN false END AS available,
           CASE WHEN m % 4 = 1 THEN m END AS purchase_dm, CASE WHEN n > 1 THEN -n END AS sale_dm,
           CASE m % 5 WHEN 0 THEN true WHEN 1 THEN false END AS illegal
    FROM (SELECT lpad(CAST(l_suppkey % 10000 AS VARCHAR), 4, '0') AS location,
                 CAST(substr(p_brand, 7) AS INT) || '-' || left(p_type, 2) AS d66, max(l_linenumber) AS m, count(*) AS n
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING 2 * count(*) FILTER (l_returnflag = 'A') >= count(*)))"""

PAIRS_SQL = f"""{GOODS_SQL}, {WORLDS_SQL}, {OVERRIDES_SQL},
best_purchase AS (SELECT d66, world_ix, max(dm) AS dm FROM purchase JOIN classes USING (class) GROUP BY d66, world_ix),
best_sale AS (SELECT d66, world_ix, max(dm) AS dm FROM sale JOIN classes USING (class) GROUP BY d66, world_ix),
meets AS (SELECT DISTINCT d66, world_ix FROM (SELECT d66, unnest(availability) AS class FROM goods) JOIN classes USING (class)),
pairs AS (
    SELECT g.d66, g.name, g.tons, g.base_price, w.world_ix, w.location, w.law, CASE WHEN g.b % 3 = 0 THEN g.lo % 10 END AS lim,
           coalesce(p.dm, 0) AS purchase_dm, coalesce(s.dm, 0) AS sale_dm, g.b % 8 = 0 AS common,
           coalesce(o.available, g.b % 8 = 0 OR m.d66 IS NOT NULL) AS available,
           coalesce(o.illegal, g.b % 3 = 0 AND w.law >= g.lo % 10) AS illegal, o.purchase_dm AS op, o.sale_dm AS os
    FROM goods g CROSS JOIN worlds w
    LEFT JOIN best_purchase p ON p.d66 = g.d66 AND p.world_ix = w.world_ix
    LEFT JOIN best_sale s ON s.d66 = g.d66 AND s.world_ix = w.world_ix
    LEFT JOIN meets m ON m.d66 = g.d66 AND m.world_ix = w.world_ix
    LEFT JOIN overrides o ON o.d66 = g.d66 AND o.location = w.location WHERE g.has_properties),
trades AS (
    SELECT d66, world_ix, location, common, available, illegal, CAST(coalesce(op, purchase_dm)
           - coalesce(os, CASE WHEN illegal AND lim IS NOT NULL THEN law - lim ELSE sale_dm END) AS BIGINT) AS dm FROM pairs),
shown AS (
    SELECT d66, world_ix, location, CASE WHEN illegal THEN '!' || s2 ELSE s2 END AS shown FROM (
        SELECT *, CASE WHEN NOT available THEN '(' || s1 || ')' ELSE s1 END AS s2 FROM (
            SELECT *, CASE WHEN common THEN '*' || s0 || '*' ELSE s0 END AS s1 FROM (
                SELECT *, CASE WHEN dm >= 0 THEN '+' ELSE '' END || dm AS s0 FROM trades))))"""


def trades(spark, d) -> DataFrame:
    return trade.calculate_trades(goods(spark, d), worlds(spark, d), illegality(spark, d), overrides(spark, d))


def goods_by_worlds(spark, d):
    traded = goods(spark, d).filter("properties is not null").select("d66")
    return trade.product(traded, load(spark, d, "supplier").selectExpr("s_suppkey AS world_ix"))


def best_modifiers(spark, d):
    pairs = trade.product(goods(spark, d).filter("properties is not null").select("d66", "properties"), worlds(spark, d))
    best = lambda c: trade.best_dm(F.col(f"properties.{c}"), F.col("classes")).cast("bigint").alias(c)
    return pairs.select("d66", "world_ix", best("purchase_dm"), best("sale_dm"))


def availability(spark, d):
    return trades(spark, d).select("d66", "world_ix", "common", "available")


def legality(spark, d):
    return trades(spark, d).select("d66", "world_ix", "illegal")


def trade_table(spark, d):
    return trades(spark, d)


def formatted(spark, d):
    return trades(spark, d).select("d66", "world_ix", trade.format_dm(FORMATS).alias("shown"))


def wide_table(spark, d):
    """All worlds: the wide table as cells."""
    return trade.by_world(goods(spark, d), trades(spark, d), FORMATS)


def rejected_records(spark, d):
    """Goods some of whose prices and modifiers were spoiled."""
    spoiled = goods_rows(spark, d).withColumns({
        "Base Price": F.when(F.expr("b % 5 = 1 AND `Base Price` IS NOT NULL"), F.lit("Cr 1,x")).otherwise(F.col("Base Price")),
        "Purchase DM": F.when(F.expr("hi % 4 = 0"), F.concat("Purchase DM", F.lit(", oops"))).otherwise(F.col("Purchase DM")),
    })
    return records.goods_faults(spoiled).select(F.col("D66").alias("d66"), F.array_join("bad", ";").alias("bad"))


def _numbered_goods(spark, d):
    listed = goods(spark, d).withColumn("book", F.lit(1))
    return in_order(listed, ("book",), [F.col("d66")], "good_ix").drop("book")


def csv_report(spark, d):
    report = trade.csv_report(_numbered_goods(spark, d), worlds(spark, d), trades(spark, d), FORMATS, layout=Layout())
    return report.withColumn("block", F.col("block").cast("bigint"))


def asciidoc_report(spark, d):
    report = trade.asciidoc_report(_numbered_goods(spark, d), worlds(spark, d), trades(spark, d), FORMATS, layout=Layout())
    return report.withColumn("block", F.col("block").cast("bigint"))


LISTED_SQL = f"""{PAIRS_SQL},
listed AS (SELECT *, row_number() OVER (ORDER BY d66) - 1 AS good_ix FROM goods),
quoted AS (SELECT d66, string_agg(shown, ',' ORDER BY world_ix) AS cells, string_agg('m|' || shown, chr(10) ORDER BY world_ix) AS adoc
           FROM shown GROUP BY d66),
titles AS (SELECT string_agg(location, ',' ORDER BY world_ix) AS csv, string_agg(location, ' |' ORDER BY world_ix) AS adoc,
                  count(*) AS n FROM worlds)"""

QUERIES = {
    "q1_goods_by_worlds": Query(
        goods_by_worlds,
        f"WITH {GOODS_SQL} SELECT d66, s_suppkey AS world_ix FROM goods, supplier WHERE has_properties",
    ),
    "q2_best_modifier": Query(best_modifiers, f"WITH {PAIRS_SQL} SELECT d66, world_ix, purchase_dm, sale_dm FROM pairs"),
    "q3_availability": Query(availability, f"WITH {PAIRS_SQL} SELECT d66, world_ix, common, available FROM pairs"),
    "q4_legality": Query(legality, f"WITH {PAIRS_SQL} SELECT d66, world_ix, illegal FROM pairs"),
    "q5_trade_table": Query(trade_table, f"WITH {PAIRS_SQL} SELECT * FROM trades"),
    "q5_rejected_records": Query(
        rejected_records,
        f"""WITH {GOODS_SQL}
SELECT d66, concat_ws(';', CASE WHEN b % 5 = 1 THEN 'Base Price' END, CASE WHEN hi % 4 = 0 THEN 'Purchase DM' END) AS bad
FROM goods WHERE has_properties AND (b % 5 = 1 OR hi % 4 = 0)""",
    ),
    "q6_formatted": Query(formatted, f"WITH {PAIRS_SQL} SELECT d66, world_ix, shown FROM shown"),
    "q7_wide_by_world": Query(
        wide_table,
        f"""WITH {PAIRS_SQL}
SELECT g.d66, g.name, CASE WHEN has_properties THEN g.tons END AS tons,
       CASE WHEN has_properties THEN CAST(g.base_price AS BIGINT) END AS base_price, s.world_ix, s.location, s.shown
FROM goods g LEFT JOIN shown s ON s.d66 = g.d66""",
    ),
    "k5_trade_csv": Query(
        csv_report,
        f"""WITH {LISTED_SQL}
SELECT CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS line_ix, 'D66,Goods,Tons,Base Price (cr),' || csv AS line FROM titles
UNION ALL SELECT 1, good_ix, d66 || ',"' || name || '",' ||
    CASE WHEN has_properties THEN tons || ',' || base_price || ',' || cells ELSE ',' END FROM listed LEFT JOIN quoted USING (d66)
UNION ALL SELECT * FROM (VALUES (2, 0, ''), (2, 1, 'Key:'), (2, 2, '*+2*,Commonly available goods.'),
    (2, 3, '(+2),Good unavailable for purchase.'), (2, 4, '+2,Legal by planetary law.'), (2, 5, '!+2,Illegal by planetary law.'),
    (3, 0, ''), (3, 1, '"Number is added when buying goods, and subtracted when selling goods."'),
    (3, 2, '"High numbers indicate excess of supply, low numbers indicate demand."'))""",
    ),
    "k6_trade_asciidoc": Query(
        asciidoc_report,
        f"""WITH {LISTED_SQL}
SELECT CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS line_ix, '= Trading DM Table' || chr(10) || chr(10) ||
    '[cols="1,4,2,3,' || n || '*1"]' || chr(10) || '|===' || chr(10) || '|D66 |Goods |Tons |Base Price (cr) |' || adoc AS line FROM titles
UNION ALL SELECT 1, good_ix, concat_ws(chr(10), '', '|' || d66, '|' || name,
    CASE WHEN has_properties THEN '|' || tons || chr(10) || '|' || base_price || chr(10) || quoted.adoc
         ELSE '2*|' || chr(10) || n || '*|' END) FROM listed LEFT JOIN quoted USING (d66), titles
UNION ALL SELECT * FROM (VALUES (2, 0, '|==='), (2, 1, ''), (2, 2, '== Key'), (2, 3, 'Commonly available goods.:: `*+2*`'),
    (2, 4, 'Good unavailable for purchase.:: `(+2)`'), (2, 5, 'Legal by planetary law.:: `+2`'),
    (2, 6, 'Illegal by planetary law.:: `!+2`'), (2, 7, ''), (2, 8, '== How to use'),
    (2, 9, '- Number is added when buying goods, and subtracted when selling goods.'),
    (2, 10, '- High numbers indicate excess of supply, low numbers indicate demand.'))""",
    ),
}
