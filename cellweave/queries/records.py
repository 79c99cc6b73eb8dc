"""Typed records from strings made of suppliers, parts, orders, nations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import codes, text
from cellweave.operators.reshape import prepend_row
from cellweave.plans import records
from cellweave.queries import Query
from cellweave.queries.inputs import load, rows
from cellweave.queries.trade import GOODS_SQL, goods_rows
from cellweave.tables import layout_of, renumber

DIGITS_SQL = f"'{codes.DIGITS}'"

# Profiles with an unknown starport, a bad digit or a missing digit now and then.
PROFILE = """concat(substring('ABCDEXQ', c_custkey % 7 + 1, 1), c_custkey % 10, substring('0AHJNPZI', c_nationkey % 8 + 1, 1),
    c_custkey % 9, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE '7' END, 'B', c_nationkey % 10, '-', c_nationkey % 6)"""


def parse_profiles(spark, d):
    df = load(spark, d, "customer").selectExpr("c_custkey", f"{PROFILE} AS text")
    profile = codes.parse_profile(F.col("text"))
    number = lambda n: profile[n].cast("bigint").alias(n)
    return df.select(
        "c_custkey", profile["starport"].alias("starport"), *[number(n) for n in codes.PROFILE_NUMBERS],
        codes.format_profile(profile).alias("shown"),
    )


def profile_errors(spark, d):
    df = load(spark, d, "customer").selectExpr("c_custkey", f"{PROFILE} AS text", "lpad(cast(c_custkey as string), 3 + c_nationkey % 2, '0') AS loc")
    parsed = df.withColumn("uwp", codes.parse_profile(F.col("text"))).withColumn("location", codes.parse_location(F.col("loc")))
    _, bad = records.bad_records(parsed, ["uwp", "location"])
    return bad.select("c_custkey", F.array_join("bad", ";").alias("bad"))


def parse_locations(spark, d):
    df = load(spark, d, "customer").selectExpr("c_custkey", "lpad(cast(c_custkey % 10000 as string), 3 + c_nationkey % 2, '0') AS loc")
    location = codes.parse_location(F.col("loc"))
    return df.select(
        "c_custkey", location["x"].cast("bigint").alias("x"), location["y"].cast("bigint").alias("y"),
        codes.format_location(location).alias("shown"),
    )


def digits(spark, d):
    """Every character of the segments."""
    df = load(spark, d, "customer").selectExpr(
        "c_custkey", "explode(sequence(1, length(c_mktsegment))) AS place", "substring(c_mktsegment, place, 1) AS c"
    )
    value = codes.parse_digit(F.col("c"))
    return df.select("c_custkey", F.col("place").cast("bigint").alias("place"), value.cast("bigint").alias("value"), codes.format_digit(value).alias("shown"))


def trade_goods(spark, d):
    return records.trade_goods(goods_rows(spark, d)).select(
        "d66", "name", "description", F.col("properties.tons").alias("tons"),
        F.col("properties.base_price").alias("base_price"),
        F.array_join(F.array_sort("properties.availability"), ";").alias("availability"),
        F.col("properties.examples").alias("examples"),
    )


def trade_modifiers(spark, d):
    df = records.trade_goods(goods_rows(spark, d)).filter("properties is not null")
    return df.select("d66", F.explode("properties.purchase_dm").alias("class", "dm")).withColumn("dm", F.col("dm").cast("bigint"))


def _criteria_rows(spark, d):
    """Criteria per brand from the sizes and prices of its parts."""
    brands = load(spark, d, "part").groupBy("p_brand").agg(
        F.count("*").alias("n"), F.max("p_size").alias("hi"), F.countDistinct("p_name").alias("names")
    ).selectExpr("*", "cast(substring(p_brand, 7) as int) AS b")
    return brands.selectExpr(
        "concat('Class ', b % 7) AS Classification", "p_brand AS Code",
        "concat(b % 8, '-', b % 8 + 2, ', 9+') AS `Planet Size`",
        "CASE b % 4 WHEN 0 THEN '' WHEN 1 THEN '9+' WHEN 2 THEN '1–10' ELSE '10' END AS Atmosphere",
        "'' AS Hydro", "concat(b % 9, '-') AS Population",
        "CASE b % 3 WHEN 0 THEN '11' ELSE '0-12 , 14' END AS Government",
        "concat(b % 10, '+') AS `Law Level`", "concat('0-', names % 4) AS `Tech Level`",
    )


CRITERIA_SQL = """brands AS (
    SELECT p_brand, CAST(substr(p_brand, 7) AS INT) AS b, count(DISTINCT p_name) AS names FROM part GROUP BY p_brand)"""


def trade_codes(spark, d):
    parsed = records.trade_codes(_criteria_rows(spark, d))
    shown = lambda c: codes.format_range_set(F.col(c)).alias(c)
    return parsed.select("classification", "code", *[shown(c) for c in records.CRITERIA_COLUMNS.values()])


def range_bounds(spark, d):
    parsed = records.trade_codes(_criteria_rows(spark, d))
    return parsed.select("code", F.posexplode("planet_sizes").alias("pos", "r")).selectExpr(
        "code", "cast(pos as bigint) AS pos", "cast(r.lo as bigint) AS lo", "cast(r.hi as bigint) AS hi"
    )


LAW_ROWS = {
    "level": "CASE WHEN event_id % 7 = 0 THEN concat(event_id % 10, '+') ELSE cast(event_id % 10 as string) END",
    "weapons": "CASE event_type WHEN 'click' THEN '' ELSE concat('w', event_id) END",
    "armour": "CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN '' ELSE concat('a', event_id) END",
}


def law_levels(spark, d):
    """Law level tables per user; error events are description rows, which lack the last cell."""
    level, weapons, armour = (F.expr(e) for e in LAW_ROWS.values())
    cells = F.when(F.col("event_type") == "error", F.array(level, weapons)).otherwise(F.array(level, weapons, armour))
    df = rows(load(spark, d, "events"), F.col("user_id"), F.col("event_id"), cells)
    layout = layout_of(df)
    titled = renumber(prepend_row(records.LAW_COLUMNS)(df, layout), layout)
    keyed = records.by_header(titled, records.LAW_COLUMNS)
    return records.law_levels(keyed, layout)


def governments(spark, d):
    df = load(spark, d, "nation").selectExpr(
        "cast(n_nationkey as string) AS Government", "n_name AS `Government Type`", "concat('region ', n_regionkey) AS Description",
        "'' AS Examples", "concat(' a  b,', n_name, ', ', n_name, ',x', n_regionkey) AS `Example Contraband`",
    )
    return records.governments(df).select(
        "code", "name", "description", "examples", F.array_join("example_contraband", ";").alias("contraband")
    )


def range_membership(spark, d):
    ranges = load(spark, d, "part").selectExpr("p_partkey", "concat(p_size, '-', p_size + 3, ',', 48, '+ , ', 2, '-') AS s")
    parsed = ranges.withColumn("r", codes.parse_range_set(F.col("s")))
    line = load(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("int").alias("q"))
    return line.join(parsed, "p_partkey").filter(codes.in_ranges(F.col("q"), F.col("r"))).groupBy("p_partkey").agg(
        F.count("*").alias("n")
    ).join(parsed, "p_partkey").select("p_partkey", "n", codes.format_range_set(F.col("r")).alias("shown"))


def classify_worlds(spark, d):
    customer = load(spark, d, "customer").selectExpr("c_custkey", f"{PROFILE} AS text")
    worlds = customer.select("c_custkey", codes.parse_profile(F.col("text")).alias("uwp"))
    return records.classify_worlds(worlds, records.trade_codes(_criteria_rows(spark, d)), "c_custkey")


def converter_registry(spark, d):
    return records.CONVERTERS["trade", "trade-goods"](goods_rows(spark, d)).select(
        "d66", F.col("properties").isNotNull().alias("has_properties")
    )


def optional_fields(spark, d):
    events = load(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    raw = F.when(F.col("event_type") == "click", "").otherwise(F.concat(F.col("k"), F.when(F.expr("event_id % 13 = 0"), "x").otherwise("")))
    return events.select("event_id", text.blank_to_null(raw).alias("raw"), text.parse_int(raw).alias("k"))


def parse_booleans(spark, d):
    df = load(spark, d, "events").selectExpr(
        "event_id", "CASE event_type WHEN 'click' THEN 'True' WHEN 'view' THEN 'FALSE' WHEN 'error' THEN 'yes' ELSE '' END AS t"
    )
    return df.select("event_id", text.parse_bool(F.col("t")).alias("flag"))


def parse_credit_amounts(spark, d):
    df = load(spark, d, "orders").selectExpr(
        "o_orderkey",
        "concat(CASE o_orderstatus WHEN 'F' THEN 'Cr' WHEN 'O' THEN 'MCr' ELSE 'KCr' END, cast(floor(o_totalprice) as bigint)) AS t",
    )
    return df.select("o_orderkey", text.parse_credits(F.col("t")).alias("credits"))


_DIGIT = lambda at: f"strpos({DIGITS_SQL}, substr(packed, {at}, 1)) - 1"
PROFILES_SQL = f"""profiles AS (
    SELECT c_custkey, packed, length(packed) = 8 AND regexp_full_match(packed, '[ABCDEX][{codes.DIGITS}]{{7}}') AS ok
    FROM (SELECT c_custkey, replace({PROFILE.replace("substring", "substr")}, '-', '') AS packed FROM customer)),
parsed AS (SELECT c_custkey, packed, substr(packed, 1, 1) AS starport, """ + ", ".join(
    f"CAST({_DIGIT(i + 2)} AS BIGINT) AS {n}" for i, n in enumerate(codes.PROFILE_NUMBERS)
) + " FROM profiles WHERE ok)"

QUERIES = {
    "n1_parse_profile": Query(
        parse_profiles,
        f"""WITH {PROFILES_SQL} SELECT c_custkey, starport, {", ".join(codes.PROFILE_NUMBERS)}, packed AS shown
FROM customer LEFT JOIN parsed USING (c_custkey)""",
    ),
    "n1_parse_location": Query(
        parse_locations,
        """SELECT c_custkey, CASE WHEN length(loc) = 4 THEN CAST(substr(loc, 1, 2) AS BIGINT) END AS x,
       CASE WHEN length(loc) = 4 THEN CAST(substr(loc, 3) AS BIGINT) END AS y, CASE WHEN length(loc) = 4 THEN loc END AS shown
FROM (SELECT c_custkey, lpad(CAST(c_custkey % 10000 AS VARCHAR), 3 + c_nationkey % 2, '0') AS loc FROM customer)""",
    ),
    "n1_parse_digit": Query(
        digits,
        f"""SELECT c_custkey, place, CAST(v AS BIGINT) AS value, CASE WHEN v IS NOT NULL THEN c END AS shown FROM (
    SELECT c_custkey, place, c, CASE WHEN c <> '' AND strpos({DIGITS_SQL}, c) > 0 THEN strpos({DIGITS_SQL}, c) - 1 END AS v
    FROM (SELECT c_custkey, place, substr(c_mktsegment, place, 1) AS c
          FROM (SELECT *, unnest(range(1, length(c_mktsegment) + 1)) AS place FROM customer)))""",
    ),
    "n1_profile_errors": Query(
        profile_errors,
        f"""WITH {PROFILES_SQL}
SELECT c_custkey, concat_ws(';', CASE WHEN NOT ok THEN 'uwp' END, CASE WHEN NOT loc_ok THEN 'location' END) AS bad
FROM (SELECT c_custkey, ok, length(lpad(CAST(c_custkey AS VARCHAR), 3 + c_nationkey % 2, '0')) = 4 AS loc_ok
      FROM profiles JOIN customer USING (c_custkey)) WHERE NOT ok OR NOT loc_ok""",
    ),
    "n3_trade_goods": Query(
        trade_goods,
        f"""WITH {GOODS_SQL}
SELECT d66, name, CASE WHEN NOT has_properties THEN CASE WHEN b % 8 = 0 THEN 'All' ELSE 'Class ' || (b % 7) || ' ,  Class ' || (hi % 7) END END AS description,
       CASE WHEN has_properties THEN tons END AS tons, CASE WHEN has_properties THEN CAST(base_price AS BIGINT) END AS base_price,
       CASE WHEN has_properties THEN array_to_string(list_sort(list_distinct(availability)), ';') END AS availability,
       CASE WHEN has_properties THEN p_brand || ' things' END AS examples FROM goods""",
    ),
    "n3_trade_modifiers": Query(
        trade_modifiers,
        f"WITH {GOODS_SQL} SELECT d66, class, CAST(dm AS BIGINT) AS dm FROM purchase JOIN goods USING (d66) WHERE has_properties",
    ),
    "n3_parse_credits": Query(
        parse_credit_amounts,
        """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CAST(floor(o_totalprice) AS BIGINT)
       WHEN 'O' THEN CAST(floor(o_totalprice) AS BIGINT) * 1000000 END AS credits FROM orders""",
    ),
    "n4_trade_codes": Query(
        trade_codes,
        f"""WITH {CRITERIA_SQL}
SELECT 'Class ' || (b % 7) AS classification, p_brand AS code, (b % 8) || '-' || (b % 8 + 2) || ', 9+' AS planet_sizes,
       CASE b % 4 WHEN 0 THEN '' WHEN 1 THEN '9+' WHEN 2 THEN '1-10' ELSE '10' END AS atmospheres, '' AS hydro,
       (b % 9) || '-' AS population, CASE b % 3 WHEN 0 THEN '11' ELSE '0-12, 14' END AS government,
       (b % 10) || '+' AS law_level, CASE names % 4 WHEN 0 THEN '0' ELSE '0-' || (names % 4) END AS tech_level FROM brands""",
    ),
    "n4_range_bounds": Query(
        range_bounds,
        f"""WITH {CRITERIA_SQL}
SELECT p_brand AS code, CAST(p.i AS BIGINT) AS pos, CAST(CASE p.i WHEN 0 THEN b % 8 ELSE 9 END AS BIGINT) AS lo,
       CAST(CASE p.i WHEN 0 THEN b % 8 + 2 END AS BIGINT) AS hi FROM brands, (VALUES (0), (1)) p(i)""",
    ),
    "n5_law_levels": Query(
        law_levels,
        """WITH law AS (
    SELECT CAST(user_id AS VARCHAR) AS table_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS row_ix,
           event_id % 10 AS level, event_id % 7 = 0 AS open, event_type = 'error' AS described,
           CASE event_type WHEN 'click' THEN '' ELSE 'w' || event_id END AS weapons,
           CASE WHEN event_type IN ('click', 'view') THEN '' ELSE 'a' || event_id END AS armour FROM events),
marked AS (SELECT *, sum(CASE WHEN described THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY row_ix) AS stretch FROM law)
SELECT table_id, row_ix, level AS min_level, CASE WHEN NOT open THEN level END AS max_level,
       CASE WHEN described THEN weapons END AS description,
       last_value(CASE WHEN NOT described THEN nullif(weapons, '') END IGNORE NULLS) OVER w AS weapons_banned,
       last_value(CASE WHEN NOT described THEN nullif(armour, '') END IGNORE NULLS) OVER w AS armour_banned
FROM marked WINDOW w AS (PARTITION BY table_id, stretch ORDER BY row_ix ROWS UNBOUNDED PRECEDING)""",
    ),
    "n6_governments": Query(
        governments,
        """SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name, 'region ' || n_regionkey AS description, '' AS examples,
       'a b;' || n_name || ';x' || n_regionkey AS contraband FROM nation""",
    ),
    "n7_range_membership": Query(
        range_membership,
        """SELECT p_partkey, count(*) AS n, any_value(p_size || '-' || (p_size + 3) || ', 48+, 2-') AS shown
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_quantity BETWEEN p_size AND p_size + 3 OR l_quantity >= 48 OR l_quantity <= 2 GROUP BY p_partkey""",
    ),
    "n8_classify_worlds": Query(
        classify_worlds,
        f"""WITH {PROFILES_SQL}, {CRITERIA_SQL}
SELECT c_custkey, p_brand AS code FROM parsed JOIN brands
  ON (size BETWEEN b % 8 AND b % 8 + 2 OR size >= 9)
 AND CASE b % 4 WHEN 0 THEN true WHEN 1 THEN atmosphere >= 9 WHEN 2 THEN atmosphere BETWEEN 1 AND 10 ELSE atmosphere = 10 END
 AND population <= b % 9 AND CASE b % 3 WHEN 0 THEN government = 11 ELSE government BETWEEN 0 AND 12 OR government = 14 END
 AND law_level >= b % 10 AND tech_level BETWEEN 0 AND names % 4""",
    ),
    "n9_converter_registry": Query(converter_registry, f"WITH {GOODS_SQL} SELECT d66, has_properties FROM goods"),
    "n10_optional_fields": Query(
        optional_fields,
        """SELECT event_id, nullif(raw, '') AS raw, TRY_CAST(nullif(raw, '') AS BIGINT) AS k FROM (
    SELECT event_id, CASE WHEN event_type = 'click' THEN '' ELSE (props->>'k') || CASE WHEN event_id % 13 = 0 THEN 'x' ELSE '' END END AS raw
    FROM events)""",
    ),
    "n11_parse_bool": Query(
        parse_booleans,
        "SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS flag FROM events",
    ),
}
