"""The trade table: every good on every world, with availability, legality and price modifier.

Inputs:
    goods       (d66, name, properties: availability, tons, base_price, purchase_dm, sale_dm)
    worlds      (world_ix, location, classes ARRAY<STRING>, law_level)
    illegality  (d66, illegal_level)                      lowest law level that forbids a good
    overrides   (location, d66, available, purchase_dm, sale_dm, illegal)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import codes, text
from cellweave.operators.catalog import override, resolve_codes
from cellweave.tables import Layout, ordered_items

# Texts of the report.
DM_SENTENCES = [
    "Number is added when buying goods, and subtracted when selling goods.",
    "High numbers indicate excess of supply, low numbers indicate demand.",
]
KEY_TEXTS = {
    "common": "Commonly available goods.",
    "unavailable": "Good unavailable for purchase.",
    "legal": "Legal by planetary law.",
    "illegal": "Illegal by planetary law.",
}
FIXED_TITLES = ["D66", "Goods", "Tons", "Base Price (cr)"]
ADOC_FIXED_WIDTHS = ["1", "4", "2", "3"]


@dataclass(frozen=True)
class Formats:
    """Texts with a `{}` for the number, wrapped around it in this order."""

    common: str = "{}"
    unavailable: str = "{}"
    illegal: str = "{}"
    legal: str = "{}"

    def key(self, example: str) -> list[tuple[str, str]]:
        return [(getattr(self, n).replace("{}", example), t) for n, t in KEY_TEXTS.items()]


@dataclass(frozen=True)
class Blocks:
    """Both sides of the goods by worlds product are dealt into this many blocks.

    Worlds go into as many as there are shuffle partitions unless said otherwise.
    """

    goods: int = 4
    worlds: int | None = None


def world_views(worlds: DataFrame, trade_codes: DataFrame, ignore_unknown: bool = False) -> DataFrame:
    """`(world_ix, location, classes, law_level)`; an unknown trade code fails the run unless ignored.

    `worlds` has a `world_ix` besides the world record. Where a table of trade
    codes repeats a code, its last row counts.
    """
    classes = resolve_codes(
        worlds.select("world_ix", F.col("social.trade_codes").alias("codes")),
        "world_ix",
        "codes",
        trade_codes,
        ignore_unknown,
        "row_ix" if "row_ix" in trade_codes.columns else None,
    )
    unknown = F.when(
        F.size("unknown") > 0,
        F.raise_error(F.concat(F.lit("unknown trade code "), F.array_join("unknown", ", "))).cast("string"),
    )
    return worlds.join(classes, "world_ix").select(
        "world_ix",
        F.coalesce(unknown, codes.format_location(F.col("location.subsector_hex"))).alias("location"),
        "classes",
        F.col("uwp.law_level").alias("law_level"),
    )


def best_dm(dms: Column, classes: Column) -> Column:
    """The largest modifier any class of the world has; 0 only where none has one."""
    found = F.transform(classes, lambda c: F.try_element_at(dms, c))
    return F.coalesce(F.array_max(found), F.lit(0))


def product(goods: DataFrame, worlds: DataFrame, world_key: str = "world_ix", blocks: Blocks = Blocks()) -> DataFrame:
    """Every good with every world, as an equi-join on blocks.

    The result is the product by definition; dealing both sides into blocks by
    hash makes as many even join keys as there are block pairs, so no task gets
    one side whole, and each row is copied only to the blocks it meets.
    """
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    world_blocks = blocks.worlds or int(goods.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = goods.withColumn("_g", deal("d66", blocks.goods)).withColumn("_w", every(world_blocks))
    w = worlds.withColumn("_w", deal(world_key, world_blocks)).withColumn("_g", every(blocks.goods))
    return g.join(w, ["_g", "_w"]).drop("_g", "_w")


def calculate_trades(
    goods: DataFrame, worlds: DataFrame, illegality: DataFrame, overrides: DataFrame, blocks: Blocks = Blocks()
) -> DataFrame:
    """`(d66, world_ix, location, dm, common, available, illegal)` for goods with properties."""
    traded = goods.filter("properties is not null").select("d66", "properties").join(illegality, "d66", "left")
    # The overrides of a location, one a good at most, travel with its worlds:
    # the product is made last and is not shuffled again for them.
    changes = overrides.groupBy("location").agg(
        F.map_from_entries(
            F.collect_set(F.struct("d66", F.struct("available", "purchase_dm", "sale_dm", "illegal").alias("change")))
        ).alias("changes")
    )
    pairs = product(traded, worlds.join(changes, "location", "left"), blocks=blocks)
    change = F.try_element_at("changes", F.col("d66"))
    p, classes, law, limit = F.col("properties"), F.col("classes"), F.col("law_level"), F.col("illegal_level")
    common = F.array_contains(p["availability"], "All")
    available = override(common | F.arrays_overlap(p["availability"], classes), change["available"])
    illegal = override(F.coalesce(law >= limit, F.lit(False)), change["illegal"])
    purchase = override(best_dm(p["purchase_dm"], classes), change["purchase_dm"])
    sale = F.when(illegal & limit.isNotNull(), law - limit).otherwise(best_dm(p["sale_dm"], classes))
    sale = override(sale, change["sale_dm"])
    return pairs.select(
        "d66",
        "world_ix",
        "location",
        (purchase - sale).cast("bigint").alias("dm"),
        common.alias("common"),
        available.alias("available"),
        illegal.alias("illegal"),
    )


def format_dm(formats: Formats) -> Column:
    """The signed number, wrapped by every format that applies."""
    shown = F.format_string("%+d", F.col("dm"))
    wrap = lambda template, inner: F.replace(F.lit(template), F.lit("{}"), inner)
    shown = F.when(F.col("common"), wrap(formats.common, shown)).otherwise(shown)
    shown = F.when(~F.col("available"), wrap(formats.unavailable, shown)).otherwise(shown)
    return F.when(F.col("illegal"), wrap(formats.illegal, shown)).otherwise(wrap(formats.legal, shown))


def wide(goods: DataFrame, trades: DataFrame, formats: Formats, locations: list[str]) -> DataFrame:
    """One row per good and one column per world of the given list."""
    shown = trades.select("d66", "location", format_dm(formats).alias("shown"))
    pivoted = shown.groupBy("d66").pivot("location", locations).agg(F.first("shown"))
    return goods.select(
        "d66", "name", F.col("properties.tons").alias("tons"), F.col("properties.base_price").alias("base_price")
    ).join(pivoted, "d66", "left")


def by_world(goods: DataFrame, trades: DataFrame, formats: Formats) -> DataFrame:
    """The wide table, flat: a row per good and world in any number of worlds; goods without properties have one row without a world."""
    shown = trades.select("d66", "world_ix", "location", format_dm(formats).alias("shown"))
    return goods.select(
        "d66", "name", F.col("properties.tons").alias("tons"), F.col("properties.base_price").alias("base_price")
    ).join(shown, "d66", "left")


def _good_rows(goods: DataFrame, trades: DataFrame, formats: Formats, layout: Layout) -> DataFrame:
    shown = ordered_items(
        trades.withColumn("shown", format_dm(formats)), ["d66"], "world_ix", F.col("shown"), layout
    )
    empty = F.array().cast("array<string>")
    return goods.select(
        "good_ix",
        "d66",
        "name",
        F.col("properties.tons").alias("tons"),
        F.col("properties.base_price").cast("string").alias("base_price"),
    ).join(shown, "d66", "left").withColumn("items", F.coalesce("items", empty))


def _world_titles(worlds: DataFrame, layout: Layout) -> DataFrame:
    return ordered_items(worlds.withColumn("all", F.lit(1)), ["all"], "world_ix", F.col("location"), layout)


def _text_lines(spark, block: int, lines: list[str]) -> DataFrame:
    rows = [(block, n, line) for n, line in enumerate(lines)]
    return spark.createDataFrame(rows, "block int, line_ix bigint, line string")


def csv_report(
    goods: DataFrame,
    worlds: DataFrame,
    trades: DataFrame,
    formats: Formats = Formats(),
    headers: bool = True,
    key: bool = True,
    explanation: bool = True,
    layout: Layout = Layout(),
) -> DataFrame:
    """The report as CSV lines `(block, line_ix, line)`: titles, goods, key, explanation.

    `goods` has a `good_ix` that orders the lines.
    """
    spark = goods.sparkSession
    strings = lambda values: F.array(*values).cast("array<string>")
    rows = _good_rows(goods, trades, formats, layout)
    cells = F.concat(
        strings([F.col("d66"), F.col("name"), F.coalesce("tons", F.lit("")), F.coalesce("base_price", F.lit(""))]),
        F.col("items"),
    )
    out = rows.select(F.lit(1).alias("block"), F.col("good_ix").alias("line_ix"), text.csv_line(cells).alias("line"))
    if headers:
        titles = F.concat(strings([F.lit(t) for t in FIXED_TITLES]), F.col("items"))
        first = _world_titles(worlds, layout).select(
            F.lit(0).alias("block"), F.lit(0).cast("bigint").alias("line_ix"), text.csv_line(titles).alias("line")
        )
        out = out.unionByName(first)
    if key:
        lines = ["", "Key:", *[f"{shown},{meaning}" for shown, meaning in formats.key("+2")]]
        out = out.unionByName(_text_lines(spark, 2, lines))
    if explanation:
        quoted = [f'"{s}"' if "," in s else s for s in DM_SENTENCES]
        out = out.unionByName(_text_lines(spark, 3, ["", *quoted]))
    return out


def asciidoc_report(
    goods: DataFrame,
    worlds: DataFrame,
    trades: DataFrame,
    formats: Formats = Formats(),
    key: bool = True,
    explanation: bool = True,
    layout: Layout = Layout(),
) -> DataFrame:
    """The report as AsciiDoc `(block, line_ix, line)`; a good is one entry of several lines."""
    spark = goods.sparkSession
    titles = _world_titles(worlds, layout)
    count = F.size("items").cast("string")
    head = F.concat(
        F.lit("= Trading DM Table\n\n"),
        F.lit(f"[cols=\"{','.join(ADOC_FIXED_WIDTHS)},"), count, F.lit('*1"]\n|===\n|'),
        F.array_join(F.concat(F.array(*[F.lit(t) for t in FIXED_TITLES]), F.col("items")), " |"),
    )
    first = titles.select(F.lit(0).alias("block"), F.lit(0).cast("bigint").alias("line_ix"), head.alias("line"))

    repeat = lambda n: F.when(n == 1, F.lit("|")).otherwise(F.concat(n.cast("string"), F.lit("*|")))
    worlds_no = worlds.agg(F.count("*")).scalar()
    good = _good_rows(goods, trades, formats, layout).withColumn("worlds_no", worlds_no)
    priced = F.concat(F.lit("|"), F.coalesce("tons", F.lit("")), F.lit("\n|"), F.col("base_price"))
    body = good.select(
        F.lit(1).alias("block"),
        F.col("good_ix").alias("line_ix"),
        F.concat(
            F.lit("\n|"), F.col("d66"), F.lit("\n|"), F.col("name"), F.lit("\n"),
            F.when(F.col("base_price").isNull(), F.lit("2*|")).otherwise(priced), F.lit("\n"),
            F.when(F.size("items") == 0, repeat(F.col("worlds_no"))).otherwise(
                F.array_join(F.transform("items", lambda c: F.concat(F.lit("m|"), c)), "\n")
            ),
        ).alias("line"),
    )
    tail = ["|==="]
    if key:
        tail += ["", "== Key", *[f"{meaning}:: `{shown}`" for shown, meaning in formats.key("+2")]]
    if explanation:
        tail += ["", "== How to use", *[f"- {s}" for s in DM_SENTENCES]]
    return first.unionByName(body).unionByName(_text_lines(spark, 2, tail))
