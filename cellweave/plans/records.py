"""Typed records from string rows.

Every converter takes string columns and adds typed ones. A value that does not
parse gives null, and `bad_records` splits such rows off with the names of the
columns at fault, so one bad row never stops a run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import codes, text
from cellweave.tables import Layout, Running, running

# Column titles of the source tables, and travel zone letters.
GOODS_COLUMNS = ["D66", "Type", "Availability", "Tons", "Base Price", "Purchase DM", "Sale DM", "Examples"]
LAW_COLUMNS = ["Law Level", "Weapons Banned", "Armour"]
CRITERIA_COLUMNS = {
    "Planet Size": "planet_sizes",
    "Atmosphere": "atmospheres",
    "Hydro": "hydro",
    "Population": "population",
    "Government": "government",
    "Law Level": "law_level",
    "Tech Level": "tech_level",
}
CRITERIA_NUMBERS = dict(zip(CRITERIA_COLUMNS.values(), codes.PROFILE_NUMBERS))
TRAVEL_ZONES = {"A": "Amber", "R": "Red", "": ""}

CONVERTERS: dict[tuple[str, str], Callable[..., DataFrame]] = {}


def converter(group: str, name: str):
    """Register a converter under (group, table name)."""

    def register(fn):
        CONVERTERS[group, name] = fn
        return fn

    return register


def bad_records(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required columns, and the others with the columns at fault in `bad`."""
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    checked = df.withColumn("bad", bad)
    return checked.filter(F.size("bad") == 0).drop("bad"), checked.filter(F.size("bad") > 0)


def unparsed(df: DataFrame, parsers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows with a text that does not parse, and the columns at fault in `bad`; a blank text is no fault."""
    wrong = lambda c, parse: (F.coalesce(F.col(c), F.lit("")) != "") & parse(F.col(c)).isNull()
    return _with_bad(df, [F.when(wrong(c, parse), F.lit(c)) for c, parse in parsers.items()])


def _with_bad(df: DataFrame, faults: list[Column]) -> DataFrame:
    return df.withColumn("bad", F.array_compact(F.array(*faults))).filter(F.size("bad") > 0)


def goods_faults(df: DataFrame) -> DataFrame:
    """Rows of goods without number or name, or with a base price where that or a modifier is malformed or blank."""
    priced = F.col("Base Price").isNotNull()
    parsers = {"Base Price": text.parse_credits, "Purchase DM": text.parse_modifiers, "Sale DM": text.parse_modifiers}
    missing = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in ("D66", "Type")]
    return _with_bad(df, missing + [F.when(priced & parse(F.col(c)).isNull(), F.lit(c)) for c, parse in parsers.items()])


def by_header(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows keyed by the titles in row 0: `(table_id, row_ix, <columns>)`.

    A cell a short row lacks is null, a blank one is `""`. Empty rows vanish.
    """
    header = df.filter("row_ix = 0").select("table_id", F.col("cells").alias("header"))
    body = df.filter((F.col("row_ix") > 0) & (F.size("cells") > 0)).join(header, "table_id")
    at = lambda c: F.array_position("header", F.lit(c)).cast("int") - 1
    return body.select("table_id", "row_ix", *[F.get("cells", at(c)).alias(c) for c in columns])


@converter("trade", "trade-goods")
def trade_goods(df: DataFrame) -> DataFrame:
    """Goods with properties; a row without base price only describes."""
    described = F.col("Base Price").isNull()
    properties = F.struct(
        text.parse_set(F.col("Availability")).alias("availability"),
        F.col("Tons").alias("tons"),
        text.parse_credits(F.col("Base Price")).alias("base_price"),
        text.parse_modifiers(F.col("Purchase DM")).alias("purchase_dm"),
        text.parse_modifiers(F.col("Sale DM")).alias("sale_dm"),
        F.col("Examples").alias("examples"),
    )
    return df.select(
        *[c for c in ("table_id", "row_ix") if c in df.columns],
        F.col("D66").alias("d66"),
        F.col("Type").alias("name"),
        F.when(described, F.col("Availability")).alias("description"),
        F.when(~described, properties).alias("properties"),
    )


@converter("worldcreation", "governments")
def governments(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("Government").alias("code"),
        F.col("Government Type").alias("name"),
        F.col("Description").alias("description"),
        F.col("Examples").alias("examples"),
        text.parse_set(F.col("Example Contraband")).alias("example_contraband"),
    )


@converter("worldcreation", "law-levels")
def law_levels(df: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Law levels in row order; `(table_id, row_ix)` must be there.

    A blank ban repeats the one of the record before, and a description row
    counts as a record without bans.
    """
    level = F.col("Law Level")
    lowest = text.parse_int(F.regexp_replace(level, r"[+]\z", ""))
    described = F.col("Armour").isNull()
    carry = lambda c: Running(
        "last", F.when(described | (F.col(c) != ""), F.struct(F.when(~described, F.col(c)).alias("v")))
    )
    carried = running(df, {"_weapons": carry("Weapons Banned"), "_armour": carry("Armour")}, layout)
    return carried.select(
        "table_id",
        "row_ix",
        lowest.alias("min_level"),
        F.when(~level.endswith("+"), lowest).alias("max_level"),
        F.when(described, F.col("Weapons Banned")).alias("description"),
        F.col("_weapons.v").alias("weapons_banned"),
        F.col("_armour.v").alias("armour_banned"),
    )


@converter("worldcreation", "trade-codes")
def trade_codes(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("Classification").alias("classification"),
        F.col("Code").alias("code"),
        *[codes.parse_range_set(F.col(title)).alias(name) for title, name in CRITERIA_COLUMNS.items()],
        *[c for c in df.columns if c == "row_ix"],
    )


def worlds_from_csv(df: DataFrame) -> DataFrame:
    """Worlds from columns Location, Name, UWP and Trade Codes (`:`-separated)."""
    null = lambda t: F.lit(None).cast(t)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.select(
        F.col("Name").alias("name"),
        null("string").alias("travel_code"),
        codes.parse_profile(blank("UWP")).alias("uwp"),
        F.struct(
            null("string").alias("sector_abbv"),
            null("string").alias("subsector"),
            codes.parse_location(blank("Location")).alias("subsector_hex"),
        ).alias("location"),
        F.struct(
            null("string").alias("allegiance"),
            null("array<string>").alias("bases"),
            null("string").alias("nobility"),
            null("int").alias("pop_multiplier"),
            F.array_distinct(F.split(blank("Trade Codes"), ":", -1)).alias("trade_codes"),
        ).alias("social"),
        null(EXT_TYPE).alias("ext"),
        null(SYSTEM_TYPE).alias("system"),
        *[c for c in df.columns if c == "_place"],
    )


EXT_TYPE = "struct<cultural:string,economic:string,importance:bigint,resource_units:bigint>"
SYSTEM_TYPE = "struct<num_belts:int,num_gas_giants:int,num_worlds:bigint,stellar:array<string>>"


def worlds_from_sector(df: DataFrame) -> DataFrame:
    """Worlds from the tab separated sector format; `RU`, `Sector` and `SS` may be absent."""
    value = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    optional = lambda c: value(c) if c in df.columns else F.lit(None).cast("string")
    inner = lambda c, b: text.strip_brackets(value(c), b[0], b[1])
    digit = lambda at: F.substring(value("PBG"), at, 1).try_cast("int")
    zone = F.element_at(F.create_map(*[F.lit(x) for kv in TRAVEL_ZONES.items() for x in kv]), value("Zone"))
    zone = F.when(value("Zone").isin(list(TRAVEL_ZONES)), zone)
    return df.select(
        F.col("Name").alias("name"),
        zone.alias("travel_code"),
        codes.parse_profile(value("UWP")).alias("uwp"),
        F.struct(
            optional("Sector").alias("sector_abbv"),
            text.blank_to_null(optional("SS")).alias("subsector"),
            codes.parse_location(value("Hex")).alias("subsector_hex"),
        ).alias("location"),
        F.struct(
            value("Allegiance").alias("allegiance"),
            F.array_distinct(F.regexp_extract_all(value("Bases"), F.lit("(?s)(.)"), F.lit(1))).alias("bases"),
            value("Nobility").alias("nobility"),
            digit(1).alias("pop_multiplier"),
            F.array_distinct(text.split_words(value("Remarks"))).alias("trade_codes"),
        ).alias("social"),
        F.struct(
            inner("[Cx]", "[]").alias("cultural"),
            inner("(Ex)", "()").alias("economic"),
            text.parse_int(inner("{Ix}", "{}")).alias("importance"),
            text.parse_int(optional("RU")).alias("resource_units"),
        ).alias("ext"),
        F.struct(
            digit(2).alias("num_belts"),
            digit(3).alias("num_gas_giants"),
            text.parse_int(value("W")).alias("num_worlds"),
            text.split_words(value("Stars")).alias("stellar"),
        ).alias("system"),
        *[c for c in df.columns if c == "_place"],
    )


#: Codes of a bitmap index; more are looked up in as many rounds of so many.
INDEXED_CODES = 2048
WORD_BITS = 64


def classify_worlds(worlds: DataFrame, criteria: DataFrame, key: str) -> DataFrame:
    """`(key, code)` for each trade code whose seven criteria a world's profile meets.

    `worlds` has `(key, uwp)`. For each criterion and each digit a bitmap says
    which codes allow it. A world's codes are the bits that its seven bitmaps have
    in common, so worlds are neither joined nor shuffled. The index goes along
    with the expression: `INDEXED_CODES` codes at a time.
    """
    digits = F.sequence(F.lit(0), F.lit(len(codes.DIGITS) - 1))

    def allowed(criterion: str) -> Column:
        return F.transform(digits, lambda v: F.coalesce(codes.in_ranges(v, F.col(criterion)), F.lit(False))).alias(criterion)

    rules = criteria.select("code", *[allowed(c) for c in CRITERIA_NUMBERS]).distinct()
    found, held = None, []
    known = worlds.select(key, "uwp").filter("uwp is not null")
    for rule in rules.toLocalIterator():
        held.append(rule)
        if len(held) == INDEXED_CODES:
            found, held = _with(found, _meeting(known, held, key)), []
    if held or found is None:
        found = _with(found, _meeting(known, held, key))
    # A code may stand in several rows of criteria, of which a world meets one or more.
    return found if rules.select("code").distinct().count() == rules.count() else found.distinct()


def _with(found: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if found is None else found.unionByName(more)


def _meeting(worlds: DataFrame, rules: list, key: str) -> DataFrame:
    """`(key, code)` of these rules, by their bitmaps."""

    def met(word: list) -> Column:
        """Codes of up to WORD_BITS rules."""
        common = None
        for criterion, number in CRITERIA_NUMBERS.items():
            bits = [sum(1 << i for i, rule in enumerate(word) if rule[criterion][digit]) for digit in range(len(codes.DIGITS))]
            signed = [b - (1 << WORD_BITS) if b >> (WORD_BITS - 1) else b for b in bits]
            allowed = F.get(F.array(*[F.lit(b).cast("bigint") for b in signed]), F.col(f"uwp.{number}"))
            common = allowed if common is None else common.bitwiseAND(allowed)
        names = F.array(*[F.struct(F.lit(i).alias("bit"), F.lit(rule["code"]).alias("code")) for i, rule in enumerate(word)])
        return F.transform(F.filter(names, lambda n: F.call_function("getbit", common, n["bit"]) == 1), lambda n: n["code"])

    meets = [met(rules[at : at + WORD_BITS]) for at in range(0, len(rules), WORD_BITS)]
    none = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(m, none) for m in meets]) if meets else none
    return worlds.select(key, F.explode(every).alias("code"))
