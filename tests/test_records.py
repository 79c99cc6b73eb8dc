"""Packed codes, ranges, typed records and the trade table by hand-worked cases."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.functions import codes, text
from cellweave.operators.reshape import concat_portions
from cellweave.plans import records, trade
from cellweave.tables import Layout


def one(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_digits(spark):
    valid = {"0": 0, "5": 5, "9": 9, "A": 10, "H": 17, "J": 18, "N": 22, "P": 23, "Z": 33}
    assert one(spark, valid, codes.parse_digit) == list(valid.values())
    assert one(spark, ["I", "O", "a", "h", ".", "", "12"], codes.parse_digit) == [None] * 7
    shown = one(spark, [str(n) for n in [-3, 34, *valid.values()]], lambda v: codes.format_digit(v.cast("int")))
    assert shown == [None, None, *valid]


def test_profiles(spark):
    got = one(spark, ["C430698-9", "E884601-5", "Q430698-9", "C43069-9", "CI30698-9"], codes.parse_profile)
    assert tuple(got[0]) == ("C", 4, 3, 0, 6, 9, 8, 9)
    assert got[1].law_level == 1
    assert got[2:] == [None] * 3
    assert one(spark, ["B563664-B"], lambda v: codes.format_profile(codes.parse_profile(v))) == ["B563664B"]


def test_ranges(spark):
    cases = {"": (None, None), "1+": (1, None), "3-": (None, 3), "1-3": (1, 3), "3–": (None, 3), "1–3": (1, 3), "7": (7, 7)}
    assert [tuple(r) for r in one(spark, cases, codes.parse_range)] == list(cases.values())
    assert one(spark, ["x", "1-2-3", "+"], codes.parse_range) == [None] * 3
    back = one(spark, ["", "1-3, 7+", "3–,  5"], lambda v: codes.format_range_set(codes.parse_range_set(v)))
    assert back == ["", "1-3, 7+", "3-, 5"]
    inside = lambda s, n: one(spark, [s], lambda v: codes.in_ranges(F.lit(n), codes.parse_range_set(v)))[0]
    assert [inside("1-, 8+", n) for n in (-10, 0, 5, 10)] == [True, True, False, True]
    assert inside("", -10)
    assert one(spark, ["1-2, x"], codes.parse_range_set) == [None]


def test_small_parsers(spark):
    assert one(spark, ["Cr1234", "MCr30", "30", "Cr", "KCr1"], text.parse_credits) == [1234, 30_000_000, None, None, None]
    assert one(spark, ["a,  b c ,a"], text.parse_set) == [["a", "b c"]]
    assert one(spark, ["A +1,B c -2,A +3", "A 1", ""], text.parse_modifiers) == [{"A": 3, "B c": -2}, None, None]
    assert one(spark, ["true", "FALSE", "yes", ""], text.parse_bool) == [True, False, None, None]
    assert one(spark, [" 12 ", "-3", "", "x1", "1.5"], text.parse_int) == [12, -3, None, None, None]
    assert one(spark, ["{ -1 }", "{}", "5"], lambda v: text.strip_brackets(v, "{", "}")) == ["-1", "", "5"]
    assert one(spark, ["  a \t\n b "], text.clean_text) == ["a b"]


def test_csv_cells(spark):
    lines = ["", '""', "a,b", ",", '"x, ""y""",z', '"two\nlines",', 'a,"",b', '"a"b,c']
    got = one(spark, lines, text.csv_cells)
    assert got == [[], [""], ["a", "b"], ["", ""], ['x, "y"', "z"], ["two\nlines", ""], ["a", "", "b"], ["ab", "c"]]
    back = one(spark, lines[:-1], lambda v: text.csv_line(text.csv_cells(v)))
    assert one(spark, back, text.csv_cells) == got[:-1]


def keyed(portions, rows, columns):
    return records.by_header(concat_portions(portions([rows])), columns)


def test_trade_goods(portions):
    rows = [
        records.GOODS_COLUMNS,
        ["11", "Common", "All", "2D x 10", "Cr20000", "Industrial +2,Rich -1", "Poor +2", "things"],
        [],
        ["66", "Exotics", "Ask the referee"],
    ]
    out = records.trade_goods(keyed(portions, rows, records.GOODS_COLUMNS)).orderBy("d66").collect()
    assert [(r.d66, r.name, r.description) for r in out] == [("11", "Common", None), ("66", "Exotics", "Ask the referee")]
    p = out[0].properties
    assert (p.availability, p.tons, p.base_price, p.purchase_dm, p.sale_dm) == (
        ["All"], "2D x 10", 20000, {"Industrial": 2, "Rich": -1}, {"Poor": 2},
    )
    assert out[1].properties is None


def test_law_levels(portions, layout):
    rows = [
        records.LAW_COLUMNS,
        ["0", "no limits", ""],
        ["1", "poison", "dust"],
        ["2", "", "mesh"],
        ["3", "a note"],
        ["4", "", "vest"],
        ["9+", "all", ""],
    ]
    out = records.law_levels(keyed(portions, rows, records.LAW_COLUMNS), layout).orderBy("row_ix").collect()
    assert [tuple(r)[2:] for r in out] == [
        (0, 0, None, "no limits", None),
        (1, 1, None, "poison", "dust"),
        (2, 2, None, "poison", "mesh"),
        (3, 3, "a note", None, None),
        (4, 4, None, None, "vest"),
        (9, None, None, "all", "vest"),
    ]


def test_sector_worlds(spark):
    columns = "Sector SS Hex Name UWP Bases Remarks Zone PBG Allegiance Stars {Ix} (Ex) [Cx] Nobility W RU".split()
    rows = [
        ("Spin", "A", "0101", "Zeycude", "C430698-9", None, "De Na Ni Po", None, "613", "ZhIN", "K9 V", "{ -1 }", "(C53-1)", "[6559]", None, "8", "-180"),
        ("Spin", "A", "0103", "Errere", "B563664-B", "KM", "Ni Ri O:0304", "A", "910", "ZhIN", "M1 V M4 V", "{ 3 }", "(957+1)", "[4939]", None, "9", "315"),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
    a, b = records.worlds_from_sector(df).collect()
    assert (a.name, a.travel_code, tuple(a.location.subsector_hex), a.social.bases, a.social.trade_codes) == (
        "Zeycude", "", (1, 1), [], ["De", "Na", "Ni", "Po"],
    )
    assert tuple(a.ext) == ("6559", "C53-1", -1, -180)
    assert (a.system.num_belts, a.system.num_gas_giants, a.system.num_worlds, a.system.stellar) == (1, 3, 8, ["K9", "V"])
    assert (b.travel_code, b.social.bases, b.social.pop_multiplier, b.system.stellar) == ("Amber", ["K", "M"], 9, ["M1", "V", "M4", "V"])
    bare = records.worlds_from_sector(df.drop("RU", "Sector", "SS")).first()
    assert bare.ext.resource_units is None and bare.location.sector_abbv is None


@pytest.fixture(scope="module")
def market(spark):
    properties = "struct<availability:array<string>,tons:string,base_price:bigint,purchase_dm:map<string,int>,sale_dm:map<string,int>,examples:string>"
    goods = spark.createDataFrame(
        [
            (0, "11", "Common", (["All"], "1", 10, {"Rich": 2, "Poor": -4}, {"Poor": 3}, "")),
            (1, "21", "Rare, odd", (["Rich"], "2", 20, {"Rich": 1}, {"Poor": -2, "Bad": -1}, "")),
            (2, "66", "Exotics", None),
        ],
        f"good_ix bigint, d66 string, name string, properties {properties}",
    )
    worlds = spark.createDataFrame(
        [(0, "0101", ["Rich", "Poor"], 5), (1, "0102", ["Poor", "Bad"], 2), (2, "0103", [], 9)],
        "world_ix bigint, location string, classes array<string>, law_level int",
    )
    illegality = spark.createDataFrame([("21", 4)], "d66 string, illegal_level bigint")
    overrides = spark.createDataFrame(
        [("0102", "11", False, None, None, True), ("0103", "21", None, 7, None, None), ("0102", "21", True, None, 5, True), ("0103", "11", None, None, None, None)],
        "location string, d66 string, available boolean, purchase_dm bigint, sale_dm bigint, illegal boolean",
    )
    return goods, worlds, illegality, overrides


def test_trade_table(market):
    out = trade.calculate_trades(*market, blocks=trade.Blocks(2, 3))
    got = {(r.d66, r.location): (r.dm, r.common, r.available, r.illegal) for r in out.collect()}
    assert got == {
        ("11", "0101"): (2 - 3, True, True, False),
        # Illegal by override without a level: the sale modifier still comes from the classes.
        ("11", "0102"): (-4 - 3, True, False, True),
        ("11", "0103"): (0, True, True, False),
        # Illegal: law level less the level of illegality.
        ("21", "0101"): (1 - (5 - 4), False, True, True),
        ("21", "0102"): (0 - 5, False, True, True),
        ("21", "0103"): (7 - (9 - 4), False, False, True),
    }


def test_negative_only_match_stays_negative(spark):
    df = spark.createDataFrame([({"Poor": -2, "Bad": -1}, ["Poor", "Bad"]), ({"Poor": -2}, ["Rich"]), ({}, [])], "dms map<string,int>, c array<string>")
    assert [r.v for r in df.select(trade.best_dm(F.col("dms"), F.col("c")).alias("v")).collect()] == [-1, 0, 0]


@pytest.mark.parametrize("layout_", [Layout(True, bits=1), Layout(False)])
def test_reports(market, layout_):
    goods, worlds, illegality, overrides = market
    formats = trade.Formats(common="*{}*", unavailable="-{}-", illegal="!{}!", legal="<{}>")
    trades = trade.calculate_trades(goods, worlds, illegality, overrides)
    lines = trade.csv_report(goods, worlds, trades, formats, layout=layout_).orderBy("block", "line_ix").collect()
    assert [r.line for r in lines] == [
        "D66,Goods,Tons,Base Price (cr),0101,0102,0103",
        "11,Common,1,10,<*-1*>,!-*-7*-!,<*+0*>",
        '21,"Rare, odd",2,20,!+0!,!-5!,!-+2-!',
        "66,Exotics,,",
        "",
        "Key:",
        "*+2*,Commonly available goods.",
        "-+2-,Good unavailable for purchase.",
        "<+2>,Legal by planetary law.",
        "!+2!,Illegal by planetary law.",
        "",
        '"Number is added when buying goods, and subtracted when selling goods."',
        '"High numbers indicate excess of supply, low numbers indicate demand."',
    ]
    bare = trade.csv_report(goods, worlds, trades, formats, headers=False, key=False, explanation=False, layout=layout_)
    assert bare.count() == 3
    adoc = trade.asciidoc_report(goods, worlds, trades, formats, key=False, explanation=False, layout=layout_)
    assert "\n".join(r.line for r in adoc.orderBy("block", "line_ix").collect()) == (
        '= Trading DM Table\n\n[cols="1,4,2,3,3*1"]\n|===\n|D66 |Goods |Tons |Base Price (cr) |0101 |0102 |0103'
        "\n\n|11\n|Common\n|1\n|10\nm|<*-1*>\nm|!-*-7*-!\nm|<*+0*>"
        "\n\n|21\n|Rare, odd\n|2\n|20\nm|!+0!\nm|!-5!\nm|!-+2-!"
        "\n\n|66\n|Exotics\n2*|\n3*|\n|==="
    )


def test_unknown_trade_codes(spark):
    csv = spark.createDataFrame([("0204", "Yamallu", "E884601-5", "Ag:Zz")], "Location string, Name string, UWP string, `Trade Codes` string")
    worlds = records.worlds_from_csv(csv).withColumn("world_ix", F.lit(0))
    known = spark.createDataFrame([("Ag", "Agricultural")], "code string, classification string")
    row = trade.world_views(worlds, known, ignore_unknown=True).first()
    assert (row.location, row.classes, row.law_level) == ("0204", ["Agricultural"], 1)
    with pytest.raises(Exception, match="unknown trade code Zz"):
        trade.world_views(worlds, known).collect()


def test_classify_worlds(spark):
    criteria = spark.createDataFrame(
        [("Agricultural", "Ag", "", "4-9", "4-8", "5-7", "", "", ""), ("Asteroid", "As", "0", "0", "0", "", "", "", "")],
        ", ".join(f"`{c}` string" for c in ["Classification", "Code", *records.CRITERIA_COLUMNS]),
    )
    worlds = spark.createDataFrame([(1, "A5555555"), (2, "A000000-0"), (3, "A5355555"), (4, "bad")], "k int, t string")
    worlds = worlds.select("k", codes.parse_profile(F.col("t")).alias("uwp"))
    out = records.classify_worlds(worlds, records.trade_codes(criteria), "k").collect()
    assert sorted(map(tuple, out)) == [(1, "Ag"), (2, "As")]


def test_bitmaps_of_many_codes(spark, monkeypatch):
    """Open, single and several ranges, more codes than a word has bits and than one round takes, a code in two rows."""
    monkeypatch.setattr(records, "INDEXED_CODES", 70)
    rng = random.Random(2)
    text = lambda: rng.choice(["", "0", "5+", "3-", "2-9", "0-4, 8+", "1,3,5,7-"])
    rows = [(f"name {i}", f"c{i % 150}", *[text() for _ in records.CRITERIA_COLUMNS]) for i in range(160)]
    criteria = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ["Classification", "Code", *records.CRITERIA_COLUMNS]))
    worlds = spark.createDataFrame([(k, "A" + "".join(rng.choice("0123456789AZ") for _ in range(7))) for k in range(80)], "k int, t string")
    worlds = worlds.select("k", "t", codes.parse_profile(F.col("t")).alias("uwp"))

    def allows(ranges, value):
        for part in ranges.split(","):
            part = part.strip()
            lo, hi = part, part
            if part.endswith("+"):
                lo, hi = part[:-1], "99"
            elif part.endswith("-"):
                lo, hi = "0", part[:-1]
            elif "-" in part:
                lo, hi = part.split("-")
            if not part or int(lo) <= value <= int(hi):
                return True
        return False

    parsed = records.trade_codes(criteria)
    out = records.classify_worlds(worlds.select("k", "uwp"), parsed, "k")
    numbers = {r.k: [codes.DIGITS.index(c) for c in r.t[1:]] for r in worlds.collect()}
    want = {(k, r[1]) for k, n in numbers.items() for r in rows if all(allows(c, v) for c, v in zip(r[2:], n))}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want) and want
    plan = records.classify_worlds(worlds.select("k", "uwp"), parsed.limit(20), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
