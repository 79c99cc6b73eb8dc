"""Both jobs from files to files."""

import pytest

from cellweave.operators import reshape
from cellweave.operators.grouping import StaticRowCounts
from cellweave.plans import jobs, records, trade
from cellweave.plans.extraction import Choice
from cellweave.sources.csvtables import read_written_tables


def _refused(spark, job, tmp_path):
    """One malformed value at a time fails the report, and is named."""
    spoiled = {
        "goods": ("trade/goods.csv", "Poor +3", "Poor 3", "11 .Sale DM."),
        "worlds": ("worlds.csv", "A548698-C", "A5486", "Midgard .UWP."),
        "law levels": ("illegal.csv", "21,7", "21,seven", "21 .Illegal law level."),
        "overrides": ("over.csv", "true,,4", "yes,,4", "0204 .Available."),
    }
    for what, (name, old, new, place) in spoiled.items():
        path = tmp_path / name
        good = path.read_text()
        path.write_text(good.replace(old, new))
        with pytest.raises(ValueError, match=f"malformed {what}: {place}"):
            jobs.trade_report(spark, job)
        path.write_text(good)


def test_trade_report(spark, tmp_path):
    (tmp_path / "index.csv").write_text("table_path,pages,tags\ntrade/goods.csv,1;2,trade;type/trade-good\ncodes.csv,3,type/trade-code\n")
    (tmp_path / "trade").mkdir()
    (tmp_path / "trade" / "goods.csv").write_text(
        "D66,Type,Availability,Tons,Base Price,Purchase DM,Sale DM,Examples\r\n"
        '11,Common,All,2D,Cr100,"Rich +2,Poor -1",Poor +3,"x, y"\r\n'
        "66,Exotics,Ask\r\n"
        "21,Arms,Rich,1D,MCr1,Rich +1,Poor +1,z\r\n"
    )
    (tmp_path / "codes.csv").write_text(
        "Classification,Code,Planet Size,Atmosphere,Hydro,Population,Government,Law Level,Tech Level\r\n"
        'Rich,Ri,"","6,8","",6-8,4-9,"",""\r\nPoor,Po,,2-5,0-3,,,,\r\n'
    )
    (tmp_path / "worlds.csv").write_text(
        "Location,Name,UWP,Bases,Trade Codes,Travel Code\n0304,Midgard,A548698-C,x,Ri:Zz,\n0204,Yamallu,E884601-5,x,Po,Amber\n"
    )
    (tmp_path / "illegal.csv").write_text("D66,Illegal law level\n21,7\n")
    (tmp_path / "over.csv").write_text("Location,D66,Available,Purchase DM,Sale DM,Illegal,Comment\n0204,21,true,,4,,note\n")
    job = jobs.TradeJob(
        index=str(tmp_path / "index.csv"), tables=str(tmp_path), world_source="csv", worlds=str(tmp_path / "worlds.csv"),
        illegality=str(tmp_path / "illegal.csv"), overrides=str(tmp_path / "over.csv"), ignore_unknown=["trade-codes"],
        formats=trade.Formats(illegal="x{}", unavailable="({})"), key=False, explanation=False,
    )
    _refused(spark, job, tmp_path)
    out = tmp_path / "report"
    jobs.write_report(jobs.trade_report(spark, job), str(out))
    text = "".join(p.read_text() for p in sorted(out.glob("part-*")))
    assert text.splitlines() == [
        "D66,Goods,Tons,Base Price (cr),0304,0204",
        "11,Common,2D,100,+2,-4",
        "66,Exotics,,",
        "21,Arms,1D,1000000,x+0,-4",
    ]


def test_extract_tables(spark, tmp_path, portions, rows_of):
    catalog = spark.createDataFrame(
        [
            ("b", "group", ["book/b"], False, None),
            ("b/one", "table", ["t"], False, "header"),
            ("b/two", "table", ["t"], False, None),
            ("b/bad", "table", ["t"], False, None),
            ("b/old", "table", ["t"], False, None),
        ],
        "path string, kind string, tags array<string>, disabled boolean, transform string",
    )
    data = portions({"b/one": [[["h", ""], ["1", " 2 "], ["x", "y"]], [["z"]]], "b/two": [[[" raw "]]], "b/bad": [[["?"]]], "b/old": [[["o"]]]})
    index = spark.createDataFrame([("b/old.csv", [9], ["t"])], "table_path string, pages array<int>, tags array<string>")
    errors = spark.createDataFrame([("b/bad", "multiple (2) tables in region")], "table_id string, error string")
    new_index, outcomes = jobs.extract_tables(
        catalog, data, index, {"header": [reshape.fold_rows([StaticRowCounts((2,))])]}, Choice(with_tags=["t"]), str(tmp_path / "out"), errors
    )
    back = reshape.concat_portions(read_written_tables(spark, str(tmp_path / "out" / "tables")))
    assert rows_of(back, "b/one") == [["h 1", "2"], ["x", "y"], ["z"]]
    assert rows_of(back, "b/two") == [[" raw "]]
    assert {(r.table_path, tuple(r.pages), tuple(r.tags)) for r in new_index.collect()} == {
        ("b/old.csv", (9,), ("t",)), ("b/one.csv", (2, 3), ("book/b", "t")), ("b/two.csv", (2,), ("book/b", "t")),
    }
    assert sorted(map(tuple, outcomes.collect())) == [
        ("b/bad", False, "multiple (2) tables in region"), ("b/one", True, None), ("b/two", True, None),
    ]

    # A second run adds, and replaces what is to be overwritten; the report's reader opens what the index names.
    newer = portions({"b/two": [[["newer"]]], "b/three": []})
    more = catalog.unionByName(
        spark.createDataFrame([("b/three", "table", ["t"], False, "titles"), ("b/four", "table", ["t"], False, "absent")], catalog.schema)
    )
    titles = {"titles": [reshape.prepend_row(["a", "b"])]}
    again, outcomes = jobs.extract_tables(more, newer, new_index, titles, Choice(with_tags=["t"], overwrite=True), str(tmp_path / "out"))
    assert {r.table_id: (r.ok, r.error) for r in outcomes.collect()} == {
        "b/one": (False, "unknown transform header"), "b/two": (True, None), "b/bad": (False, "no output"), "b/old": (False, "no output"),
        "b/three": (True, None), "b/four": (False, "unknown transform absent"),
    }
    assert {r.table_path: r.pages for r in again.collect()} == {"b/old.csv": [9], "b/one.csv": [2, 3], "b/two.csv": [2], "b/three.csv": []}
    back = reshape.concat_portions(read_written_tables(spark, str(tmp_path / "out" / "tables")))
    assert [rows_of(back, t) for t in ("b/one", "b/two", "b/three")] == [[["h 1", "2"], ["x", "y"], ["z"]], [["newer"]], [["a", "b"]]]


def test_a_user_function_fails_for_one_table(spark, tmp_path, portions, rows_of):
    """The other tables come out, and the outcomes name what went wrong."""
    catalog = spark.createDataFrame(
        [(f"b/{name}", "table", ["t"], False, "own") for name in ("one", "two", "three")] + [("b/plain", "table", ["t"], False, None)],
        "path string, kind string, tags array<string>, disabled boolean, transform string",
    )

    def own(parts):
        return [[str(int(parts[0][0][0]) * 2)]]

    data = portions({"b/one": [[["1"]]], "b/two": [[["x"]]], "b/three": [[["3"]]], "b/plain": [[["p"]]]})
    index = spark.createDataFrame([], "table_path string, pages array<int>, tags array<string>")
    new_index, outcomes = jobs.extract_tables(catalog, data, index, {"own": own}, Choice(), str(tmp_path))
    got = {r.table_id: (r.ok, r.error and r.error.split(":")[0]) for r in outcomes.collect()}
    assert got == {"b/one": (True, None), "b/two": (False, "ValueError"), "b/three": (True, None), "b/plain": (True, None)}
    back = reshape.concat_portions(read_written_tables(spark, str(tmp_path / "tables")))
    assert [rows_of(back, t) for t in ("b/one", "b/three")] == [[["2"]], [["6"]]]
    assert "b/two.csv" not in {r.table_path for r in new_index.collect()}


def test_report_from_extraction(spark, tmp_path, portions):
    """The trade report reads the folders that an extraction wrote."""
    catalog = spark.createDataFrame(
        [("b/goods", "table", ["type/trade-good"], False, "goods"), ("b/codes", "table", ["type/trade-code"], False, None)],
        "path string, kind string, tags array<string>, disabled boolean, transform string",
    )
    data = portions(
        {
            "b/goods": [[["11", "Common", "All", "2D", "Cr100", "Rich +2", "Poor +3", "x,\ny"]], [["66", "Exotics", "Ask"]]],
            "b/codes": [[["Classification", "Code", *records.CRITERIA_COLUMNS], ["Rich", "Ri", "", "6,8", "", "6-8", "4-9", "", ""]]],
        }
    )
    index = spark.createDataFrame([], "table_path string, pages array<int>, tags array<string>")
    titles = reshape.prepend_row(["D66", "Type", "Availability", "Tons", "Base Price", "Purchase DM", "Sale DM", "Examples"])
    jobs.extract_tables(catalog, data, index, {"goods": [titles]}, Choice(), str(tmp_path))
    (tmp_path / "worlds.csv").write_text("Location,Name,UWP,Bases,Trade Codes,Travel Code\n0304,Midgard,A548698-C,x,Ri,\n")
    job = jobs.TradeJob(
        index=str(tmp_path / "index"), tables=str(tmp_path / "tables"), extracted=True, world_source="csv",
        worlds=str(tmp_path / "worlds.csv"), key=False, explanation=False,
    )
    lines = [r.line for r in jobs.trade_report(spark, job).orderBy("block", "line_ix").collect()]
    assert lines == ["D66,Goods,Tons,Base Price (cr),0304", "11,Common,2D,100,+2", "66,Exotics,,"]
