"""Readers and writers on small files, in both layouts."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators.reshape import concat_portions
from cellweave.operators.userfn import check_rows, named_inputs_function, table_function
from cellweave.sources import csvtables, worldfiles

ROWS = [["h1", "h2"], [], ["", "x"], ['say "hi"', "a,b", ""], ["two\nlines\n", "cr\r\nlf"], [""], ["last"]]


def write_file(path, rows):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows(rows)


@pytest.mark.parametrize("block", [None, 16])
def test_ragged_csv(spark, tmp_path, rows_of, layout, block):
    """Also with blocks of a few bytes, so that a file is read in many pieces."""
    write_file(tmp_path / "a.csv", ROWS)
    write_file(tmp_path / "b.csv", [["only"]])
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        df = csvtables.read_csv_tables(spark, str(tmp_path), layout).cache()
        tables = {r.table_id.split("/")[-1]: r.table_id for r in df.select("table_id").distinct().collect()}
        assert rows_of(df, tables["a.csv"]) == ROWS
        assert rows_of(df, tables["b.csv"]) == [["only"]]
        assert rows_of(csvtables.read_csv_body(spark, str(tmp_path), layout), tables["a.csv"]) == ROWS[1:]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("seed", range(4))
def test_any_quotes(spark, tmp_path, rows_of, layout, seed):
    """Quotes anywhere, read as Python's reader does: bare ones, text after closing ones, cells never closed."""
    rng = random.Random(seed)
    tables = {}
    for name in "abcdef":
        lines = ["".join(rng.choice(['"', '"', ",", "x", "yz", " ", '""']) for _ in range(rng.randrange(9))) for _ in range(30)]
        lines[-1] = "end" if rng.random() < 0.5 else lines[-1]
        (tmp_path / f"{name}.csv").write_bytes(rng.choice([b"\n", b"\r\n"]).join(line.encode() for line in lines))
        with open(tmp_path / f"{name}.csv", newline="") as f:
            tables[name] = list(csv.reader(f))
    df = csvtables.read_csv_tables(spark, str(tmp_path), layout).cache()
    for r in df.select("table_id").distinct().collect():
        assert rows_of(df, r.table_id) == tables[r.table_id.split("/")[-1][0]]


def test_long_cells(spark, tmp_path, rows_of, layout):
    """Many doubled quotes, cells and lines in one record."""
    rows = [['"' * 30_000, "x"], ["c"] * 20_000, ["\n" * 3000 + '"', ""], ['a"b', 'c""d']]
    write_file(tmp_path / "a.csv", rows[:3])
    with open(tmp_path / "a.csv", "a", newline="") as f:
        f.write('a"b,c""d\r\n')
    df = csvtables.read_csv_tables(spark, str(tmp_path), layout).cache()
    assert rows_of(df, df.first().table_id) == rows


def test_written_tables_come_back(spark, tmp_path, portions, rows_of, layout):
    tables = {"007": [ROWS], "x/y z": [[["a", "b"]] * 9]}
    df = concat_portions(portions(tables))
    path = str(tmp_path / "out")
    csvtables.write_csv_tables(df, path)
    back = concat_portions(csvtables.read_written_tables(spark, path, layout))
    for name, (rows,) in tables.items():
        assert rows_of(back, name) == rows
    for file in (tmp_path / "out").glob("table_id=007/part-*"):
        assert file.read_bytes().startswith(b"h1,h2\r\n")


def test_json_tables(spark, portions, layout):
    df = concat_portions(portions([[["a", 'q"'], [], ["é"]]]))
    assert json.loads(csvtables.table_json(df, layout).first().json) == [["a", 'q"'], [], ["é"]]


def test_table_type_check(spark):
    want = "want Array[Array[string]], got "
    cases = {
        "[]": None, "[[],[]]": None, '[[""],[]]': None, '[["a","b"],["c"]]': None,
        '"rows"': want + ". with type string", '["row"]': want + ".[0] with type string", "[[1]]": want + ".[0][0] with type number",
        '[["a"],["b",["c"]]]': want + ".[1][1] with type Array", '[["a"],{"k":1}]': want + ".[1] with type Object",
        "[[null]]": want + ".[0][0] with type null", "[[true]]": want + ".[0][0] with type boolean", "[[": "not JSON",
    }
    df = spark.createDataFrame([(str(i), j) for i, j in enumerate(cases)], "table_id string, json string")
    got = [r.error for r in csvtables.check_table_json(df).orderBy(F.col("table_id").cast("int")).collect()]
    assert got == list(cases.values())
    rows, errors = csvtables.json_to_rows(df)
    assert errors.count() == 8
    assert [r.cells for r in rows.filter("table_id = '3'").orderBy("row_ix").collect()] == [["a", "b"], ["c"]]


def test_keyed_files(spark, tmp_path):
    (tmp_path / "o.csv").write_text(
        "Location,D66,Available,Purchase DM,Sale DM,Illegal,Comment\n0404,33,,,,true,\"no, really\"\n0405,26,,,5,,x\n0405,26,False,,7,,y\n"
    )
    got = {(r.location, r.d66): tuple(r)[2:] for r in worldfiles.read_overrides(spark, str(tmp_path / "o.csv")).collect()}
    assert got == {("0404", "33"): (None, None, None, True), ("0405", "26"): (False, None, 7, None)}
    (tmp_path / "i.csv").write_text("D66,Illegal law level\n11,3\n12,9\n11,4\n")
    assert sorted(map(tuple, worldfiles.read_illegality(spark, str(tmp_path / "i.csv")).collect())) == [("11", 4), ("12", 9)]
    (tmp_path / "w.csv").write_text("Location,Name,UWP,Bases,Trade Codes,Travel Code\n0204,Yamallu,E884601-5,Gas Giant,Ag:Ga,Amber\n")
    world = worldfiles.read_worlds(spark, "csv", str(tmp_path / "w.csv")).first()
    assert (world.name, tuple(world.location.subsector_hex), world.social.trade_codes) == ("Yamallu", (2, 4), ["Ag", "Ga"])
    (tmp_path / "t.tsv").write_text("Hex\tName\n0101\ta \"b\n\n0102\tc\n")
    assert [tuple(r) for r in worldfiles.read_sector_tsv(spark, str(tmp_path / "t.tsv")).collect()] == [("0101", 'a "b'), ("0102", "c")]
    with pytest.raises(ValueError, match="unknown world data source"):
        worldfiles.read_worlds(spark, "url", "x")


def test_recognised(spark):
    data = '[[{"top":1.0,"left":2.0,"width":3.0,"height":4.0,"text":"a"},{"text":"b"}],[{"text":""}]]'
    df = spark.createDataFrame([(7, data)], "page int, data string")
    assert [tuple(r) for r in csvtables.flatten_recognised(df).collect()] == [(7, 0, ["a", "b"]), (7, 1, [""])]


def test_user_functions(spark, portions, rows_of):
    df = portions({"t": [[["a"], ["b"]], [["c"]]], "u": [[["d"]]]})
    out, errors = table_function(df, lambda parts: [[str(len(parts))], *[row for part in parts for row in part]])
    assert errors.count() == 0
    assert rows_of(out) == [["2"], ["a"], ["b"], ["c"]]
    assert rows_of(out, "u") == [["1"], ["d"]]
    plain = concat_portions(df)
    both, _ = named_inputs_function({"b": plain.filter("table_id = 't'"), "a": plain}, lambda a, b: [["a", str(len(a))], ["b", str(len(b))]])
    assert rows_of(both, "u") == [["a", "1"], ["b", "0"]]
    for bad in ("rows", ["row"], [[1]], [[["deep"]]]):
        with pytest.raises(TypeError):
            check_rows(bad)
    for good in ([], [[], []], [[""], []], [["a", "b"]]):
        check_rows(good)


def test_a_failing_function_fails_for_its_table_only(spark, portions, rows_of):
    """Errors raised and results that are no rows of text are outcomes of their tables, each worked out once."""

    def odd(parts):
        first = parts[0][0][0]
        if first == "raise":
            raise KeyError("no such thing")
        return {"number": [["x"], [1]], "text": "x", "none": None}.get(first, [[first.upper()], []])

    df = portions({name: [[[name]]] for name in ("good", "raise", "number", "text", "none", "fine")})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows, errors = table_function(df, odd)
        assert rows_of(rows, "good") == [["GOOD"], []] and rows_of(rows, "fine") == [["FINE"], []] and rows.count() == 4
        assert {r.table_id: r.error.split(":")[0] for r in errors.collect()} == {
            "raise": "KeyError", "number": "TypeError", "text": "TypeError", "none": "TypeError",
        }
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keyed_csv_by_title(spark, tmp_path):
    """Columns go by title, whatever their order in a file; a quoted line break stays in its cell."""
    (tmp_path / "a.csv").write_text('Location,D66,Available,Purchase DM,Sale DM,Illegal,Comment\n0101,11,true,1,,,"two\nlines"\n')
    (tmp_path / "b.csv").write_text('Comment,Illegal,Sale DM,D66,Location\n"says ""no"", so",true,-2,12,0202\n\n')
    got = {tuple(r) for r in worldfiles.read_overrides(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("0101", "11", True, 1, None, None), ("0202", "12", None, None, -2, True)}
    comments = worldfiles.read_keyed_csv(spark, str(tmp_path / "*.csv")).select("Comment").collect()
    assert sorted(r.Comment for r in comments) == ['says "no", so', "two\nlines"]


def test_round_trip_counts_lines(spark, tmp_path, monkeypatch):
    """How long tables are is counted on lines: records are put together once, for the result, and the rows are the same."""
    from cellweave.queries import files

    spark.createDataFrame(
        [(i, "a\n\"b\n,c" * (i % 3) + str(i), "en" if i % 4 else "fr", f"s{i % 2}", i) for i in range(20)],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).write.parquet(str(tmp_path / "documents.parquet"))
    plans = []
    real = files.layout_of

    def spy(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    monkeypatch.setattr(files, "layout_of", spy)
    got = {(r.table_id, r.row_ix, r.col_ix): r.cell for r in files.csv_round_trip(spark, str(tmp_path)).collect()}
    assert plans and not any("MapInArrow" in plan for plan in plans)
    want = {r.table_id: [] for r in files.document_rows(spark, str(tmp_path)).select("table_id").collect()}
    for r in files.document_rows(spark, str(tmp_path)).orderBy("row_ix").collect():
        want[r.table_id].append(["" if c is None else c for c in r.cells])
    assert got == {(t, i, k): c for t, rows in want.items() for i, row in enumerate(rows) for k, c in enumerate(row)}
