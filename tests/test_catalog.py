"""Tags, indexes, merging, auditing and bookkeeping."""

import pytest
from pyspark.sql import functions as F

from cellweave.operators import catalog as cat
from cellweave.plans import extraction
from cellweave.sources.worldfiles import format_index, parse_index


def paths(df, column="table_path"):
    return sorted(r[column] for r in df.collect())


def index(spark, rows):
    return spark.createDataFrame(rows, "table_path string, pages array<int>, tags array<string>")


def test_index_lookup(spark):
    df = index(spark, [("a.csv", [1], ["1", "2"]), ("b.csv", [5], ["2", "3"])])
    inverted = cat.inverted_index(df)
    for tags, want in [([], ["a.csv", "b.csv"]), (["1"], ["a.csv"]), (["2"], ["a.csv", "b.csv"]), (["2", "3"], ["b.csv"]), (["1", "3"], [])]:
        assert paths(cat.paths_with_all_tags(df, inverted, tags)) == want
        assert paths(cat.with_all_tags(df, tags)) == want


def test_index_upsert(spark):
    old = index(spark, [("a.csv", [1], ["1", "2"]), ("b.csv", [5], ["2"])]).withColumn("note", F.lit("kept"))
    new = index(spark, [("a.csv", [12, 3], ["4", "3"]), ("c.csv", [], [])])
    once = cat.upsert_index(old, new)
    rows = {r.table_path: tuple(r)[1:] for r in format_index(once).collect()}
    assert rows == {"a.csv": ("3;12", "3;4", None), "b.csv": ("5", "2", "kept"), "c.csv": ("", "", None)}
    again = {r.table_path: tuple(r)[1:] for r in format_index(cat.upsert_index(once, new)).collect()}
    assert again == rows
    back = parse_index(format_index(once)).filter("table_path = 'a.csv'").first()
    assert (back.pages, back.tags) == ([3, 12], ["3", "4"])


def test_choice_of_tables(spark):
    df = index(spark, [("a", [], ["x", "y"]), ("b", [], ["y", "z"]), ("c", [], [])])
    assert paths(cat.with_any_tag(df, ["x", "z"])) == ["a", "b"]
    assert paths(cat.with_any_tag(df, [])) == ["a", "b", "c"]
    assert paths(cat.without_tags(df, ["x"])) == ["b", "c"]
    with pytest.raises(ValueError, match="x"):
        cat.check_tag_lists(["x", "y"], ["x"])
    assert cat.only_row(df.filter("table_path = 'a'"), "a").count() == 1
    for bad in ("table_path < 'c'", "table_path > 'c'"):
        with pytest.raises(ValueError, match="exactly 1"):
            cat.only_row(df.filter(bad), "it")


def test_inherited_tags_and_work_list(spark):
    rows = [
        ("b", "group", ["book/b"], False, None),
        ("b/g", "group", ["g", "x"], False, None),
        ("b/g/t1", "table", ["x", "own"], False, "fold"),
        ("b/t2", "table", [], False, None),
        ("b/g/t3", "table", ["own"], True, None),
        ("b/g/t4", "table", ["skip"], False, "fold"),
    ]
    catalog = spark.createDataFrame(rows, "path string, kind string, tags array<string>, disabled boolean, transform string")
    tags = {r.path: r.tags for r in cat.inherit_tags(catalog).collect()}
    assert tags["b/g/t1"] == ["book/b", "g", "own", "x"] and tags["b/t2"] == ["book/b"]
    done = spark.createDataFrame([("b/t2.csv",)], "table_path string")
    choose = lambda **kw: [r.out_path for r in extraction.work_list(catalog, done, extraction.Choice(**kw)).collect()]
    assert choose(without_tags=["skip"]) == ["b/g/t1.csv"]
    assert choose(overwrite=True) == ["b/g/t1.csv", "b/g/t4.csv", "b/t2.csv"]
    assert choose(with_tags=["own"]) == ["b/g/t1.csv"]


def test_merge_records(spark):
    schema = "id int, name string, place struct<x:int,tags:array<string>>"
    a = spark.createDataFrame([(1, "n", (1, None)), (2, "n", None), (3, None, (3, ["t"]))], schema)
    b = spark.createDataFrame([(1, None, (None, ["u"])), (2, "other", (2, None)), (4, "only", None)], schema)
    got = {r.id: (r.name, r.place and tuple(r.place), r.conflicts) for r in cat.merge_records(a, b, "id").collect()}
    assert got == {
        1: ("n", (1, ["u"]), []),
        2: (None, (2, None), ["name"]),
        3: (None, (3, ["t"]), []),
        4: ("only", None, []),
    }


def test_audit(spark):
    tables = spark.createDataFrame([("a", "t"), ("b", None), ("c", None)], "path string, transform string")
    templates = spark.createDataFrame([("a",), ("b",), ("d",)], "path string")
    assert sorted(map(tuple, cat.audit(tables, templates).collect())) == [
        ("b", "no extraction configured"), ("c", "table without template"), ("d", "template without table"),
    ]


def test_names_by_position(spark):
    df = spark.createDataFrame([("g", 2), ("g", 1), ("h", 1)], "grp string, y int")
    named, errors = cat.name_by_position(df, "grp", [F.col("y")], ["first", "second"])
    assert sorted((r.grp, r.y, r.name) for r in named.collect()) == [("g", 1, "first"), ("g", 2, "second")]
    assert list(map(tuple, errors.collect())) == [("h", 1, 2)]


def test_validation(spark):
    check = lambda fn, values: [
        r.ok for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(fn(F.col("v")).alias("ok")).collect()
    ]
    odd = [f"with{c}punctuation" for c in ",\"\\' {(#&=+."]
    assert check(cat.valid_name, ["valid-name-123", "valid_name_123", "invalid/name", "", *odd]) == [True, True] + [False] * (2 + len(odd))
    tags = ["valid_tag", "valid-tag", "another/valid/tag", "/invalid/tag", "invalid/tag/", "invalid//tag", *odd]
    assert check(cat.valid_tag, tags) == [True] * 3 + [False] * (3 + len(odd))
    assert check(cat.valid_node_id, ["a", "A-1", "-a", "a-", "a_b", "a\n"]) == [True, True] + [False] * 4
    assert check(cat.valid_relative_path, ["a/b", "a/./b", "/a", "./a", "a/../b", ".."]) == [True, True] + [False] * 4


def test_categories(spark):
    df = spark.createDataFrame([("cutter-small-craft",), ("scout-type-s",), ("lab-class-x-y",), ("yacht",)], "stem string")
    name, category = cat.craft_name_and_category(F.col("stem"))
    assert [tuple(r) for r in df.select(name, category).collect()] == [
        ("cutter", "category/small-craft"), ("scout", "spacecraft-type/s"), ("lab", "spacecraft-class/x-y"), ("yacht", ""),
    ]


def test_incremental_and_outcomes(spark):
    work = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "id string, content string")
    keyed = work.withColumn("key", cat.content_key(F.col("content"), [F.lit("v1")]))
    assert keyed.select("key").distinct().count() == 2
    assert keyed.select(cat.content_key(F.col("content"), [F.lit("v2")]).alias("key")).join(keyed, "key").count() == 0
    stored = keyed.filter("id = 'a'").select("key", F.lit("old").alias("result"))
    fresh = cat.new_work(keyed, stored)
    assert paths(fresh, "id") == ["b"]
    both = cat.stored_and_fresh(keyed, stored, fresh.select("key", F.lit("new").alias("result")))
    assert sorted(r.result for r in both.collect()) == ["new", "old"]
    tables = spark.createDataFrame([("a",), ("b",), ("c",)], "table_id string")
    errors = spark.createDataFrame([("b", "no table in region"), ("b", "another")], "table_id string, error string")
    out = cat.outcomes(tables, tables.filter("table_id < 'c'"), errors)
    assert sorted(map(tuple, out.collect())) == [("a", True, None), ("b", False, "another"), ("c", False, "no output")]


def test_last_row_of_a_repeated_code(spark):
    codes = spark.createDataFrame([("A", "old", 1), ("B", "b", 2), ("A", "new", 3), ("C", "y", 4), ("C", "x", 4)], "code string, classification string, at int")
    df = spark.createDataFrame([(1, ["A", "B"]), (2, ["Q"]), (3, ["C"])], "k int, codes array<string>")
    got = {r.k: (r.classes, r.unknown) for r in cat.resolve_codes(df, "k", "codes", codes, False, "at").collect()}
    assert got == {1: (["b", "new"], []), 2: ([], ["Q"]), 3: (["y"], [])}
    assert cat.resolve_codes(df, "k", "codes", codes, False).filter("k = 1").first().classes == ["b", "old"]


def test_merge_whole_fields_and_maps(spark):
    schema = "id int, whole struct<p:int,q:int>, parts struct<p:int,q:struct<r:int>>, m map<string,int>"
    a = spark.createDataFrame([(1, (1, None), (1, None), {"a": 1, "b": 2}), (2, (1, 2), (1, (2,)), {"a": 1}), (3, None, None, None)], schema)
    b = spark.createDataFrame([(1, (1, 5), (1, (5,)), {"b": 2, "a": 1}), (2, (1, 2), (3, (2,)), {"a": 2}), (3, (7, None), None, {})], schema)
    got = {r.id: r for r in cat.merge_records(a, b, "id", ("whole",)).collect()}
    assert got[1].whole is None and got[1].conflicts == ["whole"] and got[1].parts.q.r == 5 and got[1].m == {"a": 1, "b": 2}
    assert tuple(got[2].whole) == (1, 2) and sorted(got[2].conflicts) == ["m", "parts.p"]
    assert tuple(got[3].whole) == (7, None) and got[3].m == {} and got[3].conflicts == []
    # By field, the same records only complete each other.
    assert cat.merge_records(a, b, "id").filter("id = 1").first().conflicts == []
    nested = cat.merge_records(a, b, "id", ("parts.q",)).filter("id = 1").first()
    assert nested.parts.q.r == 5 and nested.conflicts == []
