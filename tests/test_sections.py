"""Sectioning against a line by line walk, in both layouts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cellweave.operators import sections as sec
from cellweave.operators.reshape import concat_portions

SUFFIX, MARKER = " SKILLS PACKAGE", "Skills:"


def as_lines(spark, tables):
    rows = [(name, i * 3, line) for name, lines in tables.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "table_id string, row_ix bigint, line string")


def walk_packages(lines):
    found, state = [], "seek"
    for line in lines:
        heading = line.endswith(SUFFIX) and line != SUFFIX
        if heading and state != "description":
            found.append([line[: -len(SUFFIX)], [], []])
            state = "description"
        elif state == "description":
            if line == MARKER:
                state = "list"
            else:
                found[-1][1].append(line)
        elif state == "list":
            found[-1][2].append(line)
    return [(n, " ".join(d), " ".join(t)) for n, d, t in found]


def walk_titles(lines):
    records, items, state, item = [], [], "find", None
    for line in lines:
        words = line.split(" ")
        if len(words) <= 2 and line != "Specialities" and all(re.search("[A-Z][a-z]+", w) for w in words):
            records.append([line, []])
            state, item = "desc", None
        elif state == "desc":
            if line == "Specialities":
                state = "wait"
            elif ":" in line:
                state = "find"
            else:
                records[-1][1].append(line)
        elif state == "wait" and line.startswith("• "):
            item = [line]
            items.append(item)
            state = "spec"
        elif state == "spec":
            if line.startswith("• "):
                item = [line]
                items.append(item)
            elif ":" in line:
                state = "wait"
            else:
                item.append(line)
    return [(n, " ".join(d)) for n, d in records], [" ".join(i) for i in items]


PACKAGE_LINES = ["A B SKILLS PACKAGE", "C SKILLS PACKAGE", " SKILLS PACKAGE", "Skills:", "Admin 1, Vacc", "Suit 0,", "text"]
TITLE_LINES = ["Admin", "Vacc Suit", "Specialities", "• One: first", "• two", "Note: x", "more text here", "low case", "", "• A: b: c"]


@pytest.mark.parametrize("seed", range(3))
def test_suffix_sections(spark, layout, seed):
    rng = random.Random(seed)
    tables = {str(t): [rng.choice(PACKAGE_LINES) for _ in range(rng.randint(0, 40))] for t in range(12)}
    out = sec.suffix_sections(as_lines(spark, tables), SUFFIX, MARKER, layout).orderBy("section_ix").collect()
    for name, lines in tables.items():
        got = [(r.name, r.description, r.list_text) for r in out if r.table_id == name]
        assert got == walk_packages(lines)


@pytest.mark.parametrize("seed", range(3))
def test_title_sections(spark, layout, seed):
    rng = random.Random(seed)
    tables = {str(t): [rng.choice(TITLE_LINES) for _ in range(rng.randint(0, 50))] for t in range(12)}
    marked = sec.title_sections(as_lines(spark, tables), "Specialities", layout).cache()
    records = sec.section_records(marked, layout).orderBy("section_ix").collect()
    items = sec.section_items(marked, layout).orderBy("item_ix").collect()
    for name, lines in tables.items():
        want_records, want_items = walk_titles(lines)
        assert [(r.name, r.description) for r in records if r.table_id == name] == want_records
        assert [r.text for r in items if r.table_id == name] == want_items


def test_item_fields(spark, layout):
    lines = ["Animals", "Specialities", "• Riding: ride", "a horse", "• no colon", "Example: skip", "ignored", "• Care (DEX): tend: them"]
    marked = sec.title_sections(as_lines(spark, {"t": lines}), "Specialities", layout)
    items = sec.section_items(marked, layout).orderBy("item_ix").collect()
    assert [(r.name, r.description) for r in items] == [("Riding", "ride a horse"), (None, None), ("Care (DEX)", "tend: them")]


def test_pairs(spark):
    df = spark.createDataFrame([("Admin 1, Vacc Suit 0,  Gun-Combat (any) 2 tail",), ("",)], "t string")
    got = [[(p["name"], p["level"]) for p in r.p] for r in df.select(sec.name_level_pairs(F.col("t")).alias("p")).collect()]
    assert got == [[("Admin", 1), ("Vacc Suit", 0), ("Gun-Combat (any)", 2)], []]


def test_sparse_rows(spark):
    parents = spark.createDataFrame([("t", 5, "B", "b"), ("t", 1, "A", "a")], "table_id string, section_ix bigint, name string, d string")
    children = spark.createDataFrame(
        [("t", 1, 0, "x", 2), ("t", 5, 1, "z", 0), ("t", 5, 0, "y", 1)],
        "table_id string, section_ix bigint, child_ix bigint, name string, level int",
    )
    blank = F.lit("")
    out = sec.sparse_rows(
        parents, [F.col("name"), blank, blank, F.col("d")], children, [blank, F.col("name"), F.col("level").cast("string"), blank]
    )
    assert [r.cells for r in out.orderBy("row_ix").collect()] == [
        ["A", "", "", "a"], ["", "x", "2", ""], ["B", "", "", "b"], ["", "y", "1", ""], ["", "z", "0", ""],
    ]


def test_ditto_and_patch(portions, rows_of, layout):
    rows = [["", "0"], ["a", "1"], ["", "2"], [], ["b", "4"], ["c", "5"], ["", "6"]]
    df = concat_portions(portions([rows]))
    patched = sec.append_next_row(df, 4, 0, layout)
    assert rows_of(patched)[4:6] == [["b c", "4"], ["", "5"]]
    filled = rows_of(sec.ditto_fill(patched, 0, layout))
    assert [r[0] if r else None for r in filled] == ["", "a", "a", None, "b c", "b c", "b c"]
    assert rows_of(sec.append_next_row(df, 6, 0, layout)) == rows
