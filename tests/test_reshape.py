"""Reshaping steps on small ragged tables, in both layouts, and against brute force."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from cellweave import tables
from cellweave.operators import reshape
from cellweave.operators.grouping import AllRows, EmptyColumn, StaticRowCounts
from cellweave.tables import Layout, Running, in_chunks, layout_of, renumber, running, to_cells


def run(portions, rows_of, layout, tables, steps):
    df = reshape.concat_portions(portions(tables))
    return rows_of(reshape.sequence(df, steps, layout=layout))


FORM = [
    ["Ship", "", "Crew"], ["", "Mass", "(max)"], ["Gnat", "12", "3"], ["", "t", ""], ["", "", "or 4"], ["Wasp", "90", ""], ["", "", "11"],
]
FOLDED_FORM = [["Ship", "Mass", "Crew (max)"], ["Gnat", "12 t", "3 or 4"], ["Wasp", "90", "11"]]
UNEVEN = [["p", "q"], ["a", "b", "c", "d", "e", "f"], ["k"], [], ["w", "x", "y", "z"]]

CASES = {
    "no steps": ([[["h 1", "h 2"], ["x", "y"]]], [], [["h 1", "h 2"], ["x", "y"]]),
    "portions in order": ([[["a"], ["b"]], [["c"], ["d"]]], [], [["a"], ["b"], ["c"], ["d"]]),
    "cells are cleaned": ([[["  a\t b  c\n", " "]]], [], [["a b c", ""]]),
    "prepend": ([[["x", "y"]]], [reshape.prepend_row(["h1", "h2"])], [["h1", "h2"], ["x", "y"]]),
    "prepend twice": (
        [[["x"], ["y"], ["z"]]],
        [reshape.prepend_row(["h2"]), reshape.prepend_row(["h1"])],
        [["h1"], ["h2"], ["x"], ["y"], ["z"]],
    ),
    "fold a header": (
        [FORM[:3]],
        [reshape.fold_rows([StaticRowCounts((2,))])],
        [FOLDED_FORM[0], FORM[2]],
    ),
    "fold by counts": (
        [FORM],
        [reshape.fold_rows([StaticRowCounts((2, 3, 2))])],
        FOLDED_FORM,
    ),
    "fold by counts, then by empty column": (
        [FORM],
        [reshape.fold_rows([StaticRowCounts((2,)), EmptyColumn(0)])],
        FOLDED_FORM,
    ),
    "fold leading empty rows": (
        [[["", "a"], ["", "b"], ["x", "c"], [], ["", "d"]]],
        [reshape.fold_rows([EmptyColumn(0)])],
        [["", "a b"], ["x", "c d"]],
    ),
    "fold all, ragged": (
        [[["a1", "a2", "a3"], ["b1", "b2"], ["c1", "c2", "c3"]]],
        [reshape.fold_rows([AllRows()])],
        [["a1 b1 c1", "a2 b2 c2", "a3 c3"]],
    ),
    "fold counts past the end": (
        [[["a"], ["b"], ["c"]]],
        [reshape.fold_rows([StaticRowCounts((2, 5, 3)), AllRows()])],
        [["a b"], ["c"]],
    ),
    "fold empty rows": ([[[], [], ["a"]]], [reshape.fold_rows([StaticRowCounts((2,))])], [[], ["a"]]),
    "expand": (
        [[["2 kg @ 30 cr"], [], ["free"], ["11 kg @ 4 cr", "x"], ["2 kg @ 30 cr!"]]],
        [reshape.expand_column_on_regex(0, r"(\d+) (\w+) @ (\d+) cr", [r"\3", r"per \1", r"\2"], [r"?", r"\g<0>"])],
        [["30", "per 2", "kg"], [], ["?", "free"], ["4", "per 11", "kg", "x"], ["?", "2 kg @ 30 cr!"]],
    ),
    "expand a later column": (
        [[["q", "u", "lo-hi"], ["q", "u"], ["q", "u", "lo", "v"]]],
        [reshape.expand_column_on_regex(2, r"(?P<a>\w+)-(?P<b>\w+)", [r"\g<b>", r"\g<a>"], [r"\g<0>"])],
        [["q", "u", "hi", "lo"], ["q", "u"], ["q", "u", "lo", "v"]],
    ),
    "expand needs a full match": (
        [[["5-LOW!"], ["5-LOW"], ["5-LOW\n"]]],
        [reshape.expand_column_on_regex(0, r"(?P<num>\d)-(\w+)", [r"<\g<num>>", r"\2\\"], [r"no \g<0>"])],
        [["no 5-LOW!"], ["<5>", "LOW\\"], ["no 5-LOW"]],
    ),
    "expand by escaped signs": (
        [[["a\\Zb"], ["(?P<x>y)"], ["no"], ["aa"]]],
        [
            reshape.expand_column_on_regex(0, r"(\w)\\Z(\w)", [r"\2\1"], [r"\g<0>"]),
            reshape.expand_column_on_regex(0, r"\(\?P<x>(?P<in>\w)\)", [r"\g<in>!"], [r"\g<0>"]),
            reshape.expand_column_on_regex(0, r"(?P<one>a)(?P=one)\Z", ["twice"], [r"\g<0>"]),
        ],
        [["ba"], ["y!"], ["no"], ["twice"]],
    ),
    "expand into nothing": ([[["a", "b"]]], [reshape.expand_column_on_regex(0, "a", [], ["x"])], [["b"]]),
    "join 1 to 3": (
        [UNEVEN],
        [reshape.join_columns(1, 3, "/")],
        [["p", "q"], ["a", "b/c", "d", "e", "f"], ["k"], [], ["w", "x/y", "z"]],
    ),
    "join from 1": (
        [UNEVEN],
        [reshape.join_columns(from_=1, delim="/")],
        [["p", "q"], ["a", "b/c/d/e/f"], ["k"], [], ["w", "x/y/z"]],
    ),
    "join to 3": (
        [UNEVEN],
        [reshape.join_columns(to=3, delim="/")],
        [["p/q"], ["a/b/c", "d", "e", "f"], ["k"], [], ["w/x/y", "z"]],
    ),
    "join all": (
        [UNEVEN],
        [reshape.join_columns(delim="/")],
        [["p/q"], ["a/b/c/d/e/f"], ["k"], [], ["w/x/y/z"]],
    ),
    "join an empty range": ([[["a", "b", "c"]]], [reshape.join_columns(2, 1, "-")], [["a", "b", "c"]]),
    "split": (
        [[["Port / Yard /Depot", "k"], ["/"], ["none"], [], ["", "m", "n"]]],
        [reshape.split_column(0, r" ?/ ?")],
        [["Port", "Yard", "Depot", "k"], ["", ""], ["none"], [], ["", "m", "n"]],
    ),
    "wrap": (
        [[["n1"], ["n2", "n3", "n4", "n5"], [], ["n6", "n7", "n8"]]],
        [reshape.wrap_row_every_n(3)],
        [["n1", "n2", "n3"], ["n4", "n5", "n6"], ["n7", "n8"]],
    ),
    "transpose": (
        [[["a"], ["b", "c"], [], ["d", "e", "f"]]],
        [reshape.transpose()],
        [["a", "b", "", "d"], ["", "c", "", "e"], ["", "", "", "f"]],
    ),
    "transpose nothing": ([[[], []]], [reshape.transpose()], []),
    "wrap then transpose": (
        [[["a", "b", "c"], ["d", "e", "f"]]],
        [reshape.wrap_row_every_n(2), reshape.transpose()],
        [["a", "c", "e"], ["b", "d", "f"]],
    ),
    "fold, split, transpose, expand, prepend": (
        [[["a 1, b", "x"], ["2, c 3", "y"]]],
        [
            reshape.fold_rows([AllRows()]),
            reshape.split_column(0, r",\s*"),
            reshape.transpose(),
            reshape.expand_column_on_regex(0, r"(\w) (\d)", [r"\1", r"\2"], [r"\g<0>", ""]),
            reshape.prepend_row(["k", "n"]),
        ],
        [["k", "n"], ["a", "1"], ["b", "2"], ["c", "3"], ["x y", ""]],
    ),
}


ROW_LOCAL = {name for name in CASES if name.split()[0] in ("no", "portions", "cells", "expand", "join", "split")}


@pytest.mark.parametrize("name", CASES)
def test_steps(portions, rows_of, layout, name):
    if layout.chunked and name in ROW_LOCAL:
        pytest.skip("steps within a row do not depend on the layout")
    tables, steps, expected = CASES[name]
    assert run(portions, rows_of, layout, tables, steps) == expected


def test_prepend_reaches_tables_without_rows(spark, portions, rows_of, layout):
    df = reshape.concat_portions(portions({"t": [[["x"]]]}))
    tables = spark.createDataFrame([("t",), ("empty",)], "table_id string")
    out = reshape.sequence(df, [reshape.prepend_row(["h"], tables)], layout=layout)
    assert rows_of(out) == [["h"], ["x"]]
    assert rows_of(out, "empty") == [["h"]]


def test_wrap_width_is_checked():
    with pytest.raises(ValueError):
        reshape.wrap_row_every_n(0)


def test_template_groups_are_checked(portions):
    df = reshape.concat_portions(portions([[["a"]]]))
    with pytest.raises(ValueError):
        reshape.sequence(df, [reshape.expand_column_on_regex(0, "(a)", [r"\2"], [])], layout=Layout(False))


def random_tables(seed):
    rng = random.Random(seed)
    cell = lambda: rng.choice(["", "", "a", "b 1", "c, d", "x"])
    table = lambda n: [[cell() for _ in range(rng.randint(0, 4))] for _ in range(n)]
    return {"big": [table(40), table(1)], "small": [table(3)], "one": [table(1)]}


def brute_fold(rows, counts, column):
    groups, rest, at = [], [], 0
    for n in counts:
        groups.append(rows[at : at + n])
        at += n
    for row in rows[at:]:
        if rest and (len(row) <= column or row[column] == ""):
            rest[-1].append(row)
        else:
            rest.append([row])
    out = []
    for group in [g for g in groups + rest if g]:
        width = max(map(len, group))
        out.append([" ".join(r[i] for r in group if len(r) > i and r[i]) for i in range(width)])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(portions, rows_of, layout, seed):
    tables = random_tables(seed)
    df = reshape.concat_portions(portions(tables))
    flat = {name: [row for part in parts for row in part] for name, parts in tables.items()}

    folded = reshape.sequence(df, [reshape.fold_rows([StaticRowCounts((3, 2)), EmptyColumn(0)])], layout=layout)
    wrapped = reshape.sequence(df, [reshape.wrap_row_every_n(3)], layout=layout)
    turned = reshape.sequence(df, [reshape.transpose()], layout=layout)
    turned_cells = {
        (r.table_id, r.row_ix, r.col_ix): r.cell for r in reshape.transpose_cells(df, layout).collect()
    }
    dense = {(r.table_id, r.row_ix): r.cells for r in renumber(df, layout).collect()}
    for name, rows in flat.items():
        assert rows_of(folded, name) == brute_fold(rows, [3, 2], 0)
        cells = [c for row in rows for c in row]
        assert rows_of(wrapped, name) == [cells[i : i + 3] for i in range(0, len(cells), 3)]
        width = max(map(len, rows))
        expected = [[row[i] if i < len(row) else "" for row in rows] for i in range(width)]
        assert rows_of(turned, name) == expected
        assert {k[1:]: v for k, v in turned_cells.items() if k[0] == name} == {
            (i, j): c for i, row in enumerate(expected) for j, c in enumerate(row)
        }
        assert [dense[name, i] for i in range(len(rows))] == rows


@given(
    rows=st.lists(st.lists(st.sampled_from(["a", "b c", "1"]), min_size=3, max_size=3), min_size=1, max_size=9),
    width=st.integers(1, 5),
)
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_laws(portions, rows_of, rows, width):
    """Turning twice and folding single rows change nothing; wrapping keeps the cells in order."""
    df = reshape.concat_portions(portions([rows]))
    whole = Layout(chunked=False)
    assert rows_of(reshape.sequence(df, [reshape.transpose(), reshape.transpose()], layout=whole)) == rows
    assert rows_of(reshape.sequence(df, [reshape.fold_rows([StaticRowCounts((1,) * len(rows))])], layout=whole)) == rows
    wrapped = rows_of(reshape.sequence(df, [reshape.wrap_row_every_n(width)], layout=whole))
    assert [c for row in wrapped for c in row] == [c for row in rows for c in row]
    assert all(len(row) == width for row in wrapped[:-1])


def test_layout_follows_the_longest_table(portions):
    df = portions({"a": [[["x"]] * 5], "b": [[["x"]]]})
    assert layout_of(df, bits=2).chunked
    assert not layout_of(df, bits=3).chunked


def test_small_tables_share_one_exchange(portions):
    """Consecutive steps on small tables are grouped on `table_id` once."""
    df = reshape.concat_portions(portions([FORM])).repartition(3)
    steps = [
        reshape.fold_rows([StaticRowCounts((2,)), EmptyColumn(0)]),
        reshape.wrap_row_every_n(2),
        reshape.fold_rows([EmptyColumn(0)]),
    ]
    plan = reshape.sequence(df, steps, layout=Layout(chunked=False))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan


def test_cells_form(portions):
    out = to_cells(portions([[["a", "b"], [], ["c"]]]))
    assert sorted(map(tuple, out.collect())) == [("t", 0, 0, "a"), ("t", 0, 1, "b"), ("t", 2, 0, "c")]


def test_rows_are_counted_again_after_steps_that_add_some(portions, rows_of):
    """One wide row becomes many rows: the steps after it must not trust the first count."""
    seen = []

    def look(df, layout):
        seen.append(layout.chunked)
        return df

    df = reshape.concat_portions(portions([[[str(i) for i in range(50)]]]))
    steps = [look, reshape.wrap_row_every_n(1), look, reshape.fold_rows([StaticRowCounts((7,)), AllRows()])]
    out = reshape.sequence(df, steps, layout=Layout(chunked=False, bits=3))
    assert seen == [False, True]
    assert rows_of(out) == [[" ".join(map(str, range(7)))], [" ".join(map(str, range(7, 50)))]]


def test_a_row_number_that_does_not_fit_fails(spark):
    df = spark.createDataFrame([("t", 0, 1 << 32, ["a"])], "table_id string, part_ix int, row_ix bigint, cells array<string>")
    with pytest.raises(Exception, match="does not fit in a portion"):
        reshape.concat_portions(df).collect()


def test_long_tables_take_their_own_route(spark, rows_of, monkeypatch):
    """One table of many rows and a thousand small ones: no row of a small one is dealt out by chunks."""
    small = [(f"s{t}", i, [str(i), ""]) for t in range(1000) for i in range(3)]
    long = [("long", i, [str(i) if i % 4 == 0 else "", "x"]) for i in range(900)]
    df = spark.createDataFrame(small + long, "table_id string, row_ix bigint, cells array<string>").repartition(4)
    dealt = []

    def spy(part, layout, *more):
        dealt.append({r.table_id for r in part.select("table_id").distinct().collect()})
        return in_chunks(part, layout, *more)

    for module in (reshape, tables):
        monkeypatch.setattr(module, "in_chunks", spy)
    steps = [reshape.fold_rows([EmptyColumn(0)]), reshape.wrap_row_every_n(3), reshape.prepend_row(["h"])]
    out = reshape.sequence(df, steps, layout=None)
    monkeypatch.setattr(reshape, "CHUNK_BITS", 6)
    mixed = reshape.sequence(df, steps).cache()
    assert dealt and all(names == {"long"} for names in dealt)
    for name in ("long", "s0", "s999"):
        assert rows_of(mixed, name) == rows_of(out, name)
    assert mixed.count() == out.count()


@pytest.mark.parametrize("n_values", [1, 3])
def test_running_values_share_one_exchange(spark, n_values):
    """Rows that are dealt out by chunks take any number of running values without another exchange of rows."""
    df = spark.range(4000).selectExpr("'t' table_id", "id row_ix", "array(cast(id % 7 as string)) cells")
    layout = Layout(chunked=True, bits=6)
    rows = in_chunks(tables.cut_lineage(df), layout)
    for i in range(n_values):
        filled = F.when(F.get("cells", F.lit(0)) == str(i), 1).otherwise(0)
        rows = running(rows, {f"v{i}": Running("sum", filled + (F.col(f"v{i - 1}") if i else 0))}, layout)
    plan = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"Exchange\s+Input \[\d+\]: \[(.*?)\]", plan)
    assert sum("cells" in columns for columns in moved) == 1  # the others move totals
    assert rows.agg(F.max("v0")).first()[0] == 572


@pytest.mark.parametrize("seed", range(3))
def test_steps_on_cells(spark, portions, layout, seed):
    """After a transposition, the same cells as by rows, but for rows without cells."""
    rng = random.Random(seed)
    cell = lambda: rng.choice(["", "a", "b 1", "c 22", "x"])
    given = {name: [[[cell() for _ in range(rng.randint(0, 4))] for _ in range(n)]] for name, n in (("big", 30), ("small", 3), ("one", 1))}
    df = reshape.concat_portions(portions(given))
    expand = reshape.expand_column_on_regex(1, r"(\w) (\d+)", [r"\2", r"\1", "m"], [r"\g<0>"])
    shrink = reshape.expand_column_on_regex(0, "a", [], [r"\g<0>"])
    chains = [
        [reshape.transpose()],
        [reshape.wrap_row_every_n(3), reshape.transpose(), reshape.wrap_row_every_n(4)],
        [reshape.transpose(), expand, shrink, reshape.prepend_row(["h", "i"])],
        [reshape.transpose(), reshape.fold_rows([StaticRowCounts((2,)), EmptyColumn(0)]), reshape.transpose()],
        [reshape.transpose(), reshape.fold_rows([AllRows()]), reshape.wrap_row_every_n(2)],
        [reshape.fold_rows([StaticRowCounts((2, 2))])],
    ]
    for steps in chains:
        by_rows = reshape.sequence(df, steps, layout=layout).filter(F.size("cells") > 0)
        want = {tuple(r) for r in to_cells(renumber(by_rows, layout)).collect()}
        cells = reshape.sequence_cells(df, steps, layout=layout)
        order = {r.table_id: sorted(r.rows) for r in cells.groupBy("table_id").agg(F.collect_set("row_ix").alias("rows")).collect()}
        got = [(r.table_id, order[r.table_id].index(r.row_ix), r.col_ix, r.cell) for r in cells.collect()]
        assert set(got) == want and len(got) == len(want)


def test_cells_know_their_steps(portions):
    df = reshape.concat_portions(portions([[["a"]]]))
    with pytest.raises(ValueError, match="steps \\[1\\]"):
        reshape.sequence_cells(df, [reshape.transpose(), reshape.join_columns()])
