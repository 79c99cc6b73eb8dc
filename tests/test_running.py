"""Ordered running values in both layouts against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.tables import Layout, Running, in_order, in_order_sorted, ordered_items, running


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = []
    for table, n in {"a": 47, "b": 3, "c": 1}.items():
        places = sorted(rng.sample(range(600), n))
        rows += [(table, p, rng.randint(-3, 3), rng.choice([None, "x", "y", "z"])) for p in places]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "table_id string, row_ix bigint, n bigint, s string").repartition(3)


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running(data, layout, inclusive, reverse):
    rows, df = data
    out = running(
        df,
        {
            "total": Running("sum", F.col("n"), inclusive),
            "top": Running("max", F.col("n"), inclusive),
            "last": Running("last", F.col("s"), inclusive),
        },
        layout,
        reverse=reverse,
    )
    got = {(r.table_id, r.row_ix): (r.total, r.top, r.last) for r in out.collect()}
    for table in "abc":
        ordered = sorted((r for r in rows if r[0] == table), key=lambda r: r[1], reverse=reverse)
        for i, row in enumerate(ordered):
            seen = ordered[: i + inclusive]
            filled = [r[3] for r in seen if r[3] is not None]
            expected = (
                sum(r[2] for r in seen),
                max((r[2] for r in seen), default=None),
                filled[-1] if filled else None,
            )
            assert got[table, row[1]] == expected
    assert len(got) == len(rows)


def test_in_order(data):
    rows, df = data
    order = [F.col("n"), F.col("row_ix")]
    expected = {}
    for table in "abc":
        placed = sorted((r for r in rows if r[0] == table), key=lambda r: (r[2], r[1]))
        expected.update({(table, r[1]): i for i, r in enumerate(placed)})
    for out in (
        in_order(df, ("table_id",), order, "place"),
        in_order_sorted(df, ("table_id",), order, Layout(True, bits=2), "place"),
    ):
        assert {(r.table_id, r.row_ix): r.place for r in out.collect()} == expected


def test_ordered_items(data, layout):
    rows, df = data
    got = {r.table_id: r["items"] for r in ordered_items(df, ["table_id"], "row_ix", F.col("n"), layout).collect()}
    assert got == {t: [r[2] for r in sorted(rows, key=lambda r: r[1]) if r[0] == t] for t in "abc"}
