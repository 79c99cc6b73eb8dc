"""Hard negatives against a comparison of every anchor with every row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import hardnegatives
from cellweave.llm.hardnegatives import Mining, MultiIndex

SMALL = Mining(positives=3, negatives=4, index=MultiIndex(codewords=4, sample=200, first_rows=40, shelf_rows=32, block_anchors=4))


def by_hand(rows, is_anchor, mining):
    """The definition, pair by pair, in whole numbers."""
    rows = [(i, label, tuple(math.floor(mining.scale * x) for x in v)) for i, label, v in rows]
    size = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, label, v + (0,) * (size - len(v))) for i, label, v in rows]
    out = []
    for i, label, v in sorted({r for r in rows if is_anchor(r[0])}):
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, own) for j, own, w in rows if j != i)
        for score, j, _ in [s for s in scored if s[2] == label][: mining.positives]:
            inside = [s for s in scored if s[2] != label and mining.low * -score <= mining.whole * -s[0] <= mining.high * -score]
            out += [(i, j, n, s[1], -score, -s[0]) for n, s in enumerate(inside[: mining.negatives], 1)]
    return sorted(out)


def mined(spark, rows, mining, every=5):
    vectors = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    return hardnegatives.mine(hardnegatives.usable(vectors), F.col("vec_id") % every == 0, mining)


@pytest.mark.parametrize("kind", ["clusters", "noise", "ties"])
def test_all_pairs(spark, kind):
    rng = np.random.default_rng(7)
    if kind == "clusters":
        centres = rng.normal(0, 1, (6, 8))
        x = centres[rng.integers(0, 6, 240)] + rng.normal(0, 0.2, (240, 8))
    elif kind == "noise":
        x = rng.normal(0, 1, (240, 7))
    else:
        x = rng.integers(-1, 2, (240, 4)) / 4
    x = x.astype(np.float32)
    rows = [(i, int(rng.integers(0, 3)), [float(c) for c in v]) for i, v in enumerate(x)]
    got = mined(spark, rows, SMALL).collect()
    assert sorted(map(tuple, got)) == by_hand(rows, lambda i: i % 5 == 0, SMALL) and got


def test_a_walk_visits_pairs_by_falling_sum():
    rng = np.random.default_rng(1)
    one, two = rng.normal(size=5), rng.normal(size=7)
    pairs = list(hardnegatives.walk(one, two))
    assert len({(i, j) for i, j, _ in pairs}) == 35
    assert [round(s, 9) for *_, s in pairs] == sorted((round(x + y, 9) for x in one for y in two), reverse=True)


def test_bounds_hold_and_leave_cells_out():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 3, (50, 6)) for c in (0, 200, -200, 500)]).astype(np.int64)
    books = [hardnegatives.codebook(part.astype(float), 3, 5) for part in (x[:, :3], x[:, 3:])]
    none = np.zeros(0)
    known = hardnegatives.Directory(*books, none, none, none, none, none)
    cell, left, right = known.place(x)
    n = len(books[0]) * len(books[1])
    known.rows = np.bincount(cell, minlength=n)
    known.radius_left, known.radius_right = np.zeros(n), np.zeros(n)
    np.maximum.at(known.radius_left, cell, left)
    np.maximum.at(known.radius_right, cell, right)
    for a in x[::20]:
        one, two, low, high = known.bounds(a)
        score = x @ a
        i, j = cell // len(two), cell % len(two)
        assert (low[i, j] <= score).all() and (score <= high[i, j]).all() and (high[i, j] <= one[i] + two[j] + 1e-6).all()
    top = [{"low": int((x @ x[-1]).max()), "high": hardnegatives.LONG}]
    assert 0 < len(hardnegatives.cells_to_visit(known, x[-1], top, set(), float("inf"))) < np.count_nonzero(known.rows)


def test_large_numbers_are_exact():
    a, x = np.array([[3_000_000_000, 1]]), np.array([[3_000_000_000, 7], [-1, 5]])
    assert hardnegatives.products(a, x).tolist() == [[9_000_000_000_000_000_007, -2_999_999_995]]


def test_odd_rows(spark):
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [0.5, 0.5]), (2, 2, [0.25, 0.5]), (2, 2, [0.25, 0.5]), (3, 2, [0.25]), (0, 2, [0.25, 0.25]),
        (5, None, [1.0, 1.0]), (6, 2, None), (7, 2, [None, 1.0]), (8, 2, [float("nan"), 1.0]), (9, 2, [float("inf"), 1.0]),
        (None, 2, [0.5, 0.5]), (10, 1, []), (10, 1, []), (15, 3, [3e38, -3e38]), (20, 2, [0.0, 0.0]), (25, 2, [-1.0, -1.0]),
    ]
    kept = [(i, label, [float(c) for c in v]) for i, label, v in rows if None not in (i, label, v) and None not in v and all(map(math.isfinite, v)) and i != 15]
    small = Mining(positives=5, negatives=10, index=MultiIndex(codewords=2, first_rows=1, shelf_rows=2, block_anchors=1))
    got = mined(spark, [r for r in rows if r[0] != 15], small)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == by_hand(kept, lambda i: i % 5 == 0, small)
    assert mined(spark, rows, small).count() >= 0  # components beyond what scores can hold
    assert mined(spark, rows[:0], small).count() == 0 and mined(spark, rows[1:2], small).count() == 0
    # Columns of other names, also such as the operator uses, are ignored.
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows if r[0] != 15], "vec_id bigint, label int, embedding array<float>, cell int, shelf int")
    again = hardnegatives.mine(hardnegatives.usable(vectors), F.col("vec_id") % 5 == 0, small)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
