"""The Jaccard join against all pairs, and its tree against plain bounds."""

import random

import numpy as np
import pytest

from cellweave.llm import jaccard
from cellweave.llm.components import components
from cellweave.llm.jaccard import JaccardJoin, SignatureTree, linked, one_of_each, tree_pairs

SCHEMA = "doc_id bigint, text string"


def brute(rows):
    """`{(doc_id, n_shingles, component_id)}` by comparing all pairs."""
    sets = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        sets.append((doc_id, {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()))
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted((d, len(s), root(d)) for d, s in sets)


def family(seed):
    """Near copies around the threshold, chains of edits, exact copies, a shared passage, and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(30)]
    texts = [None, "", " \t\n", "One", "one", "one two", "ONE two ", "two one", "a b c d", "A\tb c\rd", "a b c d e"]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(20, 90))]
        texts.append(" ".join(base))
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 22))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                base = copy
            texts.append(" ".join(copy))
    for _ in range(25):
        own = [word() for _ in range(rng.randint(5, 25))]
        texts.append(" ".join(own + passage))
    texts += rng.sample(texts, 8)
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("join", [JaccardJoin(), JaccardJoin(crowd=3, tile=4)], ids=["default", "small crowds"])
@pytest.mark.parametrize("seed", [1, 2])
def test_linked(spark, seed, join):
    """Every link is found, also where crowds are set aside and dealt into many tiles."""
    rows = family(seed)
    got = linked(spark.createDataFrame(rows, SCHEMA), join)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_long_text_and_rows_of_one_id(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(5, long), (3, long + " end"), (9, "x y z"), (9, "other words here"), (7, "x y z"), (None, "x y z"), (None, None)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {(5, 19_996, 3), (3, 19_997, 3), (7, 1, 7), (None, 1, 7), (None, 0, None)} <= got


def test_empty_table_and_clashing_columns(spark):
    assert linked(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "a b", 7, "x"), (2, "a b", 8, "y")], "doc_id bigint, text string, n bigint, token string")
    assert sorted(tuple(r) for r in linked(odd).collect()) == [(1, 1, 1), (2, 1, 1)]
    assert [r.n for r in one_of_each(odd).collect()] == [7]


def test_one_of_each_keeps_all_that_is_alone(spark):
    rows = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (None, "a b"), (6, "c"), (6, "c")]
    kept = one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 6]


@pytest.mark.parametrize("same", [True, False])
def test_tree_keeps_every_pair_that_may_link(same):
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64)) for _ in range(40)]
    sets = base + [np.unique(np.append(b[: rng.integers(40, 60)], rng.integers(0, 1 << 62, 3).astype(np.uint64))) for b in base for _ in range(3)]
    n = np.array([len(s) for s in sets])
    bits = np.stack([jaccard.bitmap_of(s) for s in sets]).view(np.uint64)
    classes = np.arange(len(sets)) // 2
    pick = rng.permutation(len(sets))
    left, right = (pick, pick) if same else (pick[:70], pick[70:])
    tree = lambda own: SignatureTree(n[own], bits[own], classes[own], fan=3)
    a, b = tree_pairs(tree(left), tree(right), JaccardJoin(), same)
    got = {frozenset((left[i], right[j])) for i, j in zip(a, b)}
    assert len(got) == len(a)
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            overlap = len(np.intersect1d(sets[x], sets[y]))
            if (not same or i < j) and classes[x] != classes[y] and 100 * overlap >= 75 * (n[x] + n[y] - overlap):
                assert frozenset((x, y)) in got
    assert len(got) < len(left) * len(right) / 8


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 3), (7, 8), (8, 9), (9, 7), (20, 20), (4, 10)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {n: got[n] for n in (1, 2, 3, 10, 4)} == dict.fromkeys((1, 2, 3, 10, 4), 1)
    assert got[9] == 7 and 20 not in got and got[130] == 100
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
