"""The manifest against trees that are built level by level."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import merkle
from cellweave.llm.queries import manifest_rows


def sha(text):
    return sha256(text.encode()).hexdigest()


def leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels(digests):
    """All levels of a tree, leaves first."""
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, i):
    """Per level, what stands left and right of the node in its run."""
    for level in tree[:-1]:
        begin = i // 8 * 8
        run = level[begin : begin + 8]
        yield "".join(run[: i - begin]), "".join(run[i - begin + 1 :])
        i //= 8


def by_hand(rows):
    """Rows of `(doc_id, source, lang, n_chars, text)` to the query's rows."""
    lower = {c: c + 32 for c in range(65, 91)}
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = [*siblings(trees[g], i), *siblings(top, place)]
            h = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                h = leaf(*r[:4], r[4] if r[4] is None else r[4].translate(lower))
            for left, right in path:
                h = sha(left + h + right)
            root = top[-1][0]
            out.append((r[0], own, trees[g][-1][0], root, sha("".join(a + b for a, b in path)), h, h == root))
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 513, 1000])
def test_places_in_the_log(n):
    """Every builder's nodes stand where `postorder` says, and all places are taken once."""
    tree = levels([sha(str(i)) for i in range(n)])
    log, nodes, level = {}, tree[0], 0
    while True:
        made = []
        for first in range(0, len(nodes), 8**merkle.STEP):
            for up, j, digest in merkle.completed(nodes[first : first + 8**merkle.STEP], first, level, n):
                if up > level or not level:
                    made.append(int(merkle.postorder(up, j, n)))
                    log[made[-1]] = digest
                    assert digest == tree[up][j]
            if first + 8**merkle.STEP >= len(nodes) and level == 0 and n <= 8**merkle.STEP:
                assert made == list(range(len(made)))  # completion order
        level += merkle.STEP
        if merkle.height(n) <= level:
            break
        nodes = tree[level]
    assert sorted(log) == list(range(sum(map(len, tree)))) and log[len(log) - 1] == tree[-1][0]


@pytest.mark.parametrize("step", [1, 2, 4])
def test_against_levels(spark, step):
    """Steps of one or two levels need several rounds of builders for few leaves."""
    rows = [(i * 7 % 1000 - 40, f"s{i % 3}", None if i % 11 == 0 else "lang" + "abbbb"[i % 5] * (i % 2), i, f"Text {i} ÄB") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    got = [tuple(r) for r in manifest_rows(docs, step).collect()]
    assert sorted(got) == sorted(by_hand(rows))
    assert {r[6] for r in got} == {True, False}


def test_many_groups(spark):
    rows = [(i, None, f"g{i % 150}", None, "A") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert sorted(tuple(r) for r in manifest_rows(docs).collect()) == sorted(by_hand(rows))


def test_odd_rows(spark):
    rows = [
        (1, None, None, None, None), (2, "", "", 0, ""), (None, "s", "en", 3, "no id"), (None, "s", "en", 3, "no id"), (None, None, None, None, None),
        (3, "S", "en", 5, "A:b\x00Ü" * 20_000), (4, "tie", "日本", 3, "X"), (4, "tie", "日本", 3, "X"), (4, "tie", "日本", 3, "x"), (-5, "a", "é", -1, "-"),
    ]
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [tuple(r) for r in manifest_rows(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=key) == sorted(by_hand(rows), key=key)
    assert manifest_rows(spark.createDataFrame([], schema)).count() == 0
    assert manifest_rows(spark.createDataFrame(rows[5:6], schema)).first().root == leaf(*rows[5])
    more = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], schema + ", ix int, leaf string, path string, block int")
    assert sorted((tuple(r) for r in manifest_rows(more).collect()), key=key) == sorted(by_hand(rows), key=key)


def test_log_can_be_written_and_read(spark, tmp_path):
    leaves = spark.range(300).select(F.lit("g").alias("group"), F.col("id").alias("ix"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    log = merkle.append_log(leaves, merkle.sizes_of(leaves))
    merkle.write_log(log, str(tmp_path / "log"))
    rows = merkle.read_log(spark, str(tmp_path / "log")).orderBy("pos").collect()
    tree = levels([sha(str(i)) for i in range(300)])
    assert [r.pos for r in rows] == list(range(sum(map(len, tree))))
    assert all(tree[r.level][r.j] == r.digest for r in rows)
    assert np.all(np.diff([r.pos for r in rows if r.level == 0]) >= 1)
