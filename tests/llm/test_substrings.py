"""Repeated passages against a plain search for every window."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import substrings
from cellweave.llm.substrings import BitSet, Repeats


def by_hand(rows, k):
    """`(doc_id, n_words, n_removed, kept)`: each window is looked up among all that start earlier."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        words = (text or "").encode().split()
        left = [True] * len(words)
        for i in range(len(words) - k + 1):
            window = tuple(words[i : i + k])
            if window in seen:
                left[i : i + k] = [False] * k
            seen.add(window)
        out.append((doc_id, len(words), left.count(False), b" ".join(w for w, on in zip(words, left) if on).decode()))
    return out


def found(spark, rows, repeats):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return [tuple(r) for r in substrings.without_repeats(docs.repartition(3), repeats).collect()]


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


@pytest.mark.parametrize("seed, k, core, words", [(1, 4, 2, 3), (2, 4, 1, 8), (3, 6, 6, 3), (4, 1, 1, 200), (5, 20, 8, 2)])
def test_few_words(spark, seed, k, core, words):
    """Few different words, so that windows repeat, overlap themselves and branch."""
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abcdefgh"[:words]) + str(rng.randrange(max(1, words // 8))) for _ in range(rng.randrange(60)))) for i in range(60)]
    assert sorted(found(spark, rows, Repeats(k, core)), key=key) == sorted(by_hand(rows, k), key=key)


def test_passages(spark):
    """Copies whole and cut, shared passages at any place, in unique text."""
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = [fresh(n) for n in (19, 20, 21, 60, 150)]
    docs = []
    for i in range(80):
        words = fresh(rng.randrange(30))
        for _ in range(rng.randrange(3)):
            words += rng.choice(shared) + fresh(rng.randrange(4))
        if i % 7 == 0 and docs:
            words = rng.choice(docs)[rng.randrange(5) :]
        docs.append(words)
    rows = [(500 - 3 * i, rng.choice([" ", "\n", " \t "]).join(w)) for i, w in enumerate(docs)]
    want = by_hand(rows, 20)
    assert sorted(found(spark, rows, Repeats()), key=key) == sorted(want, key=key)
    assert sum(r[2] for r in want) > 1000


def test_a_path_is_one_row(spark):
    """A long passage in three documents gives one span in either copy, whose source is the first."""
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(10**9)}" for _ in range(400))
    rows = [(i, f"{' '.join(f'u{i}x{j}' for j in range(30))} {passage} {' '.join(f'v{i}x{j}' for j in range(30))}") for i in (5, 6, 9)]
    docs = substrings.keyed(spark.createDataFrame(rows, "doc_id bigint, text string"))
    spans = substrings.repeated_spans(docs).collect()
    assert {(r["key"], r.source) for r in spans} == {(6, 5), (9, 5)}
    assert max(r.n for r in spans if r["key"] == 9) > 300
    assert all(r.start == r.source_start for r in spans) and len(spans) < 60


def test_words_that_collide_are_found_out(spark):
    """With hashes of three bits most windows look alike; the digests tell, and other hashes are taken."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(12)] + [(20, "x y z " * 10), (21, "x y z " * 9)]
    docs = substrings.keyed(spark.createDataFrame(rows, "doc_id bigint, text string"))
    weak = Repeats(4, 2, hash_bits=2)
    assert substrings.wrong(docs, substrings._spans(docs, weak), weak).count()
    assert sorted(found(spark, rows, weak), key=key) == sorted(by_hand(rows, 4), key=key)


def test_odd_rows(spark):
    long = "lorem ipsum dolor sit " * 30_000
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, long), (5, "Ünïcode 日本 🙂 a\x00b " * 9), (6, "tie " * 30), (6, "tie " * 30), (7, "Tie " * 30),
        (None, "tie " * 30), (None, None), (None, "tie " * 30), (-3, "tie " * 21 + "a\xa0b c\x85d"), (8, long),
    ]
    assert sorted(found(spark, rows, Repeats()), key=key) == sorted(by_hand(rows, 20), key=key)
    assert found(spark, rows[:0], Repeats()) == []
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id bigint, text string, key int, spans string, n int")
    again = substrings.without_repeats(docs)
    assert again.columns == ["doc_id", "n_words", "n_removed", "kept"] and again.agg(F.sum("n_removed")).first()[0] > 0


def test_bit_sets_miss_nothing(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    for most in (1 << 16, 1 << 20):
        known = BitSet.of(hashes, most)
        inside = np.array([r.h for r in hashes.collect()], np.int64)
        assert known.has(inside).all()
        others = np.array([r.h for r in spark.range(10**6, 10**6 + 5000).select(F.xxhash64("id").alias("h")).collect()], np.int64)
        assert known.has(others).mean() < 0.1
