"""Automata against a row by row walk, in both layouts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators.automata import Automaton, states_after, transduce
from cellweave.tables import Layout


def random_automaton(rng, n_states):
    states = tuple(f"s{i}" for i in range(n_states))
    moves = {}
    for symbol in "abcd":
        moves[symbol] = {}
        for state in rng.sample(states, rng.randint(1, n_states)):
            registers = rng.sample(["at", "other", "times"], rng.randint(0, 3))
            moves[symbol][state] = (rng.choice(states), *registers)
    return Automaton(states, moves, ("at", "other"), ("times",))


def walk(automaton, rows):
    state, held = automaton.states[0], {"at": None, "other": None, "times": 0}
    for order, symbol in rows:
        before = state
        to, *registers = automaton.moves.get(symbol, {}).get(state, (state,))
        state = to
        for r in registers:
            held[r] = held[r] + 1 if r == "times" else order
        yield before, state, held["at"], held["other"], held["times"]


@pytest.mark.parametrize("seed", range(4))
def test_against_a_walk(spark, layout, seed):
    rng = random.Random(seed)
    automaton = random_automaton(rng, rng.randint(1, 7))
    tables = {}
    for table in range(6):
        places = sorted(rng.sample(range(400), rng.choice([0, 1, 9, 120])))
        tables[f"t{table}"] = [(p, rng.choice(["a", "b", "c", "d", "x", None])) for p in places]
    rows = [(t, p, s) for t, own in tables.items() for p, s in own]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "table_id string, row_ix bigint, symbol string").repartition(3)
    out = transduce(df, F.col("symbol"), automaton, layout)
    assert out.columns == ["table_id", "row_ix", "symbol", "before", "after", "at", "other", "times"]
    got = {(r.table_id, r.row_ix): tuple(r)[3:] for r in out.collect()}
    want = {(t, p[0]): w for t, own in tables.items() for p, w in zip(own, walk(automaton, own))}
    assert got == want


def test_batches_carry_on(spark):
    """Rows of a chunk arrive in several Arrow batches."""
    rng = random.Random(8)
    automaton = random_automaton(rng, 5)
    own = [(p, rng.choice("abcdx")) for p in range(700)]
    df = spark.createDataFrame([("t", *r) for r in own] + [("u", 0, "a")], "table_id string, row_ix bigint, symbol string")
    want = {("t", p[0]): w for p, w in zip(own, walk(automaton, own))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for layout in (Layout(False), Layout(True, bits=8), Layout(True, bits=2)):
            got = {(r.table_id, r.row_ix): tuple(r)[3:] for r in transduce(df, F.col("symbol"), automaton, layout).collect()}
            assert {k: v for k, v in got.items() if k[0] == "t"} == want and len(got) == 701
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_states_after_composes():
    rng = np.random.default_rng(3)
    maps = rng.integers(0, 5, (257, 5))
    first = rng.random(257) < 0.02
    first[0] = True
    start = rng.integers(0, 5, 257)
    want, state = [], 0
    for i in range(257):
        state = maps[i, start[i] if first[i] else state]
        want.append(state)
    assert states_after(maps, first, start).tolist() == want


def test_no_registers_and_no_rows(spark, layout):
    flip = Automaton(("off", "on"), {"x": {"off": "on", "on": "off"}})
    df = spark.createDataFrame([("t", i) for i in range(9)], "table_id string, row_ix bigint")
    assert [r.after for r in transduce(df, F.lit("x"), flip, layout).orderBy("row_ix").collect()] == (["on", "off"] * 5)[:9]
    assert transduce(df.limit(0), F.lit("x"), flip, layout).count() == 0
    with pytest.raises(ValueError):
        Automaton(("a",), {"x": {"a": "b"}})
