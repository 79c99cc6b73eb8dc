"""State machines over the rows of tables, as composed transitions.

A row is a map from the state before it to the state after it. Such maps
compose, in any grouping, so a table need not be walked row by row in one task:
each chunk of rows becomes one map, a scan over the chunk maps gives the state
each chunk starts in, and then all chunks are walked at once. Registers that
note the last row of a transition, or count transitions, are part of the maps.
One pass so gives what would take several dependent running values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.session import cut_lineage, ship_package, written
from cellweave.tables import Layout, layout_of

MOST_STATES = 64
#: So many starts of chunks are sent to all tasks at most; beyond, they are joined by shuffle.
LISTED_CHUNKS = 50_000


@dataclass(frozen=True)
class Automaton:
    """States, of which tables start in the first, and what the symbols of rows do.

    `moves[symbol][state]` is the next state, or a tuple of it and the registers
    that the transition sets. A state that is not named stays, and so does every
    state at a symbol without moves. A register in `last` holds the order value
    of the row that last set it (null: none has), one in `counts` how often it was set.
    """

    states: tuple[str, ...]
    moves: dict[str, dict[str, str | tuple[str, ...]]]
    last: tuple[str, ...] = ()
    counts: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not 0 < len(self.states) <= MOST_STATES:
            raise ValueError(f"an automaton has 1 to {MOST_STATES} states")
        self.tables()

    @property
    def registers(self) -> tuple[str, ...]:
        return (*self.last, *self.counts)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By symbol (0: none with moves) and state: the next state, and whether each register is set."""
        shape = (len(self.moves) + 1, len(self.states))
        after = np.tile(np.arange(shape[1]), (shape[0], 1))
        sets = np.zeros((*shape, len(self.registers)), bool)
        for i, moves in enumerate(self.moves.values(), 1):
            for state, move in moves.items():
                to, *registers = (move,) if isinstance(move, str) else move
                s = self.states.index(state)
                after[i, s] = self.states.index(to)
                for name in registers:
                    sets[i, s, self.registers.index(name)] = True
        return after, sets

    def symbol_index(self, symbol: Column) -> Column:
        index = F.lit(0)
        for i, name in enumerate(self.moves, 1):
            index = F.when(symbol == name, i).otherwise(index)
        return index


#: Rows of a batch as maps: next states (rows, states), and what is noted by a transition from the states given (rows, registers).
Maps = tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]
#: A note of nothing, in a register that holds the last row.
NONE = -(1 << 63)


def states_after(maps: np.ndarray, first: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The state after each row. Row `i` where `first` begins a part, in state `start[i]`; row 0 must begin one.

    Maps of neighbouring stretches are composed, each time of twice the length.
    """
    whole = maps.copy()
    begin = np.flatnonzero(first)
    whole[begin] = maps[begin, start[begin]][:, None]
    reach = 1
    while reach < len(whole) and (whole != whole[:, :1]).any():
        longer = whole.copy()
        longer[reach:] = np.take_along_axis(whole[reach:], whole[:-reach], axis=1)
        whole, reach = longer, reach * 2
    return whole[:, 0]


def walked(maps: Maps, first: np.ndarray, start: np.ndarray, held: np.ndarray, n_last: int):
    """`(before, after, registers)` by row; at rows where a part begins, `start` and `held` are state and registers before it."""
    after = states_after(maps[0], first, start)
    before = np.where(first, start, np.concatenate([start[:1], after[:-1]]))
    noted = maps[1](before)
    place = np.arange(len(after))
    begin = np.maximum.accumulate(np.where(first, place, 0))
    registers = np.empty_like(noted)
    for r in range(noted.shape[1]):
        if r < n_last:
            at = np.maximum.accumulate(np.where(noted[:, r] != NONE, place, -1))
            registers[:, r] = np.where(at >= begin, noted[np.maximum(at, 0), r], held[begin, r])
        else:
            upto = noted[:, r].cumsum()
            registers[:, r] = upto - upto[begin] + noted[begin, r] + held[begin, r]
    return before, after, registers


class _Reader:
    """Batches of rows in order as maps, and where parts begin."""

    def __init__(self, automaton: Automaton, keys: list[str], order: str, of_maps: bool):
        self.states, self.n_last, self.n_registers = len(automaton.states), len(automaton.last), len(automaton.registers)
        self.after, self.sets = automaton.tables()
        self.keys, self.order, self.of_maps, self.key = keys, order, of_maps, None

    def maps(self, batch: pa.RecordBatch) -> Maps:
        rows = np.arange(batch.num_rows)
        if self.of_maps:
            flat = lambda c: np.asarray(batch[c].flatten())
            noted = flat("_noted").reshape(len(rows), self.states, self.n_registers)
            return flat("_next").reshape(len(rows), self.states), lambda before: noted[rows, before]
        symbol, order = batch["_symbol"].to_numpy(), batch[self.order].to_numpy()

        def noted_by(before: np.ndarray) -> np.ndarray:
            sets = self.sets[symbol, before]
            is_last = np.arange(self.n_registers) < self.n_last
            return np.where(is_last, np.where(sets, order[:, None], NONE), sets.astype(np.int64))

        return self.after[symbol], noted_by

    def begins(self, batch: pa.RecordBatch) -> np.ndarray:
        """Where a row has other keys than the one before it, also across batches."""
        first = np.zeros(batch.num_rows, bool)
        for key in self.keys:
            codes = batch[key].dictionary_encode(null_encoding="encode").indices.to_numpy()
            first[1:] |= codes[1:] != codes[:-1]
        ends = [tuple(batch[key][i].as_py() for key in self.keys) for i in (0, batch.num_rows - 1)]
        first[0] = ends[0] != self.key
        self.key = ends[1]
        return first

    def nothing(self) -> np.ndarray:
        return np.array([NONE] * self.n_last + [0] * (self.n_registers - self.n_last), np.int64)


def _follow(batches: Iterator[pa.RecordBatch], reader: _Reader, started: bool) -> Iterator[pa.RecordBatch]:
    """Add the states around each row and the registers before and after it."""
    state, registers = 0, reader.nothing()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        first = reader.begins(batch)
        start, held = np.zeros(n, np.int64), np.tile(reader.nothing(), (n, 1))
        if started:
            start = batch["_start"].to_numpy().astype(np.int64)
            held = np.asarray(batch["_held"].flatten()).reshape(n, -1)
            start, held = start.copy(), held.copy()
        if not first[0]:
            start[0], held[0] = state, registers
        part = first.copy()
        part[0] = True
        before, after, now = walked(reader.maps(batch), part, start, held, reader.n_last)
        state, registers = after[-1], now[-1]
        earlier = np.where(part[:, None], held, np.concatenate([now[:1], now[:-1]]))
        lists = [_lists(x) for x in (earlier, now)]
        kept = [c for c in batch.schema.names if c not in ("_start", "_held", "_next", "_noted", "_symbol")]
        yield pa.RecordBatch.from_arrays(
            [*[batch[c] for c in kept], pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), *lists],
            names=[*kept, "_before", "_after", "_earlier", "_now"],
        )


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _totals(batches: Iterator[pa.RecordBatch], reader: _Reader) -> Iterator[pa.RecordBatch]:
    """One map per part: from each state, the state after the part and the registers."""
    held_key, kinds, state, registers = None, None, None, None

    def row():
        arrays = [pa.array([k], kind) for k, kind in zip(held_key, kinds)]
        return pa.RecordBatch.from_arrays(
            [*arrays, pa.array([state.tolist()], pa.list_(pa.int32())), pa.array([registers.ravel().tolist()], pa.list_(pa.int64()))],
            names=[*reader.keys, "_next", "_noted"],
        )

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        first = reader.begins(batch)
        maps, part = reader.maps(batch), first.copy()
        part[0] = True
        ends = np.append(np.flatnonzero(part)[1:], n) - 1
        finals, notes = [], []
        for s in range(reader.states):
            start, held = np.full(n, s), np.tile(reader.nothing(), (n, 1))
            if not first[0]:
                start[0], held[0] = state[s], registers[s]
            _, after, now = walked(maps, part, start, held, reader.n_last)
            finals.append(after[ends])
            notes.append(now[ends])
        if first[0] and held_key is not None:
            yield row()
        finals, notes = np.array(finals).T, np.array(notes).transpose(1, 0, 2)
        keys = [batch[k].take(pa.array(ends)) for k in reader.keys]
        if len(ends) > 1:
            done = [k.slice(0, len(ends) - 1) for k in keys]
            next_states = pa.array([f.tolist() for f in finals[:-1]], pa.list_(pa.int32()))
            noted = pa.array([x.ravel().tolist() for x in notes[:-1]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*done, next_states, noted], names=[*reader.keys, "_next", "_noted"])
        held_key, kinds, state, registers = [k[-1].as_py() for k in keys], [k.type for k in keys], finals[-1], notes[-1]
    if held_key is not None:
        yield row()


def _scan(df: DataFrame, automaton: Automaton, layout: Layout, keys: list[str], order: str, of_maps: bool) -> DataFrame:
    """Add `_before`, `_after`, `_earlier` and `_now` to rows that have a `_symbol`, or maps as `_next` and `_noted`."""

    def follow(rows: DataFrame, parts: list[str], started: bool) -> DataFrame:
        dropped = [c for c in ("_start", "_held", "_next", "_noted", "_symbol") if c in rows.columns]
        added = T.StructType.fromDDL("_before int, _after int, _earlier array<bigint>, _now array<bigint>")
        schema = T.StructType([*rows.drop(*dropped).schema.fields, *added.fields])
        placed = rows.repartition(*parts) if parts else rows.coalesce(1)
        make = lambda batches: _follow(batches, _Reader(automaton, parts, order, of_maps), started)
        return placed.sortWithinPartitions(*parts, order).mapInArrow(make, schema)

    if not layout.chunked:
        return follow(df, keys, False)
    # Written once, since the rows are read for the maps of the chunks and for the walk.
    df = written(df.withColumn("_chunk", F.shiftright(order, layout.bits)))
    parts = [*keys, "_chunk"]
    own = ["_next", "_noted"] if of_maps else ["_symbol"]
    narrow = df.select(*parts, order, *own)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name in parts)
    totals = narrow.repartition(*parts).sortWithinPartitions(*parts, order).mapInArrow(
        lambda batches: _totals(batches, _Reader(automaton, parts, order, of_maps)), f"{kinds}, _next array<int>, _noted array<bigint>"
    )
    totals = cut_lineage(totals).withColumnRenamed("_chunk", "_at")
    starts = _scan(totals, automaton, layout_of(totals, tuple(keys), layout.bits), keys, "_at", True)
    starts = starts.select(*keys, F.col("_at").alias("_chunk"), F.col("_before").alias("_start"), F.col("_earlier").alias("_held"))
    starts = cut_lineage(starts)
    # A row per chunk; counted before it is sent to all tasks.
    starts = F.broadcast(starts) if starts.count() <= LISTED_CHUNKS else starts
    return follow(df.join(starts, parts), parts, True).drop("_chunk")


def transduce(
    df: DataFrame,
    symbol: Column,
    automaton: Automaton,
    layout: Layout,
    keys: tuple[str, ...] = ("table_id",),
    order: str = "row_ix",
) -> DataFrame:
    """Add `before` and `after`, the states around each row in order, and a column per register, as it is after the row.

    Tables of any length: no task walks more than a chunk of rows at once. Short
    tables share one exchange. A null symbol leaves all states as they are.
    """
    ship_package(df.sparkSession)
    rows = _scan(df.withColumn("_symbol", automaton.symbol_index(symbol)), automaton, layout, list(keys), order, False)
    names = F.array(*[F.lit(s) for s in automaton.states])
    columns = [F.get(names, F.col("_before")).alias("before"), F.get(names, F.col("_after")).alias("after")]
    for i, name in enumerate(automaton.registers):
        value = F.get("_now", F.lit(i))
        columns.append((F.nullif(value, F.lit(NONE)) if i < len(automaton.last) else value).alias(name))
    return rows.select(*df.columns, *columns)
