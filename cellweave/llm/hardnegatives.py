"""Hard negatives from an inverted multi-index.

Components are put on an integer grid. A vector is cut into two halves, each
with a codebook of its own; a pair of codewords is a cell. The inner product of
an anchor and a half is at most its product with the codeword plus the anchor's
length times the codeword's radius, so the sum of two such bounds holds for a
whole cell. A heap gives an anchor's cells by falling sum (the multi-sequence
walk over both sorted halves), and the walk ends where no cell that is left can
change a window: the results are exact.

Across the cluster the walk takes two strides. The first visits the best cells
up to a number of rows. What it finds bounds each window from below, and the
second visits all further cells whose bound reaches that: nothing is left then.
Cells lie on shelves of a bounded number of rows; a large cell has several.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.session import cut_lineage

LONG = (1 << 63) - 1
WINDOWS = "array<struct<slot:int,low:bigint,high:bigint>>"
FOUND = "anchor bigint, slot int, vec_id bigint, score bigint"
MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


@dataclass(frozen=True)
class MultiIndex:
    #: Per half.
    codewords: int = 16
    #: Codebooks are fitted on so many rows, those with the smallest hashes of their ids.
    sample: int = 4096
    rounds: int = 8
    #: The first stride of an anchor ends when its cells hold so many rows.
    first_rows: int = 4096
    shelf_rows: int = 8192
    block_anchors: int = 2048


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 10
    #: Negatives score between `low / whole` and `high / whole` of their positive.
    low: int = 30
    high: int = 90
    whole: int = 100
    #: A component x becomes floor(scale * x).
    scale: int = 256
    index: MultiIndex = field(default_factory=MultiIndex)


def usable(rows: DataFrame) -> DataFrame:
    """`(vec_id, label, v)` of the rows that take part: nothing is null in them, and all components are finite."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad
    return rows.filter(kept).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), v.alias("v"))


def on_grid(vectors: pa.Array, size: int, scale: int) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones go on with zeros.

    Components too large for scores in 64 bits are cut to the largest that is not.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.diff(np.asarray(vectors.offsets))
    flat = np.asarray(vectors.flatten(), float)
    out = np.zeros((len(vectors), size))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    most = min(isqrt(LONG // max(size, 1)), (1 << 31) - 1)
    with np.errstate(over="ignore"):
        out[np.repeat(np.arange(len(vectors)), lengths), at] = np.clip(np.floor(flat * scale), -most, most)
    return out.astype(np.int64)


def codebook(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """At most `k` codewords for the rows of `x` by rounds of k-means; it starts at the first distinct rows."""
    _, first = np.unique(x, axis=0, return_index=True)
    centres = x[np.sort(first)[:k]].astype(float)
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2.0 * (x @ centres.T), axis=1)


@dataclass
class Directory:
    """What every task knows of the index: codebooks, and rows and radii of each cell. Its size depends on `codewords` only."""

    left: np.ndarray
    right: np.ndarray
    rows: np.ndarray
    radius_left: np.ndarray
    radius_right: np.ndarray
    #: The first shelf of a cell, and the number of its shelves.
    shelf: np.ndarray
    shelves: np.ndarray

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each row and how far its halves are from their codewords."""
        half = self.left.shape[1]
        i, j = nearest(x[:, :half], self.left), nearest(x[:, half:], self.right)
        away = lambda y, c: np.sqrt(((y - c) ** 2).sum(1))
        return i * len(self.right) + j, away(x[:, :half], self.left[i]), away(x[:, half:], self.right[j])

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Half bounds of an anchor by codeword, and by cell the least and the largest possible score."""
        half, shape = self.left.shape[1], (len(self.left), len(self.right))
        sides = []
        for part, centres, radius, axis in ((a[:half], self.left, self.radius_left, 1), (a[half:], self.right, self.radius_right, 0)):
            length, middle = float(np.sqrt((part.astype(float) ** 2).sum())), centres @ part
            radius = radius.reshape(shape)
            # Room for rounding, far above that of double precision.
            spare = 1e-9 * length * (np.sqrt((centres**2).sum(1)) + radius.max(axis)) + 1e-6
            wide = length * radius
            lift = lambda y: y[:, None] if axis else y[None, :]  # noqa: E731, B023
            sides.append((middle + wide.max(axis) + spare, lift(middle - spare) - wide, lift(middle + spare) + wide))
        (one, low_one, high_one), (two, low_two, high_two) = sides
        return one, two, low_one + low_two, high_one + high_two


def walk(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """All pairs of codewords by falling sum of their half bounds."""
    by_one, by_two = np.argsort(-one, kind="stable").tolist(), np.argsort(-two, kind="stable").tolist()
    a, b = one[by_one].tolist(), two[by_two].tolist()
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        top, s, t = heapq.heappop(heap)
        yield by_one[s], by_two[t], -top
        if t + 1 < len(b):
            heapq.heappush(heap, (-(a[s] + b[t + 1]), s, t + 1))
        if t == 0 and s + 1 < len(a):
            heapq.heappush(heap, (-(a[s + 1] + b[0]), s + 1, 0))


def cells_to_visit(directory: Directory, a: np.ndarray, windows: list, visited: set, most_rows: float) -> list[int]:
    """Cells that may hold a row of a window, best first, without those `visited`, until they hold `most_rows`."""
    one, two, low, high = directory.bounds(a)
    rows, least = directory.rows.reshape(low.shape), min(w["low"] for w in windows)
    found, seen = [], 0
    for i, j, bound in walk(one, two):
        # Certified: no cell from here on scores above `bound`.
        if bound < least or seen >= most_rows:
            break
        cell = i * low.shape[1] + j
        reaches = any(high[i, j] >= w["low"] and low[i, j] <= w["high"] for w in windows)
        if rows[i, j] and reaches and cell not in visited:
            seen += int(rows[i, j])
            found.append(cell)
    return found


def build(vectors: DataFrame, size: int, scale: int, index: MultiIndex) -> tuple[DataFrame, Directory]:
    """The index, written: `(vec_id, label, x, shelf, cell)` with `x` as 32-bit numbers; and its directory."""
    few = vectors.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(index.sample).select("v").toArrow()
    x = on_grid(few["v"], size, scale).astype(float)
    half = size // 2
    books = [codebook(part, index.codewords, index.rounds) for part in (x[:, :half], x[:, half:])]
    none = np.zeros(0)
    empty = Directory(books[0], books[1], none, none, none, none, none)

    def place(batches):
        for batch in batches:
            grid = on_grid(batch["v"], size, scale)
            cell, left, right = empty.place(grid)
            flat = pa.array([row.tobytes() for row in grid.astype(np.int32)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], flat, pa.array(cell.astype(np.int32)), pa.array(left), pa.array(right)],
                names=["vec_id", "label", "x", "cell", "left", "right"],
            )

    placed = cut_lineage(vectors.mapInArrow(place, "vec_id bigint, label bigint, x binary, cell int, left double, right double"))
    cells = len(books[0]) * len(books[1])
    rows, left, right = np.zeros(cells, np.int64), np.zeros(cells), np.zeros(cells)
    # One row per cell at most.
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("left").alias("left"), F.max("right").alias("right")).collect():
        rows[r["cell"]], left[r["cell"]], right[r["cell"]] = r["n"], r["left"], r["right"]
    shelf, shelves, last, held = np.zeros(cells, np.int64), np.ones(cells, np.int64), 0, 0
    for cell in np.flatnonzero(rows):
        if held and held + rows[cell] > index.shelf_rows:
            last, held = last + 1, 0
        shelf[cell] = last
        if rows[cell] > index.shelf_rows:
            shelves[cell] = -(-rows[cell] // index.shelf_rows)
            last, held = last + shelves[cell], 0
        else:
            held += rows[cell]
    spark = vectors.sparkSession
    # A row per cell, so its size is bounded.
    where = spark.createDataFrame([(int(c), int(shelf[c]), int(shelves[c])) for c in range(cells)], "cell int, first bigint, several bigint")
    dealt = placed.join(F.broadcast(where), "cell").select(
        "vec_id", "label", "x", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "several")).alias("shelf")
    )
    return dealt, Directory(books[0], books[1], rows, left, right, shelf, shelves)


def best_in_windows(index: DataFrame, directory: Directory, asked: DataFrame, k: int, same_label: bool, settings: MultiIndex) -> DataFrame:
    """`(anchor, slot, rank, vec_id, score)`: the first `k` rows of each window of each anchor, by falling score, ties by smaller id.

    `asked` is `(anchor, vec_id, label, x, windows)`. Rows of the anchor's own id
    are left out, and those of another label, or of the same one.
    """
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")

    def stride(now: DataFrame, most_rows: float) -> tuple[DataFrame, DataFrame]:
        visits = cut_lineage(_visits(now, directory, most_rows))
        blocks = visits.groupBy("shelf").agg(F.ceil(F.count("*") / settings.block_anchors).cast("int").alias("blocks"))
        left = index.join(blocks, "shelf").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).drop("blocks")
        right = visits.join(blocks, "shelf").withColumn("block", F.pmod(F.xxhash64("anchor"), "blocks").cast("int")).drop("blocks")
        met = left.groupBy("shelf", "block").cogroup(right.groupBy("shelf", "block")).applyInArrow(
            lambda own, queries: _meet(own, queries, k, same_label), FOUND
        )
        return visits, cut_lineage(met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))

    none = F.array().cast("array<int>")
    visits, found = stride(asked.withColumn("visited", none), settings.first_rows)
    # At most one entry per cell of the index.
    visited = visits.groupBy("anchor").agg(F.array_distinct(F.flatten(F.collect_list("cells"))).alias("visited"))
    # A window that is full takes nothing below its last row; ties are still looked at.
    full = found.filter(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("full"))
    raised = F.transform(
        "windows",
        lambda w: F.struct(w["slot"].alias("slot"), F.greatest(w["low"], F.try_element_at("full", w["slot"])).alias("low"), w["high"].alias("high")),
    )
    now = asked.join(full, "anchor", "left").join(visited, "anchor", "left").select(
        "anchor", "vec_id", "label", "x", raised.alias("windows"), F.coalesce("visited", none).alias("visited")
    )
    _, more = stride(now, float("inf"))
    both = found.drop("rank").unionByName(more.drop("rank"))
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _visits(asked: DataFrame, directory: Directory, most_rows: float) -> DataFrame:
    """A row per anchor and shelf of a stride, with the cells to look at there."""
    known = asked.sparkSession.sparkContext.broadcast(directory)

    def run(batches):
        found = known.value
        for batch in batches:
            picked, shelves, cells = [], [], []
            for i, (windows, visited) in enumerate(zip(batch["windows"].to_pylist(), batch["visited"].to_pylist())):
                a = np.frombuffer(batch["x"][i].as_buffer(), np.int32).astype(np.int64)
                by_shelf: dict[int, list[int]] = {}
                for cell in cells_to_visit(found, a, windows, set(visited), most_rows):
                    for n in range(int(found.shelves[cell])):
                        by_shelf.setdefault(int(found.shelf[cell]) + n, []).append(cell)
                picked += [i] * len(by_shelf)
                shelves += by_shelf.keys()
                cells += by_shelf.values()
            rows = batch.select(["anchor", "vec_id", "label", "x", "windows"]).take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(shelves, pa.int64()), pa.array(cells, pa.list_(pa.int32()))], names=[*rows.schema.names, "shelf", "cells"]
            )

    return asked.mapInArrow(run, f"anchor bigint, vec_id bigint, label bigint, x binary, windows {WINDOWS}, shelf bigint, cells array<int>")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([np.frombuffer(v.as_buffer(), np.int32) for v in column], np.int64).reshape(len(column), -1)


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of `a` with all of `x`, exactly."""
    most = lambda y: int(np.abs(y).max(initial=0))
    if most(a) * most(x) * a.shape[1] < 1 << 53:
        return (a.astype(float) @ x.T.astype(float)).astype(np.int64)
    return a @ x.T


def _meet(own: pa.Table, queries: pa.Table, k: int, same_label: bool) -> pa.Table:
    """The best of a shelf for a block of anchors."""
    out = {name: [] for name in ("anchor", "slot", "vec_id", "score")}
    if own.num_rows and queries.num_rows:
        ids = own["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, label, cell, x = ids[order], own["label"].to_numpy()[order], own["cell"].to_numpy()[order], _matrix(own["x"])[order]
        for at in range(0, queries.num_rows, 64):
            some = queries.slice(at, 64)
            scores = products(_matrix(some["x"]), x)
            for i, q in enumerate(some.select(["anchor", "vec_id", "label", "windows", "cells"]).to_pylist()):
                like = label == q["label"]
                rows = np.flatnonzero((like if same_label else ~like) & (ids != q["vec_id"]) & np.isin(cell, q["cells"]))
                score = scores[i, rows]
                for w in q["windows"]:
                    inside = np.flatnonzero((score >= w["low"]) & (score <= w["high"]))
                    if len(inside) > k:
                        least = -np.partition(-score[inside], k - 1)[k - 1]
                        inside = inside[score[inside] >= least]
                    inside = inside[np.argsort(-score[inside], kind="stable")][:k]
                    out["anchor"].append(np.full(len(inside), q["anchor"]))
                    out["slot"].append(np.full(len(inside), w["slot"]))
                    out["vec_id"].append(ids[rows[inside]])
                    out["score"].append(score[inside])
    return pa.table({n: np.concatenate(v).astype(np.int32 if n == "slot" else np.int64) if v else np.zeros(0, np.int32 if n == "slot" else np.int64) for n, v in out.items()})


def mine(vectors: DataFrame, is_anchor: Column, mining: Mining = Mining()) -> DataFrame:
    """`(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`.

    `vectors` is `(vec_id, label, v)` as `usable` makes it; other columns are
    ignored. An anchor's positives are the `positives` best other rows of its
    label; for each, the `negatives` best rows of other labels whose score is in
    the positive's window. Higher scores come first, ties by smaller id.

    Rows that share an id are all searched, and none is a partner of its own id;
    equal rows are one anchor. Vectors of different lengths are compared as if
    the shorter went on with zeros. Positives below zero have no window. An empty
    table, or one without anchors, gives an empty one.
    """
    spark, index = vectors.sparkSession, mining.index
    vectors = vectors.select("vec_id", "label", "v")
    size = vectors.agg(F.max(F.size("v"))).first()[0]
    if size is None:
        return spark.createDataFrame([], MINED)
    # Two components at least, so that there are two halves.
    rows, directory = build(vectors, max(size, 2), mining.scale, index)
    anchors = rows.filter(is_anchor).select("vec_id", "label", "x").distinct().withColumn("anchor", F.monotonically_increasing_id())
    anchors = cut_lineage(anchors)
    windows = lambda low, high: F.array(F.struct(F.lit(0).alias("slot"), F.lit(low).alias("low"), F.lit(high).alias("high")))
    everything = anchors.withColumn("windows", windows(-LONG, LONG).cast(WINDOWS))
    near = best_in_windows(rows, directory, everything, mining.positives, True, index)
    positives = cut_lineage(
        near.select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    )
    # Shares of whole numbers without a product that may not fit; only scores from zero on have a window.
    share = lambda part, up: F.expr(
        f"(positive_score div {mining.whole}) * {part} + ((positive_score % {mining.whole}) * {part} + {mining.whole - 1 if up else 0}) div {mining.whole}"
    )
    window = F.struct("slot", share(mining.low, True).alias("low"), share(mining.high, False).alias("high"))
    by_anchor = positives.filter("positive_score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(window)).cast(WINDOWS).alias("windows"))
    found = best_in_windows(rows, directory, anchors.join(by_anchor, "anchor"), mining.negatives, False, index)
    named = positives.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return found.join(named, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
