"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order. It is posted in the
inverted file of each of them, with the pivot's rank. A query reads the files
of its own nearest pivots, candidates are ranked by footrule distance between
the two orders, and the nearest are ranked anew by inner product.

The index is cut into segments by hash. Queries meet every segment in blocks,
and the best of each segment are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PermutationIndex:
    pivots: int = 128
    #: So many nearest pivots stand for a vector.
    prefix: int = 32
    #: The part of a segment that is ranked by inner product, at least `least` vectors.
    share: float = 0.4
    least: int = 400
    segment_rows: int = 8192
    block_queries: int = 4096


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """`(vec_id, v)` of vectors in double precision; null, empty and zero ones and those with null or non-finite parts are left out."""
    v = F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0.0)
    return rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & some
    )


def choose_pivots(vectors: DataFrame, index: PermutationIndex) -> np.ndarray:
    """The distinct vectors with the smallest hashes: a bounded sample, in a fixed order."""
    few = vectors.select("v").groupBy("v").agg(F.count("*")).orderBy(F.xxhash64("v"), "v").limit(index.pivots).select("v")
    return np.array([r["v"] for r in few.collect()], float)


def ranks_of(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Per vector, its nearest pivots in order (ties: the pivot listed first)."""
    near = x @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


class Segment:
    """Inverted files of a part of the vectors, which are sorted by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, index: PermutationIndex):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.pivots, self.index = ids[order], x[order], pivots, index
        near = ranks_of(self.x, pivots, index.prefix).astype(np.int32)
        rows, ranks = np.divmod(np.arange(near.size), near.shape[1])
        by_pivot = np.argsort(near.ravel(), kind="stable")
        self.rows, self.ranks = rows[by_pivot].astype(np.int32), ranks[by_pivot].astype(np.int32)
        self.first = np.searchsorted(near.ravel()[by_pivot], np.arange(len(pivots) + 1))

    def search(self, query_id: int, q: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The `k` best of this segment: ids and inner products."""
        depth, n = len(near), len(self.ids)
        # The footrule distance is the same number for all, less twice what each shared pivot saves.
        saved = np.zeros(n, np.int32)
        for rank, pivot in enumerate(near):
            own = slice(self.first[pivot], self.first[pivot + 1])
            saved[self.rows[own]] += depth - np.maximum(self.ranks[own], rank)
        most = max(self.index.least, int(np.ceil(n * self.index.share)))
        if most < n:
            # Ties go to the smaller id.
            key = saved.astype(np.int64) * n - np.arange(n)
            kept = np.argpartition(-key, most - 1)[:most]
        else:
            kept = np.arange(n)
        kept = kept[self.ids[kept] != query_id]
        score = (self.x[kept] * q).sum(1)
        order = np.lexsort((self.ids[kept], -score))[:k]
        return self.ids[kept][order], score[order]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, index: PermutationIndex = PermutationIndex()) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: for each query its `k` nearest by inner product, itself left out, ties to the smaller id.

    Both tables are `(vec_id, v)` as `usable` makes them. Vectors of another
    length than most (ties: the longer) take no part. A query is left out by id. Rows that share an id are both searched. With fewer
    than `k` candidates all are returned; an empty table gives an empty one.

    Segments and blocks are sized by row counts, so that no task holds more than
    about `segment_rows` vectors and `block_queries` queries; each pair of a segment
    and a block is one task's work.
    """
    sizes = vectors.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if sizes is not None:
        vectors, queries = (t.filter(F.size("v") == sizes["size"]) for t in (vectors, queries))
    pivots = choose_pivots(vectors, index)
    spark = vectors.sparkSession
    out = "query_id bigint, vec_id bigint, score double"
    if not len(pivots):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    segments = max(1, -(-vectors.count() // index.segment_rows))
    blocks = max(1, -(-queries.count() // index.block_queries))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(deal(segments, 1).alias("segment"), "vec_id", "v").select(copies(blocks).alias("block"), "*")
    right = queries.select(deal(blocks, 2).alias("block"), "vec_id", "v").select(copies(segments).alias("segment"), "*")

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        rows = {"query_id": [], "vec_id": [], "score": []}
        if own.num_rows and asked.num_rows:
            matrix = lambda t: np.array(t["v"].combine_chunks().flatten()).reshape(t.num_rows, -1)
            part = Segment(own["vec_id"].to_numpy(), matrix(own), pivots, index)
            q = matrix(asked)
            near = ranks_of(q, pivots, index.prefix)
            for i, query_id in enumerate(asked["vec_id"].to_pylist()):
                ids, score = part.search(query_id, q[i], near[i], k)
                rows["query_id"].append(np.full(len(ids), query_id))
                rows["vec_id"].append(ids)
                rows["score"].append(score)
        return pa.table({n: np.concatenate(v) if v else np.zeros(0, np.float64 if n == "score" else np.int64) for n, v in rows.items()})

    met = left.groupBy("block", "segment").cogroup(right.groupBy("block", "segment")).applyInArrow(meet, out)
    # At most `k` rows per query and segment; the best are kept before they are shuffled.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
