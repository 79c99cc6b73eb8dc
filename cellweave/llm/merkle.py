"""Merkle manifest of a dataset as a postorder append log.

The leaves of a group are in order; while there are several nodes, every `FAN`
consecutive ones become the digest of their digests. A tree is kept as a log:
its nodes in the order in which they are completed when leaves are appended one
by one. Builders work on aligned parts of `FAN ** step` nodes, so none waits for
another, and their roots are what the next builders append.

The place of a node in the log follows from the sizes of the subtrees before it
(`postorder`), so a proof is read by computing where the siblings of each level
stand. Roots of groups are the leaves of one more tree, made in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import fresh
from cellweave.session import cut_lineage, scratch_path
from cellweave.tables import in_order

FAN_BITS = 3
FAN = 1 << FAN_BITS
#: Levels that one builder adds.
STEP = 4
LOG = "group string, pos bigint, level int, j bigint, digest string"
PATH = "array<struct<left:string,right:string>>"


def digest_of(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields: `-` for a null one, else its bytes, a colon, and its value as text."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def height(n: int) -> int:
    """Levels above the leaves of a tree of `n` leaves."""
    up = 0
    while n > 1:
        n, up = -(-n // FAN), up + 1
    return up


def width(level, n):
    """Nodes of a level."""
    return -(-n // FAN**level)


def postorder(level: int, j, n: int):
    """Place in the log of node `j` (a number or an array) of a level, in a tree of `n` leaves.

    When it is complete, so are the nodes of its level and below over all leaves
    up to its last one; of the levels above, those that ended before this leaf.
    """
    last = np.minimum((j + 1) * FAN**level, n)
    below = sum(-(-last // FAN**k) for k in range(level + 1))
    above = sum((last - 1) // FAN**k for k in range(level + 1, height(n) + 1))
    return below + above - 1


def completed(digests: list[str], first: int, level: int, n: int, step: int = STEP) -> Iterator[tuple[int, int, str]]:
    """Nodes `(level, j, digest)` in the order in which they are completed, as nodes from `first` on of a level are appended.

    `n` is the number of leaves of the whole tree; where its end is reached, runs
    end with fewer nodes, up to the root.
    """
    top, ends = min(level + step, height(n)), width(level, n)
    runs: list[list[str]] = [[] for _ in range(top - level + 1)]
    for at, digest in enumerate(digests, first):
        yield level, at, digest
        runs[0].append(digest)
        up, j, last = level, at, at + 1 == ends
        while up < top and (len(runs[up - level]) == FAN or last):
            digest = sha256("".join(runs[up - level]).encode()).hexdigest()
            runs[up - level] = []
            up, j = up + 1, j >> FAN_BITS
            yield up, j, digest
            runs[up - level].append(digest)


def sizes_of(rows: DataFrame) -> DataFrame:
    """`(group, n)`."""
    return rows.groupBy("group").agg(F.count("*").alias("n"))


def _builder(level: int, step: int):
    """What makes the nodes above one aligned part of a level, in the order of their completion."""

    def build(own: pa.Table, block: pa.Table) -> pa.Table:
        made = [[] for _ in range(4)]
        if own.num_rows and block.num_rows:
            own, n = own.sort_by("j"), block["n"][0].as_py()
            for up, j, digest in completed(own["digest"].to_pylist(), own["j"][0].as_py(), level, n, step):
                if up > level or not level:  # the step before has written what this one starts from
                    for column, value in zip(made, (int(postorder(up, j, n)), up, j, digest)):
                        column.append(value)
        group = pa.array([block["group"][0].as_py() if block.num_rows else None] * len(made[0]), pa.string())
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string())
        return pa.table([group, *[pa.array(c, k) for c, k in zip(made, kinds)]], names=["group", "pos", "level", "j", "digest"])

    return build


def append_log(leaves: DataFrame, sizes: DataFrame, step: int = STEP) -> DataFrame:
    """The log `(group, pos, level, j, digest)` of trees over leaves `(group, ix, digest)`, `ix` from 0 in order; `sizes` is `(group, n)`.

    Each `step` levels are one exchange of the nodes they start from; no task
    holds more than `FAN ** step` of them at once.
    """
    most = sizes.agg(F.max("n")).first()[0] or 0
    level, logs = 0, []
    nodes = leaves.select("group", F.col("ix").alias("j"), "digest")
    while True:
        part = FAN_BITS * step
        blocks = sizes.filter(F.col("n") > (FAN**level if level else 0)).select(
            "group", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(F.ceil(F.col("n") / FAN**level) - 1, part))).alias("block")
        )
        placed = nodes.withColumn("block", F.shiftright("j", part)).toDF("group", "j", "digest", "block")
        log = cut_lineage(placed.groupBy("group", "block").cogroup(blocks.groupBy("group", "block")).applyInArrow(_builder(level, step), LOG))
        logs.append(log)
        if FAN ** (level + step) >= most:
            break
        level += step
        nodes = log.filter(F.col("level") == level).join(sizes.filter(F.col("n") > FAN**level).select("group"), "group").select("group", "j", "digest")
    whole = logs[0]
    for log in logs[1:]:
        whole = whole.unionByName(log)
    return whole


def write_log(log: DataFrame, path: str) -> None:
    """The log in files whose rows stand by group and place."""
    log.repartitionByRange("group", "pos").sortWithinPartitions("group", "pos").write.parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def roots(log: DataFrame) -> DataFrame:
    """`(group, digest)`: a tree's root is the last node of its log."""
    return log.groupBy("group").agg(F.max_by("digest", "pos").alias("digest"))


def _extender(level: int, step: int, names: list[str]):
    """What adds paths to nodes of a level in one aligned part: the part's digests come with one row on what is above it."""

    def extend(own: pa.Table, asked: pa.Table) -> pa.Table:
        is_head = pc.is_valid(own["n"])
        if not asked.num_rows or not pc.any(is_head).as_py():
            return pa.table({f.name: pa.array([], f.type) for f in [*[asked.schema.field(c) for c in names], *_PATH_FIELDS]})
        head, nodes = own.filter(is_head).to_pylist()[0], own.filter(pc.invert(is_head))
        n, at = head["n"], dict(zip(nodes["pos"].to_pylist(), nodes["digest"].to_pylist()))
        ix = asked["ix"].to_pylist()
        steps = []
        for up in range(level, min(level + step, height(n))):
            shift = FAN_BITS * (up - level)
            sides = {j: _sides(up, j, n, at) for j in {i >> shift for i in ix}}
            steps.append([sides[i >> shift] for i in ix])
        steps += [[(above["left"], above["right"])] * len(ix) for above in head["path"]]
        flat = [pa.array([pair[side] for row in zip(*steps) for pair in row], pa.string()) for side in (0, 1)]
        offsets = pa.array(np.arange(len(ix) + 1) * len(steps), pa.int32())
        paths = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, names=["left", "right"]))
        more = {"path": paths, "root": pa.array([head["root"]] * len(ix), pa.string()), "n": pa.array([n] * len(ix), pa.int64())}
        return pa.table({**{c: asked[c] for c in names}, **more})

    return extend


def with_paths(rows: DataFrame, log: DataFrame, sizes: DataFrame, above: DataFrame, step: int = STEP) -> DataFrame:
    """Add `path`, the siblings of each level up to the root, and `root`, to rows that have the `group` and `ix` of a leaf.

    A level of the path has the digests left and right of the node, joined.
    `above` is `(group, path, root)`: what follows a tree's root, and its digest.
    Siblings are looked up in the log by their places. Paths are worked out for
    block roots first, from the top, so each part of the log is read once and a
    task holds one aligned part.
    """
    part = FAN_BITS * step
    most = sizes.agg(F.max("n")).first()[0] or 0
    tops = sizes.join(above, "group")
    found, level = None, 0
    while FAN ** (level + step) < most:
        level += step
    while level >= 0:
        items = rows if not level else log.filter(F.col("level") == level).select("group", F.col("j").alias("ix"))
        # A tree that ends within this step hangs on what is above it, a higher one on the step above.
        ends = tops.filter((F.col("n") <= FAN ** (level + step)) & (F.col("n") > (FAN**level if level else 0)))
        heads = ends.select("group", F.lit(0).cast("bigint").alias("block"), "n", "path", "root")
        if found is not None:
            heads = heads.unionByName(found.select("group", F.col("ix").alias("block"), "n", "path", "root"))
        below = (F.col("level") >= level) & (F.col("level") <= level + step)
        block = F.expr(f"shiftright(j, {FAN_BITS} * ({level + step} - level))")
        nodes = log.filter(below).select("group", block.alias("block"), "pos", "digest")
        known = nodes.unionByName(heads, allowMissingColumns=True)
        schema = T.StructType([*items.schema.fields, *T.StructType.fromDDL(f"path {PATH}, root string, n bigint").fields])

        dealt = items.withColumn("block", F.shiftright("ix", part)).toDF(*items.columns, "block")
        found = known.groupBy("group", "block").cogroup(dealt.groupBy("group", "block")).applyInArrow(_extender(level, step, items.columns), schema)
        if level:
            found = cut_lineage(found)
        level -= step
    return found.drop("n")


_PATH_FIELDS = [
    pa.field("path", pa.list_(pa.struct([pa.field("left", pa.string()), pa.field("right", pa.string())]))),
    pa.field("root", pa.string()),
    pa.field("n", pa.int64()),
]


def _sides(level: int, j: int, n: int, at: dict[int, str]) -> tuple[str, str]:
    """Digests of the other nodes of a run, left and right of node `j`."""
    begin = j >> FAN_BITS << FAN_BITS
    run = np.arange(begin, min(begin + FAN, width(level, n)))
    digests = [at[p] for p in postorder(level, run, n).tolist()]
    return "".join(digests[: j - begin]), "".join(digests[j - begin + 1 :])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(docs: DataFrame, leaf: Column, group: str = "lang", order: str = "doc_id", kept: dict[str, Column] | None = None, step: int = STEP) -> DataFrame:
    """`(group, order, leaf, ..., path, subroot, root)` per row of `docs`.

    Each value of the column `group` (null is one) has a tree, whose leaves stand
    by the column `order` (null first, ties by digest); the roots of these, by
    value (null first, by UTF-8), are the leaves of the whole. `path` has the
    siblings of all levels, up to the root. `kept` names further columns to carry,
    as expressions over `docs`. Rows that are equal in all of this are one leaf
    each. An empty table gives an empty one.

    Logs are written to the shared folder and read from there.
    """
    spark = docs.sparkSession
    carried = kept or {}
    clash = set(carried) & {"group", "ix", "leaf", "digest", "path", "root", "subroot", "block", "n", order}
    if clash:
        raise ValueError(f"columns {sorted(clash)} have names of the manifest's own")
    # Null sorts before all values.
    name = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    leaves = cut_lineage(docs.select(name.alias("group"), F.col(order).alias("_order"), leaf.alias("leaf"), *[c.alias(n) for n, c in carried.items()]))
    rows = cut_lineage(in_order(leaves, ("group",), [F.col("_order").asc_nulls_first(), F.col("leaf"), *carried], "ix"))
    sizes = cut_lineage(sizes_of(rows))
    log = _written(spark, append_log(rows.select("group", "ix", F.col("leaf").alias("digest")), sizes, step))
    tops = in_order(roots(log).select(F.lit("").alias("_all"), F.col("group").alias("of"), "digest"), ("_all",), [F.col("of")], "ix")
    tops = cut_lineage(tops.select(F.lit("").alias("group"), "ix", "of", "digest"))
    all_sizes = cut_lineage(sizes_of(tops))
    top_log = _written(spark, append_log(tops.select("group", "ix", "digest"), all_sizes, step))
    nothing = roots(top_log).select("group", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    top_paths = cut_lineage(with_paths(tops, top_log, all_sizes, nothing, step))
    whole = top_paths.select("root").head(1)
    above = top_paths.select(F.col("of").alias("group"), "path", F.col("digest").alias("root"))
    found = with_paths(rows, log, sizes, above, step)
    (label,) = fresh(found.drop("group", "ix", "_order"), group) if group != order else (f"{group}_group",)
    return found.select(
        F.when(F.col("group") != "0", F.substring("group", 2, 1 << 30)).alias(label),
        F.col("_order").alias(order),
        "leaf",
        *carried,
        "path",
        F.col("root").alias("subroot"),
        F.lit(whole[0]["root"] if whole else None).cast("string").alias("root"),
    )


def _written(spark: SparkSession, log: DataFrame) -> DataFrame:
    path = scratch_path(spark, "merkle-log")
    write_log(log, path)
    return read_log(spark, path)
