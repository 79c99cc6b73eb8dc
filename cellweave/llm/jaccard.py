"""N-gram Jaccard join with signature trees.

Documents are sets of word shingles. Equal sets become one node. Nodes that may
be alike meet by a sketch of their sets; where they meet, trees of signatures
(the OR of token bitmaps, and a range of sizes) are walked in pairs, and pairs
of branches whose largest possible overlap is too small are left out. What
remains is compared in full.

How nodes meet. A sketch holds the `sketch` smallest hashes of a set. Of two
sets with a similarity of t or more, each of the smallest hashes of their union
is in both with chance t, so with t = 0.75 they miss each other in a sketch of
48 with a chance of 0.25 ** 48; sets of up to 48 shingles cannot miss. Hashes in
more than `crowd` sketches are set aside where they are less than half of a
node's sketch: its other hashes, 25 or more or all it has, are then alike by
one half or more to those of any set that it links with, and meet as well.

What is compared. First every node with the smallest node of each place it
meets others, then, in crowds, with others by hash, which joins most groups with
a row per node, however large they are. Then, with trees, all nodes that still
meet nodes of another class. Places with more than `tile` nodes are dealt into
blocks, and each pair of blocks that may hold two classes is a task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import lazily
from cellweave.llm.components import components
from cellweave.llm.words import Words, groups, joined, mixed, words_of
from cellweave.session import cut_lineage, scratch_path

BITS = 2048
#: Pairs of branches that are looked at in one go.
AT_ONCE = 1 << 15


@dataclass(frozen=True)
class JaccardJoin:
    words: int = 5
    #: Linked where intersection * whole >= part * union.
    part: int = 75
    whole: int = 100
    sketch: int = 48
    crowd: int = 128
    tile: int = 1024


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Per text, the sorted ids of its distinct n-word shingles; with fewer words, of all its words as one; none without words."""
    words = words_of(texts)
    ids, owner = joined(words, tuple(range(1, n)))
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        size = words.first[i + 1] - words.first[i]
        if 0 < size < n:
            yield _whole(words, i, int(size))
        else:
            yield np.unique(ids[cuts[i] : cuts[i + 1]])


def _whole(words: Words, i: int, size: int) -> np.ndarray:
    own = Words(words.ids[words.first[i] : words.first[i + 1]], np.array([0, size]), words.data, words.place)
    one = own.ids if size == 1 else joined(own, tuple(range(1, size)))[0]
    return mixed(one, 70 + size)


def bitmap_of(tokens: np.ndarray) -> np.ndarray:
    flags = np.zeros(BITS, bool)
    flags[(tokens >> np.uint64(20)) % np.uint64(BITS)] = True
    return np.packbits(flags).view(np.int64)


def sketches(docs: DataFrame, join: JaccardJoin) -> DataFrame:
    """`(doc_id, n, s1, s2, sketch, bits)` per row: the size of its set, 128 bits that stand for it, its smallest hashes, its bitmap."""

    def run(batches):
        for batch in batches:
            at = 0
            for group in groups(lazily(batch["text"])):
                n, s1, s2, small, bits = [], [], [], [], []
                for tokens in shingle_sets(group, join.words):
                    n.append(len(tokens))
                    s1.append(int(mixed(tokens, 61).sum(dtype=np.uint64).view(np.int64)))
                    s2.append(int(mixed(tokens, 62).sum(dtype=np.uint64).view(np.int64)))
                    small.append(tokens[: join.sketch].view(np.int64))
                    bits.append(bitmap_of(tokens))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(at, len(group)),
                        pa.array(n, pa.int64()),
                        pa.array(s1, pa.int64()),
                        pa.array(s2, pa.int64()),
                        pa.array(small, pa.list_(pa.int64())),
                        pa.array(bits, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "s1", "s2", "sketch", "bits"],
                )
                at += len(group)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n bigint, s1 bigint, s2 bigint, sketch array<bigint>, bits array<bigint>"
    )


def _may_link(join: JaccardJoin, na, nb, overlap):
    """Whether an intersection of `overlap` suffices: overlap / (na + nb - overlap) >= part / whole."""
    return overlap * (join.whole + join.part) >= (na + nb) * join.part


def _missing(a: str, b: str):
    """How many bits of `a` are not in `b`: so many shingles at least are not in both."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)


def verified(pairs: DataFrame, docs: DataFrame, join: JaccardJoin) -> DataFrame:
    """Those pairs `(a, b)` of ids whose documents link, by their whole sets of shingles."""
    needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.join(needed, "doc_id", "left_semi")

    def sets(batches):
        for batch in batches:
            at = 0
            for group in groups(lazily(batch["text"])):
                made = [t.tobytes() for t in shingle_sets(group, join.words)]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(at, len(group)), pa.array(made, pa.binary())], names=["node", "tokens"]
                )
                at += len(group)

    path = scratch_path(docs.sparkSession, "shingle-sets")
    texts.select("doc_id", "text").mapInArrow(sets, "node bigint, tokens binary").write.parquet(path)
    held = docs.sparkSession.read.schema("node bigint, tokens binary").parquet(path)
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(
        held.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b"
    )

    def compare(batches):
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch["ta"], batch["tb"])):
                # Read in place: the sets of a batch may be large.
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) and len(y):
                    overlap = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                    if overlap * join.whole >= join.part * (len(x) + len(y) - overlap):
                        kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return both.select("a", "b", "ta", "tb").mapInArrow(compare, "a bigint, b bigint")


class SignatureTree:
    """A tree over nodes: leaves of `fan` nodes, branches of `fan` branches.

    A branch has the OR of its bitmaps, its range of sizes, the most shingles
    that a node has beyond its set bits, and its class, or -1 where it holds several.
    """

    def __init__(self, n: np.ndarray, bits: np.ndarray, classes: np.ndarray, fan: int = 8):
        spare = n - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.fan = fan
        self.levels = [(bits, n, n, spare, classes)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, spare, classes = self.levels[-1]
            first = np.arange(0, len(low), fan)
            lowest, highest = np.minimum.reduceat(classes, first), np.maximum.reduceat(classes, first)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bits, first, axis=0),
                    np.minimum.reduceat(low, first),
                    np.maximum.reduceat(high, first),
                    np.maximum.reduceat(spare, first),
                    np.where(lowest == highest, lowest, -1),
                )
            )

    def children(self, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The branches below each of `i`, and which of `i` they belong to."""
        width = len(self.levels[level - 1][1])
        below = i[:, None] * self.fan + np.arange(self.fan)
        which = np.repeat(np.arange(len(i)), self.fan)
        fits = below.ravel() < width
        return below.ravel()[fits], which[fits]


def tree_pairs(left: SignatureTree, right: SignatureTree, join: JaccardJoin, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of different classes that may link: both trees are walked down together, many pairs of branches at once."""
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    waiting = [(np.zeros(1, np.int64), np.zeros(1, np.int64), len(left.levels) - 1, len(right.levels) - 1)]
    while waiting:
        a, b, level_a, level_b = waiting.pop()
        if len(a) > AT_ONCE:
            waiting.append((a[AT_ONCE:], b[AT_ONCE:], level_a, level_b))
            a, b = a[:AT_ONCE], b[:AT_ONCE]
        bits_a, low_a, high_a, spare_a, class_a = (x[a] for x in left.levels[level_a])
        bits_b, low_b, high_b, spare_b, class_b = (x[b] for x in right.levels[level_b])
        shared = np.bitwise_count(bits_a & bits_b).sum(1).astype(np.int64)
        # A shared shingle has a shared bit, or is one of those beyond a node's bits.
        most = np.minimum.reduce([shared + spare_a, shared + spare_b, high_a, high_b])
        kept = _may_link(join, low_a, low_b, most)
        kept &= (high_a * join.whole >= low_b * join.part) & (high_b * join.whole >= low_a * join.part)
        kept &= (class_a != class_b) | (class_a == -1)
        if same:
            # The same tree on both sides, so both levels are the same.
            kept &= (a < b) if level_a == 0 else (a <= b)
        a, b = a[kept], b[kept]
        if level_a == level_b == 0:
            found_a.append(a)
            found_b.append(b)
            continue
        if not len(a):
            continue
        down_a, down_b = same or level_a >= level_b, same or level_b > level_a
        if down_a:
            a, which = left.children(level_a, a)
            b, level_a = b[which], level_a - 1
        if down_b:
            b, which = right.children(level_b, b)
            a, level_b = a[which], level_b - 1
        waiting.append((a, b, level_a, level_b))
    return np.concatenate(found_a), np.concatenate(found_b)


def _tiles(batches, join: JaccardJoin):
    """Candidate pairs of each tile; the rows of a tile follow each other and are at most two blocks."""
    held: list[pa.Table] = []
    last = None

    def made(table: pa.Table):
        side = table["side"].to_numpy()
        n, node, classes = (table[c].to_numpy() for c in ("n", "node", "class"))
        bits = table["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(n), -1)
        trees = []
        for s in (0, 1):
            own = np.flatnonzero(side == s)
            own = own[np.lexsort((node[own], n[own], classes[own]))]
            trees.append((own, SignatureTree(n[own], bits[own], classes[own]) if len(own) else None))
        (rows_a, left), (rows_b, right) = trees
        if left is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = tree_pairs(left, right or left, join, right is None)
        return node[rows_a[a]], node[(rows_a if right is None else rows_b)[b]]

    def flush():
        a, b = made(pa.concat_tables(held))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        tile = table["tile"].to_numpy()
        edges = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
        for begin, end in zip(edges[:-1], edges[1:]):
            if held and tile[begin] != last:
                yield flush()
                held = []
            held.append(table.slice(begin, end - begin))
            last = tile[begin]
    if held:
        yield flush()


def linked(docs: DataFrame, join: JaccardJoin = JaccardJoin()) -> DataFrame:
    """`(doc_id, n_shingles, component_id)` per row of `(doc_id, text, ...)`.

    `component_id` is the smallest id reachable by links. Rows with null, empty
    or blank texts have no shingles and are alone. Rows that share an id are
    taken as linked. A row without an id has the component of the rows with its
    set, null where there are none. Other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    path = scratch_path(spark, "sketches")
    made = sketches(docs, join)
    made.write.parquet(path)
    rows = spark.read.schema(made.schema).parquet(path)
    full = rows.filter("n > 0 AND doc_id IS NOT NULL")

    ids = cut_lineage(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("node")))
    nodes = full.join(ids.select(F.col("node").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"]).select(
        F.col("doc_id").alias("node"), "n", "sketch", "bits"
    )
    postings = nodes.select("node", "n", F.explode("sketch").alias("token"))
    met = postings.groupBy("token").agg(F.count("*").alias("met")).filter("met > 1")
    # Hashes that one sketch only has are most of all; the rest is written once and used by all that follows.
    postings = cut_lineage(postings.join(met, "token"))
    crowded = postings.filter(F.col("met") > join.crowd)
    leaning = crowded.groupBy("node").agg(F.count("*").alias("k"), F.max("n").alias("n")).filter(
        F.col("k") * 2 >= F.least("n", F.lit(join.sketch))
    )
    places = cut_lineage(
        postings.filter(F.col("met") <= join.crowd).unionByName(crowded.join(leaning.select("node"), "node", "left_semi").select(postings.columns))
    )

    bits = nodes.select("node", "n", "bits")
    # Each node with the smallest of each place.
    first = places.groupBy("token").agg(F.min(F.struct("node", "n")).alias("first")).select("token", "first.*")
    links = verified(_near(_stars(places, first, join), bits, join), docs, join)
    links, classes = _classes(links)
    # Then, where crowds are still open, with one of each place by hash, as long as that halves what is open.
    left = None
    while True:
        crowd = cut_lineage(_open(places, classes, join).filter(F.col("size") > join.tile))
        now = crowd.filter("class <> main").count()
        if not now or (left is not None and 2 * now > left):
            break
        left = now
        drawn = crowd.groupBy("token").agg(F.min_by(F.struct("node", "n", "class"), F.xxhash64("token", "node", F.lit(now))).alias("first"))
        drawn = drawn.select("token", "first.node", "first.n", F.col("first.class").alias("first_class"))
        again = _stars(crowd.join(drawn.select("token", "first_class"), "token").filter("class <> first_class"), drawn.drop("first_class"), join)
        more = verified(_near(again, bits, join), docs, join)
        links, classes = _classes(links.unionByName(more))

    more = verified(cut_lineage(_open_pairs(places, classes, bits, join)), docs, join)
    of = lambda c: classes.select(F.col("node").alias(c), F.col("class").alias(f"class_{c}"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")
    )
    last = components(between).select(F.col("node").alias("class"), "component")
    whole = (
        ids.join(classes, "node", "left")
        .withColumn("class", F.coalesce("class", "node"))
        .join(last, "class", "left")
        .select("s1", "s2", F.coalesce("component", "class").alias("component"))
    )
    # Rows that share an id are linked, whatever their sets.
    return rows.select("doc_id", "n", "s1", "s2").join(whole, ["s1", "s2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _stars(places: DataFrame, first: DataFrame, join: JaccardJoin) -> DataFrame:
    """Pairs `(a, b)` of each node of a place and the place's `first` node, where their sizes allow a link."""
    first = first.select("token", F.col("node").alias("b"), F.col("n").alias("m"))
    return (
        places.select("token", F.col("node").alias("a"), "n")
        .join(first, "token")
        .filter((F.col("a") != F.col("b")) & (F.least("n", "m") * join.whole >= F.greatest("n", "m") * join.part))
        .select("a", "b")
        .distinct()
    )


def _near(pairs: DataFrame, bits: DataFrame, join: JaccardJoin) -> DataFrame:
    """Pairs whose bitmaps allow a link."""
    side = lambda c: bits.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}"))
    overlap = F.least(F.col("na") - _missing("bits_a", "bits_b"), F.col("nb") - _missing("bits_b", "bits_a"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").filter(_may_link(join, F.col("na"), F.col("nb"), overlap))
    return cut_lineage(met.select("a", "b").distinct())


def _classes(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links, written, and `(node, class)` of the nodes they have."""
    links = cut_lineage(links)
    return links, cut_lineage(components(links).select("node", F.col("component").alias("class")))


def _open(places: DataFrame, classes: DataFrame, join: JaccardJoin) -> DataFrame:
    """Rows of places that hold nodes of several classes, with the class of most of its nodes (`main`), and their number in all (`size`) and in others (`others`).

    Of places with the same nodes only one is given.
    """
    held = places.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    per_class = held.groupBy("token", "class").agg(
        F.count("*").alias("k"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")
    )
    several = (
        per_class.groupBy("token")
        .agg(F.max_by("class", F.struct("k", "class")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("size"), F.sum("who").alias("who"))
        .filter("most < size")
        .groupBy("size", "who")
        .agg(F.min_by(F.struct("token", "main", "most"), "token").alias("one"))
        .select("one.token", "one.main", "size", (F.col("size") - F.col("one.most")).alias("others"))
    )
    return held.join(several, "token").select("token", "node", "n", "class", "main", "size", "others")


def _open_pairs(places: DataFrame, classes: DataFrame, bits: DataFrame, join: JaccardJoin) -> DataFrame:
    """Pairs that may link at places that still hold nodes of several classes, by signature trees.

    A place of up to `tile` nodes is a tile. In larger ones, nodes outside the
    main class are dealt into blocks that meet each other, and those of the main class into blocks that only meet the former.
    """
    small = F.col("size") <= join.tile
    minor = F.when(small, F.lit(1)).otherwise(F.ceil(F.col("others") / join.tile)).cast("int")
    major = F.when(small, F.lit(0)).otherwise(F.ceil((F.col("size") - F.col("others")) / join.tile)).cast("int")
    is_major = ~small & (F.col("class") == F.col("main"))
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    dealt = _open(places, classes, join).withColumns({"minor": minor, "major": major})
    dealt = dealt.select(
        "token", "node", "n", "class",
        F.when(is_major, F.col("minor") + deal(F.col("major"))).otherwise(deal(F.col("minor"))).alias("own"),
        F.when(is_major, F.col("minor")).otherwise(F.col("minor") + F.col("major")).alias("meets"),
    )
    tiles = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)).alias("other")).select(
        F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("tile"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "node",
        "n",
        "class",
    )
    carried = tiles.join(bits.select("node", "bits"), "node").repartition("tile").sortWithinPartitions("tile", "side", "node")
    return carried.mapInArrow(lambda batches: _tiles(batches, join), "a bigint, b bigint").distinct()


def one_of_each(docs: DataFrame, join: JaccardJoin = JaccardJoin()) -> DataFrame:
    """The rows of `docs` with one document of each component: that with the smallest id; of rows with that id, one. Rows without an id stay."""
    gone = linked(docs, join).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    repeated = docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL")
    if not repeated.head(1):
        return left
    return left.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(left.filter("doc_id IS NULL"))
