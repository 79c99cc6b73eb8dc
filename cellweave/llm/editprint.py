"""Document fingerprints by a randomised edit embedding.

A walk reads a text from its first character. At each step the character under
the pointer is put out, and random bits shared by all texts say, by step and
character, whether the pointer moves on. Texts with a small edit distance fall
back into step after an edit, so the strings put out have a small Hamming
distance. The fingerprint samples these strings: each of its places takes the
step with the smallest random number among all steps of the walk, so that walks
of like length are sampled at the same steps, over the whole text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.components import components
from cellweave.llm.words import mixed
from cellweave.session import cut_lineage, scratch_path

PLACES = 128
CYCLE = 4096  # steps after which the shared bits repeat
#: A task walks through about so many characters side by side, and prepares so many at once.
CHARS = 16_000_000
BLOCK = 1 << 20

_MOVES = (np.random.default_rng(17).random((CYCLE, 256)) < 0.5).astype(np.int64)
_MOVES[:, 0] = 0  # symbol 0 stands after each text: there the walk rests


class _Samples:
    """The steps at which some place has a new smallest random number, and those places."""

    def __init__(self):
        self.upto, self.at = 0, {}

    def reach(self, steps: int) -> dict[int, np.ndarray]:
        if self.upto < steps:
            self.upto = max(1 << 16, 2 * steps)
            found: dict[int, list[int]] = {}
            for place in range(PLACES):
                least = np.minimum.accumulate(mixed(np.arange(self.upto, dtype=np.uint64), 1000 + place))
                for step in np.flatnonzero(np.diff(least, prepend=np.uint64(0xFFFFFFFFFFFFFFFF)) != 0).tolist():
                    found.setdefault(step, []).append(place)
            self.at = {k: np.array(v) for k, v in found.items()}
        return self.at


_SAMPLES = _Samples()


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """PLACES bytes per text, a row each; a text without characters has zeros."""
    out = np.zeros((len(texts), PLACES), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    # A text's symbols, then two of 0; and what is put out at each: a mix of the symbol and the two after it.
    ends = np.cumsum(sizes + 2) - 2
    symbols, shown = np.zeros(ends[-1] + 2, np.uint8), np.zeros(ends[-1] + 2, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK)))
        points = np.frombuffer("\0\0".join([*texts[first:last], ""]).encode("utf-32-le"), "<u4")
        own = slice(ends[first] - sizes[first], ends[last - 1] + 2)
        part = (mixed(points, 51) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
        rest = ends[first:last] - own.start
        part[rest] = part[rest + 1] = 0
        symbols[own] = part
        padded = np.append(part, [0, 0]).astype(np.uint64)
        shown[own] = mixed(padded[:-2] | padded[1:-1] << np.uint64(8) | padded[2:] << np.uint64(16), 52).astype(np.uint8)
        first = last
    lanes = np.flatnonzero(sizes)
    at, end = (ends - sizes)[lanes], ends[lanes]
    samples, step = _SAMPLES.reach(6 * int(sizes.max()) + 64), 0
    while len(lanes):
        if step >= _SAMPLES.upto:
            samples = _SAMPLES.reach(step + 1)
        for step in range(step, step + 128):
            places = samples.get(step)
            if places is not None:
                live = at < end
                out[lanes[live][:, None], places] = shown[at[live]][:, None]
            at += _MOVES[step % CYCLE].take(symbols.take(at))
        step += 1
        live = at < end
        if not live.all():
            lanes, at, end = lanes[live], at[live], end[live]
    return out


def edited(text: str, other: str) -> str:
    """The last third of `text` replaced by the beginning of `other`."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


def likeness(a: Column, b: Column) -> Column:
    """The share of equal places of two fingerprints in hexadecimal."""
    pick = lambda i: F.substr(a, i * 2 + 1, F.lit(2)) == F.substr(b, i * 2 + 1, F.lit(2))
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(PLACES - 1)), pick)) / F.lit(float(PLACES))


def _parts(docs: DataFrame, parts: int, a_part: int = 20) -> list[int]:
    """Ids that part all rows about evenly, falling; from the rows with the smallest hashes."""
    few = docs.select("key").orderBy(F.xxhash64("key"), "key").limit(parts * a_part).collect()
    keys = sorted(r["key"] for r in few)
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}, reverse=True) if keys else []


def with_next(docs: DataFrame) -> DataFrame:
    """`(part, extra, key, doc_id, text)` of `(doc_id, text)`, dealt so that each row's next one, by falling id, is the next row of its partition.

    Rows are dealt to ranges of ids and sorted there. The first row of each
    range is also given, marked as extra, to the range before; the first of all
    to the last. Rows of one id are ordered by text.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    docs = docs.select("doc_id", "text", key.alias("key"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _parts(docs, 4 * tasks)
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: F.col("key") < b)) if bounds else F.lit(0)
    placed = docs.withColumn("part", part)
    heads = {r["part"]: r["key"] for r in placed.groupBy("part").agg(F.max("key").alias("key")).collect()}
    if not heads:
        return placed.withColumn("extra", F.lit(False))
    order = sorted(heads)
    before = [(heads[p], order[i - 1]) for i, p in enumerate(order)]  # a number per range
    where = F.element_at(F.create_map(*[F.lit(x) for pair in before for x in pair]), F.col("key"))
    extra = docs.filter(F.col("key").isin([k for k, _ in before])).withColumn("part", where)
    both = placed.withColumn("extra", F.lit(False)).unionByName(extra.withColumn("extra", F.lit(True)))
    return both.repartition(tasks, "part").sortWithinPartitions("part", "extra", F.desc("key"), "text")


def fingerprint(docs: DataFrame) -> DataFrame:
    """`(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)` per row of `(doc_id, text, ...)`.

    Null texts count as empty. A row's next one is that with the next smaller
    id, after the last the first; rows without an id come last, rows of one id are ordered by their text;
    a single row is its own next one. Other columns are ignored; an empty table gives an empty one.
    """

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*[batch[c].to_pylist() for c in ("part", "extra", "doc_id", "text")]):
                held.append(row)
                size += len(row[3] or "")
                if size > CHARS and len(held) > 1:
                    yield from made(held)
                    held, size = held[-1:], len(held[-1][3] or "")
        yield from made(held)

    def made(rows):
        """All but extra rows and, as its next one is not there yet, the last row."""
        texts = [r[3] or "" for r in rows]
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not pairs:
            return
        changed = [edited(texts[i], texts[i + 1]) for i in pairs]
        prints = fingerprints_of(texts + changed)
        own, other = prints[pairs], prints[len(texts) :]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in pairs], pa.int64()),
                pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([p.tobytes().hex() for p in own]),
                pa.array([p.tobytes().hex() for p in other]),
                pa.array((own == other).mean(1)),
                pa.array((own == prints[np.array(pairs) + 1]).mean(1)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    rows = with_next(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return rows.select("part", "extra", "doc_id", "text").mapInArrow(
        run,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def near_classes(prints: DataFrame, least: float = 0.75, bands: int = 24, places: int = 6, tile: int = 512) -> DataFrame:
    """`(fingerprint, class_id)` of `(fingerprint)`: distinct fingerprints, linked where they meet in a band and their likeness is `least` or more.

    A band is `places` sampled places; fingerprints that agree on all of them
    meet in its bucket. Each is compared with the bucket's first one. In buckets
    that then still hold several classes, all of different classes are compared, in tiles.
    `class_id` is the smallest fingerprint of the class.
    """
    rng = np.random.default_rng(23)
    own = prints.select("fingerprint").filter(F.col("fingerprint").isNotNull()).distinct()
    # Numbers stand for fingerprints, so that rows of bands are narrow.
    own = cut_lineage(own.select(F.monotonically_increasing_id().alias("node"), F.unhex("fingerprint").alias("bytes")))
    picks = [sorted(rng.choice(PLACES, places, replace=False).tolist()) for _ in range(bands)]
    # Buckets that share a number by chance are compared as one.
    keys = [F.xxhash64(F.lit(b), *[F.substr("bytes", F.lit(p + 1), F.lit(1)) for p in pick]) for b, pick in enumerate(picks)]
    met = own.select("node", F.explode(F.array(*keys)).alias("band"))
    met = met.join(met.groupBy("band").count().filter("count > 1").select("band"), "band")
    path = scratch_path(own.sparkSession, "bands")
    met.write.parquet(path)
    met = own.sparkSession.read.schema(met.schema).parquet(path)
    first = met.groupBy("band").agg(F.min("node").alias("b"))
    pairs = met.join(first, "band").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    side = lambda c: own.select(F.col("node").alias(c), F.hex("bytes").alias(f"print_{c}"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").filter(likeness(F.col("print_a"), F.col("print_b")) >= least)
    classes = cut_lineage(components(links.select("a", "b")).select("node", F.col("component").alias("class")))
    last = components(_open_links(met, classes, own, least, tile)).select(F.col("node").alias("class"), "component")
    whole = own.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")).join(last, "class", "left")
    path = scratch_path(own.sparkSession, "print-classes")
    whole = whole.select("bytes", F.coalesce("component", "class").alias("class"))
    whole.write.parquet(path)
    whole = own.sparkSession.read.schema(whole.schema).parquet(path)
    names = whole.groupBy("class").agg(F.min("bytes").alias("least"))
    return whole.join(names, "class").select(F.lower(F.hex("bytes")).alias("fingerprint"), F.lower(F.hex("least")).alias("class_id"))


def _open_links(met: DataFrame, classes: DataFrame, own: DataFrame, least: float, tile: int) -> DataFrame:
    """Links `(a, b)` of classes in buckets that hold several.

    A bucket of up to `tile` nodes is a tile. In larger ones, nodes outside the
    largest class are dealt into blocks that meet each other, and those of that class into blocks that only meet the former.
    """
    held = met.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    several = (
        held.groupBy("band", "class")
        .agg(F.count("*").alias("k"))
        .groupBy("band")
        .agg(F.max_by("class", F.struct("k", "class")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("size"))
        .filter("most < size")
    )
    small = F.col("size") <= tile
    minor = F.when(small, F.lit(1)).otherwise(F.ceil((F.col("size") - F.col("most")) / tile)).cast("int")
    major = F.when(small, F.lit(0)).otherwise(F.ceil(F.col("most") / tile)).cast("int")
    is_major = ~small & (F.col("class") == F.col("main"))
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    dealt = held.join(several, "band").withColumns({"minor": minor, "major": major})
    dealt = dealt.select(
        "band", "node", "class",
        F.when(is_major, F.col("minor") + deal(F.col("major"))).otherwise(deal(F.col("minor"))).alias("own"),
        F.when(is_major, F.col("minor")).otherwise(F.col("minor") + F.col("major")).alias("meets"),
    )
    tiles = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)).alias("other")).select(
        F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("tile"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "node",
        "class",
    )

    def run(batches):
        held, at = [], None
        for batch in batches:
            for row in zip(*[batch[c].to_pylist() for c in ("tile", "side", "class", "bytes")]):
                if row[0] != at:
                    yield from linked(held)
                    held, at = [], row[0]
                held.append(row[1:])
        yield from linked(held)

    def linked(rows):
        """Links that join what is alike in a tile: within its one side, or between its two."""
        if len(rows) < 2:
            return
        sides, names = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
        prints = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, PLACES)
        split, now, found = int((sides == 0).sum()), names.copy(), []
        for i in range(split):
            rest = slice(split if split < len(rows) else i + 1, None)
            alike = (prints[i] == prints[rest]).sum(1) >= least * PLACES
            for j in np.flatnonzero(alike & (now[rest] != now[i])) + rest.start:
                if now[j] != now[i]:
                    found.append((names[i], names[j]))
                    now[now == now[j]] = now[i]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    carried = tiles.join(own, "node").repartition("tile").sortWithinPartitions("tile", "side", "node")
    return carried.select("tile", "side", "class", "bytes").mapInArrow(run, "a bigint, b bigint").distinct()


def with_classes(docs: DataFrame) -> DataFrame:
    """`fingerprint(docs)` and the `class_id` of each row's fingerprint among all of them.

    What is written and joined meanwhile has the prints as bytes, half as long as their text.
    """
    made = fingerprint(docs)
    prints = ["edited_sha256", "fingerprint", "edited_fingerprint"]
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "fingerprints")
    narrow = made.withColumns({c: F.unhex(c) for c in prints})
    narrow.write.parquet(path)
    found = spark.read.schema(narrow.schema).parquet(path)
    as_text = lambda c: F.lower(F.hex(c))
    classes = near_classes(found.select(as_text("fingerprint").alias("fingerprint")))
    joined = found.join(classes.select(F.unhex("fingerprint").alias("fingerprint"), "class_id"), "fingerprint")
    return joined.select(*[as_text(c).alias(c) if c in prints else F.col(c) for c in made.columns], "class_id")
