"""Repeated passages by De Bruijn compaction.

Every window of `window` words is an edge, from the node of its first words but
one to the node of its last. Edges are not handled one by one. Neighbouring
windows that share their core, the run of `core` words with the smallest hash
in them, are a run; equal windows have equal cores, so what repeats is found
among the runs of cores that occur more than once, and a row stands for seven
windows or so.

Equal runs are one class, known by its first place. A class that is always
followed by the same one, which occurs no more often, joins up with it: paths
without branches become one row, by a join on coordinates. All but the first
place of a path repeat it. Where one core has several classes their windows may
repeat each other in part, and there the windows of first places are compared.

Every repeated span names its source, and both are read again: digests of their
words must agree, or all is done anew with other hashes.

Only bit sets of a fixed largest size are sent to tasks. They keep rows that
cannot repeat, and documents that need no second look, out of shuffles; what
they let through too much does no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import lazily
from cellweave.llm.words import groups, mixed, span_ids
from cellweave.session import cut_lineage, scratch_path
from cellweave.tables import in_order

#: A run has fewer windows than this; its start and length share one number.
RUN = 256


@dataclass(frozen=True)
class Repeats:
    window: int = 20
    core: int = 8
    seed: int = 0
    #: Bits of word hashes that count; all but in tests, which make them collide.
    hash_bits: int = 64
    #: A bit set has 32 bits per entry, and at most so many in all (16 MB).
    most_bits: int = 1 << 27

    def __post_init__(self):
        if not 0 < self.core <= self.window or self.window - self.core + 1 >= RUN:
            raise ValueError("a core has at least one word and at most those of a window, which has less than 255 more")


def word_ids(texts: list[bytes], repeats: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, unchanged, and where those of each text begin."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    place = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    ids = span_ids(data, begin, end) if len(begin) else np.zeros(0, np.uint64)
    return mixed(ids >> np.uint64(64 - repeats.hash_bits), 900 + repeats.seed), np.searchsorted(begin, place)


@dataclass
class Runs:
    """Runs of windows in reading order: their text, first window, number of windows, core, hash of all their words, and that of the next run (0: none).

    `ids` are those of the words of all texts, `first` is where each text begins among them.
    """

    text: np.ndarray
    start: np.ndarray
    n: np.ndarray
    core: np.ndarray
    whole: np.ndarray
    after: np.ndarray
    ids: np.ndarray
    first: np.ndarray


def runs_of(texts: list[bytes], repeats: Repeats) -> Runs:
    ids, first = word_ids(texts, repeats)
    k, c = repeats.window, repeats.core
    if len(ids) < k:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none, none, none, ids, first)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    at = np.arange(len(ids) - c + 1)
    cores = span_ids(ids, at, at + c)
    least = sliding_window_view(cores, k - c + 1).argmin(1)
    window = np.flatnonzero(owner[: len(ids) - k + 1] == owner[k - 1 :])
    place, text = (least + np.arange(len(least)))[window], owner[window]
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(window)))
    start, text = window[begin], text[begin]
    whole = span_ids(mixed(ids, 77), start, start + n + k - 1).view(np.int64)
    after = np.where(np.append(text[1:] == text[:-1], False)[: len(text)], np.append(whole[1:], 0)[: len(text)], 0)
    return Runs(text, start - first[text], n, cores[place[begin]].view(np.int64), whole, after, ids, first)


class BitSet:
    """Hashes that may be in a set: none that is in it is missed."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, hashes: DataFrame, most_bits: int) -> BitSet:
        """Of a written table with one column `h`. Tasks make its words, the driver only lays them out: at most `most_bits`."""
        n, bits = hashes.count(), 1 << 16
        while bits < min(32 * n, most_bits):
            bits *= 2
        at = F.col("h").bitwiseAND(F.lit(bits - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))
        rows = hashes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("set")).toArrow()
        words = np.zeros(bits >> 6, np.uint64)
        words[rows["word"].to_numpy()] = rows["set"].to_numpy().view(np.uint64)
        return cls(words)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) & np.uint64(len(self.words) * 64 - 1)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _from_texts(docs: DataFrame, schema: str, work: Callable[[list[bytes], np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """Rows that `work` makes of the texts and keys of a few documents at a time."""

    def run(batches):
        for batch in batches:
            at = 0
            keys = batch["key"].to_numpy()
            for group in groups(lazily(batch["text"])):
                made = work(group, keys[at : at + len(group)])
                at += len(group)
                yield pa.RecordBatch.from_pydict({name: pa.array(v) for name, v in made.items()})

    return docs.select("key", "text").mapInArrow(run, schema)


def _written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to the shared folder (compressed, unlike checkpoints) and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> DataFrame:
    """`(key, doc_id, text)`: keys have the order of documents. They are the ids where these are known and all different.

    Else documents are numbered: ids ascend, null last, rows of one id by their text.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if not docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").head(1):
        return docs.select(F.col("doc_id").alias("key"), "doc_id", "text")
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    # Written, since equal rows may change places when they are numbered anew.
    return cut_lineage(in_order(docs.withColumn("_all", F.lit(0)), ("_all",), order, "key")).select("key", "doc_id", "text")


def repeated_spans(docs: DataFrame, repeats: Repeats = Repeats()) -> DataFrame:
    """`(key, start, n, source, source_start)`: `n` windows from `start` on also start earlier, at `source_start` of `source`.

    `docs` is `(key, doc_id, text)` as `keyed` makes it. Every window whose words
    also start earlier is in one of the spans.
    """
    for _ in range(4):
        spans = _written(_joined_up(_spans(docs, repeats)), "spans")
        if not wrong(docs, spans, repeats).head(1):
            return spans
        repeats = replace(repeats, seed=repeats.seed + 1, hash_bits=64)
    raise RuntimeError("words of repeated spans differ from their sources with four sets of hashes")


def _spans(docs: DataFrame, repeats: Repeats) -> DataFrame:
    send = docs.sparkSession.sparkContext.broadcast
    only_cores = _from_texts(docs, "core bigint", lambda texts, _: {"core": runs_of(texts, repeats).core})
    again = _written(_repeated(only_cores.select(F.col("core").alias("h"))), "cores")
    cores = send(BitSet.of(again, repeats.most_bits))

    def kept(texts, keys):
        runs = runs_of(texts, repeats)
        on = cores.value.has(runs.core)
        return {
            "core": runs.core[on], "whole": runs.whole[on], "key": keys[runs.text[on]],
            "span": runs.start[on] * RUN + runs.n[on], "after": runs.after[on],
        }

    classes = (
        _from_texts(docs, "core bigint, whole bigint, key bigint, span bigint, after bigint", kept)
        .groupBy("core", "whole")
        .agg(
            F.count("*").alias("times"),
            F.min(F.struct("key", "span")).alias("first"),
            F.min("after").alias("after"),
            F.max("after").alias("other"),
        )
        .select(
            "core", "whole", "times", "first.key", F.expr(f"first.span div {RUN}").alias("start"),
            (F.col("first.span") % RUN).alias("n"), F.when(F.col("after") == F.col("other"), F.col("after")).alias("after"),
        )
    )
    classes = _written(classes, "classes")
    paths = _written(_paths(classes.filter("times > 1")), "paths")

    # Places of paths: those of the class each begins with. All but the first repeat the first.
    heads = send(BitSet.of(paths.select(F.col("whole").alias("h")), repeats.most_bits))

    def of_heads(texts, keys):
        runs = runs_of(texts, repeats)
        on = heads.value.has(runs.whole)
        return {"core": runs.core[on], "whole": runs.whole[on], "key": keys[runs.text[on]], "start": runs.start[on]}

    places = _from_texts(docs, "core bigint, whole bigint, key bigint, start bigint", of_heads)
    firsts = paths.select("core", "whole", "n", F.col("key").alias("source"), F.col("start").alias("source_start"))
    copies = places.join(firsts, ["core", "whole"]).filter("key <> source OR start <> source_start")

    # Windows of first places, where a core has several classes. Those of some other places come along, which repeat them as well.
    several = classes.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
    at = F.col("whole").bitwiseXOR(F.shiftleft("key", 13)).bitwiseXOR(F.col("start"))
    wanted = send(BitSet.of(_written(classes.join(several, "core").select(at.alias("h")), "places"), repeats.most_bits))

    def windows(texts, keys):
        runs = runs_of(texts, repeats)
        key = keys[runs.text]
        on = np.flatnonzero(wanted.value.has(runs.whole ^ (key << 13) ^ runs.start))
        n = runs.n[on]
        start = np.repeat(runs.start[on] - np.cumsum(n) + n, n) + np.arange(n.sum())
        begin = start + np.repeat(runs.first[runs.text[on]], n)
        one, two = (span_ids(mixed(runs.ids, seed), begin, begin + repeats.window).view(np.int64) for seed in (78, 79))
        return {"one": one, "two": two, "key": np.repeat(key[on], n), "start": start}

    edges = _written(_from_texts(docs, "one bigint, two bigint, key bigint, start bigint", windows), "edges")
    shared = send(BitSet.of(_written(_repeated(edges.select(F.col("one").alias("h"))), "shared"), repeats.most_bits))

    def that_meet(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.has(batch["one"].to_numpy())))

    met = edges.mapInArrow(that_meet, edges.schema)
    firsts = met.groupBy("one", "two").agg(F.count("*").alias("times"), F.min(F.struct("key", "start")).alias("first")).filter("times > 1")
    firsts = firsts.select("one", "two", F.col("first.key").alias("source"), F.col("first.start").alias("source_start"))
    single = met.join(firsts, ["one", "two"]).filter("key <> source OR start <> source_start").withColumn("n", F.lit(1).cast("bigint"))
    columns = ["key", "start", "n", "source", "source_start"]
    return copies.select(columns).unionByName(single.select(columns))


def _repeated(hashes: DataFrame) -> DataFrame:
    """Those that occur more than once."""
    return hashes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")


def _joined_up(spans: DataFrame) -> DataFrame:
    """Spans that meet or overlap, in the document and at their source alike, as one."""
    order = Window.partitionBy("key", "source", "shift").orderBy("start", "n")
    spans = spans.withColumn("shift", F.col("source_start") - F.col("start"))
    reached = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(reached >= F.col("start"), 0).otherwise(1)
    numbered = spans.withColumn("apart", apart).withColumn("place", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Rows that tie are equal in all that counts here, so their order does not matter.
    whole = numbered.groupBy("key", "source", "shift", "place").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"))
    return whole.select("key", "start", (F.col("end") - F.col("start")).alias("n"), "source", (F.col("start") + F.col("shift")).alias("source_start"))


def _paths(classes: DataFrame) -> DataFrame:
    """Paths without branches: the first class of each, its first place and all its windows.

    Class B goes on class A's path if A is always followed by B and both occur
    equally often: then B always follows A as well. First places then follow each other.
    """
    ahead = classes.select("key", (F.col("start") + F.col("n")).alias("start"), F.col("after").alias("leads_to"), F.col("times").alias("as_often"))
    goes_on = F.coalesce((F.col("leads_to") == F.col("whole")) & (F.col("as_often") == F.col("times")), F.lit(False))
    joined = classes.join(ahead, ["key", "start"], "left").withColumn("goes_on", goes_on)
    by_place = Window.partitionBy("key").orderBy("start")
    path = F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(by_place)
    first = F.min(F.struct("start", "core", "whole"))
    found = joined.withColumn("path", path).groupBy("key", "path").agg(first.alias("first"), F.sum("n").alias("n"))
    return found.select("first.core", "first.whole", "key", "first.start", "n")


def _parted(docs: DataFrame, spans: DataFrame, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """Documents that may have spans, with them (null: none after all), and those that have none. `spans` is `(key, spans)`.

    Only texts of the former are shuffled, and those are packed: `(doc_id, packed, spans)` and `(doc_id, text)`.
    """
    spans = _written(spans, "spans-by-text")
    near = docs.sparkSession.sparkContext.broadcast(BitSet.of(spans.select(F.xxhash64("key").alias("h")), most_bits))
    keys = docs.withColumn("h", F.xxhash64("key"))

    def have(batches):
        for batch in _few(batches):
            some = batch.filter(pa.array(near.value.has(batch["h"].to_numpy())))
            pack = zstandard.ZstdCompressor(level=1).compress
            packed = pa.array([None if t is None else pack(t.encode()) for t in lazily(some["text"])], pa.binary())
            yield pa.RecordBatch.from_arrays([some["key"], some["doc_id"], packed], names=["key", "doc_id", "packed"])

    def have_none(batches):
        for batch in batches:
            yield batch.select(["doc_id", "text"]).filter(pa.array(~near.value.has(batch["h"].to_numpy())))

    having = keys.mapInArrow(have, "key bigint, doc_id bigint, packed binary").join(spans, "key", "left")
    return having.select("doc_id", "packed", "spans"), keys.mapInArrow(have_none, "doc_id bigint, text string")


def _unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    for packed in batch["packed"]:
        yield unpack(packed.as_py()) if packed.is_valid else b""


def _few(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def wrong(docs: DataFrame, spans: DataFrame, repeats: Repeats) -> DataFrame:
    """`(source, source_start, n)` of spans whose words are not those of their source, by a digest of the words at either place."""
    own = spans.select("key", "start", "n", "source", "source_start")
    sources = spans.select(F.col("source").alias("key"), F.col("source_start").alias("start"), "n", "source", "source_start").distinct()
    asked = own.unionByName(sources).groupBy("key").agg(F.collect_list(F.struct("start", "n", "source", "source_start")).alias("spans"))
    some, _ = _parted(docs, asked, repeats.most_bits)

    def run(batches):
        for batch in _few(batches):
            rows = []
            for text, own in zip(_unpacked(batch), batch["spans"].to_pylist()):
                words = text.split()
                for s in own:
                    passage = b" ".join(words[s["start"] : s["start"] + s["n"] + repeats.window - 1])
                    digest = int.from_bytes(hashlib.blake2b(passage, digest_size=8).digest(), "little", signed=True)
                    rows.append((s["source"], s["source_start"], s["n"], digest))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(columns, names=["source", "source_start", "n", "digest"])

    read = some.filter(F.col("spans").isNotNull()).select("packed", "spans").mapInArrow(
        run, "source bigint, source_start bigint, n bigint, digest bigint"
    )
    compared = read.groupBy("source", "source_start", "n").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    return compared.filter("low <> high").select("source", "source_start", "n")


def kept_words(text: bytes, spans: list, window: int) -> tuple[int, int, str]:
    """How many words a text has, how many of them lie in windows of `spans`, and the others, joined by one blank."""
    words = text.split()
    if not spans:
        return len(words), 0, b" ".join(words).decode()
    edge = np.zeros(len(words) + 1, np.int64)
    start = np.array([s["start"] for s in spans])
    np.add.at(edge, start, 1)
    np.add.at(edge, start + [s["n"] + window - 1 for s in spans], -1)
    left = edge.cumsum()[:-1] == 0
    return len(words), int((~left).sum()), b" ".join(compress(words, left)).decode()


def without_repeats(docs: DataFrame, repeats: Repeats = Repeats()) -> DataFrame:
    """`(doc_id, n_words, n_removed, kept)` per row of `(doc_id, text, ...)`; other columns are ignored.

    A word goes if a window that covers it also starts earlier: in a document of
    smaller id, or in the same one. `kept` has the other words, joined by one
    blank. Null, empty and blank texts have no words. Rows without an id come
    last in this order, rows that share one in the order of their texts. An empty
    table gives an empty one.
    """
    docs = keyed(docs)
    spans = repeated_spans(docs, repeats)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    per_text = spans.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    near, far = _parted(docs, per_text, repeats.most_bits)

    def judged(rows: Iterator[tuple[pa.Array, Iterator[bytes], list]]) -> Iterator[pa.RecordBatch]:
        for ids, texts, spans in rows:
            made = [kept_words(text, own or [], repeats.window) for text, own in zip(texts, spans)]
            n_words, n_removed, kept = (pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string())))
            yield pa.RecordBatch.from_arrays([ids, n_words, n_removed, kept], names=["doc_id", "n_words", "n_removed", "kept"])

    def with_spans(batches):
        return judged((b["doc_id"], _unpacked(b), b["spans"].to_pylist()) for b in _few(batches, 256))

    def as_they_are(batches):
        return judged((b["doc_id"], ((t or "").encode() for t in lazily(b["text"])), [None] * b.num_rows) for b in _few(batches, 256))

    # Documents without a span are judged where they are read.
    return near.mapInArrow(with_spans, schema).unionByName(far.mapInArrow(as_they_are, schema))
