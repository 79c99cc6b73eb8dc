"""Packing documents into sequences along a Hilbert curve.

Hashed word vectors are projected to few dimensions; the place on the Hilbert
curve through them is the sort key, so that neighbours in a sequence speak of
like things. Rows are range-sorted by the key, tokens laid end to end in that
order, and the line is cut into sequences: only the last one has padding.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import lazily
from cellweave.llm.words import groups, mixed, span_ids, words_of
from cellweave.session import cut_lineage

DIMENSIONS = 4
BITS = 10  # per dimension


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class Packing:
    tokenizer: str
    length: int = 1024
    end_id: int = 0


class Coder:
    """Token ids of whole texts. What stands between places where the tokenizer always parts is looked up, once tokenized.

    These places are: before a blank that a sign follows, on both sides of a
    single line break between ASCII signs, and between an ASCII letter and ASCII punctuation.
    """

    #: The look-up table starts anew beyond so many entries.
    HELD = 1_000_000

    def __init__(self, path: str):
        # A task has one core; threads of the tokenizer would take those of others.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        self.known = np.zeros(0, np.uint64)  # ids of spans, sorted
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, spans: list[bytes], place: np.ndarray) -> None:
        """Take up new spans. `keys` are sorted, and `place` is where they belong among those known."""
        coded = [e.ids for e in self.coder.encode_batch_fast([s.decode() for s in spans], add_special_tokens=False)]
        size = np.array([len(c) for c in coded], np.int64)
        at = len(self.tokens) + np.cumsum(size) - size
        self.tokens = np.concatenate([self.tokens, np.fromiter(chain.from_iterable(coded), np.uint32, int(size.sum()))])
        self.known = np.insert(self.known, place, keys)
        self.at, self.size = np.insert(self.at, place, at), np.insert(self.size, place, size)

    def encode(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        """The ids of each text, then `end_id`."""
        if len(self.known) > self.HELD:
            self.known, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(data):
            return [np.array([end_id], np.uint32) for _ in texts]
        kind = _KIND[data]
        after = np.append(kind[1:], 0)  # what follows a byte
        before = np.append(0, kind[:-1])
        cut = ((data == 32) & (after != SPACE) & (after != OTHER)) | ((kind == MARK) & (before == LETTER))
        ascii_sign = lambda k: (k == LETTER) | (k == MARK) | (k == DIGIT)
        lone = (data == 10) & ascii_sign(before) & ascii_sign(after)
        cut |= lone
        cut[1:] |= lone[:-1]
        cut[0] = True
        inner = first[first < len(data)]
        cut[inner] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
        spans = span_ids(data, begin, end)
        keys, where, which = np.unique(spans, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != keys
        if new.any():
            raw = data.tobytes()
            self._learn(keys[new], [raw[begin[i] : end[i]] for i in where[new]], place[new])
            # A key has moved by the number of new ones before it.
            place = place + np.cumsum(new) - new
        at, size = self.at[place][which], self.size[place][which]
        upto = np.cumsum(size)
        ids = self.tokens[np.repeat(at - (upto - size), size) + np.arange(upto[-1])]
        bounds = np.append(0, upto)[np.searchsorted(begin, first)]
        return [np.append(ids[a:b], np.uint32(end_id)) for a, b in zip(bounds[:-1], bounds[1:])]


SPACE, LETTER, DIGIT, MARK, OTHER, FOREIGN = range(6)
#: What a byte of UTF-8 can be. OTHER: controls, and bytes that may begin or belong to a white space beyond ASCII.
_KIND = np.full(256, FOREIGN, np.uint8)
_KIND[:33] = OTHER
_KIND[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = SPACE
_KIND[33:127] = MARK
_KIND[127] = OTHER
_KIND[48:58] = DIGIT
_KIND[65:91] = LETTER
_KIND[97:123] = LETTER
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = OTHER


@lru_cache(maxsize=2)
def _coder(path: str) -> Coder:
    return Coder(path)


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with `bits` bits per axis (Skilling's transform, for all points at once)."""
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= np.where(high, 0, swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """Hilbert keys of texts: signed hashes of their words are summed per dimension, scaled by the root of the word count."""
    words = words_of(texts)
    owner, n = words.owner(), np.maximum(np.diff(words.first), 1)
    spread = mixed(words.ids, 31)
    axes = []
    for d in range(DIMENSIONS):
        value = ((spread >> np.uint64(16 * d)) & np.uint64(0xFFFF)).astype(float) / 32767.5 - 1
        total = np.bincount(owner, weights=value, minlength=len(texts)) / n
        # Frequent words move a text's mean away from 0; a tenth is far.
        axes.append(np.clip((np.tanh(total * 5) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1))
    return hilbert(np.stack(axes, 1).astype(np.int64))


def tokenized(docs: DataFrame, packing: Packing, bounds: list[int]) -> DataFrame:
    """`(doc_id, part, curve, ids, n)` per row: `ids` packed, `n` their number with the end id, `part` by `bounds`."""
    path, end = packing.tokenizer, packing.end_id
    edges = np.array(bounds, np.int64)

    def run(batches):
        coder = _coder(path)
        for batch in batches:
            ids, at = batch["doc_id"], 0
            for group in groups(lazily(batch["text"]), 1 << 20):
                own = ids.slice(at, len(group))
                keys = sort_keys(group, own.to_pylist())
                coded = coder.encode(group, end)
                yield pa.RecordBatch.from_arrays(
                    [
                        own,
                        pa.array(np.searchsorted(edges, keys, side="right"), pa.int32()),
                        pa.array(keys, pa.int64()),
                        pa.array([_packed(c) for c in coded], pa.binary()),
                        pa.array([len(c) for c in coded], pa.int64()),
                    ],
                    names=["doc_id", "part", "curve", "ids", "n"],
                )
                at += len(group)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part int, curve bigint, ids binary, n bigint")


def _packed(ids: np.ndarray) -> bytes:
    """Ids as 16 bits where all fit, else 32 (told by the last byte), compressed."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    raw = ids.astype("<u4" if wide else "<u2").tobytes()
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True) + (b"\1" if wide else b"\0")


def _unpacked(held: bytes, n: int) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    wide = held[-1] == 1
    raw = pa.Codec("zstd").decompress(held[:-1], n * (4 if wide else 2), asbytes=True)
    return raw if wide else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def sort_keys(texts: list[bytes], ids: list) -> np.ndarray:
    """The place on the curve, then a hash of the id: documents at one place are spread over tasks as others are."""
    spread = np.array([zlib.crc32(str(i).encode()) for i in ids], np.int64)
    return curve_keys(texts) << 23 | spread >> 9


def _bounds(docs: DataFrame, parts: int, a_part: int = 20) -> list[int]:
    """Keys that part the curve evenly, from the documents with the smallest hashes, `a_part` for each part."""
    few = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(parts * a_part)

    def keys(batches):
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"].to_pylist()
            found = [sort_keys([(t or "").encode()], [i])[0] for t, i in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["key"])

    # `few` is bounded by its limit; only one number per document comes back.
    chosen = docs.select("doc_id", "text").join(F.broadcast(few.distinct()), "doc_id", "left_semi")
    table = chosen.mapInArrow(keys, "key bigint").toArrow()
    found = np.sort(np.array(table["key"].to_pylist(), np.int64))
    return sorted(set(found[np.arange(1, parts) * len(found) // parts].tolist())) if len(found) else []


def pack(docs: DataFrame, packing: Packing | None = None) -> DataFrame:
    """One row per piece of a document: `(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)`.

    `ids` are the piece's ids as little-endian unsigned 32-bit numbers. Null and
    empty texts are one piece of the end id. Documents at one place of the curve
    are ordered by a hash of doc_id (null: of "None"), then doc_id, then ids; which of several equal
    rows comes first makes no difference. A document longer than a sequence, or
    at the edge of one, is cut. Every sequence but the last is full. Other
    columns are ignored; an empty table gives an empty one.

    Texts are tokenized once, sent to the part of the curve they belong to, and
    sorted there. Tokens are summed per part, the sums before each part are
    added up on the driver (a number per part), and tasks count on from there.
    """
    packing = packing or Packing(default_tokenizer())
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tokenized(docs, packing, _bounds(docs, 8 * tasks))
    order = ["part", "curve", "doc_id", "ids"]
    line = cut_lineage(rows.repartition(tasks, "part").sortWithinPartitions(*order))
    before, upto = {}, 0
    for row in sorted(line.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["part"]):
        before[row["part"]] = upto
        upto += row["n"]
    length = packing.length

    def run(batches):
        next_at = {}
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            parts, counts = batch["part"].to_numpy(), batch["n"].to_numpy()
            begins = np.zeros(len(counts), np.int64)
            for part in np.unique(parts).tolist():
                own = parts == part
                upto = next_at.get(part, before[part]) + np.cumsum(counts[own])
                begins[own] = upto - counts[own]
                next_at = {part: int(upto[-1])}
            pieces = (begins + counts - 1) // length - begins // length + 1
            row = np.repeat(np.arange(len(counts)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = begins[row] // length + nth
            begin = np.maximum(begins[row], sequence * length)
            end = np.minimum(begins[row] + counts[row], (sequence + 1) * length)
            start, size = begin - begins[row], end - begin
            ids = [_unpacked(held, n) for held, n in zip(batch["ids"].to_pylist(), counts.tolist())]
            cut = [ids[r][4 * s : 4 * (s + z)] for r, s, z in zip(row.tolist(), start.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(row)),
                    pa.array(start),
                    pa.array(size),
                    pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                    pa.array(counts[row]),
                    pa.array(sequence),
                    pa.array(begin - sequence * length),
                    pa.array(cut, pa.binary()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return line.select("part", "doc_id", "ids", "n").mapInArrow(
        run,
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary",
    )
