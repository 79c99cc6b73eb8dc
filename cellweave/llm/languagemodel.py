"""LM scoring with a gated recurrent network, learned and run in numpy.

A token's probability is that of its class times that within its class. The
most frequent words have classes of their own kind, with a softmax each. All
other tokens fall in open classes by their last letters; within one, a token's
share is its smoothed count in the whole corpus. Every document starts from an
empty state, which is carried from window to window until its end token.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import fresh, held_out, lazily
from cellweave.llm.words import groups, mixed, words_of
from cellweave.session import cut_lineage, scratch_path

END = np.uint64(0x5E0D)
OPEN = 32  # open classes
LANES = 512


@dataclass(frozen=True)
class Shape:
    """Size of the network and bounds of what it is learned from."""

    words: int = 2048
    classes: int = 45
    hidden: int = 16
    window: int = 16
    lanes: int = 64
    rate: float = 0.01
    #: Lanes of a long block of tokens: of at least 64 windows each, up to so many side by side.
    wide: int = 512
    #: Tokens that a task lays out in lanes at once.
    block: int = 1 << 20
    #: Sixteenths of all training documents per round; after each, the weights of its tasks are averaged.
    rounds: tuple[int, ...] = (1, 2, 3, 3, 3, 4)
    #: Counts of at most so many frequent tokens are sent to all tasks; the others are joined.
    max_shared: int = 1 << 18


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids (words, then an end per text), their open classes, and where each text's tokens begin."""
    words = words_of(texts)
    n = len(texts)
    first = words.first + np.arange(n + 1)
    at = np.ones(first[-1], bool)
    ends = first[1:] - 1
    at[ends] = False
    ids = np.full(first[-1], END, np.uint64)
    ids[at] = words.ids
    # The class of a word: its last two bytes that are not ASCII punctuation or digits, mixed.
    data = words.data
    kinds = np.zeros(first[-1], np.int64)
    if len(words.ids):
        # A word starts where bytes inside words follow others; the group's last byte is a blank.
        edge = np.diff(_inside(data).view(np.int8), prepend=np.int8(0))
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        last = _last_letters(data, begin, stop)
        pair = data[last].astype(np.uint64) << np.uint64(8) | data[np.maximum(last - 1, begin)].astype(np.uint64)
        kinds[at] = (mixed(pair, 41) % np.uint64(OPEN)).astype(np.int64)
    return ids, kinds, first


def _inside(data: np.ndarray) -> np.ndarray:
    return ~((data == 32) | ((data >= 9) & (data <= 13)))


def _is_letter(data: np.ndarray) -> np.ndarray:
    return (data >= 128) | ((data >= 97) & (data <= 122))


def _last_letters(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Place of the last letter of each word, of its first byte where it has none."""
    last = stop.copy()
    left = np.flatnonzero(~_is_letter(data[last]) & (last > begin))
    # Few words end in more than a sign or two; what is left after a few steps is found in one pass.
    for _ in range(4):
        if not len(left):
            return last
        last[left] -= 1
        left = left[~_is_letter(data[last[left]]) & (last[left] > begin[left])]
    if len(left):
        upto = np.maximum.accumulate(np.where(_is_letter(data), np.arange(len(data)), -1))
        last[left] = np.maximum(upto[stop[left]], begin[left])
    return last


def count_tokens(docs: DataFrame) -> DataFrame:
    """`(token, kind, c)` over all texts of `docs`: counted per task in Arrow batches, then summed."""

    def run(batches):
        held, size = [], 0

        def emit():
            ids = np.concatenate([h[0] for h in held])
            kinds = np.concatenate([h[1] for h in held])
            # By hashing rather than sorting: a task has many tokens and far fewer different ones.
            code, token = pd.factorize(ids)
            kind = np.zeros(len(token), np.int32)
            kind[code] = kinds
            yield pa.RecordBatch.from_arrays(
                [pa.array(token.view(np.int64)), pa.array(kind), pa.array(np.bincount(code, minlength=len(token)))],
                names=["token", "kind", "c"],
            )

        for batch in batches:
            for group in groups(lazily(batch["text"])):
                ids, kinds, _ = tokens_of(group)
                held.append((ids, kinds.astype(np.int8)))
                size += len(ids)
                if size > 6_000_000:
                    yield from emit()
                    held, size = [], 0
        if held:
            yield from emit()

    counted = docs.select("text").mapInArrow(run, "token bigint, kind int, c bigint")
    return counted.groupBy("token").agg(F.first("kind").alias("kind"), F.sum("c").alias("c"))


@dataclass
class Counts:
    """What tasks need of the corpus counts."""

    total: int  # N
    distinct: int  # V
    tokens: np.ndarray  # shared ones, sorted
    counts: np.ndarray
    kinds: np.ndarray
    mass: np.ndarray  # per open class: the sum of c + 0.1 over its tokens outside the words, and 0.1 for unseen ones

    def base(self) -> float:
        return self.total + 0.1 * (self.distinct + 1)


@dataclass
class Gru:
    vocabulary: np.ndarray  # token ids of the words, sorted
    word_class: np.ndarray
    word_place: np.ndarray  # within its class
    p: dict[str, np.ndarray]
    mass: np.ndarray

    def inputs(self, ids: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """A word's own number, or that of its open class."""
        if not len(self.vocabulary):
            return kinds.copy()
        place = np.minimum(np.searchsorted(self.vocabulary, ids), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == ids, place, len(self.vocabulary) + kinds)

    def classes(self, inputs: np.ndarray) -> np.ndarray:
        n, closed = len(self.vocabulary), len(self.p["inner_b"])
        return np.where(inputs < n, self.word_class[np.minimum(inputs, max(n - 1, 0))] if n else 0, closed + inputs - n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(p: dict[str, np.ndarray], gates: np.ndarray, h: np.ndarray):
    """One step of all lanes: `gates` are the input's part of update, reset and candidate."""
    k = h.shape[1]
    own = h @ p["state"]
    zr = _sigmoid(gates[:, : 2 * k] + own[:, : 2 * k])
    z, r = zr[:, :k], zr[:, k:]
    n = np.tanh(gates[:, 2 * k :] + r * own[:, 2 * k :])
    return n + z * (h - n), z, r, n, own[:, 2 * k :]


def _with_ones(h: np.ndarray) -> np.ndarray:
    """States with a last column of ones, which the bias is multiplied with."""
    return np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1)


def _with_bias(p: dict[str, np.ndarray], name: str) -> np.ndarray:
    """Weights of an output with their bias as the last row."""
    return np.concatenate([p[f"{name}_w"], p[f"{name}_b"][..., None, :]], -2)


def _far(weights: np.ndarray) -> bool:
    """Whether sums of these weights with states, none beyond 1, may be too far from 0 to take their exponents as they are."""
    return bool(np.abs(weights).sum(-2).max(initial=0) >= 80)


def _softmax(x: np.ndarray, far: bool) -> np.ndarray:
    """Of each column, in place: numbers of a token stand below each other, so sums and maxima go over whole rows."""
    if far:
        x -= x.max(0)
    np.exp(x, out=x)
    x *= 1 / x.sum(0)
    return x


def begin(words: np.ndarray, word_counts: np.ndarray, kind_mass: np.ndarray, shape: Shape) -> Gru:
    """A network that starts from the corpus shares: words are dealt to classes by falling count."""
    order = np.argsort(words)
    by_count = np.lexsort((words, -word_counts))
    closed = min(shape.classes, max(1, len(words)))
    wide = -(-len(words) // closed) if len(words) else 1
    word_class, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    word_class[by_count], place[by_count] = np.arange(len(words)) // wide, np.arange(len(words)) % wide
    rng = np.random.default_rng(5)
    k = shape.hidden
    small = lambda *s: rng.normal(0, 0.1, s)
    inner_b = np.full((closed, wide), -30.0)
    inner_b[word_class, place] = np.log(word_counts + 0.1)
    sizes = np.concatenate([np.bincount(word_class, weights=word_counts + 0.1, minlength=closed), kind_mass])
    p = {
        "embed": small(len(words) + OPEN, 3 * k),
        "state": small(k, 3 * k),
        "class_w": np.zeros((k, closed + OPEN)),
        # A class without words is as unlikely as a place without one.
        "class_b": np.log(np.maximum(sizes / sizes.sum(), 1e-13)),
        "inner_w": np.zeros((closed, k, wide)),
        "inner_b": inner_b,
    }
    return Gru(words[order], word_class[order], place[order], p, kind_mass)


class Trainer:
    """Truncated backpropagation by Adam; weights and moments can be taken out as one vector and put in again."""

    def __init__(self, gru: Gru, shape: Shape):
        self.gru, self.shape, self.t = gru, shape, 0
        self.m, self.v = ({n: np.zeros_like(a) for n, a in gru.p.items()} for _ in range(2))

    def state(self) -> np.ndarray:
        return np.concatenate([a.ravel() for part in (self.gru.p, self.m, self.v) for a in part.values()])

    def put(self, state: np.ndarray, t: int) -> None:
        at = 0
        for part in (self.gru.p, self.m, self.v):
            for a in part.values():
                a[...] = state[at : at + a.size].reshape(a.shape)
                at += a.size
        self.t = t

    def block(self, flat: np.ndarray, starts: np.ndarray, rate: float, fall: bool = False) -> None:
        """Learn from all tokens of documents laid end to end; `starts` marks the first of each. With `fall` the rate falls to 0 in the second half."""
        shape, k = self.shape, self.shape.hidden
        most = max(shape.lanes, min(shape.wide, len(flat) // (64 * shape.window)))
        lanes = max(1, min(most, len(flat) // shape.window))
        steps = -(-len(flat) // lanes)
        # What fills up the last lane is in no gradient.
        spare = lanes * steps - len(flat)
        flat = np.concatenate([flat, np.zeros(spare, flat.dtype)]).reshape(lanes, steps)
        starts = np.concatenate([starts, np.ones(spare, bool)]).reshape(lanes, steps)
        real = (np.arange(lanes * steps) < lanes * steps - spare).reshape(lanes, steps)
        h = np.zeros((lanes, k), self.gru.p["state"].dtype)
        for at in range(0, steps, shape.window):
            own = slice(at, at + shape.window)
            h, grad = self._gradient(flat[:, own], starts[:, own], real[:, own], h)
            self._move(grad, rate * min(1.0, 2 - 2 * at / steps) if fall else rate, lanes)

    def _gradient(self, xs: np.ndarray, new: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        gru, p, k, closed = self.gru, self.gru.p, self.shape.hidden, len(self.gru.p["inner_b"])
        lanes, w = xs.shape
        hs, kept = [], []
        zero = h.dtype.type(0)
        # The state before token i predicts it; the state after it has read it.
        for i in range(w):
            h = np.where(new[:, i : i + 1], zero, h)
            hs.append(h)
            before = h
            h, z, r, n, cand = step(p, p["embed"][xs[:, i]], h)
            kept.append((before, z, r, n, cand))
        H = np.stack(hs, 1).reshape(-1, k)
        x, live = xs.ravel(), real.ravel()
        c = gru.classes(x)
        grad = {name: np.zeros_like(a) for name, a in p.items()}
        H1, class_wb, inner_wb = _with_ones(H), _with_bias(p, "class"), _with_bias(p, "inner")
        d = _softmax(class_wb.T @ H1.T, _far(class_wb))
        d[c, np.arange(len(x))] -= 1
        if not live.all():
            d[:, ~live] = 0
        both = d @ H1
        grad["class_w"], grad["class_b"] = both[:, :k].T, both[:, k]
        dH = d.T @ p["class_w"].T
        order = np.argsort(np.where(live, c, len(p["class_b"])), kind="stable")
        edges = np.searchsorted(c[order[: live.sum()]], np.arange(closed + 1))
        in_class = order[: edges[-1]]
        far = _far(inner_wb)
        by_class, place, back = H1[in_class], gru.word_place[x[in_class]], np.empty((len(in_class), k), h.dtype)
        for q in range(closed):
            own = slice(edges[q], edges[q + 1])
            if own.stop > own.start:
                near = by_class[own]
                d = _softmax(inner_wb[q].T @ near.T, far)
                d[place[own], np.arange(d.shape[1])] -= 1
                both = d @ near
                grad["inner_w"][q], grad["inner_b"][q] = both[:, :k].T, both[:, k]
                back[own] = d.T @ p["inner_w"][q].T
        dH[in_class] += back
        dH = dH.reshape(lanes, w, k)
        dh, gates = np.zeros_like(h), np.zeros((lanes, w, 3 * k), h.dtype)
        for i in range(w - 1, -1, -1):
            before, z, r, n, cand = kept[i]
            dn = dh * (1 - z) * (1 - n**2)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * cand * r * (1 - r)
            own = np.concatenate([dz, dr, dn * r], 1)
            gates[:, i] = np.concatenate([dz, dr, dn], 1)
            grad["state"] += before.T @ own
            dh = dh * z + own @ p["state"].T + dH[:, i]
            dh = np.where(new[:, i : i + 1], zero, dh)
        order = np.argsort(x, kind="stable")
        first = np.flatnonzero(np.diff(x[order], prepend=-1))
        grad["embed"][x[order[first]]] = np.add.reduceat(gates.reshape(-1, 3 * k)[order], first, axis=0)
        return h, grad

    def _move(self, grad: dict[str, np.ndarray], rate: float, lanes: int) -> None:
        self.t += 1
        for name, a in self.gru.p.items():
            g, m, v = grad[name] / lanes, self.m[name], self.v[name]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)


def train(gru: Gru, docs: list[np.ndarray], shape: Shape) -> None:
    """One pass over documents (their inputs)."""
    if docs:
        starts = np.concatenate([np.arange(len(d)) == 0 for d in docs])
        Trainer(gru, shape).block(np.concatenate(docs), starts, shape.rate, fall=True)


class Scorer:
    """Natural log probabilities of whole documents, many side by side."""

    def __init__(self, gru: Gru):
        self.gru = gru
        self.p = {n: a.astype(np.float32) for n, a in gru.p.items()}
        self.class_wb, self.inner_wb = _with_bias(self.p, "class"), _with_bias(self.p, "inner")
        self.far = _far(self.class_wb), _far(self.inner_wb)

    def scores(self, inputs: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per document; for tokens of open classes this is the class's part only."""
        n_docs, sizes = len(first) - 1, np.diff(first)
        total = np.zeros(n_docs)
        if not n_docs:
            return total
        k = self.p["state"].shape[0]
        lane_of, load = np.zeros(n_docs, np.int64), np.zeros(min(LANES, n_docs), np.int64)
        # Longest first, each to the lane that is free next: lanes are of like length.
        free = [(0, i) for i in range(len(load))]
        for doc in np.argsort(-sizes, kind="stable"):
            used, lane = heapq.heappop(free)
            lane_of[doc] = lane
            load[lane] = used + sizes[doc]
            heapq.heappush(free, (int(load[lane]), lane))
        rank = np.argsort(np.argsort(-load, kind="stable"), kind="stable")
        lane_of, load = rank[lane_of], -np.sort(-load)
        by_lane = np.argsort(lane_of, kind="stable")
        tokens = np.concatenate([np.arange(first[d], first[d + 1]) for d in by_lane])
        lane_first = np.concatenate([[0], np.cumsum(load)])
        doc_of = np.repeat(by_lane, sizes[by_lane])
        is_first = tokens == first[doc_of]
        own = inputs[tokens]
        h = np.zeros((len(load), k), np.float32)
        window = 64
        for at in range(0, int(load[0]), window):
            live_now = int(np.searchsorted(-load, -at, side="left"))
            hs, places = [], []
            for t in range(at, min(at + window, int(load[0]))):
                live = int(np.searchsorted(-load[:live_now], -t, side="left"))
                where = lane_first[:live] + t
                h = h[:live]
                h[is_first[where]] = 0
                hs.append(h)
                places.append(where)
                h = step(self.p, self.p["embed"][own[where]], h)[0]
            at_tokens = np.concatenate(places)
            logs = self._logs(np.concatenate(hs), own[at_tokens])
            total += np.bincount(doc_of[at_tokens], weights=logs, minlength=n_docs)
        return total

    def _logs(self, h: np.ndarray, x: np.ndarray) -> np.ndarray:
        c = self.gru.classes(x)
        closed = len(self.inner_wb)
        # In the order of classes, a few thousand at a time, which stay in the processor's cache.
        order = np.argsort(c, kind="stable")
        edges = np.searchsorted(c[order], np.arange(closed + 1))
        h, x, c, by_class = _with_ones(h[order]), x[order], c[order], np.empty(len(x))
        for at in range(0, len(x), 4096):
            own = slice(at, at + 4096)
            by_class[own] = _picked(self.class_wb.T @ h[own].T, c[own], self.far[0])
        place = self.gru.word_place[x[: edges[-1]]]
        for q in range(closed):
            own = slice(edges[q], edges[q + 1])
            if own.stop > own.start:
                by_class[own] += _picked(self.inner_wb[q].T @ h[own].T, place[own], self.far[1])
        out = np.empty(len(x))
        out[order] = by_class
        return out


def _picked(x: np.ndarray, at: np.ndarray, far: bool) -> np.ndarray:
    """Log softmax at one place per column; `x` is used up."""
    if far:
        x -= x.max(0)
    found = x[at, np.arange(len(at))].astype(np.float64)
    return found - np.log(np.exp(x, out=x).sum(0))


def shared_counts(counts: DataFrame, shape: Shape) -> tuple[DataFrame, Counts, int]:
    """The counts written out, what tasks need of them, and the count from which tokens are shared.

    The bar is the lowest count that leaves at most `max_shared` tokens, so the part on the driver is bounded.
    """
    path = scratch_path(counts.sparkSession, "token-counts")
    counts.write.parquet(path)
    counts = counts.sparkSession.read.schema("token bigint, kind int, c bigint").parquet(path)
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    # How many tokens have a count between powers of two, as the bar need not be finer.
    bins = counts.groupBy(F.floor(F.log2("c") * 4).alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("low")).collect()
    bar, held = 1 << 62, 0
    for row in sorted(bins, key=lambda r: -r["b"]):
        held += row["n"]
        if held > shape.max_shared:
            break
        bar = row["low"]
    table = counts.filter(F.col("c") >= bar).toArrow().sort_by("token")
    tokens = table["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    n = table["c"].to_numpy()[order]
    kinds = table["kind"].to_numpy()[order].astype(np.int64)
    mass = {r["kind"]: r["m"] for r in counts.groupBy("kind").agg(F.sum(F.col("c") + 0.1).alias("m")).collect()}
    found = Counts(
        whole["n"] or 0, whole["v"], tokens[order], n, kinds, np.array([mass.get(q, 0.0) + 0.1 for q in range(OPEN)])
    )
    return counts, found, bar


def start(found: Counts, shape: Shape) -> Gru:
    """The network before it has learned: the most frequent words have outputs of their own."""
    top = np.lexsort((found.tokens, -found.counts))[: shape.words]
    mass = found.mass - np.bincount(found.kinds[top], weights=found.counts[top] + 0.1, minlength=OPEN)
    gru = begin(found.tokens[top], found.counts[top].astype(float), np.maximum(mass, 0.1), shape)
    gru.p = {n: a.astype(np.float32) for n, a in gru.p.items()}
    return gru


def laid_out(docs: DataFrame, found: Counts, gru: Gru, shape: Shape) -> DataFrame:
    """`(doc_id, text, held_out)` as numbers, written by round: what training and scoring read instead of texts.

    `round` is that in which a document is learned, and the number of rounds for held-out ones. `inputs` are the
    network's inputs, `base_part` and `open_part` the sums of the base and of open classes' inner shares over shared
    tokens, `known` how many there are, and `rare` the other tokens.
    """
    base, mass = found.base(), np.log10(gru.mass)
    offsets = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))

    def run(batches):
        for batch in batches:
            at = 0
            for group in groups(lazily(batch["text"])):
                ids, kinds, first = tokens_of(group)
                rows = batch.slice(at, len(group))
                at += len(group)
                inputs = gru.inputs(ids, kinds)
                open_ = inputs >= len(gru.vocabulary)
                place = np.minimum(np.searchsorted(found.tokens, ids), max(len(found.tokens) - 1, 0))
                known = found.tokens[place] == ids if len(found.tokens) else np.zeros(len(ids), bool)
                owner = np.repeat(np.arange(len(group)), np.diff(first))
                total = lambda pick, w: np.bincount(owner[pick], weights=w, minlength=len(group))
                logs = np.log10(found.counts[place[known]] + 0.1) if len(found.tokens) else np.zeros(0)
                base_part = total(known, logs) - np.diff(first) * np.log10(base)
                open_part = total(known, logs * open_[known]) - total(open_, mass[kinds[open_]])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["doc_id"],
                        rows["held_out"],
                        rows["round"],
                        pa.array(np.bincount(owner[known], minlength=len(group))),
                        pa.array(base_part),
                        pa.array(open_part),
                        pa.ListArray.from_arrays(offsets(np.bincount(owner[~known], minlength=len(group))), pa.array(ids[~known].view(np.int64))),
                        pa.ListArray.from_arrays(offsets(np.diff(first)), pa.array(inputs.astype(np.int32))),
                    ],
                    names=["doc_id", "held_out", "round", "known", "base_part", "open_part", "rare", "inputs"],
                )

    spread = F.pmod(F.xxhash64("doc_id"), F.lit(sum(shape.rounds)))
    number = F.lit(len(shape.rounds))
    for n, upto in reversed(list(enumerate(np.cumsum(shape.rounds)))):
        number = F.when(~F.col("held_out") & (spread < int(upto)), n).otherwise(number)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", "held_out", number.alias("round")).mapInArrow(
        run,
        f"doc_id {kind}, held_out boolean, round int, known bigint, base_part double, open_part double, "
        "rare array<bigint>, inputs array<int>",
    )
    path = scratch_path(docs.sparkSession, "inputs")
    rows.write.partitionBy("round").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def fit(rows: DataFrame, gru: Gru, shape: Shape) -> None:
    """Let the network learn from all rows of `laid_out` that are not held out, each in its round.

    In a round, each task goes on from the weights so far with its share of the
    round's documents. Weights and moments are then averaged by numbers of tokens, in
    tasks that hold a piece of them each, so the driver gets one set a round.
    """
    whole, done = Trainer(gru, shape), 0
    for n, share in enumerate(shape.rounds):
        rate = shape.rate * min(1.0, 2 - 2 * (done + share / 2) / sum(shape.rounds))
        got = _round(rows.filter(F.col("round") == n).select("inputs"), gru, shape, whole.state(), whole.t, rate)
        if got is not None:
            whole.put(*got)
        done += share


def learn(docs: DataFrame, found: Counts, shape: Shape) -> Gru:
    """A network that has learned from all of `docs`."""
    gru = start(found, shape)
    fit(laid_out(docs.select("doc_id", "text", F.lit(False).alias("held_out")), found, gru, shape), gru, shape)
    return gru


#: The state is averaged in so many pieces, first within so many groups of tasks, then over the groups.
PIECES = 32
GROUPS_OF_TASKS = 64


def _round(rows: DataFrame, gru: Gru, shape: Shape, state: np.ndarray, t: int, rate: float) -> tuple[np.ndarray, int] | None:
    """The averaged state after all tokens of `rows`, and the most steps of any task; None without documents."""
    cuts = np.linspace(0, len(state), PIECES + 1).astype(int)

    def run(batches):
        own = Trainer(Gru(gru.vocabulary, gru.word_class, gru.word_place, {n: a.copy() for n, a in gru.p.items()}, gru.mass), shape)
        own.put(state, t)
        held, size, tokens = [], 0, 0

        def learned():
            starts = np.zeros(size, bool)
            starts[np.concatenate([[0], np.cumsum(np.concatenate([sizes for _, sizes in held]))[:-1]])] = True
            own.block(np.concatenate([flat for flat, _ in held]), starts, rate)

        for batch in batches:
            for flat, first in _inputs_of(batch, shape.block):
                held.append((flat, np.diff(first)))
                size += len(flat)
                tokens += len(flat)
                if size >= shape.block:
                    learned()
                    held, size = [], 0
        if size:
            learned()
        if tokens:
            out = own.state()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId() % GROUPS_OF_TASKS] * PIECES, pa.int32()),
                    pa.array(range(PIECES), pa.int32()),
                    pa.array([tokens] * PIECES, pa.int64()),
                    pa.array([own.t] * PIECES, pa.int64()),
                    pa.array([out[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                ],
                names=["group", "piece", "tokens", "t", "held"],
            )

    def mean(batches):
        sums: dict[tuple[int, int], list] = {}
        names = ("group", "piece", "tokens", "t", "held")
        for batch in batches:
            for group, piece, tokens, steps, held in zip(*[lazily(batch[c]) for c in names]):
                own = sums.setdefault((group, piece), [0, 0, 0.0])
                own[0] += tokens
                own[1] = max(own[1], steps)
                own[2] = own[2] + tokens * np.frombuffer(held, np.float32).astype(float)
        if sums:
            # The groups are averaged as one group.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * len(sums), pa.int32()),
                    pa.array([piece for _, piece in sums], pa.int32()),
                    pa.array([s[0] for s in sums.values()], pa.int64()),
                    pa.array([s[1] for s in sums.values()], pa.int64()),
                    pa.array([(s[2] / s[0]).astype(np.float32).tobytes() for s in sums.values()], pa.binary()),
                ],
                names=list(names),
            )

    schema = "group int, piece int, tokens bigint, t bigint, held binary"
    each = rows.mapInArrow(run, schema).repartition("group", "piece").mapInArrow(mean, schema)
    found = sorted(each.repartition("piece").mapInArrow(mean, schema).collect(), key=lambda r: r["piece"])
    if not found:
        return None
    return np.frombuffer(b"".join(r["held"] for r in found), np.float32), max(r["t"] for r in found)


def _inputs_of(batch: pa.RecordBatch, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Inputs of some rows of a batch laid end to end, about `most` at a time, and where each row's begin."""
    column = batch["inputs"]
    first = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy()
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(first, first[at] + most, side="right")) - 1)
        yield flat[first[at] : first[to]], first[at : to + 1] - first[at]
        at = to


def score(docs: DataFrame, shape: Shape = Shape(), parts: int = 10, part: int = 0) -> DataFrame:
    """`(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)` per row of `(doc_id, text, ...)`.

    Scores are log10 probabilities of the whole text with its end. Null and
    empty texts have the end token only. Without training rows every count is
    0. Equal texts have equal scores up to rounding; other columns are ignored; an empty table gives an
    empty one. Rows without an id count as held out.

    Tokens are counted over all training rows, and the network learns from all of them. Counts of frequent tokens are
    sent to tasks; the rare tokens of each row are joined with the full counts. Texts are read twice: to count tokens,
    and to write them as the numbers that training and scoring read.
    """
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id"), parts, part).alias("held_out"))
    counts, found, bar = shared_counts(count_tokens(docs.filter(~F.col("held_out"))), shape)
    gru = start(found, shape)
    rows = laid_out(docs, found, gru, shape)
    fit(rows, gru, shape)

    def run(batches):
        scorer = Scorer(gru)
        for batch in batches:
            at = 0
            for flat, first in _inputs_of(batch, 4_000_000):
                some = batch.slice(at, len(first) - 1)
                at += len(some)
                inner = scorer.scores(flat, first) / np.log(10) + some["open_part"].to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [some["doc_id"], some["held_out"], pa.array(np.diff(first)), some["known"], some["base_part"], pa.array(inner), some["rare"]],
                    names=["doc_id", "held_out", "n_tokens", "known", "base_part", "score_part", "rare"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.drop("round").mapInArrow(
        run,
        f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base_part double, score_part double, rare array<bigint>",
    )
    [row] = fresh(scored, "row")
    scored = cut_lineage(scored.withColumn(row, F.monotonically_increasing_id()))
    rare = scored.select(row, F.explode("rare").alias("token"))
    joined = rare.join(counts.filter(F.col("c") < bar).select("token", "c"), "token", "left")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 0.1)
    sums = joined.groupBy(row).agg(F.sum(log_c).alias("logs"), F.count("c").alias("more"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.drop("rare").join(sums, row, "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(found.total).cast("bigint").alias("train_tokens"),
        (F.col("base_part") + logs).alias("base_score"),
        (F.col("score_part") + logs).alias("score"),
    )
