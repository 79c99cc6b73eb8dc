"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

The score is w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j. The pair sum
takes linear time: half of, per factor, the square of the sum less the sum of squares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellweave.llm.common import add_from_text, labelled_sample
from cellweave.llm.words import groups, mixed, words_of

WORD_BITS = 14
STATISTICS = (
    "log_words log_chars mean_word upper digit symbol marked_word distinct_word repeated_line short_line "
    "words_a_line shout bar non_ascii n_chars_known n_chars_off"
).split()
N_FEATURES = (1 << WORD_BITS) + len(STATISTICS)


@dataclass(frozen=True)
class Training:
    factors: int = 8
    epochs: int = 6
    rate: float = 0.1
    l2: float = 1e-4
    #: At most so many labelled rows of either class are learned from.
    per_class: int = 3000


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def statistics(texts: list[bytes], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Structure statistics and metadata, a row per text; and its words' places with the text of each."""
    words = words_of(texts)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    n = len(texts)
    sizes = np.array([len(t) for t in texts], float)
    owner = np.repeat(np.arange(n), np.diff(words.place))

    def count(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags)])
        return (upto[words.place[1:]] - upto[words.place[:-1]]).astype(float)

    upper = (raw >= 65) & (raw <= 90)
    letter = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    digit = (raw >= 48) & (raw <= 57)
    symbol = (raw > 32) & ~letter & ~digit
    rare = symbol & ~np.isin(raw, np.frombuffer(b".,;:'\"-()?", np.uint8))
    n_words = np.diff(words.first).astype(float)
    word_owner = words.owner()
    order = np.lexsort((words.ids, word_owner))
    new = np.ones(len(order), bool)
    new[1:] = (words.ids[order][1:] != words.ids[order][:-1]) | (word_owner[order][1:] != word_owner[order][:-1])
    distinct = np.bincount(word_owner[order][new], minlength=n).astype(float)
    lines, repeated, short = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, text in enumerate(texts):
        own = text.split(b"\n")
        lines[i], repeated[i], short[i] = len(own), len(own) - len(set(own)), sum(len(x) < 20 for x in own)
    said = np.array([-1.0 if c is None else float(c) for c in n_chars])
    code_points = sizes - count((raw & 0xC0) == 0x80)
    stats = np.stack(
        [
            np.log1p(n_words),
            np.log1p(sizes),
            _share(sizes - (n_words - 1), n_words),
            _share(count(upper), count(letter)),
            _share(count(digit), sizes),
            _share(count(symbol), sizes),
            _share(count(rare), n_words),
            _share(distinct, n_words),
            _share(repeated, lines),
            _share(short, lines),
            np.log1p(_share(n_words, lines)),
            _share(count(raw == 33), n_words),
            _share(count(raw == 124), n_words),
            _share(count(raw >= 128), sizes),
            (said >= 0).astype(float),
            np.where(said >= 0, np.clip(np.abs(np.log1p(np.maximum(said, 0)) - np.log1p(code_points)), 0, 3), 0),
        ],
        axis=1,
    )
    return stats, (mixed(words.ids, 21) >> np.uint64(64 - WORD_BITS)).astype(np.int64), word_owner


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    bias: float
    linear: np.ndarray
    pairs: np.ndarray  # (features, factors)

    def rows(self, texts: list[bytes], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows: text, feature, value; a text's word values have length one, statistics are standard scores."""
        stats, places, owner = statistics(texts, n_chars)
        keys, n = np.unique(owner << WORD_BITS | places, return_counts=True)
        text, feature, value = keys >> WORD_BITS, keys & ((1 << WORD_BITS) - 1), np.sqrt(n)
        value = value / np.sqrt(np.bincount(text, weights=value**2, minlength=len(texts)))[text]
        scaled = np.clip((stats - self.mean) / self.spread, -4, 4) / 2
        t, s = np.divmod(np.arange(scaled.size), scaled.shape[1])
        return np.concatenate([text, t]), np.concatenate([feature, s + (1 << WORD_BITS)]), np.concatenate([value, scaled.ravel()])

    def margins(self, texts: list[bytes], n_chars: list[int | None]) -> np.ndarray:
        text, feature, value = self.rows(texts, n_chars)
        total = lambda x: np.bincount(text, weights=x, minlength=len(texts))
        out = self.bias + total(self.linear[feature] * value)
        for factor in self.pairs.T:
            part = factor[feature] * value
            out += 0.5 * (total(part) ** 2 - total(part**2))
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], training: Training, mean: np.ndarray, spread: np.ndarray) -> QualityModel:
    """Learn from (features, values, label) by AdaGrad, in a fixed mixed order; both classes weigh the same."""
    rng = np.random.default_rng(3)
    w0, g0 = 0.0, 1e-6
    w, gw = np.zeros(N_FEATURES), np.full(N_FEATURES, 1e-6)
    v, gv = rng.normal(0, 0.02, (N_FEATURES, training.factors)), np.full((N_FEATURES, training.factors), 1e-6)
    ones = sum(label for _, _, label in rows)
    weigh = {0: len(rows) / (2 * max(1, len(rows) - ones)), 1: len(rows) / (2 * max(1, ones))}
    for _ in range(training.epochs):
        for i in rng.permutation(len(rows)):
            at, x, label = rows[i]
            vx = v[at] * x[:, None]
            sums = vx.sum(0)
            margin = w0 + w[at] @ x + 0.5 * (sums @ sums - (vx**2).sum())
            err = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - label) * weigh[label]
            g0 += err**2
            w0 -= training.rate * err / np.sqrt(g0)
            g = err * x + training.l2 * w[at]
            gw[at] += g**2
            w[at] -= training.rate * g / np.sqrt(gw[at])
            g = err * (x[:, None] * sums - vx * x[:, None]) + training.l2 * v[at]
            gv[at] += g**2
            v[at] -= 0.3 * training.rate * g / np.sqrt(gv[at])
    return QualityModel(mean, spread, w0, w, v)


def learn(docs: DataFrame, labels: DataFrame, training: Training = Training(), parts: int = 3, part: int = 1) -> QualityModel:
    """Learn `quality` from a bounded sample of labelled whole texts. Without labelled rows every score is 0.5."""
    sample = labelled_sample(docs, labels, "quality", parts, part, training.per_class)
    empty = QualityModel(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), 0.0, np.zeros(N_FEATURES), np.zeros((N_FEATURES, 1)))

    def extract(batches):
        for batch in batches:
            ids, marks, texts, sizes = (batch[c].to_pylist() for c in ("doc_id", "label", "text", "n_chars"))
            stats, features, values = [], [], []
            for text, size in zip(texts, sizes):
                raw = (text or "").encode()
                stats.append(statistics([raw], [size])[0][0].tobytes())
                _, feature, value = empty.rows([raw], [size])
                is_word = feature < (1 << WORD_BITS)
                features.append(feature[is_word].astype(np.int32).tobytes())
                values.append(value[is_word].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), *[pa.array(x, pa.binary()) for x in (stats, features, values)]],
                names=["doc_id", "label", "stats", "features", "vals"],
            )

    made = sample.selectExpr("cast(doc_id as bigint) doc_id", "cast(label as int) label", "text", "cast(n_chars as bigint) n_chars")
    table = made.mapInArrow(extract, "doc_id bigint, label int, stats binary, features binary, vals binary").toArrow()
    rows = sorted(zip(*[table[c].to_pylist() for c in table.column_names]))
    if not rows:
        return empty
    stats = np.stack([np.frombuffer(r[2]) for r in rows])
    mean, spread = stats.mean(0), np.maximum(stats.std(0), 1e-3)
    scaled = np.clip((stats - mean) / spread, -4, 4) / 2
    own = np.arange(len(STATISTICS)) + (1 << WORD_BITS)
    return fit(
        [
            (
                np.concatenate([np.frombuffer(r[3], np.int32).astype(np.int64), own]),
                np.concatenate([np.frombuffer(r[4], np.float32).astype(float), scaled[i]]),
                r[1],
            )
            for i, r in enumerate(rows)
        ],
        training,
        mean,
        spread,
    )


def score(docs: DataFrame, model: QualityModel, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Add `score` (0 to 1) and `predicted` (1 from 0.5), or columns of other names, to every row.

    Inputs are `text` (null: empty) and `n_chars` (null: unknown). Columns of the new names are replaced.
    """

    def work():
        def step(texts, n_chars):
            scores, at = [], 0
            for group in groups(texts):
                margin = model.margins(group, n_chars[at : at + len(group)])
                at += len(group)
                scores.append(1 / (1 + np.exp(-np.clip(margin, -35, 35))))
            found = np.concatenate(scores) if scores else np.zeros(0)
            return dict(zip(names, (pa.array(found), pa.array((found >= 0.5).astype(np.int32)))))

        return step

    return add_from_text(docs, dict(zip(names, ("double", "integer"))), work, ["text", "n_chars"])
