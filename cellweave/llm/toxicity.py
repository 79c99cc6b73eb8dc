"""Toxicity: logistic regression by FTRL-proximal over hashed words, word pairs and skip-grams.

Every weight has a rate of its own, and the L1 term keeps weights at zero until
a feature has earned one, so that the model is a short list of places and weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellweave.llm.common import add_from_text, labelled_sample
from cellweave.llm.words import groups, joined, mixed, words_of

PLACE_BITS = 20


@dataclass(frozen=True)
class Rates:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    epochs: int = 2
    #: At most so many labelled rows of either class are learned from.
    per_class: int = 4000


@dataclass
class ToxicityModel:
    bias: float
    places: np.ndarray  # of non-zero weights
    weights: np.ndarray

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << PLACE_BITS, np.float32)
        dense[self.places] = self.weights
        return dense


def features_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words, neighbour pairs and pairs with one word between, and the text of each. Punctuation parts words."""
    words = words_of(texts, marks=True)
    ids, owners = [mixed(words.ids, 11)], [words.owner()]
    for seed, gaps in ((12, (1,)), (13, (2,))):
        pairs, owner = joined(words, gaps)
        ids.append(mixed(pairs, seed))
        owners.append(owner)
    return (np.concatenate(ids) >> np.uint64(64 - PLACE_BITS)).astype(np.int64), np.concatenate(owners)


def fit(rows: list[tuple[np.ndarray, int]], rates: Rates = Rates()) -> ToxicityModel:
    """Learn from (distinct places, label) pairs, in a fixed mixed order. Without rows every score is 0."""
    size = (1 << PLACE_BITS) + 1  # the last place is the bias, which L1 leaves alone
    z, n = np.zeros(size), np.zeros(size)
    if not rows:
        return ToxicityModel(-40.0, np.zeros(0, np.int64), np.zeros(0, np.float32))

    def weights(at: np.ndarray) -> np.ndarray:
        zi, l1 = z[at], np.where(at == size - 1, 0.0, rates.l1)
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0)
        return -shrunk / ((rates.beta + np.sqrt(n[at])) / rates.alpha + rates.l2)

    order = np.random.default_rng(7)
    for _ in range(rates.epochs):
        for i in order.permutation(len(rows)):
            places, label = rows[i]
            at = np.append(places, size - 1)
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            step = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / rates.alpha
            z[at] += gradient - step * w
            n[at] += gradient**2
    touched = np.flatnonzero(n[:-1])
    w = weights(touched)
    kept = w != 0
    return ToxicityModel(float(weights(np.array([size - 1]))[0]), touched[kept], w[kept].astype(np.float32))


def learn(docs: DataFrame, labels: DataFrame, rates: Rates = Rates(), parts: int = 5, part: int = 0) -> ToxicityModel:
    """Learn `toxic` from a bounded sample of labelled whole texts; their features are made by tasks, the sample is fitted on the driver."""
    sample = labelled_sample(docs, labels, "toxic", parts, part, rates.per_class)

    def extract(batches):
        for batch in batches:
            texts, ids, marks = (batch[c].to_pylist() for c in ("text", "doc_id", "label"))
            out = []
            for text in texts:
                places, _ = features_of([(text or "").encode()])
                out.append(np.unique(places).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "label", "places"]
            )

    made = sample.selectExpr("cast(doc_id as bigint) doc_id", "cast(label as int) label", "text").mapInArrow(
        extract, "doc_id bigint, label int, places binary"
    )
    table = made.toArrow()
    rows = sorted(zip(table["doc_id"].to_pylist(), table["label"].to_pylist(), table["places"].to_pylist()))
    return fit([(np.frombuffer(p, np.int32).astype(np.int64), label) for _, label, p in rows], rates)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Add `score` (0 to 1) and `predicted` (1 from 0.5) to every row; null and empty texts get the score of no features.

    Each feature counts once per text, however long. Columns of these names are replaced.
    """

    def work():
        table = model.table()

        def step(texts):
            scores = []
            for group in groups(texts):
                places, owner = features_of(group)
                hit = np.flatnonzero(table[places])
                once = np.unique(owner[hit] * (1 << PLACE_BITS) + places[hit])
                sums = np.bincount(
                    once >> PLACE_BITS, weights=table[once & ((1 << PLACE_BITS) - 1)], minlength=len(group)
                )
                scores.append(1 / (1 + np.exp(-np.clip(sums + model.bias, -35, 35))))
            found = np.concatenate(scores) if scores else np.zeros(0)
            return {"score": pa.array(found), "predicted": pa.array((found >= 0.5).astype(np.int32))}

        return step

    return add_from_text(docs, {"score": "double", "predicted": "integer"}, work, ["text"])
