"""Language identification with bit-sliced Bloom filters over n-grams.

Slot i of the filter holds one bit per language. A language's frequent n-grams
set its bit in their slots; the AND of an n-gram's slots has the bits of all
languages that contain it. A text's n-grams are looked up at once, the bits are
counted per language, and the counts are corrected for false positives.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import add_from_text, held_out
from cellweave.llm.words import groups, mixed

GRAM = 4  # bytes of UTF-8
SLOT_BITS = 16
HASHES = 3
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_AS_LETTER = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte n-grams of lower-cased texts, runs of other signs than letters as one blank; and each one's text."""
    data = _AS_LETTER[np.frombuffer(b"".join(b" " + t + b"  " for t in texts), np.uint8)]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 3 for t in texts])
    blank = data == 32
    repeated = np.zeros(len(data), bool)
    repeated[1:] = blank[1:] & blank[:-1] & (owner[1:] == owner[:-1])
    # The last blank of a text stays, so that a single letter makes an n-gram.
    repeated[np.cumsum([len(t) + 3 for t in texts]) - 1] = False
    data, owner = data[~repeated].astype(np.uint32), owner[~repeated]
    if len(data) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    n = len(data) - GRAM + 1
    grams = data[:n].copy()
    for i in range(1, GRAM):
        grams |= data[i : n + i] << np.uint32(8 * i)
    kept = (owner[:n] == owner[GRAM - 1 :]) & (grams != 0x20202020)
    return grams[kept], owner[:n][kept]


def slots_of(grams: np.ndarray) -> np.ndarray:
    """HASHES slots per n-gram, a row each."""
    spread = mixed(grams.astype(np.uint64))
    return np.stack([(spread >> np.uint64(SLOT_BITS * i)) & np.uint64((1 << SLOT_BITS) - 1) for i in range(HASHES)]).astype(
        np.int64
    )


@dataclass
class LanguageFilters:
    languages: list[str]  # in the order that decides ties: more rows seen first
    masks: np.ndarray  # (words of 64 languages, slots), uint64

    @staticmethod
    def build(languages: list[str], grams: dict[str, np.ndarray]) -> LanguageFilters:
        masks = np.zeros((max(1, -(-len(languages) // 64)), 1 << SLOT_BITS), np.uint64)
        for i, language in enumerate(languages):
            masks[i // 64, slots_of(grams[language]).ravel()] |= np.uint64(1 << (i % 64))
        return LanguageFilters(languages, masks)

    def false_positives(self) -> np.ndarray:
        """Per language, the chance that a foreign n-gram finds all its slots set."""
        filled = [
            np.count_nonzero(self.masks[i // 64] & np.uint64(1 << (i % 64))) / (1 << SLOT_BITS)
            for i in range(len(self.languages))
        ]
        return np.array(filled) ** HASHES

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """Per text and language, the corrected share of the text's n-grams that the language contains."""
        grams, owner = grams_of(texts)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        slots, wrong = slots_of(grams), self.false_positives()
        found = np.zeros((len(texts), len(self.languages)))
        for block, masks in enumerate(self.masks):
            bits = masks[slots[0]]
            for row in slots[1:]:
                bits &= masks[row]
            for i in range(64 * block, min(64 * block + 64, len(self.languages))):
                has = ((bits >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
                found[:, i] = np.bincount(owner[has], minlength=len(texts))
        rate = found / np.maximum(total, 1)[:, None]
        return np.clip((rate - wrong) / np.maximum(1 - wrong, 1e-9), 0, 1)


def learn(docs: DataFrame, per_language: int = 2000, n_grams: int = 3000, parts: int = 4, part: int = 2) -> LanguageFilters:
    """Filters from at most `per_language` documents of each non-null `lang` (those with the smallest hashes).

    Texts are read whole. An n-gram counts once per document; each language
    keeps its `n_grams` most frequent ones, so what reaches the driver is
    bounded by languages times `n_grams`.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), parts, part))
    seen = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # Hashes are even, so of a language with many rows those below twice the wanted share are enough to choose from.
    span = 1 << 30
    bars = [(k, span if n <= 4 * per_language else span * 2 * per_language // n) for k, n in seen.items()]
    bar = F.element_at(F.create_map(*[F.lit(x) for pair in bars for x in pair]), F.col("lang")) if bars else F.lit(0)
    hashed = usable.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(span)).alias("_hash")).filter(F.col("_hash") < bar)
    order = Window.partitionBy("lang").orderBy("_hash", "doc_id")
    chosen = hashed.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= per_language)
    # Bounded by languages times per_language.
    sample = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"])

    def count(batches):
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def emit():
            for lang, parts_ in held.items():
                grams, n = np.unique(np.concatenate(parts_), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                grams = np.unique(grams_of([text.lower().encode()])[0])
                held.setdefault(lang, []).append(grams)
                size += len(grams)
                if size > 4_000_000:
                    yield from emit()
                    held, size = {}, 0
        yield from emit()

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("_at", F.row_number().over(rank)).filter(F.col("_at") <= n_grams).select("lang", "gram").collect()
    languages = sorted(seen, key=lambda lang: (-seen[lang], lang))
    grams: dict[str, list[int]] = {lang: [] for lang in languages}
    for row in top:
        grams[row["lang"]].append(row["gram"])
    return LanguageFilters.build(languages, {k: np.array(v, np.uint32) for k, v in grams.items()})


def identify(docs: DataFrame, filters: LanguageFilters, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add `lang_pred` and `score` (0 to 1), or columns of other names: the language that contains the largest share of the text's n-grams.

    `und` and 0 where the text is null, empty or has no letter, or where no
    language was learned. Ties, also where no n-gram is known, go to the
    language with more rows, then by name. Columns of these names are replaced.
    """

    def work():
        def step(texts):
            found, scores = [], []
            at = 0
            for group in groups([t and t.lower() for t in texts]):
                shares = filters.shares(group) if filters.languages else None
                for i in range(len(group)):
                    text = texts[at]
                    at += 1
                    if shares is None or not text or not _LETTER.search(text):
                        found.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        best = int(np.argmax(shares[i]))
                        found.append(filters.languages[best])
                        scores.append(float(shares[i, best]))
            return dict(zip(names, (pa.array(found, pa.string()), pa.array(scores, pa.float64()))))

        return step

    return add_from_text(docs, dict(zip(names, ("string", "double"))), work, ["text"])
