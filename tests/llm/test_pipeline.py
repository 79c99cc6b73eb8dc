"""The corpus pipeline stage by stage: what each keeps, against plain recomputation, and odd rows."""

import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellweave.llm import mixing, packing

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def kept_copies(rows):
    """The smallest id of each group of documents that link, over all pairs; documents without words stay."""
    sets = {}
    for r in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in (r.text or "").encode().decode().split(" ") if w]
        words = [w for part in words for w in part.replace("\t", "\n").replace("\r", "\n").split("\n") if w]
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    group = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    return {i for i, first in group.items() if i == first}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality_classifier", "near_duplicates", "source_mix", "packing"]
    given = docs
    for name in list(stages)[:-1]:
        made = stages[name](spark, given, SF_DIR).cache()
        assert made.columns == docs.columns
        before, after = Counter(r.doc_id for r in given.collect()), Counter(r.doc_id for r in made.collect())
        if name in ("language_id", "quality_classifier"):
            assert not after - before and 0.3 * before.total() < after.total() <= before.total()
        if name == "near_duplicates":
            assert set(after) == kept_copies(given.collect()) and after.total() < before.total()
        if name == "source_mix":
            taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix_sources(given).collect()}
            assert all(after.get(i, 0) * size == n for i, (n, size) in taken.items() if size)
        given = made
    pieces = stages["packing"](spark, given, SF_DIR).collect()
    coder = packing.Coder(packing.default_tokenizer())
    want = Counter()
    for r in given.collect():
        want[(r.doc_id, len(coder.encode([(r.text or "").encode()], 0)[0]))] += 1
    whole = Counter()
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length and p.offset + p.length <= 1024
        whole[(p.doc_id, p.doc_tokens)] += p.length
    assert whole == Counter({k: k[1] * n for k, n in want.items()})
    again = corpus_pipeline.run(spark, SF_DIR)
    assert again.agg(F.sum("length")).first()[0] == sum(p.length for p in pieces)


def test_odd_rows(spark):
    """Nulls anywhere, empty and long texts, ties, repeated rows, more columns: every stage takes what the one before it gives."""
    words = "the and of to in that was for with his"
    rows = [
        (1, None, None, None, None, "s", 1), (2, "", "en", "a", 0, None, None), (3, " \n\t", None, "b", 3, "s", 1),
        (4, f"{words} " * 5000, "en", "a", None, "s", 1), (5, "12345 !!", "en", "b", 8, "s", 1),
        (6, words, "en", "b", 3, "s", 1), (6, words, "en", "b", 3, "s", 1), (7, words, "fr", None, 3, "s", 1), (None, words, "en", "c", 5, "s", 1),
        (8, f"{words} quite other words end this one here now", None, "c", 9, "s", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA + ", score string, part int")
    given, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, SF_DIR).cache()
        seen.append(given.count())
        if name != "packing":
            assert given.columns == docs.columns
        if name == "language_id":
            assert not {1, 2, 3, 5} & {r.doc_id for r in given.collect()}
    assert seen[0] >= seen[1] >= seen[2]
    given = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, SF_DIR).cache()
        assert given.count() == 0


def test_each_stage_takes_odd_rows(spark):
    """Stages one by one, on rows that earlier ones would have taken out."""
    rows = [(1, None, None, None, None), (2, "", None, "a", 0), (2, "", None, "a", 0), (None, None, "en", None, None), (3, "x y", "en", "a", 3), (4, "x y", "de", "a", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    assert ids(stages["near_duplicates"](spark, docs, SF_DIR)) == Counter([1, 2, 3, None])
    assert not ids(stages["source_mix"](spark, docs, SF_DIR)) - Counter([1, 1, 2, 2, 2, 2, 3, 3, 4, 4, None, None])
    assert ids(stages["packing"](spark, docs, SF_DIR)) == Counter([1, 2, 2, 3, 4, None])
    assert not ids(stages["quality_classifier"](spark, docs, SF_DIR)) - Counter([1, 2, 2, 3, 4, None])
    assert not ids(stages["language_id"](spark, docs, SF_DIR)) - Counter([3, 4])
