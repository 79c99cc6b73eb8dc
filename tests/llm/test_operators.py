"""The other operators: results against plain recomputation, and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import editprint, languageid, languagemodel, mixing, neighbours, packing, quality, toxicity, urlfilter
from cellweave.llm.languagemodel import Shape

ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, size string, part int, row string"


def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, other columns whose names clash."""
    long = "lorem ipsum dolor " * 20_000
    return [
        (1, None, None, None, None, "s", "z", 1, "r"), (2, "", "en", "a", 0, None, None, None, None),
        (3, " \n\t", None, "b", 3, "s", "z", 1, "r"), (4, long, "en", "a", None, "s", "z", 1, "r"),
        (5, "Ünïcode 日本 🙂 a\x00b", "de", None, 12, "s", "z", 1, "r"), (6, "tie", "en", "b", 3, "s", "z", 1, "r"),
        (6, "tie", "en", "b", 3, "s", "z", 1, "r"), (7, "tie", "fr", "b", 3, "s", "z", 1, "r"), (None, "no id", "en", "c", 5, "s", "z", 1, "r"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 2, 3, 4, 7)] + [(4, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def n_words(text):
    return len((text or "").encode().split())


def test_mix(spark, odd):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == 9
    assert {(r.doc_id, r["size"]) for r in rows} == {(r[0], n_words(r[1])) for r in odd_rows()}
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    copies = sum(r.copies for r in rows)
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == copies
    assert mixing.mixed_documents(odd.limit(0)).count() == 0


def test_mix_shares_what_capped_sources_leave(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 90)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert sum(got.values()) == pytest.approx(2400) and got["a"] == 20 and got[None] == 180
    assert got["b"] / got["c"] == pytest.approx(2.0) or got["b"] == 2000 or got["c"] == 1000


def test_mix_comes_near_targets(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "repeat('w ', cast(id % 50 + 1 as int)) text", "concat('s', id % 4) source")
    rows = mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken / r.target - 1) < 0.08 for r in rows)


def test_language(spark, odd):
    sign = {"en": "the and ing ion", "de": "der und ung schaft", "fr": "les et eux tion"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(sign[lang].split()) + rng.choice("abcd") for _ in range(30)), lang) for i in range(300) for lang in [rng.choice(list(sign))]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    filters = languageid.learn(docs, n_grams=40)
    got = languageid.identify(docs, filters).filter(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    found = {r.doc_id: r for r in languageid.identify(odd, filters).collect()}
    assert found[1].lang_pred == found[2].lang_pred == found[3].lang_pred == "und" and found[5].lang_pred in sign
    assert languageid.identify(odd, languageid.learn(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0
    # Every n-gram of a language is found in its filter: no false negatives.
    grams = np.unique(languageid.grams_of([rows[0][1].encode()])[0])
    whole = languageid.LanguageFilters.build(["x", "y"], {"x": grams, "y": grams[:0]})
    assert whole.shares([rows[0][1].encode()])[0].tolist() == [1.0, 0.0]


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, odd, labels, module, label):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    for i in range(500):
        bad = i % 3 == 0
        words = [word() for _ in range(40)] + (["Vile!", "vermin"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), 200, int(bad)))
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, n_chars bigint, {label} int")
    model = module.learn(docs.drop(label), docs.select("doc_id", label))
    got = module.score(docs, model).filter("doc_id % 7 = 0").collect()
    assert sum(r.predicted == r[label] for r in got) >= 0.9 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    scored = module.score(odd, module.learn(odd, labels))
    assert scored.count() == 9 and scored.schema["score"].dataType.simpleString() == "double"
    assert module.score(odd, module.learn(odd.limit(0), labels)).count() == 9


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    model = quality.QualityModel(
        np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)), 0.3, rng.normal(size=quality.N_FEATURES), rng.normal(size=(quality.N_FEATURES, 3))
    )
    _, at, x = model.rows([b"a b a"], [5])
    pairs = sum(model.pairs[at[i]] @ model.pairs[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert model.margins([b"a b a"], [5])[0] == pytest.approx(0.3 + model.linear[at] @ x + pairs)


def test_language_model(spark, odd):
    got = languagemodel.score(odd, Shape(words=20, classes=4, max_shared=2)).collect()
    train = [r for r in odd_rows() if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10]
    tokens = [t for r in train for t in [*(r[1] or "").encode().lower().split(), None]]
    counts = {t: tokens.count(t) for t in set(tokens)}
    base = len(tokens) + 0.1 * (len(counts) + 1)
    texts = {r[0]: r[1] for r in odd_rows()}
    assert len(got) == 9
    for r in got:
        own = [*(texts[r.doc_id] or "").encode().lower().split(), None]
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(own), len(tokens), sum(t in counts for t in own))
        assert r.base_score == pytest.approx(sum(np.log10((counts.get(t, 0) + 0.1) / base) for t in own))
        assert r.score < 0
    assert languagemodel.score(odd.limit(0)).count() == 0


def test_lanes_give_what_one_document_alone_gives():
    rng = np.random.default_rng(1)
    shape = Shape(words=30, classes=5)
    gru = languagemodel.begin(np.arange(30, dtype=np.uint64), np.arange(1, 31).astype(float), np.ones(languagemodel.OPEN), shape)
    docs = [rng.integers(0, 62, n) for n in (1, 200, 3, 77, 5, 1)]
    languagemodel.train(gru, docs * 3, shape)
    scorer = languagemodel.Scorer(gru)
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    together = scorer.scores(np.concatenate(docs), first)
    alone = [scorer.scores(d, np.array([0, len(d)]))[0] for d in docs]
    assert together == pytest.approx(alone, rel=1e-4)
    # All continuations of a state sum to one.
    every = [scorer.scores(np.array([7, 9, x]), np.array([0, 3]))[0] - scorer.scores(np.array([7, 9]), np.array([0, 2]))[0] for x in range(62)]
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)


def test_fingerprints(spark, odd):
    got = editprint.fingerprint(odd).collect()
    order = sorted(odd_rows(), key=lambda r: (-(r[0] if r[0] is not None else -1), r[1] or ""))
    assert len(got) == 9
    texts = [r[1] or "" for r in order]
    want = sorted(
        (r[0] or -1, len(t), hashlib.sha256(editprint.edited(t, texts[(i + 1) % len(texts)]).encode()).hexdigest())
        for i, (r, t) in enumerate(zip(order, texts))
    )
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = {r.doc_id: r.fingerprint for r in got}
    assert by_text[6] == by_text[7] and all(0 <= r.near_next <= 1 for r in got)
    assert editprint.fingerprint(odd.limit(0)).count() == 0
    assert editprint.fingerprint(odd.filter("doc_id = 5")).first().near_next == 1.0
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (3000, 3000, 40)]
    moved = texts[0][:1500] + "XYZ" + texts[0][1500:]
    a, b, c, d = editprint.fingerprints_of([texts[0], moved, texts[1], texts[2]])
    assert (a == b).mean() > 0.8 > 0.2 > (a == c).mean()
    assert (editprint.fingerprints_of(["zz", texts[0], "q"])[1] == a).all()
    prints = spark.createDataFrame([(x.tobytes().hex(),) for x in (a, b, c, d)], "fingerprint string")
    assert editprint.near_classes(prints).select("class_id").distinct().count() == 3


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[50:60] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [None] * 12), (2020, [1.0])]
    vectors = neighbours.usable(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    index = neighbours.PermutationIndex(segment_rows=300, block_queries=20, least=60)
    got = {}
    for r in neighbours.search(vectors, vectors.filter("vec_id % 20 = 0"), 20, index).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == list(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        score = x.astype(float) @ x[q].astype(float)
        best = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:20]
        hits += len({r.vec_id for r in found} & set(best))
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in {r.vec_id for r in found}
        assert all(r.score == pytest.approx(score[r.vec_id]) for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
    assert hits >= 0.9 * 20 * len(got)
    assert neighbours.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "HTTP://Example.ORG", "http://a.example.org/es/1", "http://example.org/en/12?q", "http://example.org/en/2",
            "x://notexample.org/es/", "https://b.com/fr/#x", "http://com/de/", "http://www.c.com:80/de/x", "http://net/en/"]
    got = urlfilter.judge(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id int, url string, host string")).collect()
    rules = [r.rule for r in sorted(got, key=lambda r: r.page_id)]
    assert rules == [None, None, None, None, "example.org/es/", "example.org/en/1", "org/", "org/", "com/fr/", "com/de/", None, None]
    assert {r.verdict for r in got} <= {"allow", "block"} and got[0].host == ""
    assert urlfilter.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_packing(spark, odd):
    rows = packing.pack(odd).collect()
    texts = {r[0]: (r[1] or "") for r in odd_rows()}
    coder = packing.Coder(packing.default_tokenizer()).coder
    pieces, line = {}, {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.offset + r.length <= 1024
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
        line[r.sequence_id, r.offset] = r.length
    for doc_id, own in pieces.items():
        want = coder.encode(texts[doc_id], add_special_tokens=False).ids + [0]
        times = 2 if doc_id == 6 else 1
        assert sorted(np.concatenate([np.frombuffer(i, "<u4") for _, i in sorted(own)]).tolist()) == sorted(want * times)
        if times == 1:
            assert np.concatenate([np.frombuffer(i, "<u4") for _, i in sorted(own)]).tolist() == want
    at = 0
    for (sequence, offset), length in sorted(line.items()):
        assert sequence * 1024 + offset == at
        at += length
    assert len(pieces) == 8 and packing.pack(odd.limit(0)).count() == 0


def test_coder_parts_texts_where_the_tokenizer_does():
    rng = random.Random(9)
    signs = list("ab.,'\n\t  é\u3000日9\x1c\x85#sS")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["<|endoftext|> don't  I'll\n\nx"]
    coder = packing.Coder(packing.default_tokenizer())
    want = [e.ids + [0] for e in coder.coder.encode_batch(texts, add_special_tokens=False)]
    assert [c.tolist() for c in coder.encode([t.encode() for t in texts], 0)] == want


def test_hilbert_neighbours_are_one_step_apart():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(points, bits=3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_language_model_learns_word_order_from_every_training_row(spark):
    shape = Shape(words=20, classes=4)
    # The 1500 documents with the smallest hashes have one order of words, all others the reverse.
    ids = [r.id for r in spark.range(3000).orderBy(F.xxhash64("id")).collect()]
    texts = [(i, ("a b c d " if n < 1500 else "d c b a ") * 50) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    _, found, _ = languagemodel.shared_counts(languagemodel.count_tokens(docs), shape)
    gru = languagemodel.learn(docs, found, shape)
    for text in (b"a b c d " * 50, b"d c b a " * 50):
        tokens, kinds, first = languagemodel.tokens_of([text])
        score = languagemodel.Scorer(gru).scores(gru.inputs(tokens, kinds), first)[0]
        assert score / len(tokens) > -0.7  # shares alone: -1.4


@pytest.mark.parametrize("size", [1.0, 300.0])
def test_language_model_probabilities_add_up(size):
    """Over all words and open classes, with weights of any size, and for states that have read something."""
    shape = Shape(words=7, classes=3, hidden=4)
    gru = languagemodel.begin(np.arange(7, dtype=np.uint64), np.arange(1, 8).astype(float), np.ones(languagemodel.OPEN), shape)
    rng = np.random.default_rng(2)
    for name in ("class_w", "inner_w"):
        gru.p[name] = rng.normal(0, size, gru.p[name].shape)
    scorer = languagemodel.Scorer(gru)
    assert scorer.far == (size > 1, size > 1)
    logs = scorer.scores(np.concatenate([[5, 2, x] for x in range(7 + languagemodel.OPEN)]), np.arange(8 + languagemodel.OPEN) * 3)
    before = scorer.scores(np.array([5, 2]), np.array([0, 2]))[0]
    assert np.isfinite(logs).all() and abs(np.exp(logs - before).sum() - 1) < 1e-3


@pytest.mark.parametrize("tile", [512, 8])
def test_near_classes_compare_all_of_a_bucket(spark, tile):
    rng = np.random.default_rng(6)
    # Frequent places are shared by all, so most buckets have an unlike first member (zeros elsewhere); groups of 5 are near copies.
    common = rng.random(128) < 0.7
    made = [np.zeros(128, np.uint8)]
    for _ in range(12):
        middle = rng.integers(1, 256, 128).astype(np.uint8)
        for _ in range(5):
            x = middle.copy()
            x[rng.choice(128, 10, replace=False)] = 0
            made.append(x)
    for x in made:
        x[common & (rng.random(128) < 0.5)] = 0
        x[:40] = 0
    x = np.unique(np.array(made), axis=0)
    root = list(range(len(x)))
    rng2 = np.random.default_rng(23)
    picks = [sorted(rng2.choice(128, 6, replace=False).tolist()) for _ in range(24)]
    for i in range(len(x)):
        for j in range(i):
            if (x[i] == x[j]).mean() >= 0.75 and any((x[i][p] == x[j][p]).all() for p in picks):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    prints = [r.tobytes().hex() for r in x]
    got = {r.fingerprint: r.class_id for r in editprint.near_classes(spark.createDataFrame([(p,) for p in prints], "fingerprint string"), tile=tile).collect()}
    assert got == {p: min(q for q, s in zip(prints, root) if s == r) for p, r in zip(prints, root)}


def test_url_rates_are_kept_for_every_suffix(spark):
    rows = [(f"https://s{i}.t/p{i}/x", f"s{i}.t", f"/p{i}/x", float(i % 2)) for i in range(2300)]
    urls = spark.createDataFrame(rows, "url string, host string, path string, label double")
    model = urlfilter.learn(urls, max_rows=200, trees=2, depth=2)
    got = urlfilter._featured(urls, model.rates, model.prior).collect()
    assert len(got) == 2300 and all(r.s_site_seen > 0 and r.s_first_seen > 0 for r in got)
    assert all((r.s_site_rate > 0.5) == (r.label == 1) for r in got)
    assert model.score(urls).count() == 2300


def test_near_classes_link_past_an_unlike_first_member(spark):
    rng = np.random.default_rng(23)
    picks = [rng.choice(128, 6, replace=False) for _ in range(24)]
    a = np.random.default_rng(2).integers(1, 255, 128).astype(np.uint8)
    b = a.copy()
    b[1:31] += 1
    shared = np.unique(np.concatenate([p for p in picks if (a[p] == b[p]).all()]))
    # Smaller than both, in all buckets where they meet, and unlike them.
    z = np.zeros(128, np.uint8)
    z[shared] = a[shared]
    assert (a == b).mean() >= 0.75 > (a == z).mean() and z.tobytes() < min(a.tobytes(), b.tobytes())
    prints = [x.tobytes().hex() for x in (z, a, b)]
    got = {r.fingerprint: r.class_id for r in editprint.near_classes(spark.createDataFrame([(p,) for p in prints], "fingerprint string")).collect()}
    assert [got[p] for p in prints] == [prints[0], min(prints[1:]), min(prints[1:])]
