"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.llm import (
    editprint,
    hardnegatives,
    jaccard,
    languageid,
    languagemodel,
    merkle,
    mixing,
    neighbours,
    packing,
    quality,
    substrings,
    toxicity,
    urlfilter,
)
from cellweave.llm.common import held_out, read
from cellweave.queries import Query


def op1_jaccard_join(spark, sf_dir):
    return jaccard.linked(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    kept = docs.select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    return toxicity.score(kept, model).select("doc_id", "held_out", "score", "predicted")


def op3_fingerprints(spark, sf_dir):
    return editprint.with_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_source_mix(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH RECURSIVE sized AS MATERIALIZED (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents),
sources AS MATERIALIZED (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
    FROM sized GROUP BY source),
rounds AS (
    SELECT 0 AS round, 0.0::DOUBLE AS level
    UNION ALL
    SELECT r.round + 1,
           (SELECT (1.5 * sum(source_size) - sum(CASE WHEN w * r.level > 2.0 * source_size THEN 2.0 * source_size ELSE 0 END))
                   / sum(CASE WHEN w * r.level > 2.0 * source_size THEN 0 ELSE w END) FROM sources)
    FROM rounds r WHERE r.round <= (SELECT count(*) FROM sources)),
aims AS (
    SELECT source, source_size, least(w * (SELECT arg_max(level, round) FROM rounds), 2.0 * source_size) AS target FROM sources),
rated AS (
    SELECT d.doc_id, d.size, a.source_size, a.target,
           CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate,
           CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS chance
    FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""


def op5_language_model(spark, sf_dir):
    return languagemodel.score(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    kept = docs.select("doc_id", "text", F.col("n_chars").cast("bigint").alias("n_chars"), held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    return quality.score(kept, model).select("doc_id", "held_out", "score", "predicted")


def op7_neighbours(spark, sf_dir):
    vectors = neighbours.usable(read(spark, sf_dir, "embeddings"))
    return neighbours.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op8_url_filter(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op10_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("ids")


def op9_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    filters = languageid.learn(docs.select("doc_id", "text", "lang"))
    kept = docs.select("doc_id", "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return languageid.identify(kept, filters).select("doc_id", "held_out", "lang_pred", "score")


def op11_hard_negatives(spark, sf_dir):
    vectors = hardnegatives.usable(read(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH usable AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.alike
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""


def op12_substrings(spark, sf_dir):
    kept = substrings.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH words AS MATERIALIZED (
    SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word
    FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents)),
windows AS (
    SELECT doc_id, pos, word, count(*) OVER ahead = 20 AS whole, string_agg(word, ' ') OVER ahead AS passage
    FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
judged AS (
    SELECT doc_id, pos, word, whole AND row_number() OVER (PARTITION BY whole, passage ORDER BY doc_id, pos) > 1 AS again FROM windows),
covered AS (
    SELECT doc_id, pos, word, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM judged),
texts AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
           sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN texts t ON d.doc_id = t.doc_id
"""


def manifest_rows(docs, step=merkle.STEP):
    """The manifest of documents by language, with proofs read anew after every third document was changed."""
    fields = lambda text: merkle.digest_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, fields(F.translate("text", capitals, capitals.lower())))
    rows = merkle.manifest(docs, fields(F.col("text")), kept={"changed": changed}, step=step)
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("path"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir):
    return manifest_rows(read(spark, sf_dir, "documents"))


def _leaf_sql(text):
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')" for x in fields) + ")"


OP13_SQL = rf"""
WITH RECURSIVE docs AS MATERIALIZED (
    SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
           {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lower_leaf,
           xor(list_reduce(
               list_prepend(4294967295, flatten(list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1),
                   lambda i: list_prepend(CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))),
               lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) AS crc
    FROM documents),
placed AS MATERIALIZED (
    SELECT *, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ix FROM docs),
nodes AS (
    SELECT grp, 0 AS level, ix, leaf AS digest, count(*) OVER (PARTITION BY grp) AS wide FROM placed
    UNION ALL
    SELECT grp, level + 1, ix, sha256(run), count(*) OVER (PARTITION BY grp)
    FROM (SELECT grp, level, ix // 8 AS ix, string_agg(digest, '' ORDER BY ix) AS run FROM nodes WHERE wide > 1 GROUP BY grp, level, ix // 8)),
tops AS MATERIALIZED (SELECT grp, digest AS subroot, level AS up, row_number() OVER (ORDER BY grp) - 1 AS ix FROM nodes WHERE wide = 1),
top_nodes AS (
    SELECT 0 AS level, ix, subroot AS digest, count(*) OVER () AS wide FROM tops
    UNION ALL
    SELECT level + 1, ix, sha256(run), count(*) OVER ()
    FROM (SELECT level, ix // 8 AS ix, string_agg(digest, '' ORDER BY ix) AS run FROM top_nodes WHERE wide > 1 GROUP BY level, ix // 8)),
root AS (SELECT digest AS root FROM top_nodes WHERE wide = 1),
sides AS MATERIALIZED (
    SELECT grp, level, ix,
           coalesce(string_agg(digest, '') OVER (PARTITION BY grp, level, ix // 8 ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(digest, '') OVER (PARTITION BY grp, level, ix // 8 ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM (SELECT grp, level, ix, digest FROM nodes WHERE wide > 1
          UNION ALL SELECT '', level, ix, digest FROM top_nodes WHERE wide > 1)),
folded AS (
    SELECT p.doc_id, p.leaf, t.subroot, p.grp, t.up, t.ix AS top_ix, p.ix, 0 AS level, p.grp AS at,
           CASE WHEN p.crc % 3 = 0 THEN p.lower_leaf ELSE p.leaf END AS h, '' AS proof, row_number() OVER () AS id, 0 AS steps
    FROM placed p JOIN tops t ON p.grp = t.grp
    UNION ALL
    SELECT f.doc_id, f.leaf, f.subroot, f.grp, f.up, f.top_ix, s.ix // 8, s.level + 1, s.grp, sha256(s.l || f.h || s.r), f.proof || s.l || s.r, f.id, f.steps + 1
    FROM folded f JOIN sides s
      ON s.grp = CASE WHEN f.at <> '' AND f.level < f.up THEN f.grp ELSE '' END
     AND s.level = CASE WHEN f.at <> '' AND f.level >= f.up THEN 0 ELSE f.level END
     AND s.ix = CASE WHEN f.at <> '' AND f.level >= f.up THEN f.top_ix ELSE f.ix END)
SELECT f.doc_id, f.leaf, f.subroot, r.root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM (SELECT * FROM folded QUALIFY row_number() OVER (PARTITION BY id ORDER BY steps DESC) = 1) f CROSS JOIN root r
"""

QUERIES = {
    "op1_jaccard_join": Query(op1_jaccard_join),
    "op2_toxicity": Query(op2_toxicity),
    "op3_fingerprints": Query(op3_fingerprints),
    "op4_source_mix": Query(op4_source_mix, OP4_SQL),
    "op5_language_model": Query(op5_language_model),
    "op6_quality": Query(op6_quality),
    "op7_neighbours": Query(op7_neighbours),
    "op8_url_filter": Query(op8_url_filter),
    "op9_language": Query(op9_language),
    "op10_packing": Query(op10_packing),
    "op11_hard_negatives": Query(op11_hard_negatives, OP11_SQL),
    "op12_substrings": Query(op12_substrings, OP12_SQL),
    "op13_merkle_manifest": Query(op13_merkle_manifest, OP13_SQL),
}
