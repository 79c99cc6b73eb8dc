"""Mixing sources to target weights: repetition rates per source, whole copies plus a hash-seeded chance of one more."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import WORD, fresh
from cellweave.session import cut_lineage
from cellweave.tables import in_order

#: Up to so many sources their table is sent to all tasks; beyond it the join is a shuffle.
BROADCAST_SOURCES = 10_000


@dataclass(frozen=True)
class Mix:
    """Sources in code point order (null last) weigh `weights`, repeating, and share `share` times all words."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: float = 2.0
    seed: str = "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def chance(seed: str, *keys: Column) -> Column:
    """An even number in [0, 1) that depends on the keys only: 52 bits of their MD5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """`(source, source_size, target)` from `(source, source_size)`, one row per source.

    Each round gives every source below its cap an equal share by weight of
    what the capped ones leave. A share above the cap is cut to it. Rounds only
    ever add capped sources and end when none is added. Each round is one sum.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("_rank") % len(mix.weights) + 1).cast("int"))
    ranked = in_order(sizes.withColumn("_all", F.lit(0)), ("_all",), [F.col("source").asc_nulls_last()], "_rank").select(
        "source", "source_size", weight.alias("_weight")
    )
    ranked = cut_lineage(ranked.withColumn("_cap", F.col("source_size") * F.lit(mix.most)))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * mix.share
    level, n_capped = 0.0, -1
    while True:
        above = F.col("_weight") * F.lit(level) > F.col("_cap")
        row = ranked.agg(
            F.sum(F.when(above, F.col("_cap")).otherwise(0.0)).alias("capped"),
            F.sum(F.when(above, 0.0).otherwise(F.col("_weight"))).alias("weights"),
            F.count_if(above).alias("n"),
        ).first()
        if row["n"] == n_capped or not row["weights"]:
            break
        n_capped, level = row["n"], max(0.0, total - row["capped"]) / row["weights"]
    return ranked.select(
        "source", "source_size", F.least(F.col("_weight") * F.lit(level), F.col("_cap")).alias("target")
    )


def mix_sources(docs: DataFrame, mix: Mix = Mix(), keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add `size`, `source_size`, `target`, `copies` and `taken` to each row of `(doc_id, text, source, ...)`.

    A row is taken floor(target / source_size) times, and once more with the
    fraction as its chance, drawn from the hash of `keys` only: reruns agree,
    and equal rows fare alike. Null and empty texts have size 0 and are never
    taken; a null source is a source of its own, last in order; a null id is
    an id like any other. Columns that have one of the new names are replaced. An empty
    table gives an empty one.
    """
    names = ("size", "source_size", "target", "copies", "taken")
    base = docs.drop(*[c for c in docs.columns if c.lower() in names])
    [key] = fresh(base, "mix_source")
    sized = base.withColumn("size", n_words(F.col("text")))
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), mix)
    per_source = per_source.withColumnRenamed("source", key)
    if per_source.count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    more = (chance(mix.seed, *[F.col(k) for k in keys]) < rate - whole).cast("bigint")
    return (
        sized.join(per_source, F.col("source").eqNullSafe(F.col(key)), "left")
        .drop(key)
        .withColumn("copies", F.when(F.col("size") > 0, whole + more).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def mixed_documents(docs: DataFrame, mix: Mix = Mix(), keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, with the columns of `docs`."""
    whole, again = fresh(docs, "mix_row", "mix_again")
    needed = dict.fromkeys([*keys, "text", "source"])
    taken = mix_sources(docs.select(*needed, F.struct("*").alias(whole)), mix, keys)
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return taken.select(whole, times.alias(again)).select(f"{whole}.*")
