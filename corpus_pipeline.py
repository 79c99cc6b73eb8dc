"""From raw documents to packed training sequences, in five stages.

Each stage takes `(spark, docs, sf_dir)` and returns a DataFrame, which is
written as Parquet and reread as the next stage's documents. All but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import jaccard, languageid, mixing, packing, quality
from cellweave.llm.common import fresh, read
from cellweave.session import scratch_path

#: Documents with a smaller share of known n-grams in their likeliest language are in none that was learned.
LEAST_LANGUAGE_SCORE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that was learned, go.

    Null, empty and blank texts have no letters. Rows without an id are judged as
    all others; repeated rows stay repeated. An empty table gives an empty one,
    and so does one from which no language can be learned.
    """
    filters = languageid.learn(docs.select("doc_id", "text", "lang"))
    found, score = fresh(docs, "lang_found", "lang_score")
    judged = languageid.identify(docs, filters, (found, score))
    return judged.filter((F.col(found) != languageid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier of low quality than of high go.

    Null and empty texts are judged as texts without words, rows without an id as
    all others; repeated rows stay repeated. An empty table gives an empty one.
    """
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    score, good = fresh(docs, "quality_score", "quality_good")
    return quality.score(docs, model, (score, good)).filter(F.col(good) == 1).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id.

    Texts without words are near copies of none; of rows that share an id one
    stays, of rows without an id all. An empty table gives an empty one.
    """
    return jaccard.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A null source is one of its own, the last. Texts without words weigh nothing
    and come as often as their source's rate says. An empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, and the sequences they lie in.

    Null and empty texts are one piece of the end id; repeated rows and rows
    without an id are packed as all others. An empty table gives an empty one.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", pack_sequences),
]

#: SQL can say neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of `documents`; what each stage keeps is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
