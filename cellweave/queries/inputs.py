"""Tables in the shared form, derived from the benchmark tables, in Spark and in SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=256)
def _schema(spark: SparkSession, path: str):
    return spark.read.parquet(path).schema


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One benchmark table; its schema is looked up once per session."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def rows(df: DataFrame, table: Column, order: Column, cells: list[Column] | Column) -> DataFrame:
    cells = F.array(*[c.cast("string") for c in cells]) if isinstance(cells, list) else cells
    return df.select(table.cast("string").alias("table_id"), order.cast("bigint").alias("row_ix"), cells.alias("cells"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(table_id, row_ix, line)`: a document is a table, a line a row."""
    docs = load(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("table_id"), F.posexplode(F.split("text", "\n", -1)).alias("row_ix", "line")
    ).withColumn("row_ix", F.col("row_ix").cast("bigint"))


DOCUMENT_LINES = """lines AS (
    SELECT CAST(doc_id AS VARCHAR) AS table_id,
           CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS row_ix, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with a cell per word."""
    return document_lines(spark, sf_dir).select("table_id", "row_ix", F.split("line", " ", -1).alias("cells"))


DOCUMENT_WORDS = f"""{DOCUMENT_LINES},
words AS (SELECT table_id, row_ix, string_split(line, ' ') AS cells FROM lines)"""


def headed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as two cells: the first word where it starts with a capital, else empty; and the line."""
    first = F.regexp_extract("line", r"\A([A-Z]\S*)", 1)
    return document_lines(spark, sf_dir).select("table_id", "row_ix", F.array(first, F.col("line")).alias("cells"))


HEADED_LINES = f"""{DOCUMENT_LINES},
headed AS (SELECT table_id, row_ix, regexp_extract(line, '^([A-Z][^ \\t\\n\\f\\r]*)', 1) AS head, line FROM lines)"""


def conversation_portions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a table, a turn a portion (and page), a line of text a row."""
    turns = load(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").cast("string").alias("table_id"),
        F.col("turn").cast("int").alias("part_ix"),
        F.col("turn").cast("int").alias("page"),
        F.posexplode(F.split("text", "\n", -1)).alias("row_ix", "line"),
        "role",
    ).select(
        "table_id", "part_ix", "page", F.col("row_ix").cast("bigint").alias("row_ix"), F.array("role", "line").alias("cells")
    )


CONVERSATION_PORTIONS = """portions AS (
    SELECT CAST(conv_id AS VARCHAR) AS table_id, turn AS part_ix, turn AS page, role,
           CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS row_ix, unnest(ls) AS line
    FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS ls FROM conversations))"""


def cells_sql(ctes: str, table: str, order: str = "row_ix") -> str:
    """Flatten `table(table_id, <order>, cells)` with dense row numbers."""
    return f"""WITH {ctes}
SELECT table_id, row_ix, CAST(generate_subscripts(cells, 1) - 1 AS BIGINT) AS col_ix, unnest(cells) AS cell
FROM (SELECT table_id, cells, row_number() OVER (PARTITION BY table_id ORDER BY {order}) - 1 AS row_ix FROM {table})"""
