"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.session import ship_package

#: A word is a longest run of anything but blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a row is kept from learning; rows without an id always are."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(True))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from `names` that `df` does not use, in whatever case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def lazily(column: pa.Array, rows: int = 256) -> Iterator:
    """The values of a column, a few at a time: long texts are not all held as Python strings at once."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def add_from_text(
    df: DataFrame, columns: dict[str, str], work: Callable[[], Callable[[list], dict[str, pa.Array]]], inputs: list[str]
) -> DataFrame:
    """Add columns worked out in Arrow batches from the columns `inputs`.

    `work()` is called once per task and returns a function from the input
    columns of a batch (lists, in the order of `inputs`) to the new columns.
    Columns of the new names are replaced. Rows stay where they are.
    """
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in columns}]
    own = [c for c in inputs if c not in kept]
    schema = T.StructType([df.schema[c] for c in kept])
    for name, kind in columns.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                made = step(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs])
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept] + [made[c] for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *columns])

    return df.select(*kept, *own).mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, per_class: int) -> DataFrame:
    """`(doc_id, text, n_chars, label)` of labelled documents to learn from: at most `per_class` of either class.

    Rows of the part kept from learning never enter. Where a class has more rows,
    those with the smallest hashes are taken. An id that is labelled repeatedly
    takes its largest label; null labels and ids are left out.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), parts, part))
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
    )
    has = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for value in (0, 1):
        some = has.filter(F.col("label") == value).orderBy(*order).limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    # At most 2 * per_class narrow rows by construction, so this side may be broadcast.
    return docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id")
