"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """`(node, component)` of `(a, b)`: each node of a link with the smallest node it is connected to.

    Rounds of two steps, each a sum by key: every node's larger neighbours are
    hung on its smallest one, then its smaller neighbours are. Both keep what is
    connected; when nothing changes, all nodes hang on the smallest. Links are
    made distinct before they are gathered, and only minima are, so that a node
    with very many links stays a row per link. Each round is written to the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before = cut_lineage(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(own, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = hung.unionByName(own.select("a", F.col("m").alias("b"))).distinct()
        edges = cut_lineage(small)
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        now = (row["n"], row["h"])
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
