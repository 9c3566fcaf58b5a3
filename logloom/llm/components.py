"""Connected components of links between numbered nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import written


def forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass only links that join two trees of this task; the others say nothing new."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := top.setdefault(x, x)) != x:
            top[x] = x = top[above]
        return x

    for batch in batches:
        keep = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            keep.append(a != b)
            if a != b:
                top[max(a, b)] = min(a, b)
        yield batch.filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame) -> DataFrame:
    """Smallest node of the component of each node: (node, root), without nodes that have no link.

    ``links`` has long columns a and b; links may repeat and go either way.  Stars are built in turn:
    every node hands its larger neighbours, then its smaller ones, to the smallest it knows, until
    each tree is one star.  Each round is written, so a lost executor costs a reread, and the number
    of rounds grows with the logarithm of the longest path.  Minima are taken by partial sums and
    joined back, so a node with many links is not one group.
    """
    spark = links.sparkSession
    edges = written(
        links.filter("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .mapInArrow(forest_batches, "a long, b long"),
        "links",
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = written(large, "stars")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")
        )
        edges = written(small.select("e.a", "e.b").filter("a != b").distinct(), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
