"""Clusters of count vectors by cosine distance; a vector far from every cluster is an anomaly.

The result has no order: distinct vectors are ranked by how often they occur, and a vector leads a
cluster if no leader of a higher rank is within the distance.  The vectors then go to their nearest
leader, and the weighted mean of a cluster is its centre.  Neither partitions nor the order of rows
nor the sizes of blocks change the clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.detectors.sparse import Block, rows_of, stacked
from logloom.session import written

#: Vectors that the driver and a task hold densely at once; more are handled block after block.
BLOCK = 256
#: Distances are compared at this precision, so equal ones are equal on any engine.
DIGITS = 9


def cosine_distances(products: np.ndarray, norms: np.ndarray, block: np.ndarray) -> np.ndarray:
    """1 - cosine with a guarded norm, rounded; below 1e-8 it is 0."""
    distance = 1 - products / (norms[:, None] * block[None, :] + 1e-8)
    return np.round(np.where(distance < 1e-8, 0.0, distance), DIGITS)


def shapes(vectors: DataFrame) -> DataFrame:
    """(cols, xs, weight): the distinct vectors and how often each occurs."""
    return vectors.groupBy("cols", "xs").agg(F.count(F.lit(1)).alias("weight"))


def nearest_batches(block: Block, first: int):
    """Keep the nearer of the cluster known so far and the nearest of the block, the lower number on ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = rows_of(batch)
            distance = batch.column("distance").to_numpy(zero_copy_only=False).copy()
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False).copy()
            if len(distance):
                found = cosine_distances(block.products(rows), np.sqrt(rows.squares()), block.norms)
                best = found.argmin(axis=1)
                least = found[np.arange(len(best)), best]
                nearer = (cluster < 0) | (least < distance)
                distance, cluster = np.where(nearer, least, distance), np.where(nearer, first + best, cluster)
            names = batch.schema.names
            held = dict(zip(names, batch.columns)) | {"distance": pa.array(distance), "cluster": pa.array(cluster)}
            yield pa.RecordBatch.from_arrays([held[n] for n in names], names)

    return run


def with_nearest(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """Add ``cluster`` and ``distance`` of the nearest centre; -1 and infinity if there are none.

    ``centres`` has cluster (from 0, gapless), cols and xs.  The driver holds one block of them at a
    time, and so do the tasks; every block is one narrow pass over the vectors.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + ", cluster long, distance double"
    found = vectors.withColumns({"cluster": F.lit(-1).cast("long"), "distance": F.lit(float("inf"))})
    count, start = centres.count(), 0
    while start < count:
        block = centres.filter(F.col("cluster").between(start, start + BLOCK - 1)).orderBy("cluster").collect()
        found = found.mapInArrow(nearest_batches(Block(stacked(block)), start), fields)
        start += BLOCK
        if start < count:
            found = written(found, "nearest")
    return found


def far_batches(block: Block, max_dist: float):
    """Pass the vectors that no vector of the block is near to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = rows_of(batch)
            if batch.num_rows:
                found = cosine_distances(block.products(rows), np.sqrt(rows.squares()), block.norms)
                yield batch.filter(pa.array((found > max_dist).all(axis=1)))

    return run


def find_leaders(distinct: DataFrame, max_dist: float) -> DataFrame:
    """(cluster, cols, xs) of the vectors with no leader of a higher rank within ``max_dist``.

    Rank is by weight, then by the vector.  Every round takes the highest vectors that are left, lets
    them lead or follow in turn, and drops what the new leaders reach; so a round settles all vectors
    of a block at least, and the leaders are those of one long walk in the order of ranks.
    """
    spark, schema = distinct.sparkSession, "cols array<int>, xs array<double>, weight long"
    left, count = distinct.select("cols", "xs", "weight"), 0
    leaders = spark.createDataFrame([], "cluster long, cols array<int>, xs array<double>")
    while head := left.orderBy(F.desc("weight"), "cols", "xs").limit(BLOCK).collect():
        rows = stacked(head)
        block = Block(rows)
        near = cosine_distances(block.products(rows), block.norms, block.norms) <= max_dist
        np.fill_diagonal(near, True)  # also a vector without events
        free, chosen = np.ones(len(head), bool), []
        for k in range(len(head)):
            if free[k]:
                chosen.append(k)
                free &= ~near[k]
        new = [(count + i, list(head[k]["cols"]), list(head[k]["xs"])) for i, k in enumerate(chosen)]
        count += len(new)
        leaders = written(leaders.union(spark.createDataFrame(new, leaders.schema)), "leaders")
        lowest = head[-1]
        below = (F.col("weight") < lowest["weight"]) | (
            (F.col("weight") == lowest["weight"]) & (F.struct("cols", "xs") > F.struct(arrayed(lowest["cols"], "int"), arrayed(lowest["xs"], "double")))
        )
        led = Block(stacked([head[k] for k in chosen]))
        left = written(left.filter(below).mapInArrow(far_batches(led, max_dist), schema), "left")
    return leaders


def arrayed(values, kind: str):
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def fit_clusters(vectors: DataFrame, max_dist: float = 0.3) -> DataFrame:
    """(cluster, size, cols, xs): clusters of the sparse ``vectors`` (cols, xs) and their centres.

    A cluster's centre is the mean of its vectors, repeated ones counted as often as they occur.
    Clusters are numbered by the rank of their leaders; no vectors give no clusters.
    """
    distinct = written(shapes(vectors), "shapes")
    placed = written(with_nearest(distinct, find_leaders(distinct, max_dist)).drop("distance"), "placed")
    sizes = placed.groupBy("cluster").agg(F.sum("weight").alias("size"))
    cells = (
        placed.select("cluster", "weight", F.explode(F.arrays_zip("cols", "xs")).alias("c"))
        .groupBy("cluster", F.col("c.cols").alias("col")).agg(F.sum(F.col("c.xs") * F.col("weight")).alias("total"))
    )
    means = (
        cells.join(sizes, "cluster")
        .groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("col", (F.col("total") / F.col("size")).alias("x")))).alias("cells"))
        .select("cluster", F.col("cells.col").alias("cols"), F.col("cells.x").alias("xs"))
    )
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    centres = sizes.join(means, "cluster", "left").select("cluster", "size", empty("cols", "int"), empty("xs", "double"))
    return written(centres, "centres")


def score_clusters(vectors: DataFrame, centres: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``distance`` to the nearest centre, its ``cluster``, and ``anomaly``: farther than the threshold."""
    scored = with_nearest(vectors, centres)
    return scored.withColumn("anomaly", (F.col("distance") > threshold).cast("int"))
