"""Exact top-k inner products by cover trees over queries and data."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import written

#: Rows of data, and of queries, that one block of work holds at most on average.
DATA_BLOCK, QUERY_BLOCK = 4096, 2048
#: Bounds of the top of the data's tree: its centres are a sample of so many rows.
MOST_CENTRES = 256
LEAF, FAN = 256, 16


class Node:
    """Points within ``radius`` of ``centre``, their mean: row numbers of a leaf, or children."""

    __slots__ = ("centre", "norm", "radius", "rows", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray):
        self.centre = points[rows].mean(0)
        away = np.sqrt(((points[rows] - self.centre) ** 2).sum(1))
        self.norm, self.radius = float(np.sqrt((self.centre**2).sum())), float(away.max(initial=0.0))
        self.rows, self.children = rows, []
        if len(rows) > LEAF and self.radius > 0:
            self.split(points)

    def split(self, points: np.ndarray) -> None:
        """One child for each of up to ``FAN`` points that are more than half the radius apart.

        The next such point is the first one not covered, as if points were inserted one by one, and
        every point goes to the nearest.  Neither the mean nor the farthest points are taken: where all
        distances are alike, the mean is nearest to everything and each far point stands alone.
        """
        mine = points[self.rows]
        nearest, owner = np.full(len(mine), np.inf), np.zeros(len(mine), np.int64)
        for k in range(FAN):
            d = np.sqrt(((mine - mine[int((nearest > self.radius / 2).argmax())]) ** 2).sum(1))
            closer = d < nearest
            nearest[closer], owner[closer] = d[closer], k
            if nearest.max() <= self.radius / 2:
                break
        groups = [g for g in (np.flatnonzero(owner == k) for k in range(FAN)) if len(g)]
        if len(groups) > 1:
            self.children = [Node(points, self.rows[g]) for g in groups]


def fits_floats(a: np.ndarray, b: np.ndarray) -> bool:
    """Are inner products of these integer rows exact in floating point (every sum fits 53 bits)?"""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1) < 2**53


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if fits_floats(a, b):
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def take_best(scores, found, rows, new, ids, own, floor) -> np.ndarray:
    """Put the candidates of a block of products among the best of ``rows``; returns the rows that changed.

    Only entries that reach both the block's own kth score and ``floor`` are sorted, ties included.
    """
    k = scores.shape[1]
    low = -np.inf if new.dtype.kind == "f" else np.iinfo(np.int64).min
    new = np.where(own, low, new)
    cut = np.full(len(rows), low) if new.shape[1] <= k else np.partition(new, new.shape[1] - k, axis=1)[:, -k]
    if floor is not None:
        cut = np.maximum(cut, floor)
    r, c = np.nonzero((new >= cut[:, None]) & ~own)
    if not len(r):
        return rows[:0]
    touched = np.unique(r)
    changed = rows[touched]
    row = np.concatenate([r, np.repeat(touched, k)])
    score = np.concatenate([new[r, c].astype(np.int64), scores[changed].ravel()])
    name = np.concatenate([ids[c], found[changed].ravel()])
    order = np.lexsort((name, ~score, row))  # ~x falls as x rises, without overflow
    row = row[order]
    best = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
    scores[changed], found[changed] = score[best].reshape(-1, k), name[best].reshape(-1, k)
    return changed


def dual_search(queries, query_ids, floors, data, data_ids, k):
    """The k best rows for each query among ``data`` that can still reach its floor.

    Pairs of nodes are taken depth first, best bound first.  A pair is pruned when the largest product
    its centres and radii allow is below the worst kth score of the queries in the node.
    """
    scores = np.full((len(queries), k), np.iinfo(np.int64).min)
    found = np.full((len(queries), k), np.iinfo(np.int64).max)
    worst = floors.astype(np.float64).copy()
    q_float, d_float = queries.astype(np.float64), data.astype(np.float64)
    q_root = Node(q_float, np.arange(len(queries)))
    d_root = Node(d_float, np.arange(len(data)))
    exact = fits_floats(queries, data)

    def bound(q: Node, d: Node) -> float:
        b = float(q.centre @ d.centre) + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius
        return b + 1e-9 * abs(b) + 1e-6  # rounding never prunes

    todo = [(bound(q_root, d_root), q_root, d_root)]
    while todo:
        b, q, d = todo.pop()
        if b < worst[q.rows].min():
            continue
        if q.children and (not d.children or q.radius >= d.radius):
            pairs = [(c, d) for c in q.children]
        elif d.children:
            pairs = [(q, c) for c in d.children]
        else:
            rows, ids = q.rows, data_ids[d.rows]
            own = query_ids[rows][:, None] == ids[None, :]
            if exact:
                new, floor = q_float[rows] @ d_float[d.rows].T, worst[rows]
            else:
                new, floor = queries[rows] @ data[d.rows].T, None
            changed = take_best(scores, found, rows, new, ids, own, floor)
            kth = scores[changed, k - 1].astype(np.float64)
            full = found[changed, k - 1] != np.iinfo(np.int64).max
            worst[changed] = np.maximum(worst[changed], np.where(full, kth, -np.inf))
            continue
        pairs = [(bound(x, y), x, y) for x, y in pairs]
        todo += sorted((p for p in pairs if p[0] >= worst[p[1].rows].min()), key=lambda p: p[0])
    return scores, found


def matrix_of(column, rows: int) -> np.ndarray:
    """The rows of a list column, all of one length and without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def block_search(k: int):
    schema = pa.schema([("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        numbers = lambda t, c: t[c].to_numpy().astype(np.int64)
        matrix = lambda t: matrix_of(t["v"], t.num_rows)
        scores, found = dual_search(
            matrix(left), numbers(left, "vec_id"), left["floor"].to_numpy(), matrix(right), numbers(right, "vec_id"), k
        )
        row, column = np.nonzero(found != np.iinfo(np.int64).max)
        return pa.table(
            [numbers(left, "query_key")[row], found[row, column], scores[row, column]], schema=schema
        )

    return run


def routed(centres: np.ndarray, centre_ids: np.ndarray, dim: int, k: int, as_query: bool):
    """Nearest centre and distance of each row; for queries also the kth score among the centres.

    The centres are rows of the data, so that score is a floor of the query's own kth score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (centres.astype(np.float64) ** 2).sum(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix_of(batch.column("v"), batch.num_rows) if dim else np.zeros((batch.num_rows, 0), np.int64)
            scores = product(rows, centres)
            near = (square[None, :] - 2.0 * scores).argmin(1)
            away = np.sqrt(((rows - centres[near]).astype(np.float64) ** 2).sum(1))
            floor = np.full(len(rows), -np.inf)
            if as_query and len(centres) > k:
                ids = batch.column("vec_id").to_numpy()
                own = ids[:, None] == centre_ids[None, :]
                floor = -np.sort(np.where(own, np.inf, -scores.astype(np.float64)), axis=1)[:, k - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near), pa.array(away), pa.array(floor)],
                [*batch.schema.names, "cell", "away", "floor"],
            )

    return run


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 x) of each component; rows that repeat both are one."""
    v, whole = F.col("embedding"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.filter(v.isNotNull() & F.col("vec_id").isNotNull()).filter(sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")
    ).distinct()


def top_products(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k largest inner products of each query with all other rows, ties to smaller vec_id.

    ``vectors`` has vec_id and embedding (array of numbers); queries are rows whose vec_id is divisible
    by ``every``.  Returns query_id, rank, vec_id and score.

    A query meets rows of its own dimension only, never a row of its own id.  Of rows with one vector
    only the k + 1 smallest ids can be among anyone's k best, so the others are left out.  The top of
    the data's tree has centres from a sample of at most ``MOST_CENTRES`` rows; every row is routed to
    its nearest centre, and covering radii and worst kth scores by cell (tables of at most that many
    rows) prune pairs of cells.  The rest of both trees is built block by block: a block of queries and
    a block of data meet in one task, whatever the size of their cells.

    Null vectors, vectors with null or non-finite components and rows without an id take no part; an
    empty table gives no rows; with fewer than k other rows all of them are returned.
    """
    spark = vectors.sparkSession
    stored = written(quantised(vectors), "vectors")
    results = None
    for dim in sorted(r[0] for r in stored.select(F.size("v").alias("dim")).distinct().collect()):
        part = top_of_dimension(stored.filter(F.size("v") == dim), dim, every, k)
        results = part if results is None else results.union(part)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        results.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def top_of_dimension(vectors: DataFrame, dim: int, every: int, k: int) -> DataFrame:
    same = Window.partitionBy("v").orderBy("vec_id")
    data = vectors.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1).drop("nth")
    data = written(data, "data")
    queries = vectors.filter(F.col("vec_id") % every == 0).withColumn("query_key", F.col("vec_id"))
    n, n_queries = data.count(), queries.count()
    sample = data.orderBy(F.xxhash64("v"), "vec_id").limit(min(MOST_CENTRES, max(1, math.ceil(n / DATA_BLOCK)))).collect()
    centres = np.array([r["v"] for r in sample], np.int64).reshape(len(sample), dim)
    ids = np.array([r["vec_id"] for r in sample], np.int64)
    extra = "cell long, away double, floor double"
    data = written(data.mapInArrow(routed(centres, ids, dim, k, False), f"vec_id long, v array<bigint>, {extra}"), "routed")
    queries = written(
        queries.mapInArrow(routed(centres, ids, dim, k, True), f"vec_id long, v array<bigint>, query_key long, {extra}"), "asked"
    )
    cells = {r["cell"]: r for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}
    asked = {r["cell"]: r for r in queries.groupBy("cell").agg(F.max("away").alias("radius"), F.min("floor").alias("floor")).collect()}
    norms = np.sqrt((centres.astype(np.float64) ** 2).sum(1))
    dots = product(centres, centres)
    meets = [  # the data cells that a query cell has to see
        (int(q), int(d), math.ceil(cell["n"] / DATA_BLOCK))
        for q, own in asked.items()
        for d, cell in cells.items()
        if float(dots[q, d]) + norms[q] * cell["radius"] + norms[d] * own["radius"]
        + own["radius"] * cell["radius"] + 1e-3 >= own["floor"]
    ]
    turns = max(1, math.ceil(n_queries / QUERY_BLOCK))
    plan = vectors.sparkSession.createDataFrame(meets, "cell long, d long, blocks int").select(
        "cell", "d", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    blocks = F.create_map(*[x for d, c in cells.items() for x in (F.lit(int(d)), F.lit(math.ceil(c["n"] / DATA_BLOCK)))])
    left = queries.join(plan, "cell").select(
        F.col("d").alias("cell"), "block", F.pmod(F.xxhash64("vec_id"), F.lit(turns)).alias("turn"), "vec_id", "v", "query_key", "floor"
    )
    right = data.select(
        "cell", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.element_at(blocks, F.col("cell"))).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("turn"), "vec_id", "v",
    )
    keys = ["cell", "block", "turn"]
    return (
        left.groupBy(*keys).cogroup(right.groupBy(*keys))
        .applyInArrow(block_search(k), "query_key long, vec_id long, score long")
        .withColumnRenamed("query_key", "query_id")
    )
