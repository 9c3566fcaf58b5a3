"""Isolation forest: trees grown in parallel on small samples, path lengths in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.order import exact_percentiles
from logloom.session import written

_NODES = "tree int, node int, feature int, split double, below int, above int, size int"
_HASH_SPAN = float(2**63)


def tree_samples(vectors: DataFrame, row_id: str, trees: int, rows: int, seed: int) -> DataFrame:
    """``rows`` rows per tree without replacement.

    A row joins the draw of a tree when its hash falls under twice the share needed, so a scan emits
    about ``2·trees·rows`` rows in all; the smallest hashes of each tree are its sample.
    """
    total = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    bound = F.least(F.lit(1.0), F.lit(2.0 * rows) / total) * F.lit(_HASH_SPAN)
    key = lambda tree: F.shiftrightunsigned(F.xxhash64(F.lit(seed), tree, F.col(row_id)), 1)
    draws = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), key(t).alias("key"))
        ),
        lambda d: d["key"] <= F.col("_bound"),
    )
    bounded = vectors.withColumn("_bound", bound)
    drawn = bounded.select(row_id, "values", F.explode(draws).alias("_d")).select(row_id, "values", "_d.*")
    place = Window.partitionBy("tree").orderBy("key", row_id)
    return drawn.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= rows).drop("_place", "key")


def _grow(seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        rng = np.random.default_rng([seed, tree])
        x = np.stack(pdf["values"].to_numpy())
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        nodes: list[list] = []
        todo = [(np.arange(len(x)), 0, None, 0)]
        while todo:
            rows, depth, parent, side = todo.pop()
            me = len(nodes)
            nodes.append([tree, me, -1, 0.0, -1, -1, len(rows)])
            if parent is not None:
                nodes[parent][side] = me
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            open_features = np.flatnonzero(high > low)
            if depth >= limit or not len(open_features):
                continue
            feature = int(rng.choice(open_features))
            split = float(rng.uniform(low[feature], high[feature]))
            nodes[me][2:4] = [feature, split]
            goes_below = x[rows, feature] <= split
            todo.append((rows[goes_below], depth + 1, me, 4))
            todo.append((rows[~goes_below], depth + 1, me, 5))
        names = ["tree", "node", "feature", "split", "below", "above", "size"]
        return pd.DataFrame(nodes, columns=names)

    return run


def expected_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n keys."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    value = 2 * (np.log(np.maximum(safe - 1, 1)) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def fit_forest(
    vectors: DataFrame, row_id: str, trees: int = 100, max_samples: int = 256, seed: int = 0
) -> pd.DataFrame:
    """Nodes of all trees: at most ``trees · 2 · max_samples`` small rows."""
    sample = written(tree_samples(vectors, row_id, trees, max_samples, seed).orderBy("tree", row_id), "sample")
    ordered = sample.groupBy("tree").applyInPandas(
        lambda key, pdf: _grow(seed)(key, pdf.sort_values(row_id)), _NODES
    )
    return ordered.toPandas()


def forest_cut(train: DataFrame, nodes: pd.DataFrame, contamination: float = 0.03) -> float:
    """The score that the top ``contamination`` share of the training rows lies above."""
    scored = written(forest_scores(train, nodes).select("score"), "scores")
    return exact_percentiles(scored, "score", [1 - float(contamination)]).first()["value"]


def score_forest(
    vectors: DataFrame, nodes: pd.DataFrame, contamination: float | str = 0.03, train: DataFrame | None = None
) -> DataFrame:
    """``score`` and ``anomaly``: above .5 (auto), or above the cut fitted on ``train``.

    Without ``train`` the vectors are taken to be the training rows themselves.
    """
    if contamination == "auto":
        cut = 0.5
    else:
        cut = forest_cut(vectors if train is None else train, nodes, float(contamination))
    return forest_scores(vectors, nodes).withColumn("anomaly", (F.col("score") > F.lit(cut)).cast("int"))


def forest_scores(vectors: DataFrame, nodes: pd.DataFrame) -> DataFrame:
    """``score`` = 2^(−E[h]/c) of each row."""
    forest = [g.sort_values("node") for _, g in nodes.groupby("tree")]
    packed = [
        tuple(g[c].to_numpy() for c in ("feature", "split", "below", "above", "size")) for g in forest
    ]
    norm = float(expected_path(max(int(f[4][0]) for f in packed)))

    @F.pandas_udf("double")
    def isolation(values: pd.Series) -> pd.Series:
        x = np.stack(values.to_numpy())
        total = np.zeros(len(x))
        for feature, split, below, above, size in packed:
            at = np.zeros(len(x), dtype=int)
            depth = np.zeros(len(x))
            going = np.flatnonzero(feature[at] >= 0)
            while len(going):
                node = at[going]
                left = x[going, feature[node]] <= split[node]
                at[going] = np.where(left, below[node], above[node])
                depth[going] += 1
                going = going[feature[at[going]] >= 0]
            total += depth + expected_path(size[at])
        return pd.Series(2.0 ** (-total / len(packed) / norm))

    return vectors.withColumn("score", isolation("values"))
