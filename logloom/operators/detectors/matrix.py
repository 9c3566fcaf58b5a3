"""Detectors on count vectors that need the V×V matrix of event co-occurrence.

Rows stay in Spark; the driver sees only matrices over the V event types and per-candidate counts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import written

MAX_EVENTS = 4096


def gram(vectors: DataFrame) -> np.ndarray:
    """XᵀX of the ``features`` vectors, summed up a tree of executors; no pairs of cells are emitted."""
    rows = MLUtils.convertVectorColumnsFromML(vectors.select("features"), "features")
    matrix = RowMatrix(rows)
    if matrix.numCols() > MAX_EVENTS:
        raise ValueError(f"{matrix.numCols()} event types; the V×V matrix is meant for {MAX_EVENTS}")
    return matrix.computeGramianMatrix().toArray()


# --- principal components ----------------------------------------------------------------------


@dataclass
class PcaModel:
    components: np.ndarray
    threshold: float

    @property
    def kept(self) -> int:
        return self.components.shape[1]


def fit_pca(
    vectors: DataFrame, n_components: float = 0.95, threshold: float | None = None, c_alpha: float = 3.2905
) -> PcaModel:
    """Normal subspace of the uncentred second-moment matrix.

    ``n_components`` below 1 is a share of the sum of singular values.  Without a threshold the
    Q-statistic of the remaining singular values sets it.
    """
    moment = gram(vectors) / vectors.count()
    u, sigma, _ = np.linalg.svd(moment)
    if n_components < 1:
        n = int(np.argmax(np.cumsum(sigma) / sigma.sum() >= n_components)) + 1
    else:
        n = int(n_components)
    if not threshold:
        threshold = _q_statistic(sigma[n:], c_alpha)
    return PcaModel(u[:, :n], float(threshold))


def _q_statistic(rest: np.ndarray, c_alpha: float) -> float:
    p1, p2, p3 = (float((rest**k).sum()) for k in (1, 2, 3))
    h0 = 1 - 2 * p1 * p3 / (3 * p2**2)
    inner = c_alpha * np.sqrt(2 * p2 * h0**2) / p1 + 1 + p2 * h0 * (h0 - 1) / p1**2
    return p1 * inner ** (1 / h0)


def score_pca(vectors: DataFrame, model: PcaModel) -> DataFrame:
    """``spe`` = squared length outside the normal subspace, and ``anomaly``."""
    components, threshold = model.components, model.threshold

    @F.pandas_udf("double")
    def residual(values: pd.Series) -> pd.Series:
        x = np.stack(values.to_numpy())
        rest = x - (x @ components) @ components.T
        return pd.Series((rest**2).sum(axis=1))

    scored = vectors.withColumn("spe", residual("values"))
    return scored.withColumn("anomaly", (F.col("spe") > threshold).cast("int"))


# --- invariants --------------------------------------------------------------------------------


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Distinct count vectors with how often they occur: what every pass of the search reads."""
    return written(vectors.groupBy("values").agg(F.count(F.lit(1)).alias("weight")), "vectors")


def near_zero_counts(distinct: DataFrame, directions: np.ndarray, tolerance: float) -> np.ndarray:
    """For each column of ``directions``: the rows whose product with it is within ``tolerance``."""

    def count(batches):
        total = np.zeros(directions.shape[1])
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["values"].to_numpy())
                total += pdf["weight"].to_numpy() @ (np.abs(x @ directions) < tolerance)
        yield pd.DataFrame({"direction": np.arange(len(total)), "n": total})

    summed = (
        distinct.mapInPandas(count, "direction int, n double").groupBy("direction").agg(F.sum("n").alias("n"))
    )
    out = np.zeros(directions.shape[1])
    for row in summed.toLocalIterator():
        out[row["direction"]] = row["n"]
    return out


def weakest_weights(full: np.ndarray, sets: np.ndarray, scales: Sequence[int]) -> np.ndarray:
    """Whole-number weights of each column set for each scale, shape (sets, scales, length).

    They are the direction in which the set's columns vary least, with its smallest part as large as the
    scale.  Rows with a part that vanishes are nan.
    """
    blocks = full[sets[:, :, None], sets[:, None, :]]
    weakest = np.linalg.eigh(blocks)[1][:, :, 0]
    least = np.take_along_axis(weakest, np.abs(weakest).argmin(1)[:, None], 1)
    usable = np.abs(least) >= 1e-6
    whole = np.rint(np.where(usable, weakest, np.nan)[:, None, :] / least[:, None, :] * np.array(scales)[None, :, None])
    return np.where((whole == 0).any(2, keepdims=True), np.nan, whole)


def holding_sets(
    distinct: DataFrame, full: np.ndarray, sets: list[tuple[int, ...]], scales: Sequence[int], enough: float, batch: int
) -> pd.DataFrame:
    """``columns, weights, held`` of the sets that hold for at least ``enough`` rows, each with its
    first scale that does; one pass over the distinct vectors for every ``batch`` sets."""
    tables = []
    for at in range(0, len(sets), batch):
        part = sets[at : at + batch]
        weights = weakest_weights(full, np.array(part), scales)
        which, scale = np.nonzero(~np.isnan(weights).any(2))
        directions = np.zeros((len(full), len(which)))
        for i, (w, s) in enumerate(zip(which, scale)):
            directions[list(part[w]), i] = weights[w, s]
        held = near_zero_counts(distinct, directions, 1e-8) if len(which) else np.zeros(0)
        table = pd.DataFrame({"columns": [part[w] for w in which], "scale": scale, "held": held})
        table["weights"] = [weights[w, s].tolist() for w, s in zip(which, scale)]
        tables.append(table[table["held"] >= enough].sort_values("scale").drop_duplicates("columns"))
    return pd.concat(tables) if tables else pd.DataFrame(columns=["columns", "scale", "held", "weights"])


def longer_sets(sets: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Sets with one column more, all of whose parts are among ``sets``."""
    known, last = set(sets), sorted({s[-1] for s in sets})
    more = (s + (c,) for s in sets for c in last[bisect_right(last, s[-1]) :])
    return [m for m in more if all(m[:i] + m[i + 1 :] in known for i in range(len(m) - 1))]


def fit_invariants(
    vectors: DataFrame,
    percentage: float = 0.98,
    epsilon: float = 0.5,
    longest: int | None = None,
    scales: Sequence[int] = (1, 2, 3),
    batch: int = 512,
) -> dict[tuple[int, ...], list[float]]:
    """Weights over few columns that give 0 for at least ``percentage`` of the rows.

    All sets of one length are judged together: those that hold are invariants, but for the ones that
    follow from others (most rows held first, then by columns), and only sets that don't hold grow.
    The search ends with the length at which there are as many as the data has weak directions.
    The driver handles column sets and their counts only.
    """
    full = gram(vectors)
    width, rows = len(full), vectors.count()
    distinct = distinct_vectors(vectors)
    holds = near_zero_counts(distinct, np.linalg.eigh(full)[1], epsilon) >= percentage * rows
    wanted = int(np.cumprod(holds).sum())  # weak directions come first

    found: dict[tuple[int, ...], list[float]] = {(c,): [1.0] for c in range(width) if full[c, c] == 0}
    basis = [np.eye(width)[c] for (c,) in found]
    sets, length = [(c,) for c in range(width) if full[c, c] != 0], 1
    while sets and len(found) < wanted and length != longest:
        length += 1
        sets = longer_sets(sets)
        holding = holding_sets(distinct, full, sets, scales, percentage * rows, batch)
        order = sorted(zip(-holding["held"], holding["columns"], holding["weights"]))
        for _, columns, weights in order:
            new = np.zeros(width)
            new[list(columns)] = weights
            new /= np.linalg.norm(new)
            for known in basis:
                new = new - (known @ new) * known
            if np.linalg.norm(new) > 1e-6:
                basis.append(new / np.linalg.norm(new))
                found[columns] = weights
        sets = sorted(set(sets) - set(holding["columns"]))
    return found


def score_invariants(vectors: DataFrame, invariants: dict[tuple[int, ...], list[float]]) -> DataFrame:
    """``broken`` = Σ |x·θ| over the invariants, anomalous above 1e-6; all in the JVM."""
    values = F.col("values")
    broken = F.lit(0.0)
    for columns, weights in invariants.items():
        product = F.lit(0.0)
        for c, w in zip(columns, weights):
            product = product + F.get(values, F.lit(c)) * F.lit(float(w))
        broken = broken + F.abs(product)
    scored = vectors.withColumn("broken", broken)
    return scored.withColumn("anomaly", (F.col("broken") > 1e-6).cast("int"))
