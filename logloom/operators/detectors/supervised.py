"""Supervised detectors on count vectors: MLlib's tree and logistic regression, and a linear SVM with an L1 penalty."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from logloom.operators.detectors.sparse import rows_of
from logloom.session import written


def _predict(model, vectors: DataFrame) -> DataFrame:
    scored = model.transform(vectors)
    return scored.withColumn("anomaly", F.col("prediction").cast("int"))


def decision_tree(train: DataFrame, test: DataFrame, max_depth: int = 30, seed: int = 0) -> DataFrame:
    """Gini tree; 30 levels stand for no limit."""
    tree = DecisionTreeClassifier(
        labelCol="label", impurity="gini", maxDepth=max_depth, maxBins=128, maxMemoryInMB=512, seed=seed
    )
    return _predict(tree.fit(train), test)


def logistic_regression(train: DataFrame, test: DataFrame, c: float = 100.0) -> DataFrame:
    """L2 regression with inverse strength ``c`` on the raw counts."""
    rows = train.count()
    model = LogisticRegression(
        labelCol="label", regParam=1.0 / (c * rows), elasticNetParam=0.0, tol=0.01, maxIter=100, standardization=False
    )
    return _predict(model.fit(train), test)


def _column_sums(rows: DataFrame, weights: np.ndarray, scales: np.ndarray, pull) -> np.ndarray:
    """Σ pull · x over all rows, for each scaled column and the constant; tasks send one number a column.

    ``pull(product, label, times)`` gives a number for each row from its product with the weights.
    """
    width = len(weights) - 1

    def sums(batches):
        out = np.zeros(width + 1)
        for batch in batches:
            part = rows_of(batch)
            y = np.where(batch.column("label").to_numpy(zero_copy_only=False) == 1, 1.0, -1.0)
            xs = part.xs / scales[part.cols]
            product = part.sums((weights[part.cols] * xs)[:, None])[:, 0] + weights[width] / scales[width]
            pulls = pull(product, y, batch.column("weight").to_numpy(zero_copy_only=False))
            out += np.bincount(part.cols, xs * np.repeat(pulls, part.lengths), width + 1)
            out[width] += pulls.sum() / scales[width]
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_pydict({"col": some, "g": out[some]})

    out = np.zeros(width + 1)
    for row in rows.mapInArrow(sums, "col long, g double").groupBy("col").agg(F.sum("g").alias("g")).collect():
        out[row["col"]] = row["g"]
    return out


def _steepest(rows: DataFrame, scales: np.ndarray, used: np.ndarray, rounds: int = 6) -> float:
    """A bound of the largest eigenvalue of XᵀX of the scaled columns: of a matrix without negative parts,
    no positive vector grows less than that in all its places at once."""
    sizes = rows.withColumn("xs", F.transform("xs", F.abs))
    v, bound = used.astype(float), float(used.sum())
    for _ in range(rounds):
        grown = _column_sums(sizes, v, scales, lambda product, y, times: times * product)
        bound = min(bound, float((grown[used] / v[used]).max()))
        v = np.where(used, grown / grown.max(), 0.0)
    return bound


def fit_linear_svm(train: DataFrame, c: float = 1.0, iterations: int = 100, tolerance: float = 1e-2) -> np.ndarray:
    """Weights of the columns and, last, the constant that make ``Σ|w| + c · Σ max(0, 1 - y·margin)²`` least.

    ``train`` has label (1 is an anomaly), cols and xs (rising columns that are not zero).  Equal rows are
    counted once and read once a step.  Steps are proximal with momentum, which starts anew when it
    points uphill; columns are scaled by their lengths and the penalty with them, so the optimum is
    that of the raw counts.  They end when no slope is off by more than about ``tolerance``, where the
    penalty's own slope is 1, or after ``iterations``.  The driver holds one number for each column.  Rows without a label take
    no part; without any row all weights are zero.
    """
    rows = written(
        train.filter("label is not null").groupBy("label", "cols", "xs").agg(F.count(F.lit(1)).cast("double").alias("weight")), "labelled"
    )
    cells = rows.select("weight", F.explode(F.arrays_zip("cols", "xs")).alias("cell"))
    lengths = cells.groupBy("cell.cols").agg(F.sum(F.col("weight") * F.col("cell.xs") ** 2).alias("s")).collect()
    total = rows.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("n")).first()["n"]
    width = max((r["cols"] for r in lengths), default=-1) + 1
    if not total:
        return np.zeros(width + 1)
    squares = np.full(width + 1, total)
    for r in lengths:
        squares[r["cols"]] = r["s"] or 1.0
    scales = np.sqrt(squares)

    used = np.zeros(width + 1, bool)
    used[[*(r["cols"] for r in lengths), width]] = True
    curve = 2 * c * _steepest(rows, scales, used)
    w = z = np.zeros(width + 1)
    momentum = 1.0
    for _ in range(iterations):
        slope = c * _column_sums(rows, z, scales, lambda product, y, times: -2 * times * y * np.maximum(0.0, 1 - y * product))
        step = z - slope / curve
        new = np.sign(step) * np.maximum(0.0, np.abs(step) - 1 / (scales * curve))
        still = (curve * np.abs(z - new) * scales).max() <= tolerance
        uphill = (z - new) @ (new - w) > 0
        ahead = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z = new if uphill else new + (momentum - 1) / ahead * (new - w)
        momentum = 1.0 if uphill else ahead
        w = new
        if still:
            break
    return w / scales


def linear_svm(train: DataFrame, test: DataFrame, c: float = 1.0, iterations: int = 100) -> DataFrame:
    """Squared hinge loss with an L1 penalty: ``margin`` and ``anomaly`` (margin above zero) of each test row.

    Both tables have cols and xs; columns that the training rows lack weigh nothing.
    """
    weights = fit_linear_svm(train, c, iterations)
    width = len(weights) - 1

    def score(batches):
        for batch in batches:
            part = rows_of(batch)
            each = np.where(part.cols < width, weights[np.minimum(part.cols, width)], 0.0) * part.xs
            margin = part.sums(each[:, None])[:, 0] + weights[width]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(margin)], names=[*batch.schema.names, "margin"])

    schema = StructType([*test.schema.fields, StructField("margin", DoubleType())])
    return test.mapInArrow(score, schema).withColumn("anomaly", (F.col("margin") > 0).cast("int"))
