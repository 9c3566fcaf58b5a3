"""Spread of vectors within a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cells(vectors: DataFrame, batch: str, vector: str) -> DataFrame:
    return vectors.select(batch, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def _bad(x):
    return F.isnan(x) | (F.abs(x) == float("inf"))


def embedding_dispersion(vectors: DataFrame, batch: str = "batch", vector: str = "embedding") -> DataFrame:
    """Mean over dimensions of the sample variance in a batch; 0 for one row, NaN for bad input.

    The variance is merged from partial sums, so a batch of any size stays distributed.
    """
    dims = _cells(vectors, batch, vector).groupBy(batch, "dim").agg(
        F.var_samp("x").alias("v"),
        F.count(F.lit(1)).alias("n"),
        F.max(_bad(F.col("x")).cast("int")).alias("bad"),
    )
    value = (
        F.when(F.max("bad") == 1, F.lit(float("nan")))
        .when(F.max("n") < 2, F.lit(0.0))
        .otherwise(F.avg("v"))
    )
    return dims.groupBy(batch).agg(F.max("n").alias("n"), value.alias("dispersion"))


def pooled_dispersion(vectors: DataFrame, batch: str = "batch", vector: str = "embedding") -> DataFrame:
    """Older form: sample variance over all elements of a batch."""
    return _cells(vectors, batch, vector).groupBy(batch).agg(F.var_samp("x").alias("dispersion"))
