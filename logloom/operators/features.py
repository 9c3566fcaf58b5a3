"""Count features in long form and as vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.order import index_rows


def document_frequency(counts: DataFrame) -> DataFrame:
    """Sequences per event; ``counts`` has one row per (seq_id, event)."""
    return counts.groupBy("event").agg(F.count(F.lit(1)).alias("df"))


def training_events(train_counts: DataFrame, min_count: int = 1) -> DataFrame:
    """Events that occur in at least ``min_count`` training sequences, with their frequency."""
    return document_frequency(train_counts).filter(F.col("df") >= min_count)


def count_features(counts: DataFrame, events: DataFrame) -> DataFrame:
    """Counts of the training events only; a missing pair means 0."""
    return counts.join(events.select("event"), "event").select("seq_id", "event", F.col("n").cast("double").alias("x"))


def oov_feature(counts: DataFrame, events: DataFrame, sequences: DataFrame) -> DataFrame:
    """Distinct events of each sequence that are not feature columns, 0 included."""
    unknown = (
        counts.join(events.select("event"), "event", "left_anti")
        .groupBy("seq_id")
        .agg(F.count(F.lit(1)).alias("oov"))
    )
    return sequences.select("seq_id").join(unknown, "seq_id", "left").fillna(0, ["oov"])


def tf_idf(features: DataFrame, train_df: DataFrame, train_sequences: DataFrame) -> DataFrame:
    """``x · ln(N / (df + 1e-8))`` with N and df of the training sequences."""
    total = train_sequences.agg(F.count(F.lit(1)).alias("n")).scalar()
    weighted = F.col("x") * F.log(total / (F.col("df") + F.lit(1e-8)))
    return features.join(train_df, "event").withColumn("x", weighted).drop("df")


def column_means(features: DataFrame, train_sequences: DataFrame) -> DataFrame:
    """Mean of each column over all training sequences, zeros included."""
    total = train_sequences.agg(F.count(F.lit(1)).alias("n")).scalar()
    return features.groupBy("event").agg(F.sum("x").alias("_s")).select(
        "event", (F.col("_s") / total).alias("mean")
    )


def zero_mean(features: DataFrame, means: DataFrame) -> DataFrame:
    """Non-zero cells less their column mean.  Every other cell of a column is ``-mean`` and is left
    implicit: writing them out would make the sparse table dense."""
    return features.join(means, "event").withColumn("x", F.col("x") - F.col("mean"))


def sigmoid(features: DataFrame) -> DataFrame:
    """Logistic function of the non-zero cells; zeros stay zero."""
    x = F.col("x")
    return features.withColumn("x", F.when(x != 0, 1 / (1 + F.exp(-x))).otherwise(x))


def event_columns(events: DataFrame) -> DataFrame:
    """Column number of each event, by name."""
    return index_rows(
        events.select("event"), [F.col("event")], [F.substring("event", 1, 4)], name="col"
    )


def sparse_vectors(features: DataFrame, columns: DataFrame, sequences: DataFrame) -> DataFrame:
    """``cols`` and ``xs`` of each sequence: the columns that are not zero, rising, and their values."""
    cells = features.filter("x <> 0").join(columns, "event").groupBy("seq_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), "x"))).alias("_cells")
    )
    part = lambda c, kind: F.coalesce(F.col(f"_cells.{c}"), F.array().cast(f"array<{kind}>"))
    return (
        sequences.join(cells, "seq_id", "left")
        .withColumns({"cols": part("col", "int"), "xs": part("x", "double")})
        .drop("_cells")
    )


def feature_vectors(
    features: DataFrame, columns: DataFrame, sequences: DataFrame, width: int
) -> DataFrame:
    """Dense vector per sequence for the matrix detectors; sequences without events are all zero."""
    cells = features.join(columns, "event").groupBy("seq_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), "x"))).alias("_cells")
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.coalesce(F.element_at("_cells", i), F.lit(0.0)),
    )
    return (
        sequences.join(cells, "seq_id", "left")
        .withColumn("values", F.when(F.col("_cells").isNull(), F.array_repeat(F.lit(0.0), width)).otherwise(dense))
        .withColumn("features", array_to_vector("values"))
        .drop("_cells")
    )
