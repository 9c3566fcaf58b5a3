"""Labels from annotation tables, id maps and set difference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def annotate_by_id(
    log: DataFrame,
    annotations: DataFrame,
    id_column: str = "EventRecordID",
    channel: str | None = "Sec",
    label: str = "anomaly",
) -> DataFrame:
    """``Label`` is ``label`` where the id is annotated (in ``channel``, unless None), else ``-``.

    Spark broadcasts the distinct ids when it sees that they are few, and shuffles otherwise.
    """
    marks = annotations if channel is None else annotations.filter(F.col("Channel") == channel)
    ids = marks.select(id_column).distinct().withColumn("_hit", F.lit(True))
    return (
        log.join(ids, id_column, "left")
        .withColumn("Label", F.when(F.col("_hit"), F.lit(label)).otherwise(F.lit("-")))
        .drop("_hit")
    )


def annotate_by_line(
    log: DataFrame, positions: DataFrame, label: str = "anomaly", offset: int = 0
) -> DataFrame:
    """Mark rows at 0-based ``position - offset`` (offset 2 for spreadsheet line numbers)."""
    marks = positions.select((F.col("position") - offset + 1).alias("line")).distinct()
    marked = marks.withColumn("_hit", F.lit(True))
    return (
        log.join(marked, "line", "left")
        .withColumn("Label", F.when(F.col("_hit"), F.lit(label)).otherwise(F.lit("-")))
        .drop("_hit")
    )


def annotate_by_row(
    log: DataFrame, examples: DataFrame, columns: Sequence[str], label: str = "anomaly"
) -> DataFrame:
    """Mark every row equal to an example on all columns; a missing value equals nothing."""
    marks = examples.select(*columns).distinct().withColumn("_hit", F.lit(True))
    return (
        log.join(marks, list(columns), "left")
        .withColumn("Label", F.when(F.col("_hit"), F.lit(label)).otherwise(F.lit("-")))
        .drop("_hit")
    )


def label_sessions(
    sessions: DataFrame, labels: DataFrame, key: str = "session_id", strict: bool = False
) -> DataFrame:
    """1 for ``Anomaly``, 0 for any other label, null (or, if strict, an error) when there is none."""
    known = labels.select(key, F.col("Label").alias("_name")).dropDuplicates([key])
    missing = F.raise_error(F.lit("session without a label")).cast("int") if strict else F.lit(None).cast("int")
    value = F.when(F.col("_name").isNull(), missing).when(F.col("_name") == "Anomaly", 1).otherwise(0)
    return sessions.join(known, key, "left").withColumn("label", value).drop("_name")


def map_events(rows: DataFrame, index: DataFrame, default: int = 0, event: str = "event") -> DataFrame:
    """Integer per event from ``index(event, idx)``; unknown ones get ``default`` (0 or -1)."""
    return rows.join(index, event, "left").withColumn("idx", F.coalesce("idx", F.lit(default)))


def count_unknown(mapped: DataFrame, default: int = 0) -> DataFrame:
    return mapped.agg(F.coalesce(F.sum((F.col("idx") == default).cast("long")), F.lit(0)).alias("unknown"))


def exclude_rows(df: DataFrame, sampled: DataFrame, row_id: str) -> DataFrame:
    """Rows not in ``sampled``, by row identity."""
    return df.join(sampled.select(row_id), row_id, "left_anti")
