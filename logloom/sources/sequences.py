"""Sequence files: one sequence per line, tokens ``event[,seconds]`` separated by blanks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sequence_tokens(line: Column | str) -> Column:
    """Array of (event, dt); a token without a gap has 0, and so has the first one."""
    line = F.col(line) if isinstance(line, str) else line
    tokens = F.filter(F.split(line, r"\s+"), lambda t: t != "")

    def token(t: Column, i: Column) -> Column:
        parts = F.split(t, ",")
        gap = F.when((i > 0) & (F.size(parts) == 2), parts[1].try_cast("double")).otherwise(F.lit(0.0))
        return F.struct(parts[0].alias("event"), gap.alias("dt"))

    return F.transform(tokens, token)


def read_sequence_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(sequence_tokens("value").alias("tokens"))


def sequence_line(features: Sequence[str]) -> Column:
    """``v1,v2 v1,v2 …`` over arrays of equal length, with the blank after the last token."""
    zipped = F.arrays_zip(*[F.col(f) for f in features])
    token = lambda z: F.concat(
        F.concat_ws(",", *[z[f].cast("string") for f in features]), F.lit(" ")
    )
    return F.array_join(F.transform(zipped, token), "")


def write_sequence_file(df: DataFrame, features: Sequence[str], path: str) -> None:
    df.select(sequence_line(features).alias("value")).write.mode("overwrite").text(path)
