"""Counts, statistics and validators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.order import exact_percentiles, index_rows
from logloom.functions.text import binary_label


def event_counts(rows: DataFrame, seq: str = "seq_id", event: str = "event") -> DataFrame:
    """Times each event occurs in each sequence."""
    return rows.groupBy(seq, event).agg(F.count(F.lit(1)).alias("n"))


def length_stats(lengths: DataFrame, splits: Sequence[str] = (), by: str = "split", n: str = "n") -> DataFrame:
    """Count, mean, min, max and sample deviation of sequence length per split.

    Names in ``splits`` without a sequence get a row of zeros.
    """
    stats = lengths.groupBy(by).agg(
        F.count(n).alias("count"),
        F.avg(n).alias("mean"),
        F.min(n).alias("min"),
        F.max(n).alias("max"),
        F.stddev_samp(n).alias("std"),
    )
    if splits:
        names = lengths.sparkSession.createDataFrame([(s,) for s in splits], f"{by} string")
        stats = names.join(stats, by, "left")
    return stats.fillna(0)


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and share per label."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / total.scalar())


def normal_anomaly_share(df: DataFrame, label: str = "label") -> DataFrame:
    flag = binary_label(label)
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("rows"),
        (F.sum(1 - flag) / rows).alias("normal_share"),
        (F.sum(flag) / rows).alias("anomaly_share"),
    )


def count_anomaly(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows and rows whose first token is not ``-``; a blank line has no token and is no anomaly."""
    first = F.regexp_extract(F.col(raw), r"^\s*(\S+)", 1)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(((first != "-") & (first != "")).cast("long")).alias("anomalies"),
    )


def template_catalogue(
    structured: DataFrame, template: str = "EventTemplate", line: str = "line"
) -> DataFrame:
    """Distinct templates with id, occurrences and the line they first appear on."""
    return (
        structured.groupBy(template)
        .agg(F.count(F.lit(1)).alias("Occurrences"), F.min(line).alias("first_line"))
        .withColumn("EventId", F.substring(F.md5(F.col(template)), 1, 8))
    )


def null_matrix(df: DataFrame, columns: Sequence[str], project: str = "project") -> DataFrame:
    """One row per (project, column): how many values are missing, and the row total.

    A column the table lacks counts 0.
    """
    aggs = [
        (F.count_if(F.col(c).isNull()) if c in df.columns else F.lit(0).cast("long")).alias(c)
        for c in columns
    ]
    wide = df.groupBy(project).agg(*aggs, F.count(F.lit(1)).alias("__total_rows__"))
    names = [*columns, "__total_rows__"]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in names])
    return wide.select(project, F.explode(pairs).alias("p")).select(project, "p.column", "p.nulls")


_DIGITS = r"\d+(_\d+)*"
_NUMBER = rf"^[+-]?({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"


def _number(text):
    """Number as Python reads it: ``1_0`` and ``nan`` count, a suffix such as ``1f`` does not."""
    plain = F.trim(text)
    return (
        F.when(plain.rlike(_NUMBER), F.regexp_replace(plain, "_", "").try_cast("double"))
        .when(plain.rlike(r"(?i)^[+-]?nan$"), F.lit(float("nan")))
        .when(plain.rlike(r"(?i)^\+?inf(inity)?$"), F.lit(float("inf")))
        .when(plain.rlike(r"(?i)^-inf(inity)?$"), F.lit(float("-inf")))
    )


def _percentile_columns(values: DataFrame, wanted: dict[float, str]) -> DataFrame:
    """One row with a column per percentile."""
    found = exact_percentiles(values, "v", list(wanted))
    return found.agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for p, name in wanted.items()]
    )


def _value_stats(values: DataFrame, wanted: dict[float, str]) -> list:
    """Min, max, mean, population deviation and percentiles of the finite values as scalars."""
    finite = values.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))
    basic = finite.agg(
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
    )
    percentiles = _percentile_columns(finite.select("v"), wanted)
    row = basic.select(F.struct("*").alias("s")).scalar()
    pct = percentiles.select(F.struct("*").alias("s")).scalar()
    columns = [row[c].alias(c) for c in ("min", "max", "mean", "std")]
    return columns + [pct[name].alias(name) for name in wanted.values()]


def validate_numbers(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Every comma part of every token must be a finite number; counts, statistics and a verdict.

    ``lines`` needs no key: errors are counted per line inside the line.
    """
    tokens = F.filter(F.split(F.col(raw), r"\s+"), lambda t: t != "")
    parts = F.flatten(F.transform(tokens, lambda t: F.split(t, ",")))
    numbers = F.transform(parts, _number)
    data = lines.select(numbers.alias("vs"))
    inf = float("inf")
    count = lambda test: F.size(F.filter("vs", test)).cast("long")
    per_line = data.select(
        "vs",
        count(lambda v: v.isNull()).alias("bad"),
        count(lambda v: F.isnan(v)).alias("nan"),
        count(lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) == inf)).alias("inf"),
        count(lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != inf) & (F.abs(v) > 1e6)).alias("large"),
    )
    broken = (F.col("bad") + F.col("nan") + F.col("inf")) > 0
    totals = per_line.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.sum((~broken).cast("long")).alias("valid_lines"),
        F.sum(broken.cast("long")).alias("invalid_lines"),
        F.sum(F.size("vs") - F.col("bad")).alias("total_values"),
        F.sum("nan").alias("nan_count"),
        F.sum("inf").alias("inf_count"),
        F.sum("large").alias("large_value_count"),
        F.sum("bad").alias("parse_error_count"),
    )
    stats = _value_stats(data.select(F.explode("vs").alias("v")), {0.5: "median"})
    verdict = F.when(F.col("invalid_lines") == 0, "PASS").otherwise("FAIL").alias("verdict")
    return totals.select("*", verdict, *stats)


def validate_event_gaps(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Tokens must be ``event,seconds``; NaN, infinite, negative and large gaps are counted, and NaN,
    infinite or unreadable ones fail the file."""
    tokens = F.filter(F.split(F.col(raw), r"\s+"), lambda t: t != "")
    parsed = F.transform(
        tokens,
        lambda t: F.when(F.size(F.split(t, ",")) == 2, _number(F.split(t, ",")[1])),
    )
    data = lines.select(parsed.alias("vs"))
    inf = float("inf")
    count = lambda test: F.size(F.filter("vs", test)).cast("long")
    real = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != inf)
    per_line = data.select(
        "vs",
        count(lambda v: v.isNull()).alias("bad"),
        count(lambda v: F.isnan(v)).alias("nan"),
        count(lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) == inf)).alias("inf"),
        count(lambda v: real(v) & (v < 0)).alias("negative"),
        count(lambda v: real(v) & (F.abs(v) > 1e6)).alias("large"),
    )
    broken = (F.col("bad") + F.col("nan") + F.col("inf")) > 0
    totals = per_line.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.sum((~broken).cast("long")).alias("valid_lines"),
        F.sum(broken.cast("long")).alias("invalid_lines"),
        F.sum(F.size("vs") - F.col("bad")).alias("total_pairs"),
        F.sum("nan").alias("nan_count"),
        F.sum("inf").alias("inf_count"),
        F.sum("negative").alias("negative_count"),
        F.sum("large").alias("large_value_count"),
        F.sum("bad").alias("parse_error_count"),
    )
    wanted = {0.25: "p25", 0.5: "median", 0.75: "p75", 0.95: "p95", 0.99: "p99"}
    stats = _value_stats(data.select(F.explode("vs").alias("v")), wanted)
    verdict = F.when(F.col("invalid_lines") == 0, "PASS").otherwise("FAIL").alias("verdict")
    return totals.select("*", verdict, *stats)


def pair_id(df: DataFrame, first: str, second: str, name: str = "pair_id") -> DataFrame:
    """Dense id from 1 of each distinct pair in sorted order; null when a part is missing.

    Only the distinct pairs are ranked, in blocks by the head of the first part.
    """
    pairs = df.select(first, second).dropna().distinct()
    ranked = index_rows(
        pairs,
        [F.col(first), F.col(second)],
        [F.substring(F.col(first).cast("string"), 1, 4)],
        name="_index",
    ).select(first, second, (F.col("_index") + 1).alias(name))
    return df.join(ranked, [first, second], "left")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value with its place by falling count (ties by value)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return index_rows(
        counts,
        [F.desc("n"), F.col(column)],
        [-F.col("n"), F.substring(F.col(column).cast("string"), 1, 2)],
        name="place",
    )
