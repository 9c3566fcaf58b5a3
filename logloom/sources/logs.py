"""Raw logs in text and CSV form, sampling, and the structured-log sink."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.order import index_rows, line_block
from logloom.functions.text import binary_label, strip


def _ordered_file(df: DataFrame) -> DataFrame:
    """Tag rows with their place in the files: file name, then byte offset within the file."""
    where = F.col("_metadata")
    return df.select(
        "*",
        where["file_path"].alias("_file"),
        where["file_block_start"].alias("_start"),
        F.monotonically_increasing_id().alias("_seen"),
    )


def number_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1-based ``line`` in file order.

    Within one split ``monotonically_increasing_id`` rises in reading order and the split start
    orders the splits of a file, so no task sorts more than one split.
    """
    tagged = _ordered_file(df)
    rows = index_rows(
        tagged,
        [F.col("_seen")],
        [F.col("_file"), F.col("_start")],
        name="_index",
    )
    return rows.select((F.col("_index") + 1).alias("line"), *columns)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return number_lines(spark.read.text(path).withColumnRenamed("value", "raw"), ["raw"])


def read_log_csv(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """Header CSV with ``Content`` as text and ``line`` = 1..n in file order."""
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    df = reader.schema(schema).csv(path)
    return number_lines(df, df.columns).withColumn("Content", F.col("Content").cast("string"))


_MARK = "\uffff"


def log_format_pattern(log_format: str) -> tuple[str, list[str]]:
    """Anchored pattern and field names of a format such as ``<Date> <Level>: <Content>``."""
    names = re.findall(r"<([^<>]+)>", log_format)
    between = re.split(r"<[^<>]+>", log_format)
    pattern = "(.*?)".join(re.sub(" +", lambda _: r"\s+", text) for text in between)
    return f"(?dU)^{pattern}$", names


def parse_log_format(
    df: DataFrame, log_format: str, raw: str = "raw", ascii_only: bool = False
) -> DataFrame:
    """Named fields of each matching line; other lines are dropped and ``line`` numbers the rest."""
    pattern, names = log_format_pattern(log_format)
    text = F.col(raw)
    if ascii_only:
        text = F.regexp_replace(text, r"[^\x00-\x7F]+", "<NASCII>")
    # One match takes the line apart: every field is put behind a mark that no text may hold.
    marked = "".join(f"{_MARK}${i + 1}" for i in range(len(names)))
    parts = F.split(F.regexp_replace("_text", pattern, marked), _MARK)
    rows = df.select("line", strip(text).alias("_text")).filter(F.col("_text").rlike(pattern))
    kept = rows.select("line", parts.alias("_parts")).select(
        "line", *[F.col("_parts")[i + 1].alias(n) for i, n in enumerate(names)]
    )
    numbered = index_rows(kept, [F.col("line")], [line_block("line")], name="_index")
    return numbered.select((F.col("_index") + 1).alias("LineId"), *names)


def split_columns(df: DataFrame, names: Sequence[str], raw: str = "raw") -> DataFrame:
    """Split at white space into at most ``len(names)`` parts; one missing part becomes ``""``."""
    n = len(names)
    parts = F.split(F.regexp_replace(F.col(raw), r"^\s+", ""), r"\s+", n)
    filled = F.when(F.size("_parts") < n, F.concat("_parts", F.array(F.lit("")))).otherwise(F.col("_parts"))
    return (
        df.withColumn("_parts", parts)
        .withColumn("_parts", filled)
        .select("line", *[F.get("_parts", F.lit(i)).alias(name) for i, name in enumerate(names)])
    )


def read_annotations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Annotated record ids or session labels from CSV."""
    return spark.read.option("header", True).schema(schema).csv(path)


def every_nth(df: DataFrame, rate: int = 100, max_records: int | None = 50) -> DataFrame:
    """Records 0, rate, 2·rate … in file order, ``max_records`` of them at the most.

    With dense line numbers both rules are a filter on the number itself.
    """
    at = F.col("line") - 1
    keep = at % rate == 0
    if max_records is not None:
        keep = keep & (at < F.lit(rate) * max_records)
    return df.filter(keep)


def head_sample(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` lines."""
    return df.filter(F.col("line") <= n)


def abnormal_rate(df: DataFrame, label: Column | str = "label") -> DataFrame:
    """Rows, alerts and their share."""
    alerts = F.sum(binary_label(label))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        alerts.alias("alerts"),
        (alerts / F.count(F.lit(1))).alias("rate"),
    )


def tail_rows(df: DataFrame, n: int = 5000) -> DataFrame:
    """Last ``n`` lines."""
    last = df.agg(F.max("line").alias("m"))
    return df.filter(F.col("line") > last.scalar() - n)


def write_structured(structured: DataFrame, templates: DataFrame, path: str, stem: str, fmt: str = "parquet") -> None:
    """The pair ``<stem>_structured`` and ``<stem>_templates``."""
    for name, df in (("structured", structured), ("templates", templates)):
        df.write.format(fmt).mode("overwrite").option("header", True).save(f"{path}/{stem}_{name}")


def integrate_projects(tables: dict[str, DataFrame]) -> DataFrame:
    """Union of several projects' rows with a ``project`` column; missing columns are null."""
    out = None
    for project, df in tables.items():
        tagged = df.withColumn("project", F.lit(project))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
