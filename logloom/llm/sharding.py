"""Contiguous shards of near-equal bytes, from prefix sums of partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import written

ORDER = ("doc_id", "text_crc32", "size", "row")


def byte_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Cut the documents, in the order of ``doc_id``, into ``shards`` runs of nearly equal bytes.

    Returns one row per document: doc_id, size (UTF-8 bytes of ``text`` and 1 more), text_crc32,
    shard, slot (position in the shard).  A document belongs to the shard in which its middle byte
    falls, so a shard misses its target by at most the largest document.

    The rows are dealt to ranges of doc_id and written; each range reports its bytes and rows; the
    running sums of these totals (one row per range) place every row of a range by itself.  No text
    is shuffled.

    A null text counts as empty, null ids come first, rows with one id are ordered by checksum and
    size, and repeated rows each get a place of their own.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ranges = written(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"),  # spreads repeated rows over the ranges
        )
        .repartitionByRange(*ORDER)
        .withColumn("part", F.spark_partition_id()),
        "ranges",
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    totals = (  # one row per range: as many as there are shuffle partitions, so small at any size
        ranges.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(every).alias("total"),
        )
    )
    upto = Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    middle = 2 * (F.col("bytes_before") + F.sum("size").over(upto)) - F.col("size")
    placed = written(
        ranges.join(F.broadcast(totals), "part").select(
            "doc_id",
            "size",
            "text_crc32",
            F.floor((middle - 1) / (2 * F.col("total")) * shards).cast("int").alias("shard"),
            (F.col("rows_before") + F.row_number().over(upto) - 1).alias("place"),
        ),
        "placed",
    )
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # at most ``shards`` rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot")
    )
