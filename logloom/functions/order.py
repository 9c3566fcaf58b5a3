"""Row order without a single sorting task.

A log is an ordered list of rows and one project may hold a third of it, so neither a window
without keys nor one keyed by project alone is safe.  The helpers cut the order into blocks by an
expression that rises with it: each block is sorted by itself, and one small row per block carries
the offset or the last row over to the next block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES_PER_BLOCK = 1_000_000
HASH_PREFIX = 4


def line_block(line: Column | str, size: int = LINES_PER_BLOCK) -> Column:
    """Block of a dense line number: at most ``size`` rows, whatever the keys are."""
    line = F.col(line) if isinstance(line, str) else line
    return F.floor(line / size)


def seeded_hash(seed: int | str, *ids: Column | str) -> Column:
    """Shuffle key ``md5(seed|id|…)``: the same on any engine and any partitioning."""
    parts = [F.col(c) if isinstance(c, str) else c for c in ids]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def index_rows(
    df: DataFrame,
    order_by: Sequence[Column],
    blocks: Sequence[Column],
    partition_by: Sequence[str] = (),
    name: str = "row_index",
    previous: Sequence[str] = (),
) -> DataFrame:
    """Add the 0-based position of each row within ``partition_by`` under ``order_by``.

    ``blocks`` must never decrease along ``order_by``.  Rows with null keys stay.  With ``previous``,
    the struct of these columns of the row before comes along as ``previous`` (null for the first
    row of a partition); ``order_by`` must then be a single column.
    """
    parts = list(partition_by)
    keys = [f"_block{i}" for i in range(len(blocks))]
    tagged = df.withColumns(dict(zip(keys, blocks)))
    along = Window.partitionBy(*parts).orderBy(*keys)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*parts, *keys).orderBy(*order_by)
    row = F.struct(*[F.col(c) for c in previous]) if previous else None

    sums = [F.count(F.lit(1)).alias("_n")]
    carried = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")]
    added = {"_inside": F.row_number().over(inside) - 1}
    if previous:
        sums.append(F.max_by(row, order_by[0]).alias("_last"))
        carried.append(F.lag("_last").over(along).alias("_carry"))
        added["_before"] = F.lag(row).over(inside)
    small = tagged.groupBy(*parts, *keys).agg(*sums)
    small = small.select(*[F.col(c).alias(f"_of_{c}") for c in (*parts, *keys)], *carried)
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*parts, *keys)]  # null keys are keys, too
    out = (
        tagged.withColumns(added)
        .join(small, same)
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop(*[f"_of_{c}" for c in (*parts, *keys)])
    )
    if previous:
        out = out.withColumn("previous", F.coalesce("_before", "_carry"))
    return out.drop("_inside", "_offset", "_before", "_carry", *keys)


def with_totals(
    df: DataFrame, blocks: Sequence[Column], partition_by: Sequence[str], totals: dict[str, tuple[Column, str]]
) -> DataFrame:
    """Add aggregates of each row's partition to the row: ``{name: (column, "min" | "max" | "count")}``.

    Blocks are counted by themselves, their small table carries the partition's totals, and rows meet
    it by partition and block: a partition with a third of the rows stays spread out.
    """
    keys = [*partition_by, *[f"_block{i}" for i in range(len(blocks))]]
    again = {"min": F.min, "max": F.max, "count": F.sum}
    tagged = df.withColumns({f"_block{i}": b for i, b in enumerate(blocks)})
    small = tagged.groupBy(*keys).agg(*[getattr(F, kind)(c).alias(name) for name, (c, kind) in totals.items()])
    whole = Window.partitionBy(*partition_by)
    small = small.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], *[again[kind](F.col(n)).over(whole).alias(n) for n, (_, kind) in totals.items()]
    )
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]  # null keys are keys, too
    return tagged.join(small, same).drop(*[f"_of_{k}" for k in keys], *[k for k in keys if k not in partition_by])


def choose_first(
    df: DataFrame,
    key: Column,
    tie: str,
    how_many,
    partition_by: Sequence[str] = (),
    name: str = "chosen",
) -> DataFrame:
    """Flag the first ``how_many(n)`` rows of each partition under ``(key, tie)``.

    ``key`` is a uniform hash in hex.  Only the one block that holds the cut is ranked, and the cut
    itself (one row per partition) is compared with every row, so the rows are not shuffled.
    ``how_many`` maps the row count column to a count column.
    """
    parts = list(partition_by)
    keyed = df.withColumn("_key", key)
    slim = keyed.select(*parts, "_key", F.col(tie).alias("_tie")).withColumn(
        "_block", F.substring("_key", 1, HASH_PREFIX)
    )
    whole = Window.partitionBy(*parts)
    upto = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    border = (
        slim.groupBy(*parts, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_k", F.least(how_many(F.col("_total")).cast("long"), F.col("_total")))
        .filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")))
        .select(*parts, "_block", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    ranked = Window.partitionBy(*parts, "_block").orderBy("_key", "_tie")
    cut = (
        slim.join(border, [*parts, "_block"])
        .withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") == F.col("_need"))
        .select(*parts, F.struct("_key", "_tie").alias("_cut"))
    )
    mine = F.struct(F.col("_key"), F.col(tie).alias("_tie"))
    if parts:
        flagged = keyed.join(cut, parts, "left").withColumn(
            name, F.coalesce(mine <= F.col("_cut"), F.lit(False))
        )
    else:
        flagged = keyed.withColumn(
            name, F.coalesce(mine <= cut.select("_cut").scalar(), F.lit(False))
        )
    return flagged.drop("_key", "_cut")


def exact_percentiles(
    df: DataFrame, value: str, probabilities: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """Percentiles with linear interpolation, one row ``(p, value)`` per probability.

    A sketch brackets each percentile; only the values inside the brackets are counted and sorted.
    The brackets are four times as wide as the sketch may err; with few values they hold all.
    """
    probs = [float(p) for p in probabilities]
    data = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    slack = 4.0 / accuracy
    edges = [e for p in probs for e in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = data.agg(
        F.percentile_approx("v", edges, accuracy).alias("e"),
        F.count("v").alias("n"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
    ).select(F.struct("e", "n", "lo", "hi").alias("s"))
    bounds = data.withColumn("s", sketch.scalar())
    frames = []
    for i, p in enumerate(probs):
        few = F.col("s.n") < 10 * accuracy
        low = F.when(few | F.lit(p <= slack), F.col("s.lo")).otherwise(F.col("s.e")[2 * i])
        high = F.when(few | F.lit(p >= 1 - slack), F.col("s.hi")).otherwise(F.col("s.e")[2 * i + 1])
        frames.append(
            F.struct(
                F.lit(p).alias("p"),
                (F.col("v") < low).alias("below"),
                ((F.col("v") >= low) & (F.col("v") <= high)).alias("inside"),
            )
        )
    slim = bounds.select("v", F.col("s.n").alias("n"), F.explode(F.array(*frames)).alias("b"))
    counts = (
        slim.filter(F.col("b.below") | F.col("b.inside"))
        .withColumn("v", F.when(F.col("b.inside"), F.col("v")))
        .groupBy(F.col("b.p").alias("p"), "v", "n")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    upto = (
        Window.partitionBy("p")
        .orderBy(F.col("v").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    position = F.col("p") * (F.col("n") - 1)
    at = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("first", F.col("upto") - F.col("c"))
    rank_low, rank_high = F.floor(position), F.ceil(position)
    holds = lambda rank: (F.col("first") <= rank) & (rank < F.col("upto"))
    return (
        at.groupBy("p", "n")
        .agg(
            F.max(F.when(holds(rank_low), F.col("v"))).alias("a"),
            F.max(F.when(holds(rank_high), F.col("v"))).alias("b"),
        )
        .select("p", (F.col("a") + (F.col("b") - F.col("a")) * (position - rank_low)).alias("value"))
    )
