"""Deterministic splits and samples: rows are shuffled by ``md5(seed|id)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.order import HASH_PREFIX, choose_first, index_rows, line_block, seeded_hash
from logloom.operators.annotate import exclude_rows
from logloom.session import written


def split_by_label(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(label) == 0), df.filter(F.col(label) == 1)


def _share(ratio: float):
    return lambda n: F.floor(n * F.lit(float(ratio)))


def ratio_split(
    df: DataFrame, row_id: str, ratio: float, seed: int = 42, partition_by: Sequence[str] = ()
) -> DataFrame:
    """``split`` = train for the first ``int(n·ratio)`` shuffled normal rows, test_normal for the
    other normal ones, test_abnormal for all abnormal ones."""
    normal, abnormal = split_by_label(df)
    flagged = choose_first(normal, seeded_hash(seed, row_id), row_id, _share(ratio), partition_by)
    part = F.when(F.col("chosen"), F.lit("train")).otherwise(F.lit("test_normal"))
    return (
        flagged.withColumn("split", part)
        .drop("chosen")
        .unionByName(abnormal.withColumn("split", F.lit("test_abnormal")))
    )


def integrated_split(
    df: DataFrame, row_id: str, ratio: float, seed: int = 42, project: str = "project"
) -> tuple[DataFrame, DataFrame]:
    """Per project ratio split; ``…_C`` projects train whole.  Returns the split and the vocabulary
    corpus: all normal rows of the other projects."""
    complement = F.col(project).endswith("_C")
    plain = df.filter(~complement)
    split = ratio_split(plain, row_id, ratio, seed, [project]).unionByName(
        df.filter(complement).withColumn("split", F.lit("train"))
    )
    return split, plain.filter(F.col("label") == 0)


def reverse_split(split: DataFrame) -> DataFrame:
    """Swap the roles of train and test_normal."""
    swapped = (
        F.when(F.col("split") == "train", "test_normal")
        .when(F.col("split") == "test_normal", "train")
        .otherwise(F.col("split"))
    )
    return split.withColumn("split", swapped)


def first_share(
    df: DataFrame, order: str, ratio: float, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Flag the first ``int(ratio·n)`` rows in file order: per label (class-uniform) or overall."""
    parts = list(partition_by)
    indexed = index_rows(df, [F.col(order)], [line_block(order)], parts, "_index")
    totals = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("_total"))
    joined = indexed.join(totals, parts) if parts else indexed.withColumn("_total", totals.scalar())
    train = F.col("_index") < F.floor(F.col("_total") * F.lit(float(ratio)))
    return joined.withColumn("split", F.when(train, "train").otherwise("test")).drop("_index", "_total")


def mix_abnormal(split: DataFrame, row_id: str, seed: int = 88) -> DataFrame:
    """Move ``min(int(n_train/2), int(0.4·n_abnormal))`` shuffled abnormal rows into train."""
    train = split.filter(F.col("split") == "train")
    half = train.agg(F.floor(F.count(F.lit(1)) / 2).alias("h")).scalar()
    abnormal = split.filter(F.col("split") == "test_abnormal")
    flagged = choose_first(
        abnormal,
        seeded_hash(seed, row_id),
        row_id,
        lambda n: F.least(half, F.floor(n * F.lit(0.4))),
    )
    moved = flagged.withColumn(
        "split", F.when(F.col("chosen"), "train").otherwise("test_abnormal")
    ).drop("chosen")
    return split.filter(F.col("split") != "test_abnormal").unionByName(moved)


def allocate_strata(counts: DataFrame, stratum: str, target: int, strict: bool = True) -> DataFrame:
    """Rows per stratum: one each, the rest by share, rounded half to even and mended to the target.

    The mending goes round the strata by falling count (then by id), one row at a time, and never
    takes the last row of a stratum; the rounds are closed sums, not a loop.  A target below the number
    of strata can't give one each and is an error.  If not ``strict``, the same sums go on there: the
    rows that are missing are taken by share, so the commonest strata come out at 0 or less.
    """
    whole = Window.partitionBy(F.lit(1))
    ranked = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), stratum)
    base = counts.withColumn("_k", F.count(F.lit(1)).over(whole)).withColumn(
        "_total", F.sum("n").over(whole)
    )
    spare = F.lit(target) - F.col("_k")
    share = F.bround(F.col("n") / F.col("_total") * spare)
    if strict:
        few = F.raise_error(F.lit("target is below the number of strata")).cast("double")
        share = F.when(spare < 0, few).otherwise(share)
    first = base.withColumn("_alloc", share.cast("long") + 1).withColumn(
        "_rank", F.row_number().over(ranked)
    )
    diff = F.lit(target) - F.sum("_alloc").over(whole)
    up = first.withColumn("_diff", diff)
    more = F.floor((F.col("_diff") - F.col("_rank")) / F.col("_k")) + 1
    raised = F.col("_alloc") + F.greatest(F.lit(0), more)
    # Lowering: round j takes one row from each stratum with more than j rows to spare.
    rounds = (
        up.filter((F.col("_diff") < 0) & (F.col("_alloc") > 1))
        .select(stratum, "_rank", "_diff", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("_alloc") - 1, -F.col("_diff")))).alias("_round"))
    )
    taken = (
        rounds.withColumn(
            "_turn", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_round", "_rank"))
        )
        .filter(F.col("_turn") <= -F.col("_diff"))
        .groupBy(stratum)
        .agg(F.count(F.lit(1)).alias("_less"))
    )
    return up.join(taken, stratum, "left").select(
        stratum, "n", (F.when(F.col("_diff") > 0, raised).otherwise(F.col("_alloc") - F.coalesce("_less", F.lit(0)))).alias("alloc")
    )


def stratified_sample(
    df: DataFrame, stratum: str, row_id: str, target: int, seed: int = 42
) -> DataFrame:
    """About ``target`` rows with at least one of every stratum; rows without a stratum go."""
    rows = df.filter(F.col(stratum).isNotNull())
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    alloc = allocate_strata(counts, stratum, target).select(
        stratum, F.least("alloc", "n").alias("_want")
    )
    keyed = rows.withColumn("_key", seeded_hash(seed, row_id)).join(alloc, stratum)
    indexed = index_rows(
        keyed, [F.col("_key"), F.col(row_id)], [F.substring("_key", 1, HASH_PREFIX)], [stratum], "_index"
    )
    return indexed.filter(F.col("_index") < F.col("_want")).drop("_index", "_want", "_key")


def two_disjoint_samples(
    df: DataFrame, stratum: str, row_id: str, target: int, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Two stratified samples without a common row, the second drawn with ``seed+1``.

    The first is written, so that its two readers see the same rows and it is drawn once.
    """
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    enough = F.when(n >= 2 * target, F.lit(True)).otherwise(
        F.raise_error(F.lit("fewer than twice the target rows")).cast("boolean")
    )
    first = written(stratified_sample(df.filter(enough), stratum, row_id, target, seed), "sample")
    rest = exclude_rows(df, first, row_id)
    return first, stratified_sample(rest, stratum, row_id, target, seed + 1)


def random_n(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """Uniform sample of ``min(n, rows)`` rows."""
    limit = lambda total: F.least(F.lit(n).cast("long"), total)
    flagged = choose_first(df, seeded_hash(seed, row_id), row_id, limit)
    return flagged.filter("chosen").drop("chosen")


def subsample(df: DataFrame, row_id: str, ratio: float, seed: int = 42) -> DataFrame:
    """``int(n·ratio)`` random rows."""
    flagged = choose_first(df, seeded_hash(seed, row_id), row_id, _share(ratio))
    return flagged.filter("chosen").drop("chosen")


def train_valid_split(
    df: DataFrame,
    row_id: str,
    valid_size: float,
    sample_ratio: float = 1.0,
    seed: int = 42,
    order: str | None = None,
) -> DataFrame:
    """Use the first ``int(n·sample_ratio)`` sequences in file order; ``int(used·valid_size)`` random
    ones become ``valid``, the rest ``train``."""
    used = df
    if sample_ratio < 1.0:
        used = first_share(df, order or row_id, sample_ratio).filter(F.col("split") == "train").drop("split")
    flagged = choose_first(used, seeded_hash(seed, row_id), row_id, _share(valid_size))
    return flagged.withColumn("split", F.when(F.col("chosen"), "valid").otherwise("train")).drop("chosen")


def rank_by_length(df: DataFrame, length: Column, row_id: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Position by falling length within each side, then by id."""
    keyed = df.withColumn("_length", length.cast("long")).withColumn(
        "_prefix", F.substring(F.col(row_id).cast("string"), 1, 8)
    )
    return index_rows(
        keyed,
        [F.desc("_length"), F.col(row_id).cast("string")],
        [-F.col("_length"), F.col("_prefix")],
        partition_by,
        "position",
    ).drop("_length", "_prefix")
