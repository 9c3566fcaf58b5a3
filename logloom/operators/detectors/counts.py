"""Count models with back-off: the next event of a history and the event at a masked position.

A sample carries a list of contexts from general to specific.  Training counts (level, context,
target); a test sample uses the most specific context that training has seen, and is missed when its
target is not among the ``k`` most frequent targets there (ties by target).  The empty context is
not a join key: it would be one hot key, so its answer is a scalar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.vocab import SOS

SEPARATOR = " "


def history_contexts(events: str, depth: int) -> list[Column]:
    """Last 1 … ``depth`` events of a history array, as text."""
    return [F.array_join(F.slice(F.col(events), -j, j), SEPARATOR) for j in range(1, depth + 1)]


def neighbour_contexts() -> list[Column]:
    """Nearest visible event before, then also the nearest one after."""
    before, after = F.col("before").cast("string"), F.col("after").cast("string")
    return [before, F.concat_ws(SEPARATOR, before, after)]


def context_counts(samples: DataFrame, contexts: Sequence[Column], target: str) -> DataFrame:
    """``(level, ctx, target, n)`` with level 0 for no context."""
    every = F.array(F.lit(""), *contexts)
    return (
        samples.select(F.posexplode(every).alias("level", "ctx"), F.col(target).alias("target"))
        .groupBy("level", "ctx", "target")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_targets(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent targets per context, and the context's total and variety."""
    place = Window.partitionBy("level", "ctx").orderBy(F.desc("n"), "target")
    ranked = counts.withColumn("_place", F.row_number().over(place))
    best = F.when(F.col("_place") <= k, F.struct("_place", "target"))
    return ranked.groupBy("level", "ctx").agg(
        F.array_sort(F.collect_list(best)).alias("_best"), F.sum("n").alias("total")
    ).select("level", "ctx", F.col("_best.target").alias("top"), "total")


def back_off(samples: DataFrame, contexts: Sequence[Column], tops: DataFrame) -> DataFrame:
    """Most specific known context for each distinct full context: ``(full, level, ctx, top, total)``."""
    full = samples.select(contexts[-1].alias("full"), F.array(*contexts).alias("_all")).dropDuplicates(["full"])
    tried = full.select("full", F.posexplode("_all").alias("_at", "ctx")).withColumn(
        "level", F.col("_at") + 1
    )
    found = tried.join(tops.filter("level > 0"), ["level", "ctx"]).groupBy("full").agg(
        F.max_by(F.struct("level", "ctx", "top", "total"), "level").alias("_hit")
    )
    none = tops.filter("level = 0").select(F.struct("level", "ctx", "top", "total").alias("s"))
    return (
        full.select("full")
        .join(found, "full", "left")
        .select("full", F.coalesce("_hit", none.scalar()).alias("_hit"))
        .select("full", "_hit.*")
    )


def score(
    samples: DataFrame,
    contexts: Sequence[Column],
    target: str,
    counts: DataFrame,
    k: int,
    keys: Sequence[str],
) -> DataFrame:
    """Samples collapsed to ``(keys, full, target, m)``, each with ``missed`` and its probability.

    Equal samples of one key are counted before the joins.  The probability is smoothed by adding
    one to each of the V targets of training.
    """
    tops = top_targets(counts, k)
    packed = (
        samples.groupBy(*keys, contexts[-1].alias("full"), F.col(target).alias("target"))
        .agg(F.count(F.lit(1)).alias("m"))
    )
    known = back_off(samples, contexts, tops)
    variety = counts.filter("level = 0").agg(F.count(F.lit(1)).alias("v")).scalar()
    seen = counts.select("level", "ctx", "target", "n")
    return (
        packed.join(known, "full")
        .join(seen, ["level", "ctx", "target"], "left")
        .withColumn("missed", ~F.array_contains("top", F.col("target")))
        .withColumn("p", (F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + variety))
        .select(*keys, "full", "target", "m", "level", F.element_at("top", 1).alias("best"), "missed", "p")
    )


def session_misses(scored: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Windows, missed windows and windows whose best guess was right, per session."""
    return scored.groupBy(*keys).agg(
        F.sum("m").alias("windows"),
        F.sum(F.when(F.col("missed"), F.col("m")).otherwise(0)).alias("missed"),
        F.sum(F.when(F.col("best") == F.col("target"), F.col("m")).otherwise(0)).alias("right"),
    )


def visible_neighbours(masked: DataFrame, seq: str = "seq_id", chunk: str | None = None) -> DataFrame:
    """Nearest unmasked ids around each masked position, <sos> before the first, 0 after the last.

    ``chunk`` numbers stretches of the model length in a sequence; each is a sample by itself, so a
    long sequence is neither cut nor gathered in one task.
    """
    visible = F.when(F.col("bert_label") == 0, F.col("idx"))
    along = Window.partitionBy(seq, *([chunk] if chunk else [])).orderBy("pos")
    back = along.rowsBetween(Window.unboundedPreceding, -1)
    ahead = along.rowsBetween(1, Window.unboundedFollowing)
    return (
        masked.withColumn("_visible", visible)
        .withColumn("before", F.coalesce(F.last("_visible", True).over(back), F.lit(SOS).cast("long")))
        .withColumn("after", F.coalesce(F.first("_visible", True).over(ahead), F.lit(0).cast("long")))
        .drop("_visible")
        .filter(F.col("bert_label") > 0)
    )


def masked_counters(
    masked: DataFrame, scored: DataFrame, seq: str = "seq_id", chunk: str | None = None
) -> DataFrame:
    """Counters per sequence, summed over its chunks: masked and undetected tokens, keys with an id
    above 0 (the <sos> of each chunk is one), and the time and sphere signals, which this model leaves at 0."""
    samples = F.max(chunk) + 1 if chunk else F.lit(1)
    keys = masked.groupBy(seq).agg(
        (F.sum((F.col("bert_input") > 0).cast("long")) + samples).alias("total_logkey")
    )
    zero = F.lit(0).cast("long")
    found = scored.groupBy(seq).agg(
        F.sum("m").alias("masked_tokens"),
        F.sum(F.when(F.col("missed"), F.col("m")).otherwise(0)).alias("undetected_tokens"),
    )
    return keys.join(found, seq, "left").select(
        seq,
        zero.alias("num_error"),
        F.coalesce("undetected_tokens", zero).alias("undetected_tokens"),
        F.coalesce("masked_tokens", zero).alias("masked_tokens"),
        "total_logkey",
        zero.alias("deepSVDD_label"),
    )


def masked_nll(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean −log p of the true ids over masked positions."""
    return scored.groupBy(*by).agg(
        (F.sum(F.col("m") * -F.log("p")) / F.sum("m")).alias("nll"), F.sum("m").alias("positions")
    )


def weighted_total(batches: DataFrame, biases: dict[str, float], size: str = "n") -> DataFrame:
    """Σ bias·component over batch means, each batch weighted by its size."""
    total = sum((F.col(c) * F.lit(float(b)) for c, b in biases.items()), F.lit(0.0))
    return batches.agg((F.sum(total * F.col(size)) / F.sum(size)).alias("loss"))
