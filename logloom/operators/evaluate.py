"""Thresholds, confusion counts, ensembles and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNALS = ("logkey", "time", "hypersphere")


def signal_flags(theta, use: Sequence[str] = ("logkey",)) -> dict[str, Column]:
    """One flag per signal; counters must exceed ``masked·theta``, signals not in use are false."""
    limit = F.col("masked_tokens") * (theta if isinstance(theta, Column) else F.lit(float(theta)))
    off = F.lit(False)
    return {
        "logkey": F.col("undetected_tokens") > limit if "logkey" in use else off,
        "time": F.col("num_error") > limit if "time" in use else off,
        "hypersphere": F.col("deepSVDD_label") > 0 if "hypersphere" in use else off,
    }


def any_signal(flags: dict[str, Column]) -> Column:
    return flags["logkey"] | flags["time"] | flags["hypersphere"]


def flag_sequences(counters: DataFrame, theta: float, use: Sequence[str] = ("logkey",)) -> DataFrame:
    return counters.withColumn("anomaly", any_signal(signal_flags(theta, use)).cast("int"))


def thresholds(start: float = 0.0, end: float = 1.0, step: float = 0.1) -> list[float]:
    """``start + i·step`` up to ``end``."""
    n = int((end + 1e-8 - start) / step) + 1
    return [start + i * step for i in range(n)]


def rates(counts: DataFrame) -> DataFrame:
    """P, R, F1, TPR and FPR in percent from FP, TP, TN, FN; an empty denominator gives 0."""
    part = lambda top, bottom: F.when(bottom != 0, 100 * top / bottom).otherwise(F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("TP", "FP", "TN", "FN"))
    with_pr = counts.withColumn("P", part(tp, tp + fp)).withColumn("R", part(tp, tp + fn))
    p, r = F.col("P"), F.col("R")
    return (
        with_pr.withColumn("F1", F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
        .withColumn("TPR", part(tp, fn + tp))
        .withColumn("FPR", part(fp, tn + fp))
    )


def sweep(
    counters: DataFrame, thetas: Sequence[float], flag, keys: Sequence[str] = (), label: str = "label"
) -> DataFrame:
    """Confusion counts per threshold.  ``flag(theta)`` marks a row as anomalous.

    All thresholds are summed in one pass; rows are not copied per threshold.
    """
    one = F.lit(1).cast("long")
    normal, abnormal = F.col(label) == 0, F.col(label) == 1
    sums = [F.count_if(normal).alias("_normal"), F.count_if(abnormal).alias("_abnormal")]
    for i, theta in enumerate(thetas):
        hit = flag(theta)
        sums.append(F.count_if(hit & normal).alias(f"_fp{i}"))
        sums.append(F.count_if(hit & abnormal).alias(f"_tp{i}"))
    found = counters.groupBy(*keys).agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("theta"), F.col(f"_fp{i}").alias("FP"), F.col(f"_tp{i}").alias("TP")
            )
            for i, t in enumerate(thetas)
        ]
    )
    return found.select(*keys, "_normal", "_abnormal", F.explode(rows).alias("r")).select(
        *keys,
        "r.theta",
        "r.FP",
        "r.TP",
        (F.col("_normal") - F.col("r.FP")).alias("TN"),
        (F.col("_abnormal") - F.col("r.TP")).alias("FN"),
    )


def threshold_sweep(
    counters: DataFrame,
    thetas: Sequence[float] | None = None,
    use: Sequence[str] = ("logkey",),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Every rate at every threshold."""
    grid = thresholds() if thetas is None else thetas
    return rates(sweep(counters, grid, lambda t: any_signal(signal_flags(t, use)), keys))


def binary_metrics(pairs: DataFrame, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """Precision, recall and F1 in percent, guarded by 1e-8 and rounded half to even at 4 digits.

    F1 is null when nothing was found.
    """
    p, y = F.col(predicted) == 1, F.col(actual) == 1
    sums = pairs.agg(F.count_if(p & y).alias("TP"), F.count_if(p & ~y).alias("FP"), F.count_if(~p & y).alias("FN"))
    precision = 100 * F.col("TP") / (F.col("TP") + F.col("FP") + F.lit(1e-8))
    recall = 100 * F.col("TP") / (F.col("TP") + F.col("FN") + F.lit(1e-8))
    both = sums.withColumn("_p", precision).withColumn("_r", recall)
    f1 = F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r")))
    return both.select(
        F.bround("_p", 4).alias("precision"), F.bround("_r", 4).alias("recall"), F.bround(f1, 4).alias("f1")
    )


def best_threshold(
    counters: DataFrame, thetas: Sequence[float] = tuple(range(10)), errors: str = "undetected_tokens"
) -> DataFrame:
    """The threshold on an absolute error count with the best F1; ones that find nothing are
    skipped and the first of equals wins."""
    table = rates(sweep(counters, thetas, lambda t: F.col(errors) > F.lit(float(t))))
    found = table.filter("TP > 0 AND F1 > 0").agg(
        F.max_by(F.struct("theta", "FP", "TP", "TN", "FN", "P", "R", "F1"), F.struct(F.col("F1"), -F.col("theta"))).alias("b")
    )
    return found.filter(F.col("b").isNotNull()).select("b.*")


def session_rollup(windows: DataFrame, key: str = "session_id") -> DataFrame:
    """Window accuracy, and accuracy, F1, recall and precision of sessions.

    ``windows`` has m, missed and right counts and a label; a session is anomalous when any of its
    windows is, and likewise for the label.
    """
    sessions = windows.groupBy(key).agg(
        F.max((F.col("missed") > 0).cast("int")).alias("predicted"),
        F.max((F.col("label") > 0).cast("int")).alias("actual"),
        F.sum("windows").alias("windows"),
        F.sum("right").alias("right"),
    )
    p, y = F.col("predicted") == 1, F.col("actual") == 1
    sums = sessions.agg(
        F.count_if(p & y).alias("tp"),
        F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & y).alias("fn"),
        F.count(F.lit(1)).alias("n"),
        F.sum("windows").alias("windows"),
        F.sum("right").alias("right"),
    )
    part = lambda top, bottom: F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "n"))
    return sums.select(
        part(F.col("right"), F.col("windows")).alias("window_acc"),
        part(n - fp - fn, n).alias("session_acc"),
        part(2 * tp, 2 * tp + fp + fn).alias("f1"),
        part(tp, tp + fn).alias("recall"),
        part(tp, tp + fp).alias("precision"),
    )


def leaderboard(results: DataFrame, keys: Sequence[str], order: str = "row") -> DataFrame:
    """The row with the best F1 of each group, the first one on ties."""
    names = [c for c in results.columns if c not in keys]
    best = F.max_by(F.struct(*names), F.struct(F.col("F1"), -F.col(order)))
    return results.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def ensemble_and(a: DataFrame, b: DataFrame, theta: float, use: Sequence[str] = ("logkey",), key: str = "seq_id") -> DataFrame:
    """A sequence is anomalous when both models raise the same signal."""
    flags = lambda df, side: df.select(key, *[f.alias(f"{s}_{side}") for s, f in signal_flags(theta, use).items()])
    both = flags(a, "a").join(flags(b, "b"), key)
    agreed = {s: F.col(f"{s}_a") & F.col(f"{s}_b") for s in SIGNALS}
    return both.select(key, any_signal(agreed).cast("int").alias("anomaly"))


def ensemble_vote(
    models: Sequence[DataFrame], theta: float, votes: int = 0, use: Sequence[str] = ("logkey",), key: str = "seq_id"
) -> DataFrame:
    """A sequence is anomalous when more than ``votes`` models raise one signal (0: any of them)."""
    ballots = None
    for df in models:
        mine = df.select(key, *[f.cast("int").alias(s) for s, f in signal_flags(theta, use).items()])
        ballots = mine if ballots is None else ballots.unionByName(mine)
    summed = ballots.groupBy(key).agg(*[F.sum(s).alias(s) for s in SIGNALS])
    passed = {s: F.col(s) > votes for s in SIGNALS}
    return summed.select(key, any_signal(passed).cast("int").alias("anomaly"))


def supervised_threshold(scores: DataFrame, cut: float = 0.2, score: str = "score", label: str = "label") -> DataFrame:
    """Confusion counts and rates of ``score < cut`` as the anomaly rule."""
    p, y = F.col(score) < cut, F.col(label) == 1
    counts = scores.agg(
        F.count_if(p & ~y).alias("FP"),
        F.count_if(p & y).alias("TP"),
        F.count_if(~p & ~y).alias("TN"),
        F.count_if(~p & y).alias("FN"),
    )
    return rates(counts).select("FP", "TP", "TN", "FN", "P", "R", "F1")


def best_epoch(log: DataFrame, monitor: str, patience: int, mode: str = "min", keys: Sequence[str] = ("run",)) -> DataFrame:
    """Best and last epoch of recorded training logs under early stopping.

    The score to beat starts at 100 (min) or 0 (max); a run stops after ``patience`` epochs in a row
    without a better one.
    """
    if mode not in ("min", "max"):
        raise ValueError("mode must be 'min' or 'max'")
    run = Window.partitionBy(*keys).orderBy("epoch")
    before, upto = run.rowsBetween(Window.unboundedPreceding, -1), run.rowsBetween(Window.unboundedPreceding, 0)
    score = F.when(~F.isnan(monitor), F.col(monitor))
    if mode == "min":
        better = score < F.least(F.lit(100.0), F.coalesce(F.min(score).over(before), F.lit(100.0)))
    else:
        better = score > F.greatest(F.lit(0.0), F.coalesce(F.max(score).over(before), F.lit(0.0)))
    marked = (
        log.withColumn("_better", F.coalesce(better, F.lit(False)))
        .withColumn("_n", F.row_number().over(run))
        .withColumn("_at", F.coalesce(F.max(F.when(F.col("_better"), F.col("_n"))).over(upto), F.lit(0)))
        .withColumn("_stop", F.col("_n") - F.col("_at") >= patience)
        .withColumn("_over", F.coalesce(F.max(F.col("_stop").cast("int")).over(before), F.lit(0)))
    )
    lived = marked.filter("_over = 0")
    return lived.groupBy(*keys).agg(
        F.max(F.when(F.col("_better"), F.col("epoch"))).alias("best_epoch"),
        F.max_by(F.col(monitor), F.when(F.col("_better"), F.col("epoch"))).alias("best_score"),
        F.max("epoch").alias("last_epoch"),
    )
