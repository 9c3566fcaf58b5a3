"""Windows and sessions over a log with the columns ``line`` (dense order), ``t`` (epoch seconds),
``event``, ``dt`` (seconds) and ``label`` (0/1).

Windows stay in long form, one row per (window, log row): nothing has to hold a whole window or
session in one value, and counting needs no arrays.  ``window_arrays`` builds the array form.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.order import index_rows, line_block, with_totals


# --- time gaps ---------------------------------------------------------------------------------


def ordered_rows(df: DataFrame, partition_by: Sequence[str] = ("project",), micros: str = "ts_us") -> DataFrame:
    """Add ``row_index`` (place in the project, in file order) and ``dt``: seconds since the row
    before, 0 for the first row.  Gaps never reach across projects, nor does the epoch replace them.
    """
    gap = (F.col(micros) - F.col(f"previous.{micros}")) / F.lit(1e6)
    indexed = index_rows(
        df, [F.col("line")], [line_block("line")], partition_by, previous=[micros]
    )
    return indexed.withColumn("dt", F.coalesce(gap, F.lit(0.0))).drop("previous")


def delta_t(df: DataFrame, partition_by: Sequence[str] = (), micros: str = "ts_us") -> DataFrame:
    return ordered_rows(df, partition_by, micros).drop("row_index")


# --- data-anchored time windows ----------------------------------------------------------------


#: Blocks of seconds that one block of the next level holds.
FAN = 64


def _exits(step: int, length: int):
    """For each second that can open the chain inside a block of ``length``: where the chain leaves it.

    ``leave`` of the input is where the chain goes on after ``entry``, in the block or beyond it.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry", kind="stable")
        entry, leave = pdf["entry"].to_numpy(), pdf["leave"].to_numpy(copy=True)
        follower = np.searchsorted(entry, leave)
        for i in range(len(entry) - 1, -1, -1):
            if follower[i] < len(entry):
                leave[i] = leave[follower[i]]
        can_open = np.searchsorted(entry, key[-1] * length + step) + 1
        return pdf.assign(leave=leave)[:can_open]

    return run


def _followed(pdf: pd.DataFrame, wanted: int) -> pd.DataFrame:
    """The rows that the chain meets from ``wanted`` on."""
    pdf = pdf.sort_values("entry", kind="stable")
    entry, leave = pdf["entry"].to_numpy(), pdf["leave"].to_numpy()
    met, i = [], int(np.searchsorted(entry, wanted))
    while i < len(entry):
        met.append(i)
        i = int(np.searchsorted(entry, leave[i]))
    return pdf.iloc[met]


def _follow_all(pdf: pd.DataFrame) -> pd.DataFrame:
    return _followed(pdf, np.iinfo(np.int64).min)


def _follow_from(pdf: pd.DataFrame, opened: pd.DataFrame) -> pd.DataFrame:
    return _followed(pdf, opened["entry"].iloc[0]) if len(opened) else pdf[:0]


def time_window_starts(
    df: DataFrame, step: int, partition_by: Sequence[str] = ("project",), block_seconds: int | None = None
) -> DataFrame:
    """Starts of data-anchored windows: the first row, then always the first row at or after start+step.

    The chain is sequential, so distinct seconds are cut into blocks of fixed length and these into
    blocks ``FAN`` times as long.  Upwards, every block tells in parallel where the chain would leave
    it for each second at which it could enter (all within ``step`` of its begin).  A partition's
    long blocks, one map each, are walked to get their entries; downwards, every block follows the
    chain from its entry.  Returns the keys, ``start`` and ``first_index``, the ``row_index`` of the
    first row of that second.
    """
    if step <= 0:
        raise ValueError("step must be positive")
    length = block_seconds or max(86_400, 64 * step)
    parts = list(partition_by)
    block = lambda size: F.floor(F.col("entry") / size)
    seconds = (
        df.groupBy(*parts, F.col("t").alias("entry")).agg(F.min("row_index").alias("first_index"))
        .withColumns({"leave": F.col("entry") + step, "block": block(length)})
    )
    by = lambda rows, *keys: rows.groupBy(*parts, *keys)
    short = seconds.drop("first_index")
    exits = by(short, "block").applyInPandas(_exits(step, length), short.schema).withColumn("outer", block(length * FAN))
    far = by(exits, "outer").applyInPandas(_exits(step, length * FAN), exits.schema)
    opened = by(far).applyInPandas(_follow_all, far.schema)
    inner = by(exits, "outer").cogroup(by(opened, "outer")).applyInPandas(_follow_from, exits.schema)
    starts = by(seconds, "block").cogroup(by(inner, "block")).applyInPandas(_follow_from, seconds.schema)
    return starts.select(*parts, F.col("entry").alias("start"), "first_index")


def window_membership(
    df: DataFrame, starts: DataFrame, size: int, partition_by: Sequence[str] = ("project",)
) -> DataFrame:
    """Range join ``start <= t < start+size`` as an equi-join on (keys, t div size)."""
    parts = list(partition_by)
    touched = F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + size - 1) / size))
    spread = starts.withColumn("_slot", F.explode(touched))
    return (
        df.withColumn("_slot", F.floor(F.col("t") / size))
        .join(spread, [*parts, "_slot"])
        .filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + size))
        .drop("_slot")
    )


def time_windows(
    df: DataFrame, size: int, step: int, partition_by: Sequence[str] = ("project",)
) -> DataFrame:
    """Data-anchored sliding windows in long form; trailing partial windows are kept.

    ``pos`` is the place in the window: a window is a run of the project's rows, so it is the
    distance of the row from the window's first row and needs no sort per window.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    rows = df
    if "row_index" not in df.columns:
        rows = index_rows(df, [F.col("line")], [line_block("line")], partition_by)
    starts = time_window_starts(rows, step, partition_by)
    return (
        window_membership(rows, starts, size, partition_by)
        .withColumn("pos", F.col("row_index") - F.col("first_index"))
        .drop("row_index", "first_index")
    )


# --- windows as spans --------------------------------------------------------------------------
#
# A row's ``low`` and ``high`` are the first and last window that holds it.  Rows with the same span
# are in the same windows, so they are summed before anything is copied into windows.


def spread(spans: DataFrame) -> DataFrame:
    """Long form: one row per (window, row)."""
    return spans.withColumn("window", F.explode(F.sequence("low", "high"))).drop("low", "high")


def span_summaries(spans: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """``n, first_line, last_line, label`` of each (keys, window) that holds rows.

    With ``event`` among the keys these are the windows' event counts.  Only sums of rows with the
    same span are copied into windows, never rows.
    """
    sums = lambda n: [n.alias("n"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.max("label").alias("label")]
    named = spans.withColumns({"first_line": F.col("line"), "last_line": F.col("line")})
    return (
        spread(named.groupBy(*keys, "low", "high").agg(*sums(F.count(F.lit(1)))))
        .groupBy(*keys, "window")
        .agg(*sums(F.sum("n")))
    )


# --- count windows -----------------------------------------------------------------------------


def count_spans(
    df: DataFrame, size: int, step: int | None = None, partition_by: Sequence[str] = ("project",)
) -> DataFrame:
    """Spans of windows of exactly ``size`` rows every ``step`` rows; a short tail is dropped."""
    step = size if step is None else step
    if size <= 0 or step <= 0:
        raise ValueError("size and step must be positive")
    parts, blocks = list(partition_by), [line_block("line")]
    indexed = df
    if "row_index" not in df.columns:
        indexed = index_rows(df, [F.col("line")], blocks, parts)
    first = F.greatest(F.lit(0), F.ceil((F.col("row_index") - size + 1) / step))
    last = F.least(F.floor(F.col("row_index") / step), F.floor((F.col("_rows") - size) / step))
    return (
        with_totals(indexed, blocks, parts, {"_rows": (F.lit(1), "count")})
        .filter((F.col("_rows") >= size) & (first <= last))
        .withColumns({"low": first, "high": last})
        .drop("_rows", "row_index")
    )


def count_windows(
    df: DataFrame, size: int, step: int | None = None, partition_by: Sequence[str] = ("project",)
) -> DataFrame:
    """Windows of exactly ``size`` rows every ``step`` rows in long form; a short tail is dropped."""
    return spread(count_spans(df, size, step, partition_by))


# --- grid windows ------------------------------------------------------------------------------


def grid_spans(
    df: DataFrame, size: int, step: int, partition_by: Sequence[str] = ("project",)
) -> DataFrame:
    """Spans of windows on the grid ``t0 + k·step``, also of those that repeat a row range.

    The last k is the first whose end lies beyond the last row.
    """
    edges = {"_t0": (F.col("t"), "min"), "_t1": (F.col("t"), "max")}
    since = F.col("t") - F.col("_t0")
    last_k = F.greatest(F.lit(0), F.ceil((F.col("_t1") - F.col("_t0") - size + 1) / step))
    low = F.greatest(F.lit(0), F.floor((since - size) / step) + 1)
    high = F.least(F.floor(since / step), last_k)
    return (
        with_totals(df, [line_block("line")], list(partition_by), edges)
        .filter(low <= high)
        .withColumns({"low": low, "high": high})
        .drop("_t0", "_t1")
    )


def grid_summaries(spans: DataFrame, partition_by: Sequence[str] = ("project",)) -> DataFrame:
    """Summaries of the grid windows; the first one of each row range stays, empty ones don't occur."""
    parts = list(partition_by)
    return (
        span_summaries(spans, parts)
        .groupBy(*parts, "first_line", "last_line")
        .agg(F.min(F.struct("window", "n", "label")).alias("_w"))
        .select(*parts, "_w.window", "_w.n", "first_line", "last_line", "_w.label")
    )


def grid_windows(
    df: DataFrame, size: int, step: int, partition_by: Sequence[str] = ("project",)
) -> DataFrame:
    """Windows on the grid ``t0 + k·step`` in long form; empty ones and repeats of a row range are dropped."""
    spans = grid_spans(df, size, step, partition_by)
    kept = grid_summaries(spans, partition_by).select(*partition_by, "window")
    return spread(spans).join(kept, [*partition_by, "window"], "left_semi")


def hourly_spans(
    df: DataFrame, size_hours: float, step_hours: float, partition_by: Sequence[str] = ("project",)
) -> tuple[DataFrame, DataFrame]:
    """Sliding windows whose ends move from the last row of window 0: ``(spans, reach)``.

    Window 0 is ``[t0, t0+size)`` and ends at row time ``tl``; window k ≥ 1 holds the rows with
    ``min(t0+k·step, e) <= t < tl+k·step``, where e is the end before it: ``tl+(k-1)·step``, or
    ``t0+size`` for k = 1.  When window 0 holds every row there is none at all.  ``reach`` has one
    row per partition with its last window.
    """
    size, step = int(size_hours * 3600), int(step_hours * 3600)
    parts, blocks = list(partition_by), [line_block("line")]
    timed = with_totals(df, blocks, parts, {"_t0": (F.col("t"), "min"), "_t1": (F.col("t"), "max")})
    timed = timed.filter(F.col("_t1") >= F.col("_t0") + size)
    zero = F.col("t") < F.col("_t0") + size
    ended = with_totals(timed, blocks, parts, {"_tl": (F.when(zero, F.col("t")), "max")})
    last = F.floor((F.col("_t1") - F.col("_tl")) / step) + 1
    reach = ended.groupBy(*parts).agg(F.max(last).alias("last"))
    low_edge = F.least(F.col("_t0"), F.col("_tl") - step)
    low = F.greatest(F.lit(1), F.floor((F.col("t") - F.col("_tl")) / step) + 1)
    low = F.when((low == 1) & (F.col("t") < F.col("_t0") + min(size, step)), 2).otherwise(low)
    high = F.least(last, F.floor((F.col("t") - low_edge) / step))
    none = F.lit(None).cast("struct<low:bigint,high:bigint>")
    span = lambda low, high: F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))
    both = F.array_compact(
        F.array(F.when(zero, span(F.lit(0), F.lit(0))).otherwise(none), F.when(low <= high, span(low, high)).otherwise(none))
    )
    spans = ended.withColumn("_span", F.explode(both)).withColumns({"low": F.col("_span.low"), "high": F.col("_span.high")})
    return spans.drop("_span", "_t0", "_t1", "_tl"), reach


def hourly_windows(
    df: DataFrame, size_hours: float, step_hours: float, partition_by: Sequence[str] = ("project",)
) -> tuple[DataFrame, DataFrame]:
    """``(members, windows)`` of ``hourly_spans``: long form, and label and count of each window.

    Empty windows are rows of ``windows``.
    """
    spans, reach = hourly_spans(df, size_hours, step_hours, partition_by)
    keys = [*partition_by, "window"]
    windows = (
        reach.select(*partition_by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("window"))
        .join(span_summaries(spans, list(partition_by)).select(*keys, "label", "n"), keys, "left")
        .fillna(0, ["label", "n"])
    )
    return spread(spans), windows


# --- what a window holds -----------------------------------------------------------------------


def window_arrays(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arrays of time, event and Δt in row order, label = max, first Δt = 0: one row per window.

    For windows whose size bounds them; sessions of any length stay in long form.
    """
    rows = F.array_sort(F.collect_list(F.struct("line", "t", "event", "dt")))
    gaps = F.transform(
        F.col("_rows"), lambda r, i: F.when(i == 0, F.lit(0.0)).otherwise(r["dt"])
    )
    return (
        members.groupBy(*keys)
        .agg(rows.alias("_rows"), F.max("label").alias("label"))
        .select(
            *keys,
            F.col("_rows.t").alias("timestamps"),
            F.col("_rows.event").alias("events"),
            gaps.alias("dts"),
            "label",
        )
    )


def window_sizes(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Length and label per window, counted map-side."""
    return members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("label").alias("label")
    )


def equivalent_window(
    df: DataFrame, mode: str, size: float, step: float, target: str
) -> DataFrame:
    """Window parameters of the other mode with the same mean sequence length, as one row."""
    if mode == target or {mode, target} != {"time", "fixed"}:
        raise ValueError("modes must be 'time' and 'fixed', and differ")
    rate = F.col("total_events") / F.col("total_duration")
    if mode == "time":
        scaled = lambda v: F.greatest(F.lit(1.0), F.bround(F.lit(float(v)) * rate))
        mean_length = F.lit(float(size)) * rate
    else:
        scaled = lambda v: F.lit(float(v)) * (F.col("total_duration") / F.col("total_events"))
        mean_length = F.lit(float(size))
    spanned = df.agg(
        F.count(F.lit(1)).alias("total_events"),
        (F.max("t") - F.min("t")).cast("double").alias("total_duration"),
    )
    checked = spanned.withColumn(
        "total_duration",
        F.when(F.col("total_duration") > 0, F.col("total_duration")).otherwise(
            F.raise_error(F.lit("the log spans no time")).cast("double")
        ),
    )
    return checked.select(
        "total_events",
        "total_duration",
        rate.alias("avg_event_rate"),
        (F.col("total_duration") / F.col("total_events")).alias("avg_time_per_event"),
        scaled(size).alias("window_size"),
        scaled(step).alias("step_size"),
        mean_length.alias("source_avg_sequence_length"),
    )


# --- sessions ----------------------------------------------------------------------------------


def session_rows(df: DataFrame, ids: Column, key: str = "session_id") -> DataFrame:
    """One row per (row, distinct id the row mentions), with its position in the session."""
    spread = df.withColumn(key, F.explode(F.array_distinct(ids)))
    return index_rows(spread, [F.col("line")], [line_block("line")], [key], "pos")


def context_blocks(df: DataFrame, key: str, back: int, block: int = 100_000) -> DataFrame:
    """Copy each row into the position block of its session and, near the edge, into the next one.

    Within ``(key, block)`` every own row then finds its ``back`` predecessors, although no block
    holds more than ``block + back`` rows of a session of any length.
    """
    own = F.floor(F.col("pos") / block)
    reach = F.floor((F.col("pos") + back) / block)
    return df.withColumn("_block", F.explode(F.sequence(own, reach))).withColumn(
        "_own", F.col("_block") == own
    )


def next_event_windows(df: DataFrame, w: int, key: str = "session_id") -> DataFrame:
    """Pairs of ``w`` consecutive events and the event after them, per session in long form.

    A session of n events has windows at 0 … max(n-w, 0); the last one has the label ``#Pad`` and
    is filled up with ``#Pad`` when the session is shorter than ``w``.
    """
    if w <= 0:
        raise ValueError("w must be positive")
    placed = context_blocks(df.select(key, "pos", "event"), key, w)
    history = (
        Window.partitionBy(key, "_block").orderBy("pos").rowsBetween(-w, -1)
    )
    inner = (
        placed.withColumn("events", F.collect_list("event").over(history))
        .filter(F.col("_own") & (F.col("pos") >= w))
        .select(key, (F.col("pos") - w).alias("start"), "events", F.col("event").alias("next"))
    )
    tail = (
        with_totals(df, [F.floor(F.col("pos") / 100_000)], [key], {"_len": (F.lit(1), "count")})
        .filter(F.col("pos") >= F.col("_len") - w)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "event"))).alias("_rows"), F.max("_len").alias("_len"))
        .select(
            key,
            F.greatest(F.lit(0), F.col("_len") - w).cast("long").alias("start"),
            F.concat(
                F.col("_rows.event"),
                F.array_repeat(F.lit("#Pad"), F.greatest(F.lit(0), w - F.col("_len")).cast("int")),
            ).alias("events"),
            F.lit("#Pad").alias("next"),
        )
    )
    return inner.unionByName(tail)


def chunk_pad(
    df: DataFrame,
    seq_len: int,
    window_size: int | None = None,
    min_len: int = 0,
    events: str = "events",
    dts: str = "dts",
) -> DataFrame:
    """Cut array rows (as read from a sequence file) into padded chunks of ``seq_len``.

    Rows shorter than ``min_len`` go; a row is cut to ``seq_len``; ``window_size`` None means one
    chunk per row.  Pads are the full ``<pad>`` whatever the width of the ids.
    """
    body = df.filter((F.size(events) >= min_len) & (F.size(events) > 0))
    line = F.slice(F.col(events), 1, seq_len)
    gaps = F.transform(
        F.slice(F.col(dts), 1, seq_len), lambda v, i: F.when(i == 0, F.lit(0.0)).otherwise(v)
    )
    width = F.size("_line") if window_size is None else F.lit(int(window_size))
    pad = F.greatest(F.lit(0), F.lit(seq_len) - F.size("_chunk"))
    return (
        body.withColumn("_line", line)
        .withColumn("_gaps", gaps)
        .withColumn("_width", width)
        .withColumn("_at", F.explode(F.sequence(F.lit(0), F.size("_line") - 1, F.col("_width"))))
        .withColumn("_chunk", F.slice("_line", F.col("_at") + 1, F.col("_width")))
        .withColumn("_dchunk", F.slice("_gaps", F.col("_at") + 1, F.col("_width")))
        .withColumn(events, F.slice(F.concat("_chunk", F.array_repeat(F.lit("<pad>"), pad)), 1, seq_len))
        .withColumn(dts, F.slice(F.concat("_dchunk", F.array_repeat(F.lit(0.0), pad)), 1, seq_len))
        .withColumn("chunk", (F.col("_at") / F.col("_width")).cast("int"))
        .drop("_line", "_gaps", "_width", "_at", "_chunk", "_dchunk")
    )
