"""Windows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import block_ids
from logloom.operators import profile, windows
from logloom.plans import views
from logloom.plans.registry import query, with_views


def micros(seconds):
    return F.round(seconds * 1e6).cast("long")


def joined(array, transform=lambda v: v.cast("string")):
    return F.array_join(F.transform(array, transform), ",")


@query(
    "w1_delta_t",
    with_views(views.ROWS, "SELECT project, line, event, dt_us FROM rows_v"),
)
def w1_delta_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir).select("project", "line", "event", "ts_us")
    rows = windows.delta_t(log, ["project"])
    return rows.select("project", "line", "event", micros(F.col("dt")).alias("dt_us"))


@query(
    "w2_time_windows",
    with_views(
        views.WINDOWS,
        "SELECT project, start, count(*) AS n, min(line) AS first_line, max(line) AS last_line, "
        "max(label) AS label FROM win_v GROUP BY project, start",
    ),
)
def w2_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = views.window_rows(spark, sf_dir)
    return members.groupBy("project", "start").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("line").alias("first_line"),
        F.max("line").alias("last_line"),
        F.max("label").alias("label"),
    )


@query(
    "w3_count_windows",
    with_views(
        views.ROWS,
        """, numbered AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY line) - 1 AS r,
                         count(*) OVER (PARTITION BY project) AS total FROM rows_v),
        spread AS (SELECT *, unnest(range(greatest(0, CAST(ceil((r - 19) / 8.0) AS BIGINT)),
                                          least(r // 8, CAST(floor((total - 20) / 8.0) AS BIGINT)) + 1)) AS win
                   FROM numbered)
        SELECT project, win AS "window", count(*) AS n, min(line) AS first_line, max(line) AS last_line,
               max(label) AS label FROM spread GROUP BY project, win""",
    ),
)
def w3_count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.span_summaries(windows.count_spans(views.model_rows(spark, sf_dir), 20, 8))


@query(
    "w4_grid_windows",
    with_views(
        views.ROWS,
        """, span AS (SELECT project, min(t) AS t0, max(t) AS t1 FROM rows_v GROUP BY project),
        grid AS (SELECT project, t0,
                        unnest(range(0, greatest(0, CAST(ceil((t1 - t0 - 3600 + 1) / 1200.0) AS BIGINT)) + 1)) AS k
                 FROM span),
        held AS (SELECT g.project, g.k, count(*) AS n, min(line) AS first_line, max(line) AS last_line,
                        max(label) AS label
                 FROM grid g JOIN rows_v r ON r.project = g.project
                  AND r.t >= g.t0 + g.k * 1200 AND r.t < g.t0 + g.k * 1200 + 3600
                 GROUP BY g.project, g.k)
        SELECT project, min(k) AS "window", n, first_line, last_line, label
        FROM held GROUP BY project, n, first_line, last_line, label""",
    ),
)
def w4_grid_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.grid_summaries(windows.grid_spans(views.model_rows(spark, sf_dir), 3600, 1200))


_HOURLY = """, b AS (SELECT project, min(t) AS t0, max(t) AS t1 FROM rows_v GROUP BY project),
c AS (SELECT b.project, t0, t1, max(t) AS tl FROM b JOIN rows_v r ON r.project = b.project AND r.t < t0 + 21600
      GROUP BY b.project, t0, t1 HAVING t1 >= t0 + 21600),
numbered AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY line) - 1 AS r FROM rows_v),
ends AS (SELECT c.project, k,
           (SELECT count(*) FROM rows_v r WHERE r.project = c.project AND r.t < c.tl + k * 3600) AS e,
           (SELECT count(*) FROM rows_v r WHERE r.project = c.project AND r.t < c.t0 + k * 3600) AS s
         FROM (SELECT *, unnest(range(1, (t1 - tl) // 3600 + 2)) AS k FROM c) c),
zero AS (SELECT c.project, 0 AS k,
           (SELECT count(*) FROM rows_v r WHERE r.project = c.project AND r.t < c.t0 + 21600) AS e, 0 AS s FROM c),
both_v AS (SELECT project, k, s, e FROM ends UNION ALL SELECT project, k, s, e FROM zero),
bounds AS (SELECT project, k, e, CASE WHEN k = 0 THEN 0 ELSE least(s, lag(e) OVER (PARTITION BY project ORDER BY k)) END AS s
           FROM both_v)"""


@query(
    "w5_hourly_windows",
    with_views(
        views.ROWS,
        _HOURLY + """
        SELECT b.project, b.k AS "window", count(r.line) AS n, COALESCE(max(r.label), 0) AS label
        FROM bounds b LEFT JOIN numbered r ON r.project = b.project AND r.r >= b.s AND r.r < b.e
        GROUP BY b.project, b.k""",
    ),
)
def w5_hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = windows.hourly_windows(views.model_rows(spark, sf_dir), 6, 1)
    return found.select("project", "window", "n", "label")


@query(
    "w5_hourly_event_counts",
    with_views(
        views.ROWS,
        _HOURLY + """
        SELECT b.project, b.k AS "window", r.event, count(*) AS n
        FROM bounds b JOIN numbered r ON r.project = b.project AND r.r >= b.s AND r.r < b.e
        GROUP BY b.project, b.k, r.event""",
    ),
)
def w5_hourly_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, _ = windows.hourly_spans(views.model_rows(spark, sf_dir), 6, 1)
    return windows.span_summaries(spans, ["project", "event"]).select("project", "window", "event", "n")


@query(
    "w6_window_arrays",
    with_views(
        views.WINDOWS,
        """SELECT project, start, max(label) AS label,
               string_agg(CAST(t AS VARCHAR), ',' ORDER BY pos) AS timestamps,
               string_agg(event, ',' ORDER BY pos) AS events,
               string_agg(CAST(dt_us AS VARCHAR), ',' ORDER BY pos) AS dts
        FROM win_v GROUP BY project, start""",
    ),
)
def w6_window_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = windows.window_arrays(views.window_rows(spark, sf_dir), ["project", "start"])
    return arrays.select(
        "project",
        "start",
        "label",
        joined("timestamps").alias("timestamps"),
        joined("events").alias("events"),
        joined("dts", lambda v: micros(v).cast("string")).alias("dts"),
    )


@query(
    "j7_window_membership",
    with_views(views.WINDOWS, "SELECT project, start, line, event FROM win_v"),
)
def j7_window_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.window_rows(spark, sf_dir).select("project", "start", "line", "event")


_SESSIONS = views.TEXT + """,
sess_v AS (
  SELECT session_id, line, event_type AS event,
         row_number() OVER (PARTITION BY session_id ORDER BY line) - 1 AS pos
  FROM (SELECT line, event_type, unnest(list_distinct(regexp_extract_all(message, 'blk_-?\\d+'))) AS session_id
        FROM text_v))"""


@query(
    "w7_sessions_by_key",
    with_views(_SESSIONS, "SELECT session_id, pos, line, event FROM sess_v"),
)
def w7_sessions_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.text_view(spark, sf_dir).select("line", F.col("event_type").alias("event"), "message")
    return windows.session_rows(rows, block_ids("message")).select("session_id", "pos", "line", "event")


@query(
    "w8_next_event_windows",
    with_views(
        views.CONVERSATIONS,
        """, s AS (SELECT session_id, list(event ORDER BY pos) AS ev, count(*) AS n FROM conv_v GROUP BY session_id),
        w AS (SELECT session_id, ev, n, unnest(range(0, greatest(0, n - 3) + 1)) AS start FROM s)
        SELECT session_id, start,
               array_to_string(list_resize(ev[start + 1 : start + 3], 3, '#Pad'), ',') AS events,
               CASE WHEN start + 3 < n THEN ev[start + 4] ELSE '#Pad' END AS next
        FROM w""",
    ),
)
def w8_next_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = windows.next_event_windows(views.conversation_rows(spark, sf_dir), 3)
    return pairs.select("session_id", "start", F.array_join("events", ",").alias("events"), "next")


@query(
    "w8_next_event_windows_by_block",
    with_views(
        _SESSIONS,
        """, n AS (SELECT session_id, pos, event, count(*) OVER (PARTITION BY session_id) AS len,
                       string_agg(event, ',') OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS before
                  FROM sess_v)
        SELECT session_id, pos - 10 AS start, before AS events, event AS next FROM n WHERE pos >= 10
        UNION ALL
        SELECT session_id, greatest(0, max(len) - 10), 
               string_agg(event, ',' ORDER BY pos) || repeat(',#Pad', CAST(greatest(0, 10 - max(len)) AS INT)), '#Pad'
        FROM n WHERE pos >= len - 10 GROUP BY session_id""",
    ),
)
def w8_next_event_windows_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.text_view(spark, sf_dir).select("line", F.col("event_type").alias("event"), "message")
    sessions = windows.session_rows(rows, block_ids("message"))
    pairs = windows.next_event_windows(sessions, 10)
    return pairs.select("session_id", "start", F.array_join("events", ",").alias("events"), "next")


@query(
    "w9_chunk_pad",
    with_views(
        views.WINDOWS,
        """, a AS (SELECT seq_id, list(event ORDER BY pos)[:12] AS ev, list(dt_us ORDER BY pos)[:12] AS dt
                  FROM win_v GROUP BY seq_id HAVING count(*) >= 2),
        c AS (SELECT *, unnest(range(0, len(ev), 5)) AS i FROM a)
        SELECT seq_id, CAST(i // 5 AS INTEGER) AS chunk,
               array_to_string(list_resize(ev[i + 1 : i + 5], 12, '<pad>'), ',') AS events,
               array_to_string(list_resize(dt[i + 1 : i + 5], 12, 0), ',') AS dts
        FROM c""",
    ),
)
def w9_chunk_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = windows.window_arrays(views.window_rows(spark, sf_dir), ["seq_id"])
    chunks = windows.chunk_pad(arrays, 12, 5, 2)
    return chunks.select(
        "seq_id",
        "chunk",
        joined("events").alias("events"),
        joined("dts", lambda v: micros(v).cast("string")).alias("dts"),
    )


@query(
    "w10_windows_per_project",
    with_views(
        views.ROWS,
        """, numbered AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY line) - 1 AS r,
                          count(*) OVER (PARTITION BY project) AS total FROM rows_v)
        SELECT project, r // 25 AS "window", max(label) AS label, string_agg(event, ',' ORDER BY line) AS events
        FROM numbered WHERE r // 25 < total // 25 GROUP BY project, r // 25""",
    ),
)
def w10_windows_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = windows.count_windows(views.model_rows(spark, sf_dir), 25)
    arrays = windows.window_arrays(members, ["project", "window"])
    return arrays.select("project", "window", "label", joined("events").alias("events"))


_RATE = """SELECT n AS total_events, d AS total_duration, round(n / d, 9) AS avg_event_rate,
 round(d / n, 6) AS avg_time_per_event, {size} AS window_size, {step} AS step_size, {mean} AS source_avg_sequence_length
 FROM (SELECT count(*) AS n, CAST(max(t) - min(t) AS DOUBLE) AS d FROM log_v)"""


def _rate(df: DataFrame) -> DataFrame:
    places = {"avg_event_rate": 9, "avg_time_per_event": 6, "window_size": 6, "step_size": 6, "source_avg_sequence_length": 6}
    return df.withColumns({c: F.round(c, p) for c, p in places.items()})


@query(
    "w11_time_to_count",
    with_views(
        views.LOG,
        _RATE.format(
            size="greatest(1.0, round_even(7200.0 * (n / d), 0))",
            step="greatest(1.0, round_even(1800.0 * (n / d), 0))",
            mean="round(7200.0 * (n / d), 6)",
        ),
    ),
)
def w11_time_to_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rate(windows.equivalent_window(views.log_view(spark, sf_dir), "time", 7200, 1800, "fixed"))


@query(
    "w11_count_to_time",
    with_views(
        views.LOG,
        _RATE.format(
            size="round(40.0 * (d / n), 6)", step="round(10.0 * (d / n), 6)", mean="CAST(40.0 AS DOUBLE)"
        ),
    ),
)
def w11_count_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rate(windows.equivalent_window(views.log_view(spark, sf_dir), "fixed", 40, 10, "time"))


@query(
    "a1_event_counts",
    with_views(views.WINDOWS, "SELECT seq_id, event, count(*) AS n FROM win_v GROUP BY seq_id, event"),
)
def a1_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.event_counts(views.window_rows(spark, sf_dir))


@query(
    "a2_length_stats",
    with_views(
        views.split_sql(),
        """, stats AS (SELECT split, count(*) AS count, avg(n) AS mean, min(n) AS min, max(n) AS max,
                      stddev_samp(n) AS std FROM split_v GROUP BY split)
        SELECT d.split, COALESCE(count, 0) AS count, round(COALESCE(mean, 0), 6) AS mean, COALESCE(min, 0) AS min,
               COALESCE(max, 0) AS max, round(COALESCE(std, 0), 6) AS std
        FROM (VALUES ('train'), ('test_normal'), ('test_abnormal'), ('vocab')) d(split) LEFT JOIN stats USING (split)""",
    ),
)
def a2_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = views.split_sequences(views.window_rows(spark, sf_dir))
    stats = profile.length_stats(split, ["train", "test_normal", "test_abnormal", "vocab"])
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    "k2_sort_by_length",
    with_views(
        views.WINDOWS,
        "SELECT seq_id, n, row_number() OVER (ORDER BY n DESC, seq_id) - 1 AS position FROM seq_v",
    ),
)
def k2_sort_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.operators.splits import rank_by_length

    seqs = views.sequences(views.window_rows(spark, sf_dir))
    return rank_by_length(seqs, F.col("n"), "seq_id").select("seq_id", "n", "position")
