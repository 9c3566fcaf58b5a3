"""Log-shaped views over the given tables, in Spark and as SQL text for the check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import binary_label
from logloom.operators.splits import ratio_split
from logloom.operators.windows import ordered_rows, time_windows
from logloom.session import written

WINDOW_SECONDS, STEP_SECONDS = 3600, 1200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; times are read as UTC whatever the session had."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log: line, ts_us, t, project, event, value, Label, label."""
    ts = F.col("ts").cast("timestamp")
    bucket = F.floor(F.col("value") / 25).cast("string")
    alert = (F.col("event_type") == "error") & (F.col("value") > 200)
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("line"),
        F.unix_micros(ts).alias("ts_us"),
        F.unix_seconds(ts).alias("t"),
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("project"),
        F.concat_ws("_", "event_type", bucket).alias("event"),
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.when(alert, "anomaly").otherwise("-").alias("Label"),
        alert.cast("int").alias("label_flag"),
    )


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows ready for windows: project, line, row_index, t, event, dt, label (0/1)."""
    log = log_view(spark, sf_dir).withColumn("label", binary_label("Label"))
    return ordered_rows(log.select("project", "line", "ts_us", "t", "event", "label"), ["project"])


def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of the data-anchored hourly windows, one row per (window, log row)."""
    return time_windows(model_rows(spark, sf_dir), WINDOW_SECONDS, STEP_SECONDS).withColumn(
        "seq_id", F.concat_ws(":", "project", F.col("start").cast("string"))
    )


def sequences(members: DataFrame) -> DataFrame:
    """One row per window: length and label."""
    return members.groupBy("seq_id", "project", "start").agg(
        F.count(F.lit(1)).alias("n"), F.max("label").alias("label")
    )


def stored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window rows, the first gap of each window at 0, written once for several readers."""
    gap = F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(F.col("dt"))
    members = window_rows(spark, sf_dir).withColumn("dt", gap)
    return written(
        members.select("seq_id", "project", "start", "pos", "line", "t", "event", "dt", "label"), "windows"
    )


def split_windows(spark: SparkSession, sf_dir: str, ratio: float = 0.6) -> DataFrame:
    """Stored window rows with the split and the label of their sequence."""
    members = stored_windows(spark, sf_dir)
    split = split_sequences(members, ratio).select("seq_id", "split", "label")
    return members.drop("label").join(split, "seq_id")


def split_sequences(members: DataFrame, ratio: float = 0.6, seed: int = 42) -> DataFrame:
    """Ratio split of the windows; the one row per window is written before its three readers."""
    return ratio_split(written(sequences(members), "sequences"), "seq_id", ratio, seed)


def text_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` rendered as raw log lines: ``<Label> <Date> <Time> <Host> <Component>: <Content>``."""
    log = log_view(spark, sf_dir)
    ts = F.timestamp_micros("ts_us")
    uid = F.col("user_id")
    text = lambda c: c.cast("string")
    n = F.floor("value")
    content = F.concat(
        F.lit("user="), text(uid),
        F.lit("|type="), F.col("event_type"),
        F.lit("|ip=10.0."), text(F.floor(uid / 256)), F.lit("."), text(uid % 256),
        F.lit("|code=0x"), F.lower(F.hex(F.col("event_id") % 4096)),
        F.lit("|n="), text(n),
    )
    block = F.concat(F.lit("blk_"), text(uid % 40 - 20))
    other = F.concat(F.lit("blk_"), text(F.col("event_id") % 7))
    message = (
        F.when(F.col("event_type") == "error",
               F.concat(F.lit("Receiving block "), block, F.lit(" src /10.0."), text(F.floor(uid / 256)),
                        F.lit("."), text(uid % 256), F.lit(" failed with code 0x"), F.lower(F.hex(n))))
        .when(F.col("event_type") == "click",
              F.concat(F.lit("Served block "), block, F.lit(" to user"), text(uid), F.lit(" after "), other))
        .when(F.col("event_type") == "view",
              F.concat(F.lit("Verification succeeded for "), block))
        .when(F.col("event_type") == "purchase",
              F.concat(F.lit("Moved "), text(n), F.lit(" bytes from "), block, F.lit(" into "), other,
                       F.lit(" and "), block))
        .otherwise(F.concat(F.lit("session opened for user"), text(uid), F.lit(" in "), text(n), F.lit(" ms")))
    )
    mark = F.when(F.col("label_flag") == 1, "ALERT").otherwise("-")
    raw = F.when(
        (F.col("event_type") == "signup") & (F.col("value") < 1), F.lit("-- mark --")
    ).otherwise(
        F.concat(
            mark, F.lit(" "), F.date_format(ts, "yyyy-MM-dd"), F.lit(" "), F.date_format(ts, "HH:mm:ss"),
            F.lit(" node"), text(uid % 16), F.lit(" "), F.col("event_type"), F.lit(": "), content,
        )
    )
    return log.select("line", "t", "event_id", "event_type", "label_flag", content.alias("content"),
                      message.alias("message"), raw.alias("raw"))


def xml_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as Windows event XML: fields of some events are missing, empty or in attributes, and
    some have elements and attributes that few others have."""
    log = log_view(spark, sf_dir)
    text = lambda c: c.cast("string")
    when = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    security = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('<Security UserID="S-'), text(F.col("user_id")), F.lit('"/>'))).otherwise(
        F.lit("<Security/>")
    )
    bonus = F.when(F.col("event_type") == "error", F.concat(F.lit('<Data Name="Status">0x'), F.hex(F.floor("value")), F.lit("</Data>"))).otherwise(F.lit(""))
    third = F.col("event_id") % 3 == 0
    raw_time = F.when(third, F.concat(F.lit('" RawTime="'), text(F.col("ts_us")))).otherwise(F.lit(""))
    rare = F.when(
        third,
        F.concat(F.lit('<Execution ProcessID="4" SessionID="'), text(F.col("user_id") % 5), F.lit('"/><Extra>R&amp;D &lt;'), text(F.col("event_id")), F.lit("&gt;</Extra>")),
    ).otherwise(F.lit(""))
    xml = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="App" Guid="{'),
        F.col("event_type"), F.lit('}"/><EventID Qualifiers="">'), text(4600 + F.floor(F.col("value") / 25)),
        F.lit('</EventID><TimeCreated SystemTime="'), when, raw_time, F.lit('"/>'), rare,
        F.lit("<EventRecordID>"), text(F.col("event_id")),
        F.lit("</EventRecordID><Channel>Security</Channel><Computer>node"), text(F.col("user_id") % 16),
        F.lit("</Computer>"), security,
        F.lit('</System><EventData><Data Name="User">'), text(F.col("user_id")),
        F.lit('</Data><Data Name="Empty"/><Data Name="Kind"> '), F.col("event_type"), F.lit("\n</Data>"),
        bonus, F.lit("</EventData></Event>"),
    )
    return log.select("event_id", xml.alias("xml"))


def conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as session rows: the symbol is the role and the length class of the text."""
    size = F.least(F.lit(9), F.floor(F.length("text") / 100))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("pos"),
        F.concat_ws("_", "role", size.cast("string")).alias("event"),
    )


def md5_order(seed, column: str) -> str:
    return f"md5('{seed}|' || {column})"


# --- the same views as SQL ---------------------------------------------------------------------

LOG = """
log_v AS (
  SELECT event_id + 1 AS line, epoch_us(ts) AS ts_us, epoch_us(ts) // 1000000 AS t,
         'p' || (user_id % 4) AS project,
         event_type || '_' || CAST(floor(value / 25) AS BIGINT) AS event,
         event_id, user_id, event_type, value,
         CASE WHEN event_type = 'error' AND value > 200 THEN 'anomaly' ELSE '-' END AS "Label",
         CASE WHEN event_type = 'error' AND value > 200 THEN 1 ELSE 0 END AS label_flag
  FROM events)"""

ROWS = LOG + """,
rows_v AS (
  SELECT project, line, t, event, label_flag AS label,
         COALESCE(ts_us - lag(ts_us) OVER (PARTITION BY project ORDER BY line), 0) AS dt_us
  FROM log_v)"""

WINDOWS = ROWS + f""",
secs AS (SELECT DISTINCT project, t FROM rows_v),
follow AS (
  SELECT project, t, min(t) OVER (PARTITION BY project ORDER BY t
           RANGE BETWEEN {STEP_SECONDS} FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM secs),
starts AS (
  SELECT project, min(t) AS start FROM secs GROUP BY project
  UNION ALL
  SELECT s.project, f.nt FROM starts s JOIN follow f ON f.project = s.project AND f.t = s.start
  WHERE f.nt IS NOT NULL),
win_v AS (
  SELECT s.project || ':' || s.start AS seq_id, s.project, s.start, r.line, r.t, r.event, r.label,
         row_number() OVER (PARTITION BY s.project, s.start ORDER BY r.line) - 1 AS pos,
         CASE WHEN row_number() OVER (PARTITION BY s.project, s.start ORDER BY r.line) = 1
              THEN 0 ELSE r.dt_us END AS dt_us
  FROM starts s JOIN rows_v r
    ON r.project = s.project AND r.t >= s.start AND r.t < s.start + {WINDOW_SECONDS}),
seq_v AS (
  SELECT seq_id, project, start, count(*) AS n, max(label) AS label FROM win_v
  GROUP BY seq_id, project, start)"""


def split_sql(ratio: float = 0.6, seed: int = 42, name: str = "split_v", keys: str = "") -> str:
    over = f"PARTITION BY {keys}" if keys else ""
    return WINDOWS + f""",
{name} AS (
  SELECT seq_id, project, start, n, label,
         CASE WHEN label = 1 THEN 'test_abnormal'
              WHEN row_number() OVER (PARTITION BY {keys + ',' if keys else ''} label ORDER BY {md5_order(seed, 'seq_id')}, seq_id)
                   <= floor(count(*) OVER (PARTITION BY {keys + ',' if keys else ''} label) * {ratio}::DOUBLE)
              THEN 'train' ELSE 'test_normal' END AS split
  FROM seq_v)"""


TEXT = LOG + """,
text_v AS (
  SELECT line, t, event_id, event_type, label_flag, content, message,
         CASE WHEN event_type = 'signup' AND value < 1 THEN '-- mark --' ELSE
           CASE WHEN label_flag = 1 THEN 'ALERT' ELSE '-' END
           || strftime(make_timestamp(ts_us), ' %Y-%m-%d %H:%M:%S node') || (user_id % 16)
           || ' ' || event_type || ': ' || content END AS raw
  FROM (
    SELECT *,
      'user=' || user_id || '|type=' || event_type || '|ip=10.0.' || (user_id // 256) || '.' || (user_id % 256)
      || '|code=0x' || lower(to_hex(event_id % 4096)) || '|n=' || CAST(floor(value) AS BIGINT) AS content,
      CASE event_type
        WHEN 'error' THEN 'Receiving block blk_' || (user_id % 40 - 20) || ' src /10.0.' || (user_id // 256)
             || '.' || (user_id % 256) || ' failed with code 0x' || lower(to_hex(CAST(floor(value) AS BIGINT)))
        WHEN 'click' THEN 'Served block blk_' || (user_id % 40 - 20) || ' to user' || user_id
             || ' after blk_' || (event_id % 7)
        WHEN 'view' THEN 'Verification succeeded for blk_' || (user_id % 40 - 20)
        WHEN 'purchase' THEN 'Moved ' || CAST(floor(value) AS BIGINT) || ' bytes from blk_' || (user_id % 40 - 20)
             || ' into blk_' || (event_id % 7) || ' and blk_' || (user_id % 40 - 20)
        ELSE 'session opened for user' || user_id || ' in ' || CAST(floor(value) AS BIGINT) || ' ms' END AS message
    FROM log_v))"""

CONVERSATIONS = """
conv_v AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS pos,
         role || '_' || least(9, length(text) // 100) AS event
  FROM conversations)"""
