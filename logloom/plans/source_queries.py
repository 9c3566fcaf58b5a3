"""Sources, sinks and row-level expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text
from logloom.functions.order import index_rows, line_block
from logloom.operators import profile
from logloom.operators import vocab as vocabulary
from logloom.operators.windows import window_arrays
from logloom.plans import views
from logloom.plans.registry import query, with_views
from logloom.plans.window_queries import joined, micros
from logloom.session import new_path, written
from logloom.sources import logs, sequences, xml

_XML_FIELDS = """, x AS (
  SELECT event_id, user_id, event_type, ts_us, CAST(floor(value) AS BIGINT) AS n,
         strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S.%f') AS made,
         4600 + CAST(floor(value / 25) AS BIGINT) AS eid FROM log_v)"""
_XML_CONTENT = """'User=' || user_id || '|Kind=' || event_type
  || CASE WHEN event_type = 'error' THEN '|Status=0x' || to_hex(n) ELSE '' END"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.xml_view(spark, sf_dir).select("event_id", xml.parse_event("xml").alias("event"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xml.event_fields(_events(spark, sf_dir))


@query(
    "s1_xml_events",
    with_views(
        views.LOG,
        _XML_FIELDS + f"""
        SELECT event_id, 'App' AS provider, '{{' || event_type || '}}' AS guid, CAST(eid AS VARCHAR) AS eid,
          made AS created, CAST(event_id AS VARCHAR) AS record, 'Security' AS channel, 'node' || (user_id % 16) AS computer,
          CASE WHEN user_id % 2 = 0 THEN 'S-' || user_id END AS sid, CAST(user_id AS VARCHAR) AS usr, event_type AS kind,
          CASE WHEN event_type = 'error' THEN '0x' || to_hex(n) END AS status, {_XML_CONTENT} AS content,
          CASE WHEN event_id % 3 = 0 THEN CAST(ts_us AS VARCHAR) END AS raw_time,
          CASE WHEN event_id % 3 = 0 THEN CAST(user_id % 5 AS VARCHAR) END AS session,
          CASE WHEN event_id % 3 = 0 THEN 'R&D <' || event_id || '>' END AS extra,
          CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END
            + CASE WHEN event_id % 3 = 0 THEN 4 ELSE 0 END + 10 AS n_fields
        FROM x""",
    ),
)
def s1_xml_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("fields")
    return _records(spark, sf_dir).select(
        "event_id",
        f["Provider_Name"].alias("provider"),
        f["Provider_Guid"].alias("guid"),
        f["EventID"].alias("eid"),
        f["TimeCreated_SystemTime"].alias("created"),
        f["EventRecordID"].alias("record"),
        f["Channel"].alias("channel"),
        f["Computer"].alias("computer"),
        f["Security_UserID"].alias("sid"),
        f["User"].alias("usr"),
        f["Kind"].alias("kind"),
        f["Status"].alias("status"),
        f["Content"].alias("content"),
        f["TimeCreated_RawTime"].alias("raw_time"),
        f["Execution_SessionID"].alias("session"),
        f["Extra"].alias("extra"),
        F.size("fields").alias("n_fields"),
    )


@query(
    "s1_xml_files",
    with_views(
        views.LOG,
        _XML_FIELDS + f"""SELECT CAST(event_id AS VARCHAR) AS record, CAST(eid AS VARCHAR) AS eid, {_XML_CONTENT} AS content FROM x""",
    ),
)
def s1_xml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "xml")
    views.xml_view(spark, sf_dir).select("xml").write.text(path)
    f = F.col("fields")
    return xml.event_fields(xml.read_event_files(spark, path)).select(
        f["EventRecordID"].alias("record"), f["EventID"].alias("eid"), f["Content"].alias("content")
    )


@query(
    "s1b_channel_in_content",
    with_views(
        views.LOG,
        _XML_FIELDS + f"""
        SELECT event_id, 'Channel=Security;' || replace({_XML_CONTENT}, '|', ';') AS content,
               CASE WHEN user_id % 2 = 0 THEN 8 ELSE 7 END + CASE WHEN event_id % 3 = 0 THEN 4 ELSE 0 END AS n_fields FROM x""",
    ),
)
def s1b_channel_in_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = xml.event_fields_channel_in_content(_events(spark, sf_dir))
    return rows.select("event_id", F.col("fields")["Content"].alias("content"), F.size("fields").alias("n_fields"))


_FIELD_NAMES = """SELECT field FROM (VALUES ('Provider_Name'), ('Provider_Guid'), ('EventID'), ('TimeCreated_SystemTime'),
  ('EventRecordID'), ('Channel'), ('Computer'), ('User'), ('Kind'), ('Content')) v(field)
  WHERE EXISTS (SELECT 1 FROM log_v)"""


@query("s2_common_fields", with_views(views.LOG, _FIELD_NAMES))
def s2_common_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xml.field_names(_records(spark, sf_dir))


@query(
    "s2_all_fields",
    with_views(
        views.LOG,
        _FIELD_NAMES + """
        UNION SELECT 'Security_UserID' FROM log_v WHERE user_id % 2 = 0
        UNION SELECT 'Status' FROM log_v WHERE event_type = 'error'
        UNION SELECT unnest(['TimeCreated_RawTime', 'Execution_ProcessID', 'Execution_SessionID', 'Extra']) FROM log_v WHERE event_id % 3 = 0""",
    ),
)
def s2_all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xml.field_names(_records(spark, sf_dir), common=False)


@query(
    "s2_common_table",
    with_views(
        views.LOG,
        _XML_FIELDS + f"""SELECT event_id, CAST(eid AS VARCHAR) AS "EventID", event_type AS "Kind", {_XML_CONTENT} AS "Content" FROM x""",
    ),
)
def s2_common_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xml.common_table(_records(spark, sf_dir)).select("event_id", "EventID", "Kind", "Content")


@query(
    "s3_every_nth",
    with_views(views.LOG, "SELECT line, event FROM log_v WHERE (line - 1) % 100 = 0 ORDER BY line LIMIT 50"),
)
def s3_every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.every_nth(views.log_view(spark, sf_dir), 100, 50).select("line", "event")


@query(
    "s4_log_csv",
    with_views(views.TEXT, 'SELECT line, event_id AS "EventRecordID", content AS "Content" FROM text_v'),
)
def s4_log_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv")
    rows = views.text_view(spark, sf_dir).sort("line")
    rows.select(F.col("event_id").alias("EventRecordID"), F.col("content").alias("Content")).write.option(
        "header", True
    ).csv(path)
    return logs.read_log_csv(spark, path, "EventRecordID long, Content string")


@query(
    "s5_log_format",
    with_views(
        views.TEXT,
        """SELECT row_number() OVER (ORDER BY line) AS "LineId", split_part(raw, ' ', 1) AS "Label",
             split_part(raw, ' ', 2) AS "Date", split_part(raw, ' ', 3) AS "Time", split_part(raw, ' ', 4) AS "Host",
             event_type AS "Component", content AS "Content"
        FROM text_v WHERE raw <> '-- mark --'""",
    ),
)
def s5_log_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.text_view(spark, sf_dir)
    return logs.parse_log_format(rows, "<Label> <Date> <Time> <Host> <Component>: <Content>")


@query(
    "s6_split_columns",
    with_views(
        views.TEXT,
        """, p AS (SELECT line, string_split(raw, ' ') AS a FROM text_v)
        SELECT line, a[1] AS label, a[2] AS day, a[3] AS hour,
               COALESCE(a[4], '') AS host, a[5] AS component, array_to_string(a[6:], ' ') AS content
        FROM p WHERE len(a) >= 6
        UNION ALL SELECT line, a[1], a[2], a[3], '', NULL, NULL FROM p WHERE len(a) = 3""",
    ),
)
def s6_split_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["label", "day", "hour", "host", "component", "content"]
    return logs.split_columns(views.text_view(spark, sf_dir), names)


@query(
    "s7_read_annotations",
    with_views(
        views.LOG,
        """SELECT CASE WHEN user_id % 2 = 0 THEN 'Sec' ELSE 'App' END AS "Channel", event_id AS "EventRecordID"
        FROM log_v WHERE label_flag = 1""",
    ),
)
def s7_read_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "annotations")
    views.log_view(spark, sf_dir).filter("label_flag = 1").select(
        F.when(F.col("user_id") % 2 == 0, "Sec").otherwise("App").alias("Channel"),
        F.col("event_id").alias("EventRecordID"),
    ).write.option("header", True).csv(path)
    return logs.read_annotations(spark, path, "Channel string, EventRecordID long")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_arrays(views.window_rows(spark, sf_dir), ["seq_id"])


_LINES = views.WINDOWS + """,
line_v AS (SELECT seq_id, string_agg(event || ',' || CAST(dt_us AS VARCHAR) || ' ', '' ORDER BY pos) AS line
           FROM win_v GROUP BY seq_id)"""


@query("s9_sequence_line", with_views(_LINES, "SELECT seq_id, line FROM line_v"))
def s9_sequence_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("dts", F.transform("dts", micros))
    return rows.select("seq_id", sequences.sequence_line(["events", "dts"]).alias("line"))


@query(
    "s8_read_sequence_file",
    with_views(_LINES, "SELECT line, count(*) AS copies FROM line_v GROUP BY line"),
)
def s8_read_sequence_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "sequences")
    sequences.write_sequence_file(_lines(spark, sf_dir), ["events", "dts"], path)
    tokens = sequences.read_sequence_file(spark, path)
    again = F.concat(
        F.array_join(
            F.transform("tokens", lambda k: F.concat_ws(",", k["event"], micros(k["dt"]).cast("string"))), " "
        ),
        F.lit(" "),
    )
    return tokens.select(again.alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "s10_structured_log",
    with_views(
        views.LOG,
        """SELECT substr(md5(event_type), 1, 8) AS "EventId", event_type AS "EventTemplate",
             (SELECT count(*) FROM log_v b WHERE b.event_type = a.event_type) AS "Occurrences", count(*) AS rows
        FROM log_v a GROUP BY event_type""",
    ),
)
def s10_structured_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "structured")
    log = views.log_view(spark, sf_dir).select("line", F.col("event_type").alias("EventTemplate"))
    structured = log.withColumn("EventId", text.template_id("EventTemplate"))
    logs.write_structured(structured, profile.template_catalogue(structured), folder, "log")
    catalogue = spark.read.parquet(f"{folder}/log_templates")
    counts = spark.read.parquet(f"{folder}/log_structured").groupBy("EventId").agg(F.count(F.lit(1)).alias("rows"))
    return catalogue.join(counts, "EventId").select("EventId", "EventTemplate", "Occurrences", "rows")


@query(
    "s11_head_sample",
    with_views(
        views.TEXT,
        """SELECT count(*) AS rows, CAST(sum(CASE WHEN split_part(raw, ' ', 1) <> '-' THEN 1 ELSE 0 END) AS BIGINT) AS alerts,
             round(sum(CASE WHEN split_part(raw, ' ', 1) <> '-' THEN 1 ELSE 0 END) / count(*), 9) AS rate
        FROM (SELECT * FROM text_v ORDER BY line LIMIT 500)""",
    ),
)
def s11_head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = logs.head_sample(views.text_view(spark, sf_dir), 500)
    first = F.split("raw", " ")[0]
    return logs.abnormal_rate(head, first).withColumn("rate", F.round("rate", 9))


@query(
    "s11_tail_rows",
    with_views(views.LOG, "SELECT line, event FROM log_v ORDER BY line DESC LIMIT 5000"),
)
def s11_tail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.tail_rows(views.log_view(spark, sf_dir), 5000).select("line", "event")


@query(
    "s13_integrate_projects",
    with_views(
        views.LOG,
        """SELECT line, event, value, 'T1105' AS project FROM log_v WHERE "Label" = 'anomaly' OR user_id % 4 = 0
        UNION ALL SELECT line, event, NULL, 'T1105_C' FROM log_v WHERE NOT ("Label" = 'anomaly' OR user_id % 4 = 0)""",
    ),
)
def s13_integrate_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir)
    mine = (F.col("Label") == "anomaly") | (F.col("user_id") % 4 == 0)
    return logs.integrate_projects(
        {
            "T1105": log.filter(mine).select("line", "event", "value"),
            "T1105_C": log.filter(~mine).select("line", "event"),
        }
    )


@query(
    "p1_drop_null_content",
    with_views(views.LOG, "SELECT line, NULLIF(event_type, 'view') AS \"Content\" FROM log_v WHERE event_type <> 'view'"),
)
def p1_drop_null_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir).select("line", F.nullif("event_type", F.lit("view")).alias("Content"))
    return log.dropna(subset=["Content"])


@query(
    "p2_mask_windows",
    with_views(
        views.TEXT,
        r"""SELECT line, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content,
             '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}', '<*>', 'g'), '\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}', '<*>', 'g'),
             '0x[0-9a-fA-F]+', '<*>', 'g'), '\b\d+\b', '<*>', 'g'), '=[^|]+', '=<*>', 'g') AS masked FROM text_v""",
    ),
)
def p2_mask_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.text_view(spark, sf_dir).select("line", text.mask_content("content").alias("masked"))


@query(
    "p2_mask_bgl",
    with_views(
        views.TEXT,
        r"""SELECT line, regexp_replace(regexp_replace(regexp_replace(message, '(0x)[0-9a-fA-F]+', '<*>', 'g'),
             '\d+.\d+.\d+.\d+', '<*>', 'g'), '\d+', '<*>', 'g') AS masked FROM text_v""",
    ),
)
def p2_mask_bgl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.text_view(spark, sf_dir).select(
        "line", text.mask_content("message", text.MASKS["bgl"]).alias("masked")
    )


@query(
    "p2_mask_hdfs",
    with_views(
        views.TEXT,
        r"""SELECT line, regexp_replace(regexp_replace(regexp_replace(message, 'blk_[-\d]+', 'blk_<*>', 'g'),
             '\d+\.\d+\.\d+\.\d+', '<*>', 'g'), '(/[-\w]+)+', '<*>', 'g') AS masked FROM text_v""",
    ),
)
def p2_mask_hdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.text_view(spark, sf_dir).select(
        "line", text.mask_content("message", text.MASKS["hdfs_drain"]).alias("masked")
    )


@query(
    "p2_mask_documents",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '0x[0-9a-fA-F]+', '<*>', 'g'), '[0-9]+', '<*>', 'g')) AS masked
    FROM documents""",
)
def p2_mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = text.mask_content("text", [r"0x[0-9a-fA-F]+", r"[0-9]+"])
    return views.table(spark, sf_dir, "documents").select("doc_id", F.md5(masked).alias("masked"))


@query(
    "p3_tokenize",
    """SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens
    FROM (SELECT doc_id, [x FOR x IN regexp_split_to_array(text, '\\s+') IF x <> ''] AS t FROM documents)""",
)
def p3_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "documents").select("doc_id", text.tokenize("text").alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query(
    "p3_tokenize_on_punctuation",
    with_views(
        views.TEXT,
        r"""SELECT line, array_to_string([x FOR x IN regexp_split_to_array(content || '; <*> ' || message,
             '[-!"#$%&''()+,./:;=?@\[\]^_`{|}~]') IF trim(x) <> ''], '~') AS tokens FROM text_v""",
    ),
)
def p3_tokenize_on_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("content", F.lit("; <*> "), "message")
    tokens = text.tokenize_on_punctuation(line)
    return views.text_view(spark, sf_dir).select("line", F.array_join(tokens, "~").alias("tokens"))


@query(
    "p4_clean_text",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[\r\n]', '', 'g'), '^\s+|\s+$', '', 'g')) AS cleaned
    FROM documents""",
)
def p4_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text("text")).alias("cleaned"))


@query(
    "p5_drop_leading_channel",
    with_views(
        views.TEXT,
        """SELECT line, CASE event_type WHEN 'error' THEN NULL
             WHEN 'view' THEN 'Channel=Other;' || replace(content, '|', ';') ELSE replace(content, '|', ';') END AS content
        FROM text_v""",
    ),
)
def p5_drop_leading_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.regexp_replace("content", r"\|", ";;")
    kind = F.col("event_type")
    given = (
        F.when(kind == "error", "Channel=Security;;")
        .when(kind == "view", F.concat(F.lit("Channel=Other;"), parts, F.lit(";")))
        .otherwise(F.concat(F.lit("Channel=Security;"), parts))
    )
    return views.text_view(spark, sf_dir).select("line", text.drop_leading_channel(given).alias("content"))


@query(
    "p6_binary_label",
    with_views(
        views.LOG,
        "SELECT line, CASE WHEN NULLIF(event_type, 'view') = 'click' THEN 0 ELSE 1 END AS flag FROM log_v",
    ),
)
def p6_binary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    label = F.when(kind == "click", "-").when(kind != "view", kind)
    return views.log_view(spark, sf_dir).select("line", text.binary_label(label).alias("flag"))


@query(
    "p7_event_time",
    with_views(
        views.LOG,
        """SELECT line, CASE WHEN event_type <> 'view' THEN t END AS windows, t AS bgl, t AS thunderbird, t - 32400 AS timeline
        FROM log_v""",
    ),
)
def p7_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.timestamp_micros("ts_us")
    kind = F.col("event_type")
    mixed = (
        F.when(kind == "view", F.lit("no time"))
        .when(kind == "click", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == "error", F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )
    second = lambda value, name: F.unix_seconds(text.event_time(value, text.TIME_FORMATS[name])).alias(name)
    return views.log_view(spark, sf_dir).select(
        "line",
        second(mixed, "windows"),
        second(F.date_format(ts, "yyyy-MM-dd-HH.mm.ss.SSSSSS"), "bgl"),
        second(F.date_format(ts, "yyyy.MM.dd HH:mm:ss"), "thunderbird"),
        second(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" +09:00")), "timeline"),
    )


@query(
    "p8_pad_time",
    with_views(
        views.LOG,
        """SELECT line, strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S') || '.' ||
               rpad(rtrim(strftime(make_timestamp(ts_us), '%f'), '0'), 6, '0') AS padded, ts_us FROM log_v""",
    ),
)
def p8_pad_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    short = F.regexp_replace(exact, "0+$", "")
    padded = text.pad_time(short)
    return views.log_view(spark, sf_dir).select(
        "line",
        padded.alias("padded"),
        F.unix_micros(text.event_time(padded, text.TIME_FORMATS["windows"][:1])).alias("ts_us"),
    )


@query(
    "p9_date_range",
    with_views(
        views.LOG,
        """SELECT line, event FROM log_v
        WHERE CAST(make_timestamp(ts_us) AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'""",
    ),
)
def p9_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = text.in_date_range(F.timestamp_micros("ts_us"), "2024-01-05", "2024-01-09")
    return views.log_view(spark, sf_dir).filter(kept).select("line", "event")


@query(
    "p10_before_date",
    with_views(views.LOG, "SELECT line, event FROM log_v WHERE make_timestamp(ts_us) < TIMESTAMP '2024-01-12'"),
)
def p10_before_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = text.before_date(F.timestamp_micros("ts_us"), "2024-01-12")
    return views.log_view(spark, sf_dir).filter(kept).select("line", "event")


@query(
    "p11_build_content",
    with_views(
        views.TEXT,
        """SELECT line, 'Channel=' || NULLIF(event_type, 'view') || '|Details=' || content AS built,
               'Content' || content AS prefixed FROM text_v""",
    ),
)
def p11_build_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = F.nullif("event_type", F.lit("view"))
    return views.text_view(spark, sf_dir).select(
        "line",
        text.build_content(channel, "content").alias("built"),
        text.prefixed_content("content").alias("prefixed"),
    )


@query("p12_template_id", with_views(views.TEXT, "SELECT line, substr(md5(message), 1, 8) AS id FROM text_v"))
def p12_template_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.text_view(spark, sf_dir).select("line", text.template_id("message").alias("id"))


@query(
    "p14_block_ids",
    with_views(
        views.TEXT,
        r"SELECT line, unnest(list_distinct(regexp_extract_all(message, 'blk_-?\d+'))) AS block FROM text_v",
    ),
)
def p14_block_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.text_view(spark, sf_dir).select("line", F.explode(text.block_ids("message")).alias("block"))


@query(
    "p15_project_filter",
    with_views(
        views.LOG,
        """SELECT project || CASE WHEN project = 'p3' THEN '_C' ELSE '' END AS project, project = 'p3' AS complement, count(*) AS n
        FROM log_v WHERE project IN ('p1', 'p3') GROUP BY ALL""",
    ),
)
def p15_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = F.when(F.col("project") == "p3", "p3_C").otherwise(F.col("project"))
    log = views.log_view(spark, sf_dir).withColumn("project", tagged)
    picked = log.filter((F.col("project") == "p1") | text.is_complement("project"))
    return picked.groupBy("project", text.is_complement("project").alias("complement")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "p16_event_symbol",
    with_views(
        views.LOG,
        """SELECT line, substr(md5(event_type), 1, 8) AS mined, CAST(4600 + CAST(floor(value / 25) AS BIGINT) AS VARCHAR) AS source
        FROM log_v""",
    ),
)
def p16_event_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined, source = text.template_id("event_type"), 4600 + F.floor(F.col("value") / 25)
    return views.log_view(spark, sf_dir).select(
        "line",
        text.event_symbol(mined, source).alias("mined"),
        text.event_symbol(mined, source, "EventID").alias("source"),
    )


@query(
    "k1_sort_by_time",
    with_views(views.LOG, "SELECT line, row_number() OVER (ORDER BY t // 3600, line) AS place FROM log_v"),
)
def k1_sort_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.col("t") / 3600)
    log = views.log_view(spark, sf_dir).select("line", hour.alias("hour"))
    placed = index_rows(log, [F.col("hour"), F.col("line")], [F.col("hour"), line_block("line")], name="i")
    return placed.select("line", (F.col("i") + 1).alias("place"))


@query(
    "k4_union_all",
    with_views(
        views.LOG,
        """SELECT source, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (
          SELECT 'log' AS source, line AS id FROM log_v UNION ALL SELECT 'doc', doc_id FROM documents
          UNION ALL SELECT 'log', line FROM log_v WHERE "Label" = 'anomaly') GROUP BY source""",
    ),
)
def k4_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir).select(F.lit("log").alias("source"), F.col("line").alias("id"), "Label")
    docs = views.table(spark, sf_dir, "documents").select(F.lit("doc").alias("source"), F.col("doc_id").alias("id"))
    rows = log.drop("Label").unionByName(docs).unionByName(log.filter("Label = 'anomaly'").drop("Label"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(
    "k6_key_intersection",
    with_views(views.LOG, _FIELD_NAMES.replace("field FROM", "field, 'all' AS held_by FROM")),
)
def k6_key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xml.field_names(_records(spark, sf_dir)).withColumn("held_by", F.lit("all"))


@query(
    "a3_label_distribution",
    with_views(
        views.LOG,
        """SELECT "Label", count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM log_v GROUP BY "Label" """,
    ),
)
def a3_label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.label_distribution(views.log_view(spark, sf_dir), "Label").withColumn("share", F.round("share", 9))


@query(
    "a3_anomaly_share",
    """SELECT count(*) AS rows, round(sum(1 - toxic) / count(*), 9) AS normal_share, round(sum(toxic) / count(*), 9) AS anomaly_share
    FROM documents JOIN labels USING (doc_id)""",
)
def a3_anomaly_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id")
    labels = views.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    marked = docs.join(labels, "doc_id").withColumn("mark", F.when(F.col("toxic") == 1, "toxic").otherwise("-"))
    out = profile.normal_anomaly_share(marked, "mark")
    return out.withColumns({c: F.round(c, 9) for c in ("normal_share", "anomaly_share")})


@query(
    "a4_count_anomaly",
    with_views(
        views.TEXT,
        """SELECT count(*) AS rows, CAST(sum(CASE WHEN split_part(raw, ' ', 1) <> '-' THEN 1 ELSE 0 END) AS BIGINT) AS anomalies
        FROM text_v""",
    ),
)
def a4_count_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.count_anomaly(views.text_view(spark, sf_dir))


@query(
    "a5_template_catalogue",
    with_views(
        views.TEXT,
        r"""SELECT regexp_replace(message, '\d+', '<*>', 'g') AS "EventTemplate",
             substr(md5(regexp_replace(message, '\d+', '<*>', 'g')), 1, 8) AS "EventId",
             count(*) AS "Occurrences", min(line) AS first_line FROM text_v GROUP BY 1, 2""",
    ),
)
def a5_template_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = text.mask_content("message", [r"\d+"]).alias("EventTemplate")
    return profile.template_catalogue(views.text_view(spark, sf_dir).select("line", masked))


@query(
    "a6_null_matrix",
    with_views(
        views.LOG,
        """, m AS (SELECT project, NULLIF(event_type, 'view') AS a, CASE WHEN value < 10 THEN NULL ELSE value END AS b FROM log_v)
        SELECT project, "column", nulls FROM (
          SELECT project, 'a' AS "column", count(*) - count(a) AS nulls FROM m GROUP BY project
          UNION ALL SELECT project, 'b', count(*) - count(b) FROM m GROUP BY project
          UNION ALL SELECT project, 'absent', 0 FROM m GROUP BY project
          UNION ALL SELECT project, '__total_rows__', count(*) FROM m GROUP BY project)""",
    ),
)
def a6_null_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir).select(
        "project",
        F.nullif("event_type", F.lit("view")).alias("a"),
        F.when(F.col("value") >= 10, F.col("value")).alias("b"),
    )
    return profile.null_matrix(log, ["a", "b", "absent"])


_NUMBER_LINES = """, lines AS (SELECT line, CASE event_type
    WHEN 'view' THEN CAST(line AS VARCHAR) || ',' || CAST(floor(value * 100) / 4 AS VARCHAR) || ' 1e7'
    WHEN 'click' THEN '' WHEN 'error' THEN CASE WHEN label_flag = 1 THEN 'nan 3' ELSE '-inf' END
    WHEN 'signup' THEN 'x' || line || ' 2,5' ELSE CAST(line % 977 AS VARCHAR) END AS raw FROM log_v),
  parts AS (SELECT line, unnest(string_split(t, ',')) AS p FROM (
    SELECT line, unnest([x FOR x IN string_split(raw, ' ') IF x <> '']) AS t FROM lines)),
  v AS (SELECT line, TRY_CAST(p AS DOUBLE) AS v FROM parts),
  bad AS (SELECT DISTINCT line FROM v WHERE v IS NULL OR isnan(v) OR isinf(v)),
  f AS (SELECT v FROM v WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v))"""


def _number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, line = F.col("event_type"), F.col("line").cast("string")
    raw = (
        F.when(kind == "view", F.concat(line, F.lit(","), (F.floor(F.col("value") * 100) / 4).cast("string"), F.lit(" 1e7")))
        .when(kind == "click", F.lit(""))
        .when(kind == "error", F.when(F.col("label_flag") == 1, "nan 3").otherwise("-inf"))
        .when(kind == "signup", F.concat(F.lit("x"), line, F.lit(" 2,5")))
        .otherwise((F.col("line") % 977).cast("string"))
    )
    return views.log_view(spark, sf_dir).select("line", raw.alias("raw"))


@query(
    "a7_validate_numbers",
    with_views(
        views.LOG,
        _NUMBER_LINES + """
        SELECT (SELECT count(*) FROM lines) AS total_lines,
          (SELECT count(*) FROM lines) - (SELECT count(*) FROM bad) AS valid_lines,
          (SELECT count(*) FROM bad) AS invalid_lines,
          count(v) AS total_values, count(*) FILTER (isnan(v)) AS nan_count, count(*) FILTER (isinf(v)) AS inf_count,
          count(*) FILTER (NOT isnan(v) AND NOT isinf(v) AND abs(v) > 1e6) AS large_value_count,
          count(*) - count(v) AS parse_error_count,
          CASE WHEN (SELECT count(*) FROM bad) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict,
          (SELECT min(v) FROM f) AS min, (SELECT max(v) FROM f) AS max, (SELECT round(avg(v), 4) FROM f) AS mean,
          (SELECT round(stddev_pop(v), 3) FROM f) AS std, (SELECT round(quantile_cont(v, 0.5), 6) FROM f) AS median
        FROM v""",
    ),
)
def a7_validate_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.validate_numbers(_number_lines(spark, sf_dir))
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 3), "median": F.round("median", 6)})


@query(
    "a8_validate_event_gaps",
    with_views(
        views.WINDOWS,
        """, v AS (SELECT seq_id, CASE WHEN event LIKE 'error_1_' THEN NULL WHEN event LIKE 'view_9%' THEN 'nan'::DOUBLE
                    WHEN event LIKE 'click_8%' THEN -1.0 ELSE CAST(dt_us AS DOUBLE) END AS v FROM win_v),
        bad AS (SELECT DISTINCT seq_id FROM v WHERE v IS NULL OR isnan(v)),
        f AS (SELECT v FROM v WHERE v IS NOT NULL AND NOT isnan(v)),
        q AS (SELECT quantile_cont(v, [0.25, 0.5, 0.75, 0.95, 0.99]) AS q, min(v) AS min, max(v) AS max,
                     round(avg(v), 2) AS mean, round(stddev_pop(v), 1) AS std FROM f)
        SELECT (SELECT count(*) FROM seq_v) AS total_lines, (SELECT count(*) FROM seq_v) - (SELECT count(*) FROM bad) AS valid_lines,
          (SELECT count(*) FROM bad) AS invalid_lines, count(v) AS total_pairs, count(*) FILTER (isnan(v)) AS nan_count,
          CAST(0 AS BIGINT) AS inf_count, count(*) FILTER (v < 0) AS negative_count, count(*) FILTER (NOT isnan(v) AND abs(v) > 1e6) AS large_value_count,
          count(*) - count(v) AS parse_error_count,
          CASE WHEN (SELECT count(*) FROM bad) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict,
          any_value(q.min) AS min, any_value(q.max) AS max, any_value(q.mean) AS mean, any_value(q.std) AS std,
          round(any_value(q.q[1]), 4) AS p25, round(any_value(q.q[2]), 4) AS median, round(any_value(q.q[3]), 4) AS p75,
          round(any_value(q.q[4]), 4) AS p95, round(any_value(q.q[5]), 4) AS p99
        FROM v, q""",
    ),
)
def a8_validate_event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = views.window_rows(spark, sf_dir)
    rows = window_arrays(members, ["seq_id"]).withColumn("dts", F.transform("dts", micros))
    token = F.zip_with(
        "events",
        "dts",
        lambda e, d: F.when(e.like("error_1_"), e)
        .when(e.like("view_9%"), F.concat(e, F.lit(",nan")))
        .when(e.like("click_8%"), F.concat(e, F.lit(",-1")))
        .otherwise(F.concat(e, F.lit(","), d.cast("string"))),
    )
    lines = written(rows.select(F.array_join(token, " ").alias("raw")), "lines")
    out = profile.validate_event_gaps(lines)
    places = {"mean": 2, "std": 1, "p25": 4, "median": 4, "p75": 4, "p95": 4, "p99": 4}
    return out.withColumns({c: F.round(c, p) for c, p in places.items()})


@query(
    "a9_pair_id",
    with_views(
        views.LOG,
        """, p AS (SELECT line, NULLIF(event_type, 'view') AS a, CAST(floor(value / 25) AS BIGINT) AS b FROM log_v)
        SELECT line, CASE WHEN a IS NOT NULL THEN dense_rank() OVER (PARTITION BY a IS NULL ORDER BY a, b) END AS pair_id FROM p""",
    ),
)
def a9_pair_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir).select(
        "line", F.nullif("event_type", F.lit("view")).alias("a"), F.floor(F.col("value") / 25).alias("b")
    )
    return profile.pair_id(log, "a", "b").select("line", "pair_id")


@query(
    "a10_value_counts",
    with_views(
        views.LOG,
        "SELECT event, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event) - 1 AS place FROM log_v GROUP BY event",
    ),
)
def a10_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(views.log_view(spark, sf_dir), "event")


@query(
    "s12_vocab_table",
    with_views(
        views.LOG,
        """SELECT event AS token, row_number() OVER (ORDER BY count(*) DESC, event) + 4 AS idx, count(*) AS freq
        FROM log_v GROUP BY event UNION ALL SELECT * FROM (VALUES ('<pad>', 0, 0), ('<unk>', 1, 0), ('<eos>', 2, 0), ('<sos>', 3, 0), ('<mask>', 4, 0))""",
    ),
)
def s12_vocab_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "vocab")
    log = views.log_view(spark, sf_dir).select(F.col("event").alias("token"))
    vocabulary.build_vocab(log).write.parquet(path)
    return spark.read.parquet(path)
