"""Annotation joins, splits and samples."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import annotate, splits
from logloom.plans import views
from logloom.plans.registry import query, with_views
from logloom.plans.views import md5_order
from logloom.session import written


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated records: expensive events, half of them in another channel, some listed twice."""
    log = views.log_view(spark, sf_dir).filter("value > 120")
    rows = log.select(
        F.when(F.col("user_id") % 2 == 0, "Sec").otherwise("App").alias("Channel"),
        F.col("event_id").alias("EventRecordID"),
    )
    return rows.unionByName(rows.filter("Channel = 'Sec'"))


@query(
    "j1_annotate_by_id",
    with_views(
        views.LOG,
        """SELECT event_id AS "EventRecordID", event, CASE WHEN value > 120 AND user_id % 2 = 0 THEN 'anomaly' ELSE '-' END AS "Label"
        FROM log_v""",
    ),
)
def j1_annotate_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir).select(F.col("event_id").alias("EventRecordID"), "event")
    return annotate.annotate_by_id(log, _annotations(spark, sf_dir))


@query(
    "j1_annotate_documents",
    """SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'toxic' ELSE '-' END AS "Label"
    FROM documents""",
)
def j1_annotate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "lang")
    marks = views.table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return annotate.annotate_by_id(docs, marks, "doc_id", channel=None, label="toxic")


@query(
    "j2_annotate_by_line",
    with_views(
        views.LOG,
        """SELECT line, event, CASE WHEN line - 1 IN (SELECT event_id - 2 FROM log_v WHERE value > 150) THEN 'attack' ELSE '-' END AS "Label"
        FROM log_v""",
    ),
)
def j2_annotate_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir).select("line", "event")
    positions = views.log_view(spark, sf_dir).filter("value > 150").select(F.col("event_id").alias("position"))
    return annotate.annotate_by_line(log, positions, "attack", offset=2)


@query(
    "j3_annotate_by_row",
    with_views(
        views.LOG,
        """, r AS (SELECT line, project, event_type, NULLIF(CAST(floor(value / 5) AS BIGINT), 3) AS size FROM log_v),
        e AS (SELECT DISTINCT project, event_type, size FROM r WHERE line IN (SELECT line FROM log_v WHERE value > 100 OR user_id = 7))
        SELECT r.line, CASE WHEN e.project IS NOT NULL THEN 'anomaly' ELSE '-' END AS "Label"
        FROM r LEFT JOIN e ON r.project = e.project AND r.event_type = e.event_type AND r.size = e.size""",
    ),
)
def j3_annotate_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir).withColumn("size", F.nullif(F.floor(F.col("value") / 5), F.lit(3)))
    examples = log.filter("value > 100 OR user_id = 7")
    columns = ["project", "event_type", "size"]
    rows = log.select("line", *columns)
    return annotate.annotate_by_row(rows, examples, columns).select("line", "Label")


@query(
    "j4_label_sessions",
    """SELECT d.doc_id AS session_id, CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 1 ELSE 0 END AS label
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def j4_label_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"))
    labels = views.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("session_id"), F.when(F.col("toxic") == 1, "Anomaly").otherwise("Normal").alias("Label")
    )
    return annotate.label_sessions(docs, labels)


_TRAIN_INDEX = """, idx AS (SELECT event, row_number() OVER (ORDER BY event) AS i FROM
  (SELECT DISTINCT event FROM log_v WHERE value < 100))"""


def _event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of cheap rows only, numbered by name, so that the others are unknown."""
    from logloom.operators.features import event_columns

    seen = views.log_view(spark, sf_dir).filter("value < 100").select("event").distinct()
    return event_columns(seen).select("event", (F.col("col") + 1).alias("idx"))


@query(
    "j5_map_events",
    with_views(
        views.LOG,
        _TRAIN_INDEX + "SELECT line, COALESCE(i, 0) AS zero, COALESCE(i, -1) AS minus FROM log_v LEFT JOIN idx USING (event)",
    ),
)
def j5_map_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir).select("line", "event")
    index = _event_index(spark, sf_dir)
    mapped = annotate.map_events(log, index, 0).withColumnRenamed("idx", "zero")
    again = annotate.map_events(mapped, index, -1)
    return again.select("line", "zero", F.col("idx").alias("minus"))


@query(
    "j5_count_unknown",
    with_views(
        views.LOG,
        _TRAIN_INDEX + "SELECT count(*) AS unknown FROM log_v WHERE event NOT IN (SELECT event FROM idx)",
    ),
)
def j5_count_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir).select("line", "event")
    return annotate.count_unknown(annotate.map_events(log, _event_index(spark, sf_dir)))


@query(
    "j6_exclude_rows",
    with_views(
        views.LOG,
        f"""SELECT line, event FROM log_v WHERE line NOT IN (
          SELECT line FROM log_v ORDER BY {md5_order(42, 'line')}, line LIMIT 3000)""",
    ),
)
def j6_exclude_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir).select("line", "event")
    return annotate.exclude_rows(log, splits.random_n(log, "line", 3000), "line")


@query(
    "k5_difference",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def k5_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return annotate.exclude_rows(docs, views.table(spark, sf_dir, "labels"), "doc_id")


@query(
    "l1_split_by_label",
    with_views(views.WINDOWS, "SELECT CASE WHEN label = 0 THEN 'normal' ELSE 'abnormal' END AS part, seq_id FROM seq_v"),
)
def l1_split_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, abnormal = splits.split_by_label(views.sequences(views.window_rows(spark, sf_dir)))
    tag = lambda df, name: df.select(F.lit(name).alias("part"), "seq_id")
    return tag(normal, "normal").unionByName(tag(abnormal, "abnormal"))


@query("l2_ratio_split", with_views(views.split_sql(0.8), "SELECT seq_id, split, label FROM split_v"))
def l2_ratio_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.split_sequences(views.window_rows(spark, sf_dir), 0.8).select("seq_id", "split", "label")


_INTEGRATED = views.split_sql(0.6, 42, "per_v", "project") + """,
all_v AS (SELECT seq_id, CASE WHEN project = 'p3' THEN 'p3_C' ELSE project END AS project, label,
                 CASE WHEN project = 'p3' THEN 'train' ELSE split END AS split FROM per_v)"""


def _integrated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seqs = views.sequences(views.window_rows(spark, sf_dir)).select("seq_id", "project", "label")
    tagged = seqs.withColumn("project", F.when(F.col("project") == "p3", "p3_C").otherwise(F.col("project")))
    return splits.integrated_split(tagged, "seq_id", 0.6)


@query("l3_integrated_split", with_views(_INTEGRATED, "SELECT seq_id, project, label, split FROM all_v"))
def l3_integrated_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _integrated(spark, sf_dir)[0]


@query(
    "l3_vocab_corpus",
    with_views(views.WINDOWS, "SELECT seq_id, project, label FROM seq_v WHERE label = 0 AND project <> 'p3'"),
)
def l3_vocab_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _integrated(spark, sf_dir)[1]


@query(
    "l4_class_uniform_split",
    with_views(
        views.LOG,
        """SELECT line, label_flag, CASE WHEN row_number() OVER (PARTITION BY label_flag ORDER BY line)
             <= floor(count(*) OVER (PARTITION BY label_flag) * 0.5::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM log_v""",
    ),
)
def l4_class_uniform_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir).select("line", "label_flag")
    return splits.first_share(log, "line", 0.5, ["label_flag"]).select("line", "label_flag", "split")


@query(
    "l4_sequential_split",
    with_views(
        views.LOG,
        """SELECT line, label_flag, CASE WHEN row_number() OVER (ORDER BY line)
             <= floor(count(*) OVER () * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM log_v""",
    ),
)
def l4_sequential_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir).select("line", "label_flag")
    return splits.first_share(log, "line", 0.7).select("line", "label_flag", "split")


@query(
    "l5_mix_abnormal",
    with_views(
        views.split_sql(),
        f""", k AS (SELECT least(count(*) FILTER (split = 'train') // 2,
                        CAST(floor(count(*) FILTER (split = 'test_abnormal') * 0.4::DOUBLE) AS BIGINT)) AS k FROM split_v)
        SELECT seq_id, label, CASE WHEN split = 'test_abnormal' AND row_number() OVER (PARTITION BY split ORDER BY {md5_order(88, 'seq_id')}, seq_id)
              <= (SELECT k FROM k) THEN 'train' ELSE split END AS split FROM split_v""",
    ),
)
def l5_mix_abnormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = written(views.split_sequences(views.window_rows(spark, sf_dir)), "split")
    return splits.mix_abnormal(split, "seq_id").select("seq_id", "label", "split")


# The strata are few and common, so rounding alone decides the allocation here unless it misses the
# target; the mending by +-1 is written out as a recursive query.
_STRATA = """, c AS (SELECT stratum, count(*) AS n FROM rows_s GROUP BY stratum),
a0 AS (SELECT stratum, n, 1 + CAST(round_even(n / sum(n) OVER () * ({target} - count(*) OVER ()), 0) AS BIGINT) AS a,
              row_number() OVER (ORDER BY n DESC, stratum) AS rk, count(*) OVER () AS k FROM c),
turns AS (
  SELECT stratum, rk, u.j, row_number() OVER (ORDER BY u.j, rk) AS turn
  FROM a0, (SELECT unnest(range(1, 200)) AS j) u
  WHERE CASE WHEN (SELECT sum(a) FROM a0) > {target} THEN u.j <= a - 1 ELSE true END),
fix AS (SELECT stratum, count(*) AS moved FROM turns
        WHERE turn <= abs({target} - (SELECT sum(a) FROM a0)) GROUP BY stratum),
alloc AS (SELECT stratum, n, a + COALESCE(moved, 0) * sign({target} - (SELECT sum(a) FROM a0)) AS want
          FROM a0 LEFT JOIN fix USING (stratum))"""

_EVENT_ROWS = views.LOG + ", rows_s AS (SELECT line, NULLIF(event, 'view_0') AS stratum FROM log_v WHERE event <> 'view_0')"


def _picked(seed: int, source: str) -> str:
    return f"""SELECT line, stratum FROM (SELECT r.line, r.stratum, want,
        row_number() OVER (PARTITION BY r.stratum ORDER BY {md5_order(seed, 'line')}, line) AS rn
      FROM {source} r JOIN alloc USING (stratum)) WHERE rn <= want"""


def _stratum_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.log_view(spark, sf_dir).select("line", F.nullif("event", F.lit("view_0")).alias("stratum"))


@query(
    "l6_stratified_sample",
    with_views(_EVENT_ROWS, _STRATA.format(target=333) + _picked(42, "rows_s")),
)
def l6_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_sample(_stratum_rows(spark, sf_dir), "stratum", "line", 333).select("line", "stratum")


@query(
    "l6_allocation",
    with_views(_EVENT_ROWS, _STRATA.format(target=120) + "SELECT stratum, n, CAST(want AS BIGINT) AS alloc FROM alloc"),
)
def l6_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _stratum_rows(spark, sf_dir).dropna().groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    # as its SQL, which also answers where a large log has more than 120 strata
    return splits.allocate_strata(counts, "stratum", 120, strict=False)


_SECOND = (
    _STRATA.format(target=300)
    + ", first_s AS MATERIALIZED ("
    + _picked(42, "rows_s")
    + "), rest_s AS (SELECT * FROM rows_s WHERE line NOT IN (SELECT line FROM first_s))"
)
_AGAIN = _STRATA.format(target=300)
for _name in ("alloc", "turns", "fix", "a0", "c"):
    _AGAIN = re.sub(rf"\b{_name}\b", f"{_name}_2", _AGAIN)
_AGAIN = _AGAIN.replace("rows_s", "rest_s")


@query(
    "l7_two_disjoint_samples",
    with_views(
        _EVENT_ROWS,
        _SECOND + _AGAIN + "SELECT 1 AS draw, line, stratum FROM first_s UNION ALL SELECT 2, line, stratum FROM ("
        + _picked(43, "rest_s").replace("JOIN alloc", "JOIN alloc_2") + ")",
    ),
)
def l7_two_disjoint_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stratum_rows(spark, sf_dir).dropna()
    first, second = splits.two_disjoint_samples(rows, "stratum", "line", 300)
    tag = lambda df, n: df.select(F.lit(n).alias("draw"), "line", "stratum")
    return tag(first, 1).unionByName(tag(second, 2))


@query(
    "l8_random_n",
    with_views(views.LOG, f"SELECT line, event FROM log_v ORDER BY {md5_order(42, 'line')}, line LIMIT 1500"),
)
def l8_random_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_n(views.log_view(spark, sf_dir), "line", 1500).select("line", "event")


@query(
    "l9_train_valid_split",
    with_views(
        views.LOG,
        f""", used AS (SELECT line, event FROM log_v QUALIFY row_number() OVER (ORDER BY line) <= floor(count(*) OVER () * 0.5::DOUBLE)),
        v AS (SELECT line, CASE WHEN row_number() OVER (ORDER BY {md5_order(42, 'line')}, line)
                 <= floor(count(*) OVER () * 0.1::DOUBLE) THEN 'valid' ELSE 'train' END AS split, length(event) AS n FROM used)
        SELECT line, split, row_number() OVER (PARTITION BY split ORDER BY n DESC, CAST(line AS VARCHAR)) - 1 AS position FROM v""",
    ),
)
def l9_train_valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir).select("line", "event")
    split = splits.train_valid_split(log, "line", 0.1, sample_ratio=0.5)
    ranked = splits.rank_by_length(split, F.length("event"), "line", ["split"])
    return ranked.select("line", "split", "position")


@query(
    "l9_validation_share",
    f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {md5_order(7, 'doc_id')}, doc_id)
          <= floor(count(*) OVER () * 0.2::DOUBLE) THEN 'valid' ELSE 'train' END AS split FROM documents""",
)
def l9_validation_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id")
    return splits.train_valid_split(docs, "doc_id", 0.2, seed=7)


@query(
    "l10_reverse_split",
    with_views(
        views.split_sql(),
        """SELECT seq_id, CASE split WHEN 'train' THEN 'test_normal' WHEN 'test_normal' THEN 'train' ELSE split END AS split
        FROM split_v""",
    ),
)
def l10_reverse_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.reverse_split(views.split_sequences(views.window_rows(spark, sf_dir))).select("seq_id", "split")


@query(
    "l11_test_subsample",
    with_views(
        views.split_sql(),
        f"""SELECT seq_id FROM split_v WHERE split = 'test_normal'
        QUALIFY row_number() OVER (ORDER BY {md5_order(5, 'seq_id')}, seq_id) <= floor(count(*) OVER () * 0.3::DOUBLE)""",
    ),
)
def l11_test_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = written(views.split_sequences(views.window_rows(spark, sf_dir)), "split").filter("split = 'test_normal'")
    return splits.subsample(split, "seq_id", 0.3, seed=5).select("seq_id")
