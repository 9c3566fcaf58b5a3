"""Template mining and detectors on count vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text
from logloom.operators import features, templates
from logloom.operators.detectors import cluster, forest, matrix, supervised
from logloom.operators.profile import template_catalogue
from logloom.operators.splits import train_valid_split
from logloom.plans import views
from logloom.plans.registry import query, with_views
from logloom.plans.vocab_queries import COUNTS, sequence_counts
from logloom.session import written


# --- templates ---------------------------------------------------------------------------------

HDFS_MASKED = r"""regexp_replace(regexp_replace(regexp_replace({text}, 'blk_[-\p{{Nd}}]+', 'blk_<*>', 'g'),
  '\p{{Nd}}+\.\p{{Nd}}+\.\p{{Nd}}+\.\p{{Nd}}+', '<*>', 'g'), '(/[-\w]+)+', '<*>', 'g')"""
BGL_MASKED = r"""regexp_replace(regexp_replace(regexp_replace({text}, '(0x)[0-9a-fA-F]+', '<*>', 'g'),
  '\p{{Nd}}+.\p{{Nd}}+.\p{{Nd}}+.\p{{Nd}}+', '<*>', 'g'), '\p{{Nd}}+', '<*>', 'g')"""
#: ``messages`` from ``masked_v (message)``.
MESSAGES = r""",
messages AS (
  SELECT message, list_filter(regexp_split_to_array(message, '\s+'), lambda w: w <> '') AS words
  FROM (SELECT DISTINCT message FROM masked_v WHERE message IS NOT NULL))"""


def shared_sql(threshold: float) -> str:
    """Views over ``cells (message, k, word, support)``: the words of a message and its least support."""
    return f""",
shared AS (
  SELECT message, list(word ORDER BY k) AS ws, list(k ORDER BY k) AS places, list(support ORDER BY k) AS ss,
         COALESCE(list_reverse_sort(list(support))[CAST(greatest(1, ceil(CAST({threshold} AS DOUBLE) * count(*))) AS INT)], 0) AS cut
  FROM cells GROUP BY message)"""


def position_sql(depth: int, threshold: float, max_child: int = 100) -> str:
    """``mapping (message, template)`` of the position miner over ``masked_v (message)``."""
    out = MESSAGES + f""",
leaf0 AS (SELECT *, CAST(len(words) AS VARCHAR) AS leaf FROM messages WHERE len(words) >= {max(1, depth - 2)})"""
    steps = max(0, depth - 3)
    for i in range(steps):
        word = f"words[{i + 1}]"
        out += f""",
branch{i} AS (SELECT *, CASE WHEN regexp_matches({word}, '\\p{{Nd}}') THEN '<*>' ELSE {word} END AS branch FROM leaf{i}),
wide{i} AS (SELECT *, count(*) OVER (PARTITION BY leaf, branch) AS in_branch, count(*) OVER (PARTITION BY leaf) AS in_node FROM branch{i}),
leaf{i + 1} AS (
  SELECT message, words, leaf || ' ' || CASE WHEN in_branch * {max_child} >= in_node THEN COALESCE(branch, '<*>') ELSE '<*>' END AS leaf
  FROM wide{i})"""
    return out + f""",
placed AS (SELECT message, leaf, unnest(range(len(words))) AS k, unnest(words) AS word FROM leaf{steps}),
cells AS (
  SELECT *, CASE WHEN word = '<*>' THEN 0 ELSE count(*) OVER (PARTITION BY leaf, k, word) END AS support FROM placed)""" + shared_sql(threshold) + """,
mapping AS (
  SELECT m.message, CASE WHEN s.cut > 1
    THEN array_to_string(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN ss[i] >= cut THEN ws[i] ELSE '<*>' END), ' ')
    ELSE array_to_string(words, ' ') END AS template
  FROM messages m LEFT JOIN shared s USING (message))
"""


def subsequence_sql(threshold: float) -> str:
    """The same of the subsequence miner."""
    return MESSAGES + """,
placed AS (SELECT message, unnest(range(len(words))) AS k, unnest(words) AS word FROM messages),
supports AS (SELECT word, count(DISTINCT message) AS support FROM placed GROUP BY word),
cells AS (SELECT * FROM placed JOIN supports USING (word) WHERE word <> '<*>')""" + shared_sql(threshold) + """,
fixed_words AS (
  SELECT message, len(words) AS n, list_filter(range(1, len(ws) + 1), lambda i: ss[i] >= cut) AS chosen, ws, places
  FROM shared JOIN messages USING (message) WHERE cut > 1),
chosen_words AS (
  SELECT message, n, list_transform(chosen, lambda i: ws[i]) AS fixed, list_transform(chosen, lambda i: places[i]) AS k FROM fixed_words),
gaps AS (
  SELECT message, fixed, unnest(range(len(fixed) + 1)) AS i, unnest(list_concat(k, [n])) AS here, unnest(list_concat([-1], k)) AS before
  FROM chosen_words),
fields AS (SELECT fixed, i, max(CASE WHEN here - before > 1 THEN 1 ELSE 0 END) AS field FROM gaps GROUP BY fixed, i),
mined AS (
  SELECT fixed, string_agg(concat_ws(' ', CASE WHEN field = 1 THEN '<*>' END, fixed[i + 1]), ' ' ORDER BY i)
           FILTER (WHERE field = 1 OR i < len(fixed)) AS template
  FROM fields GROUP BY fixed),
mapping AS (
  SELECT m.message, COALESCE(t.template, array_to_string(words, ' ')) AS template
  FROM messages m LEFT JOIN chosen_words c USING (message) LEFT JOIN mined t ON t.fixed = c.fixed)
"""


MINED = views.TEXT + """,
masked_v AS (SELECT line, message AS content, """ + HDFS_MASKED.format(text="message") + """ AS message FROM text_v)""" + position_sql(5, 0.5) + """,
mined_v AS (
  SELECT line, content, template AS "EventTemplate", substring(md5(template), 1, 8) AS "EventId"
  FROM masked_v JOIN mapping USING (message))"""


def _mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.text_view(spark, sf_dir).select("line", F.col("message").alias("Content"))
    masked = text.mask_content("Content", text.MASKS["hdfs_drain"])
    mapping = templates.mine_templates_by_position(rows, masked, depth=5, threshold=0.5)
    return templates.assign_templates(rows, masked, mapping)


@query(
    "t1_mine_by_position",
    with_views(
        MINED,
        """SELECT "EventTemplate", count(*) AS "Occurrences", min(line) AS first_line, "EventId"
           FROM mined_v GROUP BY ALL""",
    ),
)
def t1_mine_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_catalogue(_mined(spark, sf_dir))


@query(
    "t1_mine_documents",
    with_views(
        """masked_v AS (
  SELECT """ + BGL_MASKED.format(text="content") + """ AS message
  FROM (SELECT unnest(string_split(text, chr(10))) AS content FROM documents))""" + position_sql(4, 0.5),
        "SELECT template, count(*) AS messages FROM mapping GROUP BY template",
    ),
)
def t1_mine_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a message."""
    lines = views.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("Content"))
    masked = text.mask_content("Content", text.MASKS["bgl"])
    mapping = templates.mine_templates_by_position(lines, masked, depth=4, threshold=0.5)
    return mapping.groupBy("template").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "t2_mine_by_subsequence",
    with_views(
        views.TEXT + """,
masked_v AS (SELECT """ + BGL_MASKED.format(text="message") + """ AS message FROM text_v)""" + subsequence_sql(0.5),
        "SELECT array_to_string(words, chr(10)) AS message, template FROM mapping JOIN messages USING (message)",
    ),
)
def t2_mine_by_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.text_view(spark, sf_dir).select("message")
    masked = text.mask_content("message", text.MASKS["bgl"])
    return templates.mine_templates_by_subsequence(rows, text.tokenize(masked), 0.5)


@query("t3_assign_templates", with_views(MINED, 'SELECT line, "EventId", "EventTemplate" FROM mined_v'))
def t3_assign_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mined(spark, sf_dir).select("line", "EventId", "EventTemplate")


@query("p13_template_params")
def p13_template_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = templates.template_params(_mined(spark, sf_dir))
    return rows.select("line", "EventTemplate", F.array_join("ParameterList", "~").alias("parameters"))


def count_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-count vectors of all windows over the training events, with split and label."""
    counts, split = sequence_counts(spark, sf_dir)
    events = features.training_events(counts.filter("split = 'train'"))
    columns = written(features.event_columns(events), "columns")
    cells = features.count_features(counts, events)
    vectors = features.feature_vectors(cells, columns, split, columns.count())
    return written(vectors.select("seq_id", "label", "split", "values"), "values").withColumn(
        "features", array_to_vector("values")
    )


def sparse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts of all windows over the training events as sparse vectors, with split and label."""
    counts, split = sequence_counts(spark, sf_dir)
    events = features.training_events(counts.filter("split = 'train'"))
    columns = written(features.event_columns(events), "columns")
    vectors = features.sparse_vectors(features.count_features(counts, events), columns, split)
    return written(vectors.select("seq_id", "label", "split", "cols", "xs"), "vectors")


@query("m1_pca_detector")
def m1_pca_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = count_vectors(spark, sf_dir)
    model = matrix.fit_pca(vectors.filter("split = 'train'"), 0.8)
    scored = matrix.score_pca(vectors.filter("split <> 'train'"), model)
    return scored.select("seq_id", "label", F.round("spe", 6).alias("spe"), "anomaly")


@query("m2_invariant_detector")
def m2_invariant_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = count_vectors(spark, sf_dir)
    found = matrix.fit_invariants(vectors.filter("split = 'train'"), longest=2)
    scored = matrix.score_invariants(vectors.filter("split <> 'train'"), found)
    return scored.select("seq_id", "label", "broken", "anomaly")


CLUSTERS = with_views(
    COUNTS,
    """,
    numbered AS (SELECT event, row_number() OVER (ORDER BY event) - 1 AS col FROM doc_v),
    sparse AS (
      SELECT s.seq_id, s.label, s.split, COALESCE(list(col ORDER BY col) FILTER (col IS NOT NULL), []) AS cols,
        COALESCE(list(CAST(c.n AS DOUBLE) ORDER BY col) FILTER (col IS NOT NULL), []) AS xs
      FROM split_v s LEFT JOIN (SELECT seq_id, col, n FROM counts_v JOIN numbered USING (event)) c USING (seq_id)
      GROUP BY s.seq_id, s.label, s.split),
    shape AS (
      SELECT row_number() OVER (ORDER BY weight DESC, cols, xs) AS id, *
      FROM (SELECT cols, xs, count(*) AS weight FROM sparse WHERE split = 'train' GROUP BY cols, xs)),
    cell AS (SELECT id, unnest(cols) AS col, unnest(xs) AS x FROM shape),
    long AS (SELECT id, sqrt(sum(x * x)) AS norm FROM cell GROUP BY id),
    apart AS (
      SELECT a.id, b.id AS other, 1 - sum(a.x * b.x) / (any_value(m.norm) * any_value(n.norm) + 1e-8) AS d
      FROM cell a JOIN cell b USING (col) JOIN long m ON m.id = a.id JOIN long n ON n.id = b.id GROUP BY a.id, b.id),
    rounded AS (SELECT id, other, round(CASE WHEN d < 1e-8 THEN 0 ELSE d END, 9) AS d FROM apart),
    reach AS (SELECT id, list(other) AS near FROM rounded WHERE d <= 0.3 GROUP BY id),
    everyone AS (SELECT s.id, COALESCE(near, [s.id]) AS near FROM shape s LEFT JOIN reach USING (id)),
    walk AS (
      WITH RECURSIVE w(leader, gone) AS (
        SELECT id, near FROM everyone WHERE id = 1
        UNION ALL
        SELECT n.id, list_concat(n.gone, e.near)
        FROM (SELECT (SELECT min(s.id) FROM shape s WHERE s.id > w.leader AND NOT list_contains(w.gone, s.id)) AS id, w.gone FROM w) n
        JOIN everyone e ON e.id = n.id)
      SELECT leader, row_number() OVER (ORDER BY leader) - 1 AS cluster FROM w),
    home AS (
      SELECT s.id, s.weight, COALESCE((
        SELECT arg_min(cluster, (r.d, cluster)) FROM rounded r JOIN walk ON leader = r.other WHERE r.id = s.id),
        (SELECT cluster FROM walk WHERE leader = s.id)) AS cluster FROM shape s),
    size AS (SELECT cluster, sum(weight) AS size FROM home GROUP BY cluster),
    centre AS (
      SELECT cluster, col, sum(x * weight) / any_value(size) AS x FROM cell JOIN home USING (id) JOIN size USING (cluster) GROUP BY cluster, col),
    width AS (SELECT cluster, sqrt(sum(x * x)) AS norm FROM centre GROUP BY cluster),
    test AS (SELECT seq_id, label, unnest(cols) AS col, unnest(xs) AS x FROM sparse WHERE split <> 'train'),
    lengths AS (SELECT seq_id, sqrt(sum(x * x)) AS norm FROM test GROUP BY seq_id),
    met AS (
      SELECT t.seq_id, 1 - sum(t.x * c.x) / (any_value(l.norm) * any_value(w.norm) + 1e-8) AS d
      FROM test t JOIN centre c USING (col) JOIN lengths l ON l.seq_id = t.seq_id JOIN width w ON w.cluster = c.cluster
      GROUP BY t.seq_id, c.cluster),
    best AS (SELECT seq_id, round(min(CASE WHEN d < 1e-8 THEN 0 ELSE d END), 9) AS d FROM met GROUP BY seq_id)
    SELECT seq_id, label, round(COALESCE(d, 1), 6) AS distance, CASE WHEN COALESCE(d, 1) > 0.3 THEN 1 ELSE 0 END AS anomaly
    FROM sparse LEFT JOIN best USING (seq_id) WHERE split <> 'train'""",
)


@query("m3_cluster_detector", CLUSTERS)
def m3_cluster_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = sparse_counts(spark, sf_dir)
    centres = cluster.fit_clusters(vectors.filter("split = 'train'"))
    scored = cluster.score_clusters(vectors.filter("split <> 'train'"), centres)
    return scored.select("seq_id", "label", F.round("distance", 6).alias("distance"), "anomaly")


@query("m4_isolation_forest")
def m4_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = count_vectors(spark, sf_dir)
    train = vectors.filter("split = 'train'")
    nodes = forest.fit_forest(train, "seq_id")
    scored = forest.score_forest(vectors.filter("split <> 'train'"), nodes, train=train)
    return scored.select("seq_id", "label", F.round("score", 6).alias("score"), "anomaly")


def labelled_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells, columns and sequences of all windows for detectors that learn from labels of both kinds:
    seven in ten random windows train, whatever their label, and their events are the columns."""
    counts, sequences = sequence_counts(spark, sf_dir)
    split = written(train_valid_split(sequences.drop("split"), "seq_id", 0.3), "labelled")
    counts = counts.drop("split").join(split.select("seq_id", "split"), "seq_id")
    events = features.training_events(counts.filter("split = 'train'"))
    return features.count_features(counts, events), written(features.event_columns(events), "columns"), split


def _sides(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    stored = written(vectors, "vectors")
    return stored.filter("split = 'train'"), stored.filter("split = 'valid'")


def _labelled_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells, columns, split = labelled_cells(spark, sf_dir)
    vectors = features.feature_vectors(cells, columns, split, columns.count())
    return _sides(vectors.select("seq_id", "label", "split", "features"))


@query("m5_decision_tree")
def m5_decision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = supervised.decision_tree(*_labelled_vectors(spark, sf_dir))
    return scored.select("seq_id", "label", "anomaly")


@query("m6_logistic_regression")
def m6_logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = supervised.logistic_regression(*_labelled_vectors(spark, sf_dir))
    return scored.select("seq_id", "label", "anomaly")


@query("m7_linear_svm")
def m7_linear_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, columns, split = labelled_cells(spark, sf_dir)
    vectors = features.sparse_vectors(cells, columns, split).select("seq_id", "label", "split", "cols", "xs")
    scored = supervised.linear_svm(*_sides(vectors))
    return scored.select("seq_id", "label", F.round("margin", 4).alias("margin"), "anomaly")
