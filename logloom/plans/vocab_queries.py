"""Vocabulary, encoding, masking, padding and count features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import features, profile, windows
from logloom.operators import vocab as vocabulary
from logloom.operators.vocab import _hex_bound
from logloom.plans import views
from logloom.plans.registry import query, with_views
from logloom.plans.window_queries import joined, micros
from logloom.session import written

SEQ_LEN, RATIO, SEED = 32, 0.65, 31

VOCAB = views.split_sql() + """,
rows_t AS (SELECT w.* REPLACE (s.label AS label), s.split FROM win_v w JOIN split_v s ON s.seq_id = w.seq_id),
words AS (SELECT event AS token, count(*) AS freq FROM rows_t WHERE split = 'train' GROUP BY event),
vocab_v AS (
  SELECT token, row_number() OVER (ORDER BY freq DESC, token) + 4 AS idx, freq FROM words
  UNION ALL SELECT * FROM (VALUES ('<pad>', 0, 0), ('<unk>', 1, 0), ('<eos>', 2, 0), ('<sos>', 3, 0), ('<mask>', 4, 0)))"""

CODED = VOCAB + """,
coded AS (SELECT seq_id, split, label, start, pos, event, dt_us, COALESCE(idx, 1) AS idx
          FROM rows_t LEFT JOIN vocab_v ON token = event)"""


def masked_sql(ratio: float = RATIO, seed: int = SEED, name: str = "masked") -> str:
    bound = _hex_bound(ratio)
    draw = f"substr(md5('{seed}|' || seq_id || '|' || pos), 1, 8)"
    return f""",
{name} AS (SELECT *, CASE WHEN {draw} < '{bound}' THEN 4 ELSE idx END AS bert_input,
                  CASE WHEN {draw} < '{bound}' THEN idx ELSE 0 END AS bert_label,
                  CASE WHEN {draw} < '{bound}' THEN 0 ELSE dt_us END AS time_input,
                  CASE WHEN {draw} < '{bound}' THEN dt_us ELSE 0 END AS time_label FROM coded)"""


def train_vocab(rows: DataFrame) -> DataFrame:
    return vocabulary.build_vocab(rows.filter("split = 'train'").select(F.col("event").alias("token")))


def coded_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Window rows with their ids and their chunk of the model length, and the training vocabulary."""
    rows = written(views.split_windows(spark, sf_dir), "split")
    vocab = written(train_vocab(rows), "vocab")
    chunked = rows.withColumn("chunk", F.floor(F.col("pos") / SEQ_LEN))
    return vocabulary.encode_rows(chunked, vocab), vocab


@query(
    "v1_build_vocab",
    with_views(
        VOCAB,
        "SELECT token, idx, freq FROM vocab_v WHERE idx < 5 OR (idx < 45 AND freq >= 3)",
    ),
)
def v1_build_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.split_windows(spark, sf_dir).filter("split = 'train'")
    return vocabulary.build_vocab(rows.select(F.col("event").alias("token")), min_freq=3, max_size=40)


@query(
    "v2_encode",
    with_views(
        VOCAB,
        """, enc AS (SELECT seq_id, [3] || list(COALESCE(idx, 1) ORDER BY pos) || [2] AS ids
                    FROM win_v LEFT JOIN vocab_v ON token = event GROUP BY seq_id)
        SELECT seq_id, CAST(len(ids) AS INTEGER) AS length, array_to_string(list_resize(ids, 12, 0), ',') AS ids FROM enc""",
    ),
)
def v2_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(views.split_windows(spark, sf_dir), "split")
    arrays = windows.window_arrays(rows, ["seq_id"])
    coded = vocabulary.encode_arrays(arrays, train_vocab(rows), ["seq_id"], seq_len=12, with_eos=True, with_sos=True)
    return coded.select("seq_id", "length", joined("ids").alias("ids"))


@query(
    "v3_decode",
    with_views(
        VOCAB,
        """, ids AS (SELECT line, CAST(floor(value) AS BIGINT) AS idx FROM log_v)
        SELECT line, idx, COALESCE(token, '<' || idx || '>') AS token FROM ids LEFT JOIN vocab_v USING (idx) WHERE idx <> 0""",
    ),
)
def v3_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = train_vocab(views.split_windows(spark, sf_dir))
    ids = views.log_view(spark, sf_dir).select("line", F.floor("value").alias("idx"))
    return vocabulary.decode_rows(ids, vocab, drop_pads=True).select("line", "idx", "token")


@query(
    "v4_extend_vocab",
    with_views(
        VOCAB,
        """, other AS (SELECT DISTINCT role || '_' || least(9, length(text) // 100) AS token FROM conversations
                      UNION SELECT event FROM log_v)
        SELECT token, idx FROM vocab_v UNION ALL
        SELECT token, (SELECT max(idx) FROM vocab_v) + row_number() OVER (ORDER BY token)
        FROM other WHERE token NOT IN (SELECT token FROM vocab_v)""",
    ),
)
def v4_extend_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = written(train_vocab(views.split_windows(spark, sf_dir)), "vocab")
    talk = views.conversation_rows(spark, sf_dir).select(F.col("event").alias("token"))
    log = views.log_view(spark, sf_dir).select(F.col("event").alias("token"))
    other = vocabulary.build_vocab(talk.unionByName(log))
    return vocabulary.extend_vocab(vocab, other).select("token", "idx")


@query(
    "v5_mask_predict",
    with_views(CODED, masked_sql() + "SELECT seq_id, pos, bert_input, bert_label, time_input, time_label FROM masked"),
)
def v5_mask_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _ = coded_rows(spark, sf_dir)
    masked = vocabulary.mask_rows(coded, RATIO, seed=SEED)
    return masked.select(
        "seq_id", "pos", "bert_input", "bert_label",
        micros(F.col("time_input")).alias("time_input"), micros(F.col("time_label")).alias("time_label"),
    )


_DRAW = f"substr(md5('{SEED}|' || seq_id || '|' || pos), 1, 8)"


@query(
    "v5_mask_train",
    with_views(
        CODED,
        f""", size AS (SELECT count(*) AS v FROM vocab_v)
        SELECT seq_id, pos, CASE WHEN {_DRAW} < '{_hex_bound(RATIO * 0.8)}' THEN 4
                 WHEN {_DRAW} < '{_hex_bound(RATIO * 0.9)}'
                 THEN CAST('0x' || substr(md5('{SEED}r|' || seq_id || '|' || pos), 1, 8) AS BIGINT) % (SELECT v FROM size)
                 ELSE idx END AS bert_input,
               CASE WHEN {_DRAW} < '{_hex_bound(RATIO)}' THEN idx ELSE 0 END AS bert_label FROM coded""",
    ),
)
def v5_mask_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, vocab = coded_rows(spark, sf_dir)
    size = vocab.agg(F.count(F.lit(1)).alias("v")).scalar()
    masked = vocabulary.mask_rows(coded, RATIO, size, SEED, predict=False)
    return masked.select("seq_id", "pos", "bert_input", "bert_label")


@query(
    "v6_batch_pad",
    with_views(
        CODED,
        masked_sql() + f""", samples AS (SELECT seq_id, any_value(start // 86400) AS batch, [3] || list(bert_input ORDER BY pos) AS ids,
             [0] || list(bert_label ORDER BY pos) AS labels, [0] || list(time_input ORDER BY pos) AS times FROM masked GROUP BY seq_id),
        sized AS (SELECT *, least(8, max(len(ids)) OVER (PARTITION BY batch)) AS l FROM samples)
        SELECT seq_id, array_to_string(list_resize(ids, l, 0), ',') AS bert_input,
          array_to_string(list_resize(labels, l, 0), ',') AS bert_label, array_to_string(list_resize(times, l, 0), ',') AS time_input
        FROM sized""",
    ),
)
def v6_batch_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _ = coded_rows(spark, sf_dir)
    day = F.floor(F.col("start") / 86400).alias("batch")
    # a batch is cut to 8, so what lies beyond is not gathered
    masked = vocabulary.mask_rows(coded.filter(F.col("pos") < 8), RATIO, seed=SEED).select("*", day)
    padded = vocabulary.pad_batches(vocabulary.model_samples(masked, ["seq_id", "batch"]), "batch", 8)
    return padded.select(
        "seq_id",
        joined("bert_input").alias("bert_input"),
        joined("bert_label").alias("bert_label"),
        joined("time_input", lambda v: micros(v).cast("string")).alias("time_input"),
    )


@query(
    "v7_next_labels",
    with_views(
        views.CONVERSATIONS,
        """, s AS (SELECT session_id, list(event ORDER BY pos) AS ev, count(*) AS n FROM conv_v GROUP BY session_id),
        w AS (SELECT session_id, CASE WHEN i + 2 < n THEN ev[i + 3] ELSE '#Pad' END AS label, i AS start
              FROM (SELECT *, unnest(range(0, greatest(0, n - 2) + 1)) AS i FROM s)),
        f AS (SELECT label, min(CAST(session_id AS BIGINT) * 1000 + start) AS first FROM w GROUP BY label)
        SELECT label, CASE WHEN label = '#Pad' THEN 1 ELSE row_number() OVER (ORDER BY first) + 1 END AS idx FROM f""",
    ),
)
def v7_next_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = windows.next_event_windows(views.conversation_rows(spark, sf_dir), 2)
    ordered = pairs.withColumn("session", F.col("session_id").cast("long"))
    return vocabulary.next_label_index(ordered, ["session", "start"])


@query(
    "v8_rank_templates",
    with_views(
        views.LOG,
        """SELECT substr(md5(event), 1, 8) AS "EventId", count(*) AS "Occurrences",
             row_number() OVER (ORDER BY count(*) DESC, substr(md5(event), 1, 8)) AS rank FROM log_v GROUP BY event""",
    ),
)
def v8_rank_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir).select("line", F.col("event").alias("EventTemplate"))
    return vocabulary.rank_templates(profile.template_catalogue(log))


# --- features ----------------------------------------------------------------------------------

COUNTS = views.split_sql() + """,
counts_v AS (SELECT w.seq_id, split, event, count(*) AS n FROM win_v w JOIN split_v USING (seq_id) GROUP BY ALL),
doc_v AS (SELECT event, count(*) AS df FROM counts_v WHERE split = 'train' GROUP BY event),
total_v AS (SELECT count(*) AS n FROM split_v WHERE split = 'train')"""


def sequence_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Event counts per sequence and the sequences, both with the split."""
    members = views.stored_windows(spark, sf_dir)
    split = written(views.split_sequences(members).select("seq_id", "label", "split"), "split")
    counts = profile.event_counts(members).join(split.select("seq_id", "split"), "seq_id")
    return written(counts, "counts"), split


@query(
    "f1_count_features",
    with_views(COUNTS, "SELECT seq_id, event, CAST(n AS DOUBLE) AS x FROM counts_v JOIN doc_v USING (event)"),
)
def f1_count_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, _ = sequence_counts(spark, sf_dir)
    return features.count_features(counts, features.training_events(counts.filter("split = 'train'")))


@query(
    "f2_oov_feature",
    with_views(
        COUNTS,
        """, kept AS (SELECT event FROM doc_v WHERE df >= 5),
        u AS (SELECT seq_id, count(*) AS oov FROM counts_v WHERE event NOT IN (SELECT event FROM kept) GROUP BY seq_id)
        SELECT seq_id, COALESCE(oov, 0) AS oov FROM split_v LEFT JOIN u USING (seq_id)""",
    ),
)
def f2_oov_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, split = sequence_counts(spark, sf_dir)
    return features.oov_feature(counts, features.training_events(counts.filter("split = 'train'"), 5), split)


def _weighted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counts, split = sequence_counts(spark, sf_dir)
    events = features.training_events(counts.filter("split = 'train'"))
    train = split.filter("split = 'train'")
    weighted = features.tf_idf(features.count_features(counts, events), events, train)
    return weighted.join(split.select("seq_id", "split"), "seq_id"), train


_TFIDF = """, tf AS (SELECT seq_id, split, event, n * ln((SELECT n FROM total_v) / (df + 1e-8::DOUBLE)) AS x
                    FROM counts_v JOIN doc_v USING (event))"""


@query("f3_tf_idf", with_views(COUNTS, _TFIDF + "SELECT seq_id, event, round(x, 6) AS x FROM tf"))
def f3_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted, _ = _weighted(spark, sf_dir)
    return weighted.select("seq_id", "event", F.round("x", 6).alias("x"))


@query(
    "f4_zero_mean",
    with_views(
        COUNTS,
        _TFIDF + """, mean_v AS (SELECT event, sum(x) / (SELECT n FROM total_v) AS m FROM tf WHERE split = 'train' GROUP BY event)
        SELECT seq_id, event, round(x - m, 6) AS x FROM tf JOIN mean_v USING (event)""",
    ),
)
def f4_zero_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted, train = _weighted(spark, sf_dir)
    means = features.column_means(weighted.filter("split = 'train'"), train)
    return features.zero_mean(weighted, means).select("seq_id", "event", F.round("x", 6).alias("x"))


@query(
    "f4_sigmoid",
    with_views(COUNTS, _TFIDF + "SELECT seq_id, event, round(1 / (1 + exp(-x)), 6) AS x FROM tf WHERE x <> 0"),
)
def f4_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted, _ = _weighted(spark, sf_dir)
    return features.sigmoid(weighted.filter("x <> 0")).select("seq_id", "event", F.round("x", 6).alias("x"))
