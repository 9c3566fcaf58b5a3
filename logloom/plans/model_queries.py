"""Count models and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import evaluate, windows
from logloom.operators import vocab as vocabulary
from logloom.operators.detectors import counts as models
from logloom.operators.detectors import dispersion
from logloom.plans import views
from logloom.plans.registry import query, with_views
from logloom.plans.vocab_queries import CODED, RATIO, SEQ_LEN, coded_rows, masked_sql
from logloom.session import written

DEPTH, GUESSES, CANDIDATES = 3, 9, 15

# --- next event --------------------------------------------------------------------------------


def next_sql(depth: int = DEPTH, guesses: int = GUESSES, name: str = "a") -> str:
    """SQL views of the next-event model: ``sess_<name>`` has windows, missed and right counts."""
    levels = range(1, depth + 1)
    ctx = ", ".join(f"array_to_string(h[{depth - j + 1}:{depth}], ' ') AS c{j}" for j in levels)
    train = " UNION ALL ".join(
        ["SELECT 0 AS level, '' AS ctx, next FROM samp_{n} WHERE split = 'train'"]
        + [f"SELECT {j}, c{j}, next FROM samp_{{n}} WHERE split = 'train'" for j in levels]
    ).format(n=name)
    joins = " ".join(
        f"LEFT JOIN known_{name} k{j} ON k{j}.level = {j} AND k{j}.ctx = s.c{j}" for j in levels
    )
    level = " ".join(f"WHEN k{j}.ctx IS NOT NULL THEN {j}" for j in reversed(levels))
    text = " ".join(f"WHEN k{j}.ctx IS NOT NULL THEN s.c{j}" for j in reversed(levels))
    return f""",
arr_{name} AS (SELECT seq_id, list(event ORDER BY pos) AS ev, count(*) AS n FROM win_v GROUP BY seq_id),
samp_{name} AS (
  SELECT w.*, split, label, {ctx} FROM (
    SELECT seq_id, i AS start, list_resize(ev[i + 1 : i + {depth}], {depth}, '#Pad') AS h,
           CASE WHEN i + {depth} < n THEN ev[i + {depth} + 1] ELSE '#Pad' END AS next
    FROM (SELECT *, unnest(range(0, greatest(0, n - {depth}) + 1)) AS i FROM arr_{name})) w JOIN split_v USING (seq_id)),
cnt_{name} AS (SELECT level, ctx, next, count(*) AS n FROM ({train}) GROUP BY level, ctx, next),
rank_{name} AS (SELECT *, row_number() OVER (PARTITION BY level, ctx ORDER BY n DESC, next) AS rk FROM cnt_{name}),
known_{name} AS (SELECT DISTINCT level, ctx FROM cnt_{name}),
lev_{name} AS (SELECT s.*, CASE {level} ELSE 0 END AS level, CASE {text} ELSE '' END AS ctx FROM samp_{name} s {joins} WHERE split <> 'train'),
sess_{name} AS (
  SELECT l.seq_id, any_value(l.label) AS label, count(*) AS windows,
         CAST(sum(CASE WHEN rk IS NULL OR rk > {guesses} THEN 1 ELSE 0 END) AS BIGINT) AS missed,
         CAST(sum(CASE WHEN rk = 1 THEN 1 ELSE 0 END) AS BIGINT) AS "right"
  FROM lev_{name} l LEFT JOIN rank_{name} r ON r.level = l.level AND r.ctx = l.ctx AND r.next = l.next
  GROUP BY l.seq_id)"""


def next_event_samples(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    rows = views.stored_windows(spark, sf_dir)
    split = views.split_sequences(rows).select("seq_id", "split", "label")
    pairs = windows.next_event_windows(rows.select("seq_id", "pos", "event"), depth, "seq_id")
    return written(pairs.join(split, "seq_id"), "pairs")


def next_event_misses(samples: DataFrame, depth: int = DEPTH, guesses: int = GUESSES) -> DataFrame:
    contexts = models.history_contexts("events", depth)
    counted = written(models.context_counts(samples.filter("split = 'train'"), contexts, "next"), "ngrams")
    test = samples.filter("split <> 'train'")
    scored = models.score(test, contexts, "next", counted, guesses, ["seq_id", "label"])
    return models.session_misses(scored, ["seq_id", "label"])


@query(
    "m8_next_event_topk",
    with_views(views.split_sql(), next_sql() + 'SELECT seq_id, label, windows, missed, "right" FROM sess_a'),
)
def m8_next_event_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_event_misses(next_event_samples(spark, sf_dir, DEPTH))


@query(
    "k3_top_candidates",
    with_views(
        views.split_sql(),
        next_sql(2) + """SELECT level, ctx, string_agg(next, ' ' ORDER BY rk) AS top
        FROM rank_a WHERE rk <= 5 GROUP BY level, ctx""",
    ),
)
def k3_top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = next_event_samples(spark, sf_dir, 2).filter("split = 'train'")
    counted = models.context_counts(samples, models.history_contexts("events", 2), "next")
    return models.top_targets(counted, 5).select("level", "ctx", F.array_join("top", " ").alias("top"))


@query(
    "e5_session_rollup",
    with_views(
        views.split_sql(),
        next_sql() + """, s AS (SELECT CASE WHEN missed > 0 THEN 1 ELSE 0 END AS p, label AS y, windows, "right" FROM sess_a),
        m AS (SELECT sum(p * y) AS tp, sum(p * (1 - y)) AS fp, sum((1 - p) * y) AS fn, count(*) AS n, sum(windows) AS w, sum("right") AS r FROM s)
        SELECT round(r / w, 9) AS window_acc, round((n - fp - fn) / n, 9) AS session_acc, round(2 * tp / (2 * tp + fp + fn), 9) AS f1,
               round(tp / (tp + fn), 9) AS recall, round(tp / (tp + fp), 9) AS precision FROM m""",
    ),
)
def e5_session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    misses = next_event_misses(next_event_samples(spark, sf_dir, DEPTH))
    out = evaluate.session_rollup(misses, "seq_id")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    "e4_best_threshold",
    with_views(
        views.split_sql(),
        next_sql(2, 1) + """, g AS (SELECT unnest(range(0, 10)) AS th),
        c AS (SELECT th, count(*) FILTER (label = 0 AND missed > th) AS fp, count(*) FILTER (label = 1 AND missed > th) AS tp,
                     count(*) FILTER (label = 0 AND missed <= th) AS tn, count(*) FILTER (label = 1 AND missed <= th) AS fn
              FROM sess_a, g GROUP BY th)
        SELECT CAST(th AS DOUBLE) AS theta, fp AS "FP", tp AS "TP", tn AS "TN", fn AS "FN", round(200.0 * tp / (2 * tp + fp + fn), 6) AS "F1"
        FROM c WHERE tp > 0 ORDER BY "F1" DESC, th LIMIT 1""",
    ),
)
def e4_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    misses = next_event_misses(next_event_samples(spark, sf_dir, 2), 2, 1)
    best = evaluate.best_threshold(misses, errors="missed")
    return best.select("theta", "FP", "TP", "TN", "FN", F.round("F1", 6).alias("F1"))


@query(
    "e3_binary_metrics",
    with_views(
        views.split_sql(),
        next_sql() + """, s AS (SELECT CASE WHEN missed > 0 THEN 1 ELSE 0 END AS p, label AS y FROM sess_a),
        m AS (SELECT sum(p * y) AS tp, sum(p * (1 - y)) AS fp, sum((1 - p) * y) AS fn FROM s),
        r AS (SELECT 100 * tp / (tp + fp + 1e-8::DOUBLE) AS p, 100 * tp / (tp + fn + 1e-8::DOUBLE) AS r FROM m)
        SELECT round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(2 * p * r / (p + r), 4) AS f1 FROM r""",
    ),
)
def e3_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    misses = next_event_misses(next_event_samples(spark, sf_dir, DEPTH))
    pairs = misses.select((F.col("missed") > 0).cast("int").alias("predicted"), F.col("label").alias("actual"))
    return evaluate.binary_metrics(pairs)


@query(
    "e9_supervised_threshold",
    with_views(
        views.split_sql(),
        next_sql() + """, s AS (SELECT "right" / windows < 0.2 AS p, label = 1 AS y FROM sess_a),
        m AS (SELECT count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (p AND y) AS tp, count(*) FILTER (NOT p AND NOT y) AS tn,
                     count(*) FILTER (NOT p AND y) AS fn FROM s)
        SELECT fp AS "FP", tp AS "TP", tn AS "TN", fn AS "FN", round(100.0 * tp / (tp + fp), 6) AS "P", round(100.0 * tp / (tp + fn), 6) AS "R",
               round(200.0 * tp / (2 * tp + fp + fn), 6) AS "F1" FROM m""",
    ),
)
def e9_supervised_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    misses = next_event_misses(next_event_samples(spark, sf_dir, DEPTH))
    out = evaluate.supervised_threshold(misses.withColumn("score", F.col("right") / F.col("windows")))
    return out.withColumns({c: F.round(c, 6) for c in ("P", "R", "F1")})


# --- masked events -----------------------------------------------------------------------------


def masked_model_sql(seed: int = 31, k: int = CANDIDATES, name: str = "a") -> str:
    """SQL views of the masked-event model: ``cnt_<name>`` and the scored positions ``sc_<name>``."""
    m = f"masked_{name}"
    return masked_sql(RATIO, seed, m) + f""",
near_{name} AS (
  SELECT *, COALESCE(last_value(CASE WHEN bert_label = 0 THEN idx END IGNORE NULLS)
              OVER (PARTITION BY seq_id, pos // {SEQ_LEN} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 3) AS b,
            COALESCE(first_value(CASE WHEN bert_label = 0 THEN idx END IGNORE NULLS)
              OVER (PARTITION BY seq_id, pos // {SEQ_LEN} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS f
  FROM {m}),
ms_{name} AS (SELECT seq_id, split, label, bert_label AS target, CAST(b AS VARCHAR) AS c1, b || ' ' || f AS c2
              FROM near_{name} WHERE bert_label > 0),
mc_{name} AS (SELECT level, ctx, target, count(*) AS n FROM (
    SELECT 0 AS level, '' AS ctx, target FROM ms_{name} WHERE split = 'train'
    UNION ALL SELECT 1, c1, target FROM ms_{name} WHERE split = 'train'
    UNION ALL SELECT 2, c2, target FROM ms_{name} WHERE split = 'train') GROUP BY level, ctx, target),
mr_{name} AS (SELECT *, row_number() OVER (PARTITION BY level, ctx ORDER BY n DESC, target) AS rk,
                     sum(n) OVER (PARTITION BY level, ctx) AS total FROM mc_{name}),
mk_{name} AS (SELECT DISTINCT level, ctx, total FROM mr_{name}),
sc_{name} AS (
  SELECT q.seq_id, q.split, q.label, q.target, r.rk, COALESCE(r.n, 0) AS n, q.total FROM (
    SELECT s.*, COALESCE(k2.level, k1.level, 0) AS level, COALESCE(k2.ctx, k1.ctx, '') AS ctx,
           COALESCE(k2.total, k1.total, (SELECT total FROM mk_{name} WHERE level = 0)) AS total
    FROM ms_{name} s LEFT JOIN mk_{name} k2 ON k2.level = 2 AND k2.ctx = s.c2
      LEFT JOIN mk_{name} k1 ON k1.level = 1 AND k1.ctx = s.c1
    WHERE split <> 'train') q
  LEFT JOIN mr_{name} r ON r.level = q.level AND r.ctx = q.ctx AND r.target = q.target),
ct_{name} AS (
  SELECT t.seq_id, t.label, CAST(0 AS BIGINT) AS num_error, COALESCE(undetected_tokens, 0) AS undetected_tokens,
         COALESCE(masked_tokens, 0) AS masked_tokens, total_logkey, CAST(0 AS BIGINT) AS "deepSVDD_label"
  FROM (SELECT seq_id, any_value(label) AS label, count(*) FILTER (bert_input > 0) + max(pos) // {SEQ_LEN} + 1 AS total_logkey
        FROM {m} WHERE split <> 'train' GROUP BY seq_id) t
  LEFT JOIN (SELECT seq_id, count(*) AS masked_tokens, count(*) FILTER (rk IS NULL OR rk > {k}) AS undetected_tokens
             FROM sc_{name} GROUP BY seq_id) u USING (seq_id))"""


def masked_model(coded: DataFrame, seed: int = 31, k: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """Scored masked positions and counters of the test sequences."""
    masked = vocabulary.mask_rows(coded, RATIO, seed=seed)
    near = written(models.visible_neighbours(masked, chunk="chunk"), "neighbours")
    contexts = models.neighbour_contexts()
    counted = written(models.context_counts(near.filter("split = 'train'"), contexts, "bert_label"), "contexts")
    test = near.filter("split <> 'train'")
    scored = models.score(test, contexts, "bert_label", counted, k, ["seq_id"])
    return scored, models.masked_counters(masked.filter("split <> 'train'"), scored, chunk="chunk")


def _labelled_counters(coded: DataFrame, seed: int = 31, k: int = CANDIDATES) -> DataFrame:
    _, counters = masked_model(coded, seed, k)
    labels = coded.groupBy("seq_id").agg(F.max("label").alias("label"))
    return written(counters.join(labels, "seq_id"), "counters")


@query(
    "m9_masked_event_topk",
    with_views(CODED, masked_model_sql() + "SELECT * FROM ct_a"),
)
def m9_masked_event_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled_counters(coded_rows(spark, sf_dir)[0])


@query(
    "m10_masked_nll",
    with_views(
        CODED,
        masked_model_sql() + """, v AS (SELECT count(*) AS v FROM mc_a WHERE level = 0)
        SELECT count(*) AS positions, round(avg(-ln((n + 1) / (total + v))), 6) AS nll FROM sc_a, v""",
    ),
)
def m10_masked_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = masked_model(coded_rows(spark, sf_dir)[0])
    return models.masked_nll(scored).withColumn("nll", F.round("nll", 6))


@query(
    "m10_weighted_loss",
    """WITH b AS (SELECT label, CAST(count(*) AS BIGINT) AS n, avg(embedding[1]::DOUBLE) AS mask, avg(embedding[2]::DOUBLE) AS sphere
                  FROM embeddings GROUP BY label)
    SELECT round(sum(n * (0.7 * mask + 0.3 * sphere)) / sum(n), 6) AS loss FROM b""",
)
def m10_weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda i: F.avg(F.col("embedding")[i].cast("double"))
    batches = views.table(spark, sf_dir, "embeddings").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), cell(0).alias("mask"), cell(1).alias("sphere")
    )
    return models.weighted_total(batches, {"mask": 0.7, "sphere": 0.3}).withColumn("loss", F.round("loss", 6))


@query(
    "m11_embedding_dispersion",
    """WITH c AS (SELECT label AS batch, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings),
    d AS (SELECT batch, dim, var_samp(x) AS v, count(*) AS n FROM c GROUP BY batch, dim)
    SELECT batch, max(n) AS n, round(CASE WHEN max(n) < 2 THEN 0 ELSE avg(v) END, 8) AS dispersion FROM d GROUP BY batch""",
)
def m11_embedding_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = views.table(spark, sf_dir, "embeddings").select(F.col("label").alias("batch"), "embedding")
    return dispersion.embedding_dispersion(vectors).withColumn("dispersion", F.round("dispersion", 8))


@query(
    "m11_pooled_dispersion",
    """SELECT batch, round(var_samp(x), 8) AS dispersion
    FROM (SELECT label AS batch, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY batch""",
)
def m11_pooled_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = views.table(spark, sf_dir, "embeddings").select(F.col("label").alias("batch"), "embedding")
    return dispersion.pooled_dispersion(vectors).withColumn("dispersion", F.round("dispersion", 8))


# --- evaluation of the masked model ------------------------------------------------------------

_FLAG = "undetected_tokens > masked_tokens * {}::DOUBLE"


@query(
    "e1_flag_sequences",
    with_views(
        CODED,
        masked_model_sql(31, 3) + f"SELECT seq_id, label, CASE WHEN {_FLAG.format(0.3)} THEN 1 ELSE 0 END AS anomaly FROM ct_a",
    ),
)
def e1_flag_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = _labelled_counters(coded_rows(spark, sf_dir)[0], 31, 3)
    return evaluate.flag_sequences(counters, 0.3).select("seq_id", "label", "anomaly")


_RATES = """round(CASE WHEN tp + fp > 0 THEN 100.0 * tp / (tp + fp) ELSE 0 END, 6) AS "P",
  round(100.0 * tp / (tp + fn), 6) AS "R", round(200.0 * tp / (2 * tp + fp + fn), 6) AS "F1",
  round(100.0 * tp / (tp + fn), 6) AS "TPR", round(100.0 * fp / (fp + tn), 6) AS "FPR" """
_SWEEP = """, g AS (SELECT i * 0.1::DOUBLE AS theta FROM (SELECT unnest(range(0, 11)) AS i)),
c_{n} AS (SELECT theta, count(*) FILTER (label = 0 AND undetected_tokens > masked_tokens * theta) AS fp,
             count(*) FILTER (label = 1 AND undetected_tokens > masked_tokens * theta) AS tp,
             count(*) FILTER (label = 0 AND NOT undetected_tokens > masked_tokens * theta) AS tn,
             count(*) FILTER (label = 1 AND NOT undetected_tokens > masked_tokens * theta) AS fn
      FROM ct_{n}, g GROUP BY theta)"""


@query(
    "e2_threshold_sweep",
    with_views(
        CODED,
        masked_model_sql(31, 3)
        + _SWEEP.format(n="a")
        + f'SELECT round(theta, 6) AS theta, fp AS "FP", tp AS "TP", tn AS "TN", fn AS "FN", {_RATES} FROM c_a',
    ),
)
def e2_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = _labelled_counters(coded_rows(spark, sf_dir)[0], 31, 3)
    out = evaluate.threshold_sweep(counters)
    return out.withColumns({c: F.round(c, 6) for c in ("theta", "P", "R", "F1", "TPR", "FPR")})


def _two_models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    coded = coded_rows(spark, sf_dir)[0]
    return _labelled_counters(coded, 31, 3), _labelled_counters(coded, 32, 5)


_TWO = masked_model_sql(31, 3, "a") + masked_model_sql(32, 5, "b")


@query(
    "e6_leaderboard",
    with_views(
        CODED,
        _TWO + _SWEEP.format(n="a") + _SWEEP.format(n="b").replace(", g AS (SELECT i * 0.1::DOUBLE AS theta FROM (SELECT unnest(range(0, 11)) AS i))", "")
        + f""", r AS (SELECT 'k3' AS encoder, theta, fp, tp, tn, fn, {_RATES} FROM c_a UNION ALL SELECT 'k5', theta, fp, tp, tn, fn, {_RATES} FROM c_b)
        SELECT encoder, round(theta, 6) AS theta, "F1", fp AS "FP", tp AS "TP" FROM r
        QUALIFY row_number() OVER (PARTITION BY encoder ORDER BY "F1" DESC, theta) = 1""",
    ),
)
def e6_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_models(spark, sf_dir)
    both = a.withColumn("encoder", F.lit("k3")).unionByName(b.withColumn("encoder", F.lit("k5")))
    table = evaluate.threshold_sweep(both, keys=["encoder"]).withColumn("F1", F.round("F1", 6))
    best = evaluate.leaderboard(table, ["encoder"], "theta")
    return best.select("encoder", F.round("theta", 6).alias("theta"), "F1", "FP", "TP")


_AB = "a.undetected_tokens > a.masked_tokens * 0.3::DOUBLE {} b.undetected_tokens > b.masked_tokens * 0.3::DOUBLE"


@query(
    "e7_ensemble_and",
    with_views(
        CODED,
        _TWO + f"SELECT a.seq_id, CASE WHEN {_AB.format('AND')} THEN 1 ELSE 0 END AS anomaly FROM ct_a a JOIN ct_b b ON a.seq_id = b.seq_id",
    ),
)
def e7_ensemble_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_models(spark, sf_dir)
    return evaluate.ensemble_and(a, b, 0.3)


@query(
    "e8_ensemble_vote",
    with_views(
        CODED,
        _TWO + f"SELECT a.seq_id, CASE WHEN {_AB.format('OR')} THEN 1 ELSE 0 END AS anomaly FROM ct_a a JOIN ct_b b ON a.seq_id = b.seq_id",
    ),
)
def e8_ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ensemble_vote(_two_models(spark, sf_dir), 0.3)


@query(
    "e10_best_epoch",
    with_views(
        views.LOG,
        """, l AS (SELECT project AS run, t // 86400 - 19722 AS epoch, round(avg(value), 6) AS loss FROM log_v GROUP BY 1, 2),
        b AS (SELECT *, loss < least(100.0, COALESCE(min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100.0)) AS better FROM l),
        w AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS seen FROM b),
        s AS (SELECT run, COALESCE(min(epoch) FILTER (epoch - COALESCE(seen, 0) >= 5), max(epoch)) AS last_epoch FROM w GROUP BY run)
        SELECT w.run, max(epoch) FILTER (better) AS best_epoch, min(loss) FILTER (better) AS best_score, any_value(last_epoch) AS last_epoch
        FROM w JOIN s USING (run) WHERE epoch <= last_epoch GROUP BY w.run""",
    ),
)
def e10_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.log_view(spark, sf_dir)
    losses = log.groupBy(
        F.col("project").alias("run"), (F.floor(F.col("t") / 86400) - 19722).alias("epoch")
    ).agg(F.round(F.avg("value"), 6).alias("loss"))
    return evaluate.best_epoch(losses, "loss", 5)
