"""Evaluation, miners and detectors."""

import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from logloom.operators import evaluate, templates
from logloom.operators.detectors import cluster, counts, dispersion, forest, matrix, supervised
from logloom.session import shuffles_dropped, written

COUNTERS = "seq_id string, label int, num_error long, undetected_tokens long, masked_tokens long, deepSVDD_label long"


def test_sweep_golden(rows):
    df = rows([("a", 0, 0, 0, 4, 0), ("b", 0, 0, 1, 4, 0), ("c", 1, 0, 2, 4, 0), ("d", 1, 0, 4, 4, 0)], COUNTERS)
    r = evaluate.threshold_sweep(df, [0.5]).first()
    assert (r["FP"], r["TP"], r["TN"], r["FN"]) == (0, 1, 2, 1)
    assert (r["P"], r["R"], round(r["F1"], 2)) == (100, 50, 66.67)
    assert evaluate.thresholds()[3] == 0.30000000000000004 and len(evaluate.thresholds()) == 11


def test_published_rates(rows):
    """Rates recomputed from published confusion counts."""
    df = rows([(71, 27, 1977, 26), (18, 9, 2030, 44), (15, 9, 2033, 44), (75, 5, 2101, 29), (189, 33, 4803, 18)],
              "FP long, TP long, TN long, FN long")
    got = [[round(r[c], 2) for c in ("P", "R", "F1")] for r in evaluate.rates(df).orderBy("FP").collect()]
    assert got == [[37.5, 16.98, 23.38], [33.33, 16.98, 22.5], [27.55, 50.94, 35.76], [6.25, 14.71, 8.77], [14.86, 64.71, 24.18]]
    r = evaluate.rates(df.filter("FP = 71")).first()
    assert (round(r["TPR"], 3), round(r["FPR"], 4)) == (50.943, 3.4668)


def test_binary_metrics(rows):
    df = rows(list(zip([1, 1, 1, 0, 0, 0], [1, 0, 1, 1, 0, 0])), "predicted int, actual int")
    assert tuple(evaluate.binary_metrics(df).first()) == (66.6667, 66.6667, 66.6667)


def test_ensembles(rows):
    a = rows([("s1", 1, 0, 3, 4, 0), ("s2", 0, 0, 0, 4, 0)], COUNTERS)
    b = rows([("s1", 1, 0, 3, 4, 0), ("s2", 0, 0, 4, 4, 0)], COUNTERS)
    hits = lambda df: {r["seq_id"] for r in df.filter("anomaly = 1").collect()}
    assert hits(evaluate.ensemble_and(a, b, 0.5)) == {"s1"}
    assert hits(evaluate.ensemble_vote([a, b], 0.5)) == {"s1", "s2"}
    assert hits(evaluate.ensemble_vote([a, b], 0.5, votes=1)) == {"s1"}


def test_best_epoch(rows):
    losses = [5.0, 4.0, float("nan"), 4.0, 4.5, 1.0]
    df = rows([("r", i + 1, v) for i, v in enumerate(losses)], "run string, epoch long, loss double")
    out = evaluate.best_epoch(df, "loss", 3).first()
    assert (out["best_epoch"], out["best_score"], out["last_epoch"]) == (2, 4.0, 5)
    assert evaluate.best_epoch(df, "loss", 4).first()["best_epoch"] == 6


def test_best_threshold(rows):
    df = rows([("a", 0, 0, 2, 9, 0), ("b", 1, 0, 5, 9, 0), ("c", 1, 0, 3, 9, 0)], COUNTERS)
    out = evaluate.best_threshold(df).first()
    assert (out["theta"], out["F1"]) == (2.0, 100.0)


def test_dispersion(rows):
    df = rows([("a", [0.0, 0.0]), ("a", [2.0, 4.0]), ("b", [1.0, 1.0]), ("c", [float("nan"), 1.0]), ("c", [1.0, 1.0])],
              "batch string, embedding array<double>")
    got = {r["batch"]: r["dispersion"] for r in dispersion.embedding_dispersion(df).collect()}
    assert (got["a"], got["b"]) == (5.0, 0.0) and np.isnan(got["c"])


# --- miners ------------------------------------------------------------------------------------


def mined(df, **kw):
    return {r["message"]: r["template"] for r in templates.mine_templates_by_position(df, F.col("m"), **kw).collect()}


def texts(rows, *values):
    return rows([(v,) for v in values], "m string")


def test_position_miner(rows):
    df = texts(rows, "open file x", "open file y", "close it", "close it", None, "", " a   b ")
    assert mined(df, depth=3, threshold=0.3) == {
        "open file x": "open file <*>", "open file y": "open file <*>", "close it": "close it", "": "", " a   b ": "a b"
    }
    # At depth 4 the first word parts the leaves; words with digits share the wildcard branch.
    df = texts(rows, "a x y", "b x y", "n1 x y", "n2 x y", "a")
    got = mined(df, depth=4, threshold=0.5)
    assert got == {"a x y": "a x y", "b x y": "b x y", "n1 x y": "<*> x y", "n2 x y": "<*> x y", "a": "a"}
    # Branches that are too small for the width go to the wildcard branch.
    df = texts(rows, "a x", "b x", "c x")
    assert set(mined(df, depth=4, threshold=0.5, max_child=2).values()) == {"<*> x"}
    assert mined(texts(rows), depth=4) == {}


def loop_miner(messages, threshold):
    """Depth-3 mining by plain loops."""
    out = {}
    for m in messages:
        words = m.split()
        same = [o.split() for o in messages if len(o.split()) == len(words)]
        support = [0 if w == "<*>" else sum(o[i] == w for o in same) for i, w in enumerate(words)]
        cut = sorted(support)[-max(1, math.ceil(threshold * len(words)))]
        out[m] = " ".join(w if s >= cut or cut < 2 else "<*>" for w, s in zip(words, support))
    return out


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_miners_do_not_depend_on_order_or_partitions(spark, rows, partitions):
    rng = np.random.default_rng(2)
    lines = [" ".join(rng.choice([*"abcdef", "<*>"], size=int(rng.integers(1, 6)))) for _ in range(300)]
    df = texts(rows, *lines).orderBy(F.md5(F.concat("m", F.lit(str(partitions))))).repartition(partitions)
    assert mined(df, depth=3, threshold=0.5) == loop_miner(set(lines), 0.5)
    by_order = templates.mine_templates_by_subsequence(df, F.split("m", " "), 0.5)
    got = {(r["message"], r["template"]) for r in by_order.collect()}
    again = templates.mine_templates_by_subsequence(texts(rows, *lines), F.split("m", " "), 0.5)
    assert got == {(r["message"], r["template"]) for r in again.collect()} and len(got) == len(set(lines))
    for message, template in got:  # the words between the fields are a subsequence of the message
        left = iter(message.split("\n"))
        assert all(w in left for w in template.split() if w != "<*>")
    out = templates.assign_templates(df, F.col("m"), templates.mine_templates_by_position(df, F.col("m"), 3, 0.5))
    assert out.count() == 300


@pytest.mark.parametrize("depth, threshold, max_child", [(2, 0.5, 100), (4, 0.5, 100), (4, 1.0, 3), (5, 0.3, 4), (6, 0.7, 2), (4, 1.2, 100)])
def test_lengths_are_mined_in_tasks_or_by_joins_alike(rows, monkeypatch, depth, threshold, max_child):
    """Where a task can hold all messages of a length, no word is written or shuffled by itself."""
    rng = np.random.default_rng(depth)
    words = ["a", "b", "c", "d1", "\u0663", "é", "<*>", "x<*>"]
    lines = [" ".join(rng.choice(words, size=int(rng.integers(0, 6)))) for _ in range(300)]
    lines += [f" {x}\u00a0\u2003 {x}\t" for x in lines[:40]] + ["", " ", None, lines[0]]
    df, found, stems = texts(rows, *lines), {}, []
    real = templates.written
    monkeypatch.setattr(templates, "written", lambda frame, stem: (stems.append(stem), real(frame, stem))[1])
    for size in (templates.TASK_BYTES, 3000, 0):
        monkeypatch.setattr(templates, "TASK_BYTES", size)
        out = templates.mine_templates_by_position(df, F.col("m"), depth, threshold, max_child).collect()
        found[size] = sorted(map(tuple, out))
        if len(found) == 1:
            assert "cells" not in stems
    assert "cells" in stems and len(found) == 3
    assert len(set(map(str, found.values()))) == 1 and len(found[0]) == len({x for x in lines if x is not None})


def test_lengths_in_parts_move_no_word_by_itself(spark, rows, monkeypatch):
    """Parts and their cells are packed, so the tables on the way have fewer rows than messages, let alone words."""
    rng = np.random.default_rng(8)
    words = np.array([*"abcdefgh", "<*>", *(f"w{i}" for i in range(400))])
    draw = lambda n: words[np.minimum(rng.geometric(0.05, n) - 1, len(words) - 1)]
    lines = [" ".join(draw(n)) for n in (3, 7, 130) for _ in range(150)]
    lines += [lines[200], lines[400], "left alone"]
    found = {}
    real = templates.written
    monkeypatch.setattr(templates, "written", lambda frame, stem: found.setdefault(stem, real(frame, stem)))
    monkeypatch.setattr(templates, "TASK_BYTES", 50000)
    assert mined(texts(rows, *lines), depth=3, threshold=0.5) == loop_miner(set(lines), 0.5)
    assert "parts" in [f.name for f in found["lengths"].schema] and found["lengths"].count() == 1
    n, parts = found["lengths"].first()
    assert n == 130 and parts > 10 and found["parts"].count() == parts
    assert found["cells"].count() <= parts * parts < 150 * 130 / 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_packed_parts_are_whole(monkeypatch):
    monkeypatch.setattr(templates, "PACK_BYTES", 40)
    messages = ["a b", " a  b", "c" * 90 + " d", "e 1", "e 2", "a b", "\u00e9 x"]
    plain = [None, "a b", *[None] * 5]
    head = [m.split()[0] for m in messages]
    same = lambda v: pa.array([v] * len(messages), pa.int64())
    part = templates.pack_part(pa.table({"n": same(2), "part": same(5), "parts": same(9), "message": messages,
                                         "plain": pa.array(plain, pa.string()), "head": head}))
    own = pa.concat_tables(templates.unpacked(part["data"]))
    assert len(part) > 1 and part["part"].to_pylist() == [5] * len(part) and sorted(own["message"].to_pylist()) == sorted(set(messages))
    assert [r["plain"] for r in own.to_pylist() if r["message"] == " a  b"] == ["a b"]
    assert part["heads"].to_pylist()[1:] == [None] * (len(part) - 1)
    assert dict(zip(part["heads"][0].as_py(), part["messages"][0].as_py())) == {"a": 2, "c" * 90: 1, "e": 2, "\u00e9": 1}


def test_shuffles_go_with_the_job_that_writes(spark, rows):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: disk.getAllFiles().size()
    before = files()
    with shuffles_dropped(spark):
        out = written(spark.range(5000).groupBy((F.col("id") % 70).alias("k")).count(), "counts")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and out.count() == 70


def test_templates_of_two_kinds_meet_wherever_they_stand(rows):
    df = texts(rows, "a b c1", "x y z1", "a b c2", "x y z2")
    assert set(mined(df, depth=3, threshold=0.5).values()) == {"a b <*>", "x y <*>"}
    out = templates.mine_templates_by_subsequence(df, F.split("m", " "), 0.5)
    assert {r["template"] for r in out.collect()} == {"a b <*>", "x y <*>"}


def test_subsequence_miner(rows):
    df = texts(rows, "send file one now", "send file two more now", "boot", "", None)
    out = templates.mine_templates_by_subsequence(df, F.split("m", " "), 0.5)
    assert {r["message"]: r["template"] for r in out.collect()} == {
        "send\nfile\none\nnow": "send file <*> now", "send\nfile\ntwo\nmore\nnow": "send file <*> now", "boot": "boot", "": ""
    }
    # A field stands wherever one of the messages has other words.
    df = texts(rows, "a b c1 d", "a x1 b d", "a b d")
    out = templates.mine_templates_by_subsequence(df, F.split("m", " "), 0.5)
    assert {r["template"] for r in out.collect()} == {"a <*> b <*> d"}


def test_parameters(rows):
    df = rows([("a <*> c", "a  x y   c"), ("a", "a"), ("z <*>", "nothing")], "EventTemplate string, Content string")
    got = [r["ParameterList"] for r in templates.template_params(df).collect()]
    assert got == [["x y"], [], []]


# --- count models ------------------------------------------------------------------------------


def test_back_off(rows):
    schema = "session_id string, events array<string>, next string"
    train = rows([("t", ["a", "b"], "c")] * 3 + [("t", ["x", "b"], "d")], schema)
    test = rows([("s", ["a", "b"], "c"), ("s", ["q", "b"], "c"), ("s", ["q", "q"], "d"), ("s", ["a", "b"], "d")], schema)
    ctx = counts.history_contexts("events", 2)
    model = counts.context_counts(train, ctx, "next")
    scored = counts.score(test, ctx, "next", model, 1, ["session_id"]).collect()
    got = {(r["full"], r["target"]): (r["level"], r["missed"]) for r in scored}
    assert got == {("a b", "c"): (2, False), ("a b", "d"): (2, True), ("q b", "c"): (1, False), ("q q", "d"): (0, True)}
    p = {(r["full"], r["target"]): r["p"] for r in scored}
    assert p[("a b", "c")] == 4 / 5 and p[("q q", "d")] == 2 / 6


# --- vector detectors --------------------------------------------------------------------------


def vectors(rows, x, extra=()):
    data = [(f"s{i:05d}", [float(v) for v in r]) for i, r in enumerate(x)]
    return rows(data, "seq_id string, values array<double>").withColumn("features", array_to_vector("values"))


def test_pca(rows):
    rng = np.random.default_rng(0)
    base = rng.poisson(4, size=(200, 1))
    x = np.hstack([base, 2 * base, rng.poisson(1, size=(200, 2))])
    df = vectors(rows, x)
    assert np.allclose(matrix.gram(df), x.T @ x)
    model = matrix.fit_pca(df, 2)
    u = np.linalg.svd(x.T @ x / len(x))[0][:, :2]
    want = ((x - x @ u @ u.T) ** 2).sum(axis=1)
    got = [r["spe"] for r in matrix.score_pca(df, model).orderBy("seq_id").collect()]
    assert np.allclose(got, want) and model.threshold > 0
    assert matrix.fit_pca(df, 0.8).kept == 1


def test_invariants(rows):
    rng = np.random.default_rng(0)
    a = rng.integers(1, 9, size=400)
    x = np.stack([a, a, rng.integers(0, 9, size=400), np.zeros(400)], axis=1)
    df = vectors(rows, x)
    found = matrix.fit_invariants(df, longest=2)
    assert found[(3,)] == [1.0]
    assert {tuple(np.abs(v)) for k, v in found.items() if k == (0, 1)} == {(1.0, 1.0)}
    odd = vectors(rows, [[2, 2, 5, 0], [2, 3, 5, 0], [1, 1, 0, 1]])
    got = [r["anomaly"] for r in matrix.score_invariants(odd, found).orderBy("seq_id").collect()]
    assert got == [0, 1, 1]


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_invariants_of_three_columns(rows, partitions):
    rng = np.random.default_rng(3)
    a, b, c = rng.integers(1, 9, size=(3, 300))
    df = vectors(rows, np.stack([a, b, a + b, c], axis=1)).repartition(partitions)
    found = matrix.fit_invariants(df)
    assert set(found) == {(0, 1, 2)} and found[(0, 1, 2)] in ([1.0, 1.0, -1.0], [-1.0, -1.0, 1.0])
    # Of three equal columns two pairs say everything.
    found = matrix.fit_invariants(vectors(rows, np.stack([a, a, a, c], axis=1)).repartition(partitions))
    assert sorted(found) == [(0, 1), (0, 2)]
    assert matrix.longer_sets([(0, 1), (0, 2), (1, 2), (1, 3)]) == [(0, 1, 2)]


def sparse(rows, x):
    data = [(f"s{i:05d}", [c for c, v in enumerate(r) if v], [float(v) for v in r if v]) for i, r in enumerate(x)]
    return rows(data, "seq_id string, cols array<int>, xs array<double>")


def plain_clusters(x, max_dist):
    """Leaders by falling weight, then by columns and values; each vector to its nearest leader."""
    def apart(a, b):
        d = 1 - np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-8)
        return 0.0 if d < 1e-8 else round(d, 9)

    weight = {}
    for r in map(tuple, x.tolist()):
        weight[r] = weight.get(r, 0) + 1
    rank = lambda r: (-weight[r], [c for c, v in enumerate(r) if v], [v for v in r if v])
    leaders = []
    for r in sorted(weight, key=rank):
        if all(apart(r, l) > max_dist for l in leaders):
            leaders.append(r)
    total, size = np.zeros((len(leaders), x.shape[1])), np.zeros(len(leaders), int)
    for r, n in weight.items():
        k = min(range(len(leaders)), key=lambda k: (apart(r, leaders[k]) if any(r) else float(r != leaders[k]), k))
        total[k] += n * np.array(r)
        size[k] += n
    return total / size[:, None], size


@pytest.mark.parametrize("block", [7, 256])
def test_clusters_have_no_order(rows, monkeypatch, block):
    monkeypatch.setattr(cluster, "BLOCK", block)
    rng = np.random.default_rng(0)
    x = rng.poisson(0.6, (220, 9)) * rng.integers(1, 4, (220, 9))
    x[:20] = x[20:40]
    x[100:103] = 0
    centres, size = plain_clusters(x, 0.3)
    assert len(size) > 20
    for partitions, order in ((1, x), (4, x), (16, rng.permutation(x))):
        got = cluster.fit_clusters(sparse(rows, order).repartition(partitions)).orderBy("cluster").collect()
        assert [r["size"] for r in got] == size.tolist() and [r["cluster"] for r in got] == list(range(len(size)))
        dense = np.zeros_like(centres)
        for r in got:
            dense[r["cluster"], r["cols"]] = r["xs"]
        assert np.allclose(dense, centres)


def test_cluster_scores(rows):
    x = np.array([[9, 1, 0, 0]] * 3 + [[0, 0, 9, 2]])
    found = cluster.fit_clusters(sparse(rows, x))
    odd = sparse(rows, [[9, 1, 0, 0], [0, 9, 0, 9], [0, 0, 0, 0], [0, 0, 5, 1]])
    scored = cluster.score_clusters(odd, found).orderBy("seq_id").collect()
    assert [(r["cluster"], r["anomaly"]) for r in scored] == [(0, 0), (1, 1), (0, 1), (1, 0)]
    none = cluster.fit_clusters(sparse(rows, x).limit(0))
    assert none.count() == 0 and {r["anomaly"] for r in cluster.score_clusters(odd, none).collect()} == {1}


def test_forest(rows):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, size=(400, 2)), [[9, 9], [-8, 9]]])
    df = vectors(rows, x)
    nodes = forest.fit_forest(df, "seq_id", trees=40, max_samples=64, seed=3)
    assert nodes.groupby("tree").size().max() < 128 and nodes["tree"].nunique() == 40
    assert (nodes[nodes["node"] == 0]["size"] == 64).all()
    scored = forest.score_forest(df, nodes, contamination=0.005).orderBy(F.desc("score")).limit(2).collect()
    assert {r["seq_id"] for r in scored} == {"s00400", "s00401"}
    assert all(r["anomaly"] == 1 for r in scored)
    again = forest.fit_forest(df.repartition(3), "seq_id", trees=40, max_samples=64, seed=3)
    assert nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(again.sort_values(["tree", "node"]).reset_index(drop=True))


def test_forest_cut_comes_from_training_rows(rows):
    usual = [(f"s{i}", [float(i % 5), 1.0]) for i in range(200)] + [("o", [90.0, 80.0])]
    df = rows(usual, "seq_id string, values array<double>")
    nodes = forest.fit_forest(df, "seq_id", trees=100, max_samples=64, seed=3)
    odd = rows([("x", [90.0, 80.0]), ("y", [2.0, 1.0]), ("z", [85.0, 95.0])], "seq_id string, values array<double>")
    flags = {r["seq_id"]: r["anomaly"] for r in forest.score_forest(odd, nodes, train=df).collect()}
    assert flags == {"x": 1, "y": 0, "z": 1}


def test_counters_sum_over_all_chunks_of_a_long_window(rows):
    from logloom.operators.vocab import mask_rows

    df = rows([("w", k, k // 32, 5 + k % 3, 0.0) for k in range(100)], "seq_id string, pos int, chunk long, idx long, dt double")
    masked = mask_rows(df, 0.65)
    near = counts.visible_neighbours(masked, chunk="chunk")
    scored = near.select("seq_id", F.lit(1).cast("long").alias("m"), (F.col("pos") % 2 == 0).alias("missed"))
    got = counts.masked_counters(masked, scored, chunk="chunk").first()
    hidden = [r["pos"] for r in masked.filter("bert_label > 0").collect()]
    assert got["masked_tokens"] == len(hidden) > 50 and max(hidden) > 90
    assert got["undetected_tokens"] == sum(p % 2 == 0 for p in hidden) and got["total_logkey"] == 104
    first = {r["chunk"]: r["before"] for r in near.orderBy("pos").collect() if r["pos"] % 32 == 0}
    assert set(first.values()) <= {3}


def test_linear_svm_is_at_its_optimum(spark):
    """Slopes of the loss are one against each weight that stays, and at most one at weights of zero."""
    c, rng = 0.05, np.random.default_rng(5)
    x = rng.poisson([0.5, 3, 1, 20, 0.2, 0], (300, 6)).astype(float)
    y = np.where(x[:, 0] * 2 + x[:, 2] - 2 + rng.normal(0, 0.5, 300) > 0, 1, 0)
    rows = [(int(v), [i for i in range(6) if r[i]], [float(q) for q in r if q]) for v, r in zip(y, x)]
    df = spark.createDataFrame([*rows, (None, [0], [9.0])], "label int, cols array<int>, xs array<double>").repartition(4)
    w = supervised.fit_linear_svm(df, c, 300, 1e-3)
    full, sign = np.c_[x[:, : len(w) - 1], np.ones(300)], 2 * y - 1
    slope = c * full.T @ (-2 * sign * np.maximum(0, 1 - sign * (full @ w)))
    assert len(w) == 6 and np.count_nonzero(np.abs(w) > 1e-9) >= 2
    zero = w == 0
    assert (np.abs(slope[zero]) <= 1 + 1e-3).all()
    assert np.allclose(slope[~zero], -np.sign(w[~zero]), atol=1e-2)
    got = supervised.linear_svm(df, df, c).filter("label is not null").agg({"margin": "count"}).first()[0]
    assert got == 300


def test_linear_svm_of_odd_tables(spark):
    schema = "label int, cols array<int>, xs array<double>"
    assert supervised.fit_linear_svm(spark.createDataFrame([], schema)).tolist() == [0.0]
    empty = spark.createDataFrame([(1, [], []), (0, [], [])], schema)
    assert supervised.linear_svm(empty, empty).filter("anomaly = 1").count() == 0
