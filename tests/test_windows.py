import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import windows

TIMES = [0, 1, 5, 6, 20]


def ranges(members, key):
    found = members.groupBy(key).agg(F.min("line").alias("a"), F.max("line").alias("b")).collect()
    return sorted((r["a"] - 1, r["b"]) for r in found)


def anchored(times, size, step):
    out, i = [], 0
    while i < len(times):
        end = next((j for j in range(i, len(times)) if times[j] >= times[i] + size), len(times))
        out.append((i, end))
        i = next((j for j in range(i, len(times)) if times[j] >= times[i] + step), len(times))
    return out


def grid(times, size, step):
    out, k = set(), 0
    while True:
        low, high = times[0] + k * step, times[0] + k * step + size
        inside = [i for i, t in enumerate(times) if low <= t < high]
        if inside:
            out.add((inside[0], inside[-1] + 1))
        if high > times[-1]:
            return sorted(out)
        k += 1


def hourly(times, size, step):
    n = len(times)
    first = sum(t < times[0] + size for t in times)
    if first == n:
        return []
    out, a, b, low, high = [(0, first)], 0, first, times[0], times[first - 1]
    while b < n:
        low, high = low + step, high + step
        a = min(next((i for i in range(n) if times[i] >= low), n), b)
        b = next((i for i in range(n) if times[i] >= high), n)
        out.append((a, b))
    return out


def random_logs(count, seed):
    rng = np.random.default_rng(seed)
    for _ in range(count):
        gaps = rng.choice([0, 1, 2, 5, 9, 40], size=int(rng.integers(1, 60)))
        yield np.cumsum(gaps).tolist(), int(rng.integers(1, 20)), int(rng.integers(1, 20))


def test_time_windows_golden(log):
    assert ranges(windows.time_windows(log(TIMES), 5, 3), "start") == [(0, 2), (2, 4), (4, 5)]


def test_time_windows_match_a_loop_with_tiny_blocks(spark, log):
    cases = list(random_logs(12, 5))
    for size, step, block in ((5, 3, 7), (4, 11, 5), (12, 2, 3)):
        frames, want = None, {}
        for i, (times, _, _) in enumerate(cases):
            df = log(times, project=f"p{i}")
            frames = df if frames is None else frames.unionByName(df)
            want[f"p{i}"] = anchored(times, size, step)
        rows = windows.ordered_rows(frames)
        starts = windows.time_window_starts(rows, step, ["project"], block_seconds=block)
        members = windows.window_membership(rows, starts, size, ["project"])
        found = members.groupBy("project", "start").agg(F.min("line").alias("a"), F.max("line").alias("b")).collect()
        got = {}
        for r in found:
            got.setdefault(r["project"], []).append((r["a"] - 1, r["b"]))
        assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("step,gaps", [(3, 4), (11, 400)])
def test_window_starts_over_many_long_blocks(spark, step, gaps):
    times = np.cumsum(np.random.default_rng(5).integers(0, gaps, 3000)).tolist()
    want, wanted = [], -1
    for i, t in enumerate(times):
        if t >= wanted:
            want.append((t, i))
            wanted = t + step
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(times)], "project string, row_index long, t long")
    got = windows.time_window_starts(df, step, block_seconds=20).collect()
    assert sorted((r["start"], r["first_index"]) for r in got) == want


def test_positions_and_first_gap(log):
    members = windows.time_windows(windows.ordered_rows(log(TIMES)), 5, 3)
    got = sorted((r["start"], r["pos"], r["line"]) for r in members.collect())
    assert got == [(0, 0, 1), (0, 1, 2), (5, 0, 3), (5, 1, 4), (20, 0, 5)]


def test_count_windows(log):
    members = windows.count_windows(log(TIMES), 2)
    assert ranges(members, "window") == [(0, 2), (2, 4)]
    assert ranges(windows.count_windows(log(range(10)), 4, 3), "window") == [(0, 4), (3, 7), (6, 10)]
    assert windows.count_windows(log(TIMES), 6).count() == 0
    with pytest.raises(ValueError):
        windows.count_windows(log(TIMES), 0)


def test_grid_windows(log):
    assert ranges(windows.grid_windows(log(TIMES), 5, 3), "window") == [(0, 2), (2, 4), (3, 4), (4, 5)]
    for times, size, step in random_logs(6, 11):
        assert ranges(windows.grid_windows(log(times), size, step), "window") == grid(times, size, step)


def test_hourly_windows(log):
    for times, size, step in [(TIMES, 5, 3), *random_logs(6, 17)]:
        hours = [t * 3600 for t in times]
        members, found = windows.hourly_windows(log(hours), size, step)
        want = hourly(hours, size * 3600, step * 3600)
        assert found.count() == len(want)
        assert ranges(members, "window") == sorted((a, b) for a, b in want if a < b)
    members, found = windows.hourly_windows(log([h * 3600 for h in TIMES]), 5, 3)
    assert (found.count(), found.filter("n = 0").count()) == (8, 5)


def test_summaries_are_those_of_the_long_form(log):
    for times, size, step in random_logs(3, 23):
        rows = log(times).withColumn("label", (F.col("line") % 5 == 0).cast("int"))
        for spans in (windows.count_spans(rows, 4, 3), windows.grid_spans(rows, size, step)):
            plain = windows.spread(spans).groupBy("project", "window").agg(
                F.count("line").alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.max("label").alias("label")
            )
            got = windows.span_summaries(spans).select(plain.columns)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_no_join_or_window_on_project_alone(spark, log):
    rows = windows.ordered_rows(log(range(30)))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (windows.count_spans(rows, 4, 3), windows.grid_spans(rows, 5, 3), windows.hourly_spans(rows, 0.002, 0.001)[0]):
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            joins = [line for line in plan.splitlines() if "Join " in line]
            assert joins and all("_block0" in line for line in joins)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_window_arrays(rows):
    df = rows([("w", 1, 10, "a", 7.0, 0), ("w", 2, 11, "b", 1.0, 1)], "k string, line long, t long, event string, dt double, label int")
    out = windows.window_arrays(df, ["k"]).first()
    assert (out["events"], out["dts"], out["label"]) == (["a", "b"], [0.0, 1.0], 1)


def test_next_event_windows(rows):
    schema = "session_id string, pos long, event string"
    data = [("s", i, e) for i, e in enumerate("abcd")] + [("t", 0, "a")]
    got = {
        (r["session_id"], r["start"]): (r["events"], r["next"])
        for r in windows.next_event_windows(rows(data, schema), 2).collect()
    }
    assert got == {
        ("s", 0): (["a", "b"], "c"),
        ("s", 1): (["b", "c"], "d"),
        ("s", 2): (["c", "d"], "#Pad"),
        ("t", 0): (["a", "#Pad"], "#Pad"),
    }


def test_next_event_windows_across_position_blocks(rows):
    events = [f"e{i % 5}" for i in range(40)]
    df = rows([("hot", i, e) for i, e in enumerate(events)], "session_id string, pos long, event string")
    placed = windows.context_blocks(df, "session_id", 3, block=6)
    assert placed.filter("_own").count() == 40
    assert placed.groupBy("_block").count().agg(F.max("count")).first()[0] <= 9


def test_chunk_pad(rows):
    df = rows([(["a", "b", "c"], [3.0, 1.0, 2.0])], "events array<string>, dts array<double>")
    out = windows.chunk_pad(df, 5).first()
    assert out["events"] == ["a", "b", "c", "<pad>", "<pad>"]
    assert out["dts"] == [0.0, 1.0, 2.0, 0.0, 0.0]
    cut = windows.chunk_pad(df, 5, 2).orderBy("chunk").collect()
    assert [r["events"][:2] for r in cut] == [["a", "b"], ["c", "<pad>"]]
    assert cut[1]["dts"][0] == 2.0
    assert windows.chunk_pad(df, 5, None, 4).count() == 0


def test_equivalent_window(log):
    times = [0, *[round(i * 10) for i in range(1, 100)], 1000]
    out = windows.equivalent_window(log(times), "time", 100, 50, "fixed").first()
    assert (out["window_size"], out["step_size"]) == (10, 5)
    with pytest.raises(ValueError):
        windows.equivalent_window(log(times), "time", 1, 1, "time")
    with pytest.raises(Exception):
        windows.equivalent_window(log([5, 5]), "time", 1, 1, "fixed").collect()
