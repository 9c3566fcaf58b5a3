import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from logloom.functions.order import choose_first, exact_percentiles, index_rows, line_block, seeded_hash


def test_index_and_previous_across_blocks_with_a_hot_key(rows):
    data = [("hot" if i % 3 else f"k{i % 7}", i + 1, i * 10) for i in range(200)]
    df = rows(data, "key string, line long, v long")
    out = index_rows(df, [F.col("line")], [line_block("line", 9)], ["key"], previous=["v"]).collect()
    seen = {}
    for r in sorted(out, key=lambda r: r["line"]):
        last = seen.get(r["key"], [])
        assert r["row_index"] == len(last)
        assert (r["previous"]["v"] if r["previous"] else None) == (last[-1] if last else None)
        seen.setdefault(r["key"], []).append(r["v"])


def test_index_without_keys(rows):
    df = rows([(i,) for i in range(57)], "line long")
    out = index_rows(df, [F.col("line")], [line_block("line", 5)])
    assert all(r["line"] == r["row_index"] for r in out.collect())


def test_choose_first_takes_the_exact_number(rows):
    df = rows([(i, f"g{i % 3 == 0}") for i in range(500)], "id long, g string")
    key = seeded_hash(7, "id")
    whole = choose_first(df, key, "id", lambda n: F.floor(n * F.lit(0.37))).filter("chosen")
    want = sorted((r["k"], r["id"]) for r in df.withColumn("k", key).collect())[:185]
    assert {r["id"] for r in whole.collect()} == {i for _, i in want}
    each = choose_first(df, key, "id", lambda n: F.lit(11), ["g"]).filter("chosen")
    assert [r["count"] for r in each.groupBy("g").count().collect()] == [11, 11]
    assert choose_first(df, key, "id", lambda n: F.lit(0)).filter("chosen").count() == 0
    assert choose_first(df, key, "id", lambda n: n).filter("chosen").count() == 500


def test_percentiles_match_numpy(rows):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=150_000), rng.normal(size=3000), np.r_[np.zeros(900), rng.exponential(size=50)], np.array([4.0])):
        df = rows(pd.DataFrame({"v": values}), "v double")
        probs = [0.0, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
        got = {r["p"]: r["value"] for r in exact_percentiles(df, "v", probs).collect()}
        want = np.percentile(values, [100 * p for p in probs])
        assert np.allclose([got[p] for p in probs], want)


def test_rows_with_null_keys_stay(rows):
    df = rows([("p", 1), (None, 2), (None, 3)], "key string, line long")
    out = index_rows(df, [F.col("line")], [line_block("line", 2)], ["key"]).collect()
    assert sorted((r["line"], r["row_index"]) for r in out) == [(1, 0), (2, 0), (3, 1)]
