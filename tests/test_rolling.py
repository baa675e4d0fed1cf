import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbre.operators import rolling


def test_forest_against_plain_sums():
    g = np.random.default_rng(1)
    pos = np.unique(g.integers(0, 5000, 700))
    val = g.integers(-5, 9, (len(pos), 2))
    f = rolling.Forest(pos, val)
    lo, hi = g.integers(-100, 5200, 400), g.integers(-100, 5200, 400)
    got = f.range_sum(lo, hi)
    for a, b, s in zip(lo, hi, got, strict=True):
        assert (s == val[(pos >= a) & (pos < b)].sum(axis=0)).all()


def acts(seed, n=400, entities=6, members=5, days=300):
    r = random.Random(seed)
    return [(r.randrange(entities), f"m{r.randrange(members)}", r.randrange(days), "z") for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_days_with_members_against_brute_force(spark, seed):
    data = acts(seed)
    df = spark.createDataFrame(data, "e int, m string, d int, dia string")
    got = {(r["e"], r["window"], r["d"], r["members"]) for r in rolling.days_with_members(df, "e", "m", "d", (7, 30), 3).collect()}
    want = set()
    for e in range(6):
        for w in (7, 30):
            for d in range(0, 340):
                k = len({m for x, m, t, _ in data if x == e and d - w < t <= d})
                if k >= 3:
                    want.add((e, w, d, k))
    assert got == want


def test_trailing_totals_cover_silent_days(spark):
    df = spark.createDataFrame([(1, 10, 5), (1, 12, 7), (1, 60, None), (2, 3, 1), (None, 3, 1), (2, None, 1)], "e int, d int, v int")
    got = {(r["e"], r["d"]): (r["v_7"], r["v_30"]) for r in rolling.trailing_totals(df, "e", "d", ["v"], (7, 30), last_day=20).collect()}
    assert got[(1, 10)] == (5, 5) and got[(1, 11)] == (5, 5) and got[(1, 16)] == (12, 12) and got[(1, 17)] == (7, 12) and got[(1, 41)] == (0, 7)
    assert (1, 60) in got and (2, 20) in got and (2, 21) not in got and len([k for k in got if k[0] == 1]) == 51


def test_running_columns(spark):
    df = spark.createDataFrame([(1, 10, 5, 1), (1, 13, 2, 1), (1, 14, 0, -2), (2, 12, 1, 4)], "e int, d int, v int, c int")
    got = {(r["e"], r["d"]): (r["v_2"], r["c"]) for r in rolling.trailing_totals(df, "e", "d", ["v"], (2,), running=("c",)).collect()}
    assert got == {(1, 10): (5, 1), (1, 11): (5, 1), (1, 12): (0, 1), (1, 13): (2, 2), (1, 14): (2, 0), (2, 12): (1, 4)}


def test_totals_before_1970_and_negative_values(spark):
    df = spark.createDataFrame([(-3, -400, -5), (-3, -398, 2)], "e int, d int, v int")
    got = {r["d"]: r["v_7"] for r in rolling.trailing_totals(df, "e", "d", ["v"], (7,)).collect()}
    assert got == {-400: -5, -399: -5, -398: -3}


def test_empty(spark):
    df = spark.createDataFrame([], "e int, m string, d int")
    assert rolling.days_with_members(df, "e", "m", "d").count() == 0
    assert rolling.trailing_totals(df.withColumn("v", F.lit(1)), "e", "d", ["v"]).count() == 0


def test_nodes_corrections_and_queries(spark):
    data = acts(3, days=1500)
    df = spark.createDataFrame([(e, d, i % 7) for i, (e, _, d, _) in enumerate(data)], "e int, d int, v int")
    early, late = df.filter("v < 4"), df.filter("v >= 4")
    nodes = rolling.correct_nodes(rolling.tree_nodes(early, "e", "d", ["v"]), late, "e", "d", ["v"])
    full = rolling.tree_nodes(df, "e", "d", ["v"])
    key = lambda n: {(r["e"], r["shard"], r["level"], r["node"]): r["v"] for r in n.collect()}
    assert key(nodes) == key(full)
    touched = rolling.tree_nodes(late, "e", "d", ["v"]).count()
    assert touched <= late.select("e", "d").distinct().count() * (rolling.LEVELS + 1)
    r = random.Random(5)
    asked = [(None, 1, 5), (1, None, 5), (1, 3, 3), (1, 3, 3)]
    asked += [(r.randrange(7), a := r.randrange(-50, 1500), a + r.randrange(0, 1200)) for _ in range(60)]
    q = spark.createDataFrame(asked, "e int, a int, b int")
    plain = [(e, d, i % 7) for i, (e, _, d, _) in enumerate(data)]
    for x in rolling.query_nodes(nodes, q, "e", "a", "b", ["v"]).collect():
        ok = x["e"] is not None and x["a"] is not None
        assert x["v"] == (sum(v for e, d, v in plain if e == x["e"] and x["a"] <= d <= x["b"]) if ok else 0)
    assert rolling.query_nodes(nodes, q, "e", "a", "b", ["v"]).count() == 64


def _brute(acts, windows, least):
    out = set()
    for e in {a[0] for a in acts}:
        for w in windows:
            days = {d + k for x, _, d in acts if x == e for k in range(w)}
            for d in days:
                if len({m for x, m, t in acts if x == e and d - w < t <= d}) >= least:
                    out.add((e, w, d))
    return out


def test_far_dates_and_shards_leave_other_entities_alone(spark):
    r = random.Random(12)
    acts = [(e, f"m{r.randrange(6)}", r.choice([500, 505, 511, 512, 515, 1023, 1024, 1500]) + r.randrange(4)) for e in range(1, 5) for _ in range(40)]
    acts += [(2, "x", -711_000), (2, "y", -711_001), (2, "z", -710_999), (3, "x", 2_932_000), (3, "y", 2_932_000)]
    df = spark.createDataFrame(acts, "e int, m string, d int")
    got = {(x["e"], x["window"], x["d"]) for x in rolling.days_with_members(df, "e", "m", "d", (7, 30), 3).collect()}
    assert got == _brute(acts, (7, 30), 3)
    near = [(e, d, 1) for e, _, d in acts if abs(d) < 5000 and e in (1, 4)] + [(9, -711_000, 5)]
    leaves = spark.createDataFrame(near, "e int, d int, v int").groupBy("e", "d").agg(F.sum("v").alias("v"))
    tot = rolling.trailing_totals(leaves.withColumn("r", F.col("v")), "e", "d", ["v"], (7, 600), running=("r",))
    rows = {(x["e"], x["d"]): (x["v_7"], x["v_600"], x["r"]) for x in tot.collect()}
    for e in (1, 4):
        mine = [(d, n) for x, d, n in near if x == e]
        lo, hi = min(mine)[0], max(mine)[0]
        assert {d for x, d in rows if x == e} == set(range(lo, hi + 1))
        for d in range(lo, hi + 1):
            want = tuple(sum(n for t, n in mine if d - w < t <= d) for w in (7, 600, 10**6))
            assert rows[(e, d)] == want
    assert rows[(9, -711_000)] == (5, 5, 5)


def test_one_buyer_with_a_third_of_all_rows_is_combined_first(spark):
    acts = spark.range(3000).select(F.lit(1).alias("e"), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("="), F.col("id").cast("string"))).alias("m"), (F.col("id") % 5).cast("int").alias("d"))
    plan = rolling.presence_deltas(acts, "e", "m", "d", (7,))._jdf.queryExecution().executedPlan().toString()
    lines = [x.strip(" :+-*()0123456789") for x in plan.splitlines()]
    lowest = next(i for i in range(len(lines) - 1, -1, -1) if lines[i].startswith("Exchange"))
    assert lines[lowest + 1].startswith("HashAggregate"), plan  # partial step below the first exchange
