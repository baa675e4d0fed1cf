import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumbre.operators import asof, cluster, components, series, upsert


# clusters -----------------------------------------------------------------


def brute(rows, w, n):
    rows = sorted([r for r in rows if r[1] is not None], key=lambda r: r[1])
    if len(rows) < n:
        return False, 0, None
    best = 0
    for _, a in [(m, d) for m, d in rows]:
        first = {}
        for m, d in rows:
            if a <= d <= a + dt.timedelta(days=w):
                first.setdefault(m, d)
        best = max(best, len(first))
        if len(first) >= n:
            return True, len(first), sorted(first.values())[n - 1]
    return False, best, None


@pytest.mark.parametrize("seed", [1, 2])
def test_first_clusters_against_brute_force(spark, day, seed):
    r = random.Random(seed)
    data = [(e, r.choice([None, "A", "B", "C", "D"]), day(r.randrange(600))) for e in range(40) for _ in range(r.randrange(1, 9))]
    data += [(1, "A", None), (None, "A", day(1))]
    got = cluster.first_clusters(spark.createDataFrame(data, "e int, m string, d date"), "e", "m", "d", 60, 3)
    for x in got.collect():
        want = brute([(m, d) for e, m, d in data if e == x["e"]], 60, 3)
        assert (x["found"], x["members_max"], x["detected"]) == want, x
    assert got.count() == 40


def test_cluster_edges(spark, day):
    c = lambda rows: cluster.first_clusters(spark.createDataFrame([(1, m, day(d)) for m, d in rows], "e int, m string, d date"), "e", "m", "d", 60, 3).first()
    assert c([("A", 0), ("B", 20), ("C", 60)])["detected"] == day(60)
    assert not c([("A", 0), ("B", 20), ("C", 61)])["found"]
    assert not c([("A", 0), ("A", 4), ("A", 8)])["found"]
    assert c([("A", 5), ("B", 5), (None, 5)])["detected"] == day(5)


def test_titles(spark):
    rows = [("President & CEO", True), ("EVP and Chief Financial Officer", True), ("Vice President of Sales", False), ("SVP, Finance", False), ("Vice Chairman", False), ("Director", False), (None, False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    hit = cluster.mentions("t", ("CHIEF EXECUTIVE", "CEO", "CHIEF FINANCIAL", "PRESIDENT", "CHAIRMAN"), ("VICE PRESIDENT", "VICE CHAIRMAN"), r"\b[SEA]?VP\b")
    assert df.filter(hit != F.col("want")).count() == 0


# as-of and intervals --------------------------------------------------------


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("tol", [None, 9])
def test_asof_against_brute_force(spark, day, forward, tol):
    r = random.Random(7)
    left = [(i, r.choice([1, 1, 1, 2, None]), day(r.randrange(900)), "v") for i in range(200)]
    right = [(r.choice([1, 1, 2, 3]), day(r.randrange(900)), i) for i in range(150)]
    got = asof.asof(spark.createDataFrame(left, "i int, k int, d date, v string"), spark.createDataFrame(right, "k int, d date, x int"), "k", "d", "d", ["x"], forward=forward, tolerance=tol)
    res = {x["i"]: x["x"] for x in got.collect()}
    assert len(res) == 200
    for i, k, d, _ in left:
        ok = [(abs((e - d).days), -x, x) for kk, e, x in right if kk == k and (e >= d if forward else e <= d) and (tol is None or abs((e - d).days) <= tol)]
        assert res[i] == (min(ok)[2] if ok else None)


def test_asof_empty(spark, day):
    l = spark.createDataFrame([(1, day(0))], "k int, d date")
    assert asof.asof(l, spark.createDataFrame([], "k int, d date, x int"), "k", "d", "d", ["x"]).first()["x"] is None
    assert asof.asof(l.limit(0), l.withColumn("x", F.lit(1)), "k", "d", "d", ["x"]).count() == 0


def test_interval_join(spark, day):
    r = random.Random(3)
    left = [(i, r.choice([1, 2, None]), day(r.randrange(300))) for i in range(60)]
    right = [(j, r.choice([1, 2]), day(r.randrange(300))) for j in range(80)]
    got = asof.interval_join(spark.createDataFrame(left, "i int, k int, d date"), spark.createDataFrame(right, "j int, k int, d date"), "k", "d", "d", 30, 5, ["j"])
    want = sorted((i, j) for i, k, d in left for j, kk, e in right if k == kk and -30 <= (e - d).days <= 5)
    assert sorted((x["i"], x["j"]) for x in got.collect()) == want


# versions -------------------------------------------------------------------


def test_latest_and_upserts_are_idempotent(spark):
    t = spark.createDataFrame([(1, 1, "a", 10), (1, 2, "b", 20)], "k int, v int, s string, keep int")
    new = spark.createDataFrame([(1, 5, "c", 99), (1, 4, "z", 98), (2, 7, "d", 30)], "k int, v int, s string, keep int")
    assert {tuple(r) for r in upsert.latest(t, ["k"], [F.col("v")]).collect()} == {(1, 2, "b", 20)}
    base = t.filter("v = 2")
    once = upsert.upsert(base, new, ["k"], [F.col("v")], ["v", "s"])
    assert {tuple(r) for r in once.collect()} == {(1, 5, "c", 20), (2, 7, "d", 30)}
    twice = upsert.upsert(once, new, ["k"], [F.col("v")], ["v", "s"])
    assert {tuple(r) for r in twice.collect()} == {tuple(r) for r in once.collect()}
    ins = upsert.insert_absent(base, new, ["k"])
    assert {tuple(r) for r in ins.collect()} == {(1, 2, "b", 20), (2, 7, "d", 30)}
    assert {tuple(r) for r in upsert.insert_absent(ins, new, ["k"]).collect()} == {tuple(r) for r in ins.collect()}
    assert upsert.latest(t.limit(0), ["k"], [F.col("v")]).count() == 0


# series ---------------------------------------------------------------------


def test_growth_halves(spark):
    acc = [(1, 2024 * 4 + i, v) for i, v in enumerate([100, 105, 116, 135, 170, 230])]
    gap = [(2, 2023 * 4 + q, v) for q, v in ((2, 100), (3, 500), (6, 120), (7, 130), (8, 140))]
    few = [(3, 1, 5), (3, 2, 0), (3, 3, None), (3, 4, 6)]
    got = {r["e"]: r for r in series.growth_halves(spark.createDataFrame(acc + gap + few, "e int, q int, v int"), "e", "q", "v").collect()}
    assert got[1]["tasas"] == 5 and got[1]["media_reciente"] > got[1]["media_antigua"]
    assert got[2]["tasas"] == 3 and abs(got[2]["media_antigua"] - 4.0) < 1e-9
    assert 3 not in got


def test_medians_against_sorting(spark):
    r = random.Random(4)
    data = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, 0.0, float("nan"), r.uniform(-50, 50), r.uniform(-1e9, 1e9), 7.5, 1e-12])) for _ in range(700)] + [("c", 2.0), ("d", None)]
    got = {x["g"]: (x["n"], x["bajo"], x["alto"]) for x in series.medians(spark.createDataFrame(data, "g string, v double"), ["g"], "v").collect()}
    for g in ("a", "b", None, "c"):
        v = sorted(x for k, x in data if k == g and x is not None and x == x)
        assert got[g] == (len(v), v[(len(v) - 1) // 2], v[len(v) // 2])
    assert "d" not in got
    assert series.medians(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_systematic_sample(spark):
    got = sorted(r["id"] for r in series.systematic_sample(spark.range(103), [F.col("id")], 10).collect())
    assert got == [i * 103 // 10 for i in range(10)]
    assert series.systematic_sample(spark.range(0), [F.col("id")], 10).count() == 0
    assert series.systematic_sample(spark.range(3), [F.col("id")], 10).count() == 3


def test_pending_work(spark):
    c = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    done = spark.createDataFrame([(1, "a", 5), (1, "b", 9), (2, "a", 5), (2, "b", 5)], "k int, m string, t int")
    news = [spark.createDataFrame([(1, 7), (2, None)], "k int, t int"), spark.createDataFrame([(2, 5)], "k int, t int")]
    got = {(r["k"], r["m"]) for r in series.pending_work(c, done, news, "k", ["a", "b"], "m", "t").collect()}
    assert got == {(1, "a"), (3, "a"), (3, "b")}


# components -----------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    edges += [(2000, 2000 + i) for i in range(1, 80)]
    par = {}

    def f(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            par[max(f(a), f(b))] = min(f(a), f(b))
    got = {x["id"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: f(x) for x in par}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
