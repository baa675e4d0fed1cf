import random

import pytest
from pyspark.sql import functions as F

from lumbre.llm.nearest import nearest_in_time

LEFT, RIGHT = "caso long, e int, d date, id string, match string", "id long, e int, fin date, d string, e2 int"


def run(spark, left, right, tol=50, **kw):
    got = nearest_in_time(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "e", "d", "e", "fin", "id", tol, **kw)
    assert got.columns == ["caso", "e", "d", "id", "match", "match_id", "match_days"]
    return got.collect()


@pytest.mark.parametrize(("seed", "tol"), [(1, 50), (2, 7), (3, 0)])
def test_against_brute_force(spark, day, seed, tol):
    r = random.Random(seed)
    right = [(i, r.choice([1, 1, 1, 2, 3]), day(r.randrange(30) * 31 + r.randrange(3)), "x", 0) for i in range(120)]
    left = [(i, r.choice([1, 1, 2, 4]), day(r.randrange(-40, 1000)), "k", None) for i in range(200)]
    got = run(spark, left, right, tol, buckets=5)
    assert len(got) == 200
    for x in got:
        ok = [(abs((f - x["d"]).days), f, i) for i, e, f, _, _ in right if e == x["e"] and abs((f - x["d"]).days) <= tol]
        assert x["match_id"] == (min(ok)[2] if ok else None) and x["match_days"] == (min(ok)[0] if ok else None)


def test_ties_nulls_repeats_and_empty(spark, day):
    right = [(9, 1, day(90), "a", 1), (8, 1, day(90), "a", 1), (3, 1, day(110), "a", 1), (1, None, day(100), "a", 1), (2, 1, None, "a", 1), (None, 1, day(100), "a", 1)]
    left = [(1, 1, day(100), None, None), (1, 1, day(100), None, None), (2, None, day(100), None, None), (3, 1, None, None, None), (4, 1, day(141), None, None)]
    got = {(x["caso"], x["match_id"]) for x in run(spark, left, right, 30)}
    assert got == {(1, 8), (2, None), (3, None), (4, None)}
    assert [x["match_id"] for x in run(spark, left[:1], [], 30)] == [None]
    assert run(spark, [], right, 30) == []


def test_one_hot_entity_over_many_blocks(spark, day):
    right = [(i, 1, day(i * 3), "x", 0) for i in range(1000)]
    left = [(i, 1, day(i), "k", None) for i in range(3000)]
    got = {x["caso"]: x["match_id"] for x in run(spark, left, right, 2)}
    assert all(got[i] == min(999, (i + 1) // 3) for i in range(2998))


def test_dates_only(spark):
    df = spark.range(1).select(F.col("id"), F.current_timestamp().alias("d"))
    with pytest.raises(TypeError):
        nearest_in_time(df, df, "id", "d", "id", "d", "id", 5)
