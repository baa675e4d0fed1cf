import random

import pytest
from pyspark.sql import functions as F

from lumbre.operators import pit

EV = "caso long, e int, d date, id string, r string"
AT = "id long, e int, fin date, filed date, shares long, d string"


def run(spark, ev, at):
    a = spark.createDataFrame(at, AT)
    got = pit.as_known(spark.createDataFrame(ev, EV), a, "e", "d", "e", "filed", [F.col("fin"), F.col("filed")], "id", ["id", "shares"], "m_")
    assert got.columns == ["caso", "e", "d", "id", "r", "m_id", "m_shares"]
    return {r["caso"]: r["m_id"] for r in got.collect()}, got.count()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, day, seed):
    r = random.Random(seed)
    at = [(i, r.choice([1, 1, 1, 2, 3]), day(r.randrange(20) * 90), day(r.randrange(2000)), i, "x") for i in range(200)]
    ev = [(i, r.choice([1, 1, 2, 3, 4]), day(r.randrange(2200)), "k", None) for i in range(150)]
    got, n = run(spark, ev, at)
    assert n == 150
    for c, e, d, _, _ in ev:
        ok = [x for x in at if x[1] == e and x[3] <= d]
        assert got[c] == (max(ok, key=lambda x: (x[2], x[3], -x[0]))[0] if ok else None)


def test_nulls_ties_repeats_and_empty(spark, day):
    at = [(5, 1, day(10), day(50), 7, None), (4, 1, day(10), day(50), 8, None), (6, None, day(10), day(50), 9, None), (7, 1, day(99), None, 9, None)]
    got, n = run(spark, [(1, 1, day(50), "a", "b"), (1, 1, day(50), "a", "b"), (2, 1, day(49), None, None), (3, None, day(60), None, None), (4, 1, None, None, None)], at)
    assert got == {1: 4, 2: None, 3: None, 4: None} and n == 5
    assert run(spark, [(1, 1, day(50), "a", "b")], [])[0] == {1: None}
    assert run(spark, [], at)[0] == {}


def test_dates_only(spark):
    df = spark.sql("SELECT 1L caso, 1 e, timestamp '2020-01-01' d, 1L id, current_date() filed")
    with pytest.raises(TypeError):
        pit.as_known(df, df, "e", "d", "e", "filed", [F.col("filed")], "id", ["id"])


def test_entity_of_ticker(spark):
    cases = spark.createDataFrame([(1, 5, "A"), (2, None, "B"), (3, None, None), (4, None, "ZZ")], "c int, empresa_id int, ticker string")
    names = spark.createDataFrame([(7, "B"), (6, "B"), (5, "A"), (9, None)], "id int, ticker string")
    assert {r["c"]: r["empresa_id"] for r in pit.with_entity(cases, names).collect()} == {1: 5, 2: 6, 3: None, 4: None}
