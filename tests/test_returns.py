import datetime as dt

import pytest

from lumbre.plans import registry


def write(spark, folder, day, events):
    """Events of (user, day, value); those of day 0 are purchases."""
    rows = [(i, dt.datetime.combine(day(k), dt.time(9)), u, "purchase" if k == 0 else "click", v) for i, (u, k, v) in enumerate(events)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")


def run(spark, folder, name):
    return registry.queries()[name](spark, str(folder)).collect()


def test_horizons_leave_out_what_began_at_zero(spark, tmp_path, day):
    write(spark, tmp_path, day, [(1, 0, 10.0), (1, 7, 0.0), (1, 19, 5.0), (2, 0, 10.0), (2, 7, 10.0), (2, 19, 20.0), (2, 31, 30.0)])
    got = {r["dias"]: tuple(r)[1:] for r in run(spark, tmp_path, "a6_horizons")}
    assert got == {12: (1, 1.0, 1.5, -0.5, 0.0, 1, -0.5), 24: (1, 2.0, 5.0, -3.0, 0.0, 1, -3.0)}


def test_a_horizon_without_any_return(spark, tmp_path, day):
    write(spark, tmp_path, day, [(1, 0, 10.0), (1, 7, 0.0), (1, 19, 5.0), (1, 31, 5.0)])
    for r in run(spark, tmp_path, "a6_horizons"):
        assert (r["n"], r["excluidos"]) == (0, 1) and r["superan"] != r["superan"]
        assert [r[c] for c in ("retorno", "referencia", "exceso", "mediana_alta")] == [None] * 4


def test_a_horizon_beyond_the_last_event_is_as_in_its_sql(spark, tmp_path, day):
    import duckdb

    write(spark, tmp_path, day, [(1, 0, 10.0), (1, 7, 2.0), (1, 19, 5.0)])
    got = [tuple(r) for r in run(spark, tmp_path, "a6_horizons")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(str, got)) == sorted(map(str, con.execute(registry.oracle_sql()["a6_horizons"]).fetchall()))


CASES = {
    "entry": [(1, 0, 10.0), (1, 7, 0.0), (1, 19, 5.0), (2, 0, 10.0), (2, 7, 10.0), (2, 19, 20.0), (3, 0, 1.0), (3, 8, 0.0), (3, 18, 0.0), (4, 0, 1.0), (4, 9, 0.0), (4, 17, -2.0), (5, 0, 1.0), (5, 9, 0.0), (6, 0, 1.0), (6, 9, 3.0), (6, 17, 0.0)],
    "mean": [(1, 0, 10.0), (1, 7, 0.0), (1, 19, 5.0), (2, 0, 10.0), (2, 8, 4.0), (2, 18, 6.0), (3, 0, 1.0)],
    "all": [(1, 0, 10.0), (1, 7, 0.0), (1, 19, 0.0)],
    # no zero; a mean of 67.49125, which the SQL rounds to 67.4912
    "half": [(1, 0, 10.0), *[(1, 7, v) for v in (18.41, 51.91, 59.72, 179.43, 27.04, 86.36, 53.95, 63.11)], (1, 19, 29.06), (1, 19, 51.16)],
}


@pytest.mark.parametrize("case", CASES)
def test_excess_is_as_in_its_sql(spark, tmp_path, day, case):
    import duckdb

    write(spark, tmp_path, day, CASES[case])
    got = [tuple(r) for r in run(spark, tmp_path, "f26_excess")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    key = lambda r: str([abs(x) if x != x else x for x in r])  # noqa: E731  # NaN has no sign
    assert sorted(map(key, got)) == sorted(map(key, con.execute(registry.oracle_sql()["f26_excess"]).fetchall()))
    if case == "entry":
        assert {r[0]: r[1] for r in got}[0] == float("inf")
