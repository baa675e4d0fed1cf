import importlib
import pathlib

import pytest

from lumbre.plans import registry
from lumbre.plans.pipeline import Stage, run_stages
from lumbre.streaming import alerts

TABLES = pathlib.Path("/root/testdata/sf0.001")


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_core_does_not_import_llm():
    root = pathlib.Path(importlib.import_module("lumbre").__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["w1_clusters", "a2_worklist", "f_clean", "p2_found", "p4_found"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, str(TABLES))
    con.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in con.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: tuple("" if v is None else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r)
    assert sorted(key(r) for r in df.select(*cols).collect()) == sorted(key(r) for r in con.fetchall())


def test_stages():
    def boom(_):
        raise ValueError("no")

    res, rep = run_stages([Stage("a", lambda r: 1), Stage("b", boom, critical=False), Stage("c", lambda r: r["a"] + 1), Stage("d", boom), Stage("e", lambda r: 0)])
    assert res == {"a": 1, "c": 2} and rep.done == ["a", "c"] and list(rep.failed) == ["b", "d"] and rep.skipped == ["e"] and not rep.ok


def test_streaming_alerts_and_windows(spark, tmp_path, day):
    data = [(1, "A", day(0)), (1, "B", day(20)), (1, "C", day(40)), (1, "D", day(41)), (2, "A", day(0)), (2, "A", day(1)), (2, None, day(2)), (3, "A", day(0)), (3, "B", day(100)), (3, "C", day(200)), (None, "A", day(1))]
    spark.createDataFrame(data, "e int, m string, d date").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("e int, m string, d date").parquet(str(tmp_path / "in"))
    q = alerts.cluster_alerts(src, "e", "m", "d", 60, 3).writeStream.format("memory").queryName("alerts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["e"], r["detected"], r["members"]) for r in spark.table("alerts").collect()] == [(1, day(40), 3)]
    t = spark.sql("SELECT 'k' k, timestamp '2024-01-01 00:01:00' ts, 2 v UNION ALL SELECT 'k', timestamp '2024-01-01 00:04:00', 3 UNION ALL SELECT 'k', timestamp '2024-01-01 02:00:00', 9")
    t.coalesce(1).write.parquet(str(tmp_path / "ev"))
    ev = spark.readStream.schema(t.schema).parquet(str(tmp_path / "ev"))
    q = alerts.windowed_totals(ev, "ts", ["k"], "v", "5 minutes", "5 minutes", "10 minutes").writeStream.format("memory").queryName("wins").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert (2, 5) in [(r["n"], r["total"]) for r in spark.table("wins").collect()]
