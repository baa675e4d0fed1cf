import datetime as dt
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lumbre.functions import clean
from lumbre.operators import asof, series, upsert
from lumbre.plans.config import Config
from lumbre.plans.pipeline import run_parts
from lumbre.session import checkpoint_dir, left_join
from lumbre.sources import facts, form4, sinks
from lumbre.streaming.passes import run_pass


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def test_overwrites_marks_and_replacements_are_idempotent(spark):
    t = spark.createDataFrame([(1, "a", 5, True), (2, "b", 6, True), (3, "c", None, False), (None, "n", 7, True)], "k int, a string, v int, activa boolean")
    new = spark.createDataFrame([(1, "x", None, 1), (1, "y", 9, 2), (2, None, None, 1), (8, "q", 1, 1)], "k int, a string, v int, t int")
    once = upsert.overwrite(t, new, ["k"], [F.col("t")], ["a", "v"])
    assert rows(once, "k", "a", "v") == sorted([(1, "y", 9), (2, None, None), (3, "c", None), (None, "n", 7)], key=str)
    assert rows(upsert.overwrite(once, new, ["k"], [F.col("t")], ["a", "v"])) == rows(once)
    m = upsert.mark(t, spark.createDataFrame([(1,), (3,), (None,)], "k int"), "k", F.col("activa"), activa=F.lit(False), a=F.lit("fuera"))
    assert rows(m, "k", "a", "activa") == sorted([(1, "fuera", False), (2, "b", True), (3, "c", False), (None, "n", True)], key=str)
    assert rows(upsert.mark(m, t, "k", F.col("activa") & (F.col("k") == 1), a=F.lit("z"))) == rows(m)
    g = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (None, 4)], "k int, v int")
    r = upsert.replace_group(g, spark.createDataFrame([(1, 9), (5, 5)], "k int, v int"), "k")
    assert rows(r) == sorted([(1, 9), (2, 3), (5, 5), (None, 4)], key=str)
    assert rows(upsert.replace_group(r, r.filter("k = 1"), "k")) == rows(r)
    none = t.limit(0)
    assert upsert.overwrite(none, new, ["k"], [F.col("t")], ["a"]).count() == 0 and upsert.mark(none, t, "k", F.lit(True), a=F.lit("z")).count() == 0


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.read.parquet(path).withColumn("id", F.col("id") + 1), path)
    assert rows(spark.read.parquet(path)) == [(1,), (2,), (3,)]
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.replace_table(bad, path)
    assert rows(spark.read.parquet(path)) == [(1,), (2,), (3,)]


def test_parts_fail_apart():
    def load(q):
        if q == "2020Q2":
            raise ValueError("broken")
        return q

    got, rep = run_parts(["2020Q1", "2020Q2", "2020Q3"], load)
    assert list(got) == ["2020Q1", "2020Q3"] and rep.failed == {"2020Q2": "ValueError: broken"} and not rep.ok


def test_a_pass_takes_what_is_new_once(spark, tmp_path):
    src, out, prog = (str(tmp_path / x) for x in ("in", "out", "progress"))
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(src)
    stream = lambda: spark.readStream.schema("k int, v string").parquet(src)

    def write(batch):
        batch.write.mode("append").parquet(out)

    assert run_pass(stream(), write, prog) == 1
    spark.createDataFrame([(2, "b")], "k int, v string").write.mode("append").parquet(src)
    run_pass(stream(), write, prog)
    run_pass(stream(), write, prog)
    assert rows(spark.read.parquet(out)) == [(1, "a"), (2, "b")]


def test_parameters_of_repeated_keys(spark):
    many = [("cluster_members", "4")] * 10 + [("cluster_window_days", "90"), ("other", "1"), ("last_quarters", None)]
    c = Config.read(spark.createDataFrame(many, "clave string, valor string"))
    assert (c.cluster_members, c.cluster_window_days, c.last_quarters) == (4, 90, 8)
    with pytest.raises(ValueError, match="cluster_members"):
        Config.read(spark.createDataFrame([("cluster_members", "4"), ("cluster_members", "5")], "clave string, valor string"))


def test_null_keys_match_nothing_and_all_stay(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (None, "y"), (2, "z")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, b string")
    assert rows(left_join(a, b, ["k"]), "k", "a", "b") == sorted([(1, "x", "p"), (None, "y", None), (None, "y", None), (2, "z", None)], key=str)


def test_look_ups_against_plain_search(spark, day):
    r = random.Random(3)
    prices = [(r.randrange(3), r.randrange(200), float(r.randrange(1, 50))) for _ in range(150)]
    best = {}
    for k, d, v in prices:
        best[(k, d)] = max(v, best.get((k, d), 0.0))
    asks = [(r.randrange(4), r.randrange(220)) for _ in range(80)]
    p = spark.createDataFrame([(k, day(d), v) for k, d, v in prices], "k int, dia date, v double")
    q = spark.createDataFrame([*[(k, day(d)) for k, d in asks], (None, day(1)), (1, None)], "k int, d date")
    got = asof.lookups(q, p, "k", "d", "dia", "v", {"fwd": ("first", 0, 11), "bwd": ("last", -5, 0), "top": ("max", 0, 40), "n": ("count", -14, 0), "any": ("first", 0, None)})
    got = {(x["k"], (x["d"] - day(0)).days): x for x in got.collect()}
    assert set(got) == set(asks)
    for (k, d), x in got.items():
        near = lambda a, b: [best[(k, t)] for t in range(d + a, d + b + 1) if (k, t) in best]  # noqa: B023, E731
        assert x["fwd"] == next(iter(near(0, 11)), None) and x["bwd"] == next(iter(near(-5, 0)[::-1]), None)
        assert x["top"] == max(near(0, 40), default=None) and x["n"] == len(near(-14, 0)) and x["any"] == next(iter(near(0, 400)), None)


def test_systematic_sample_over_many_partitions(spark):
    df = spark.range(1000).repartition(13).withColumn("z", F.col("id") * 2)
    assert [r["id"] for r in series.systematic_sample(df, [F.col("id")], 7).orderBy("id").collect()] == [i * 1000 // 7 for i in range(7)]
    assert series.systematic_sample(df.limit(0), [F.col("id")], 7).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://x:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(_, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_a_quarter_from_files_and_from_an_archive(spark, tmp_path):
    files = {
        "SUBMISSION.tsv": "ACCESSION_NUMBER\tFILING_DATE\tISSUERCIK\tISSUERNAME\tISSUERTRADINGSYMBOL\na1\t15-MAR-2023\t77.0\tAcme \"Co\"\tacm\na2\t16-MAR-2023\t99\tOther\toth\n",
        "REPORTINGOWNER.tsv": "ACCESSION_NUMBER\tRPTOWNERNAME\tRPTOWNER_TITLE\tRPTOWNER_RELATIONSHIP\na1\tDoe Ann\t\tDirector\na1\tRoe Bob\tCEO\tOfficer\n",
        "NONDERIV_TRANS.tsv": "ACCESSION_NUMBER\tNONDERIV_TRANS_SK\tTRANS_DATE\tTRANS_CODE\tTRANS_SHARES\tTRANS_PRICEPERSHARE\tTRANS_ACQUIRED_DISP_CD\na1\t1\t14-MAR-2023\tp\t10\t2.5\tA\na2\t2\t14-MAR-2023\tS\t1\t1\tD\na1\t3\t14-MAR-2099\tP\t1\t1\tA\n",
    }
    folder = tmp_path / "q"
    folder.mkdir()
    for n, t in files.items():
        (folder / n).write_text(t)
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        for n, t in files.items():
            z.writestr(f"2023q1/{n.lower()}", t)
    known = spark.createDataFrame([("0000000077", 5)], "cik string, empresa_id int")
    for path, zipped in ((str(folder), False), (str(tmp_path / "q.zip"), True)):
        got = form4.load_quarter(spark, path, "2024-01-01", known, zipped=zipped).collect()
        assert [(r["empresa_id"], r["trans_sk"], r["nombre_insider"], r["cargo"], r["tipo_transaccion"], float(r["importe_total"])) for r in got] == [(5, 1, "Doe Ann", "Director", "P", 25.0)]


def test_predicates_and_indexes(spark):
    df = spark.createDataFrame([("Nasdaq GS", " s-3/A"), ("NYSE, otc", "424B5"), (None, None), ("", "10-Q")], "b string, f string")
    got = df.select(clean.accepted("b", ("NASDAQ", "NYSE"), ("OTC",)).alias("a"), clean.shelf_form("f").alias("s")).collect()
    assert [(r["a"], r["s"]) for r in got] == [(True, True), (False, True), (False, False), (False, False)]
    day = dt.date(2024, 5, 1)
    idx = spark.createDataFrame([("1", "S-3", day), ("1", "424B2", dt.date(2024, 6, 1)), ("1", "nt 10-K", day), ("2", "S-3", dt.date(2010, 1, 1)), ("2", None, day)], "cik string, form string, filing_date date")
    assert rows(facts.shelf_and_late(idx, "2024-07-01", 6)) == [("1", dt.date(2024, 6, 1), day), ("2", None, None)]
    stale = spark.createDataFrame([(dt.datetime(2024, 1, 1), 5), (dt.datetime(2024, 1, 3), 5), (None, 5), (dt.datetime(2024, 1, 3), None)], "t timestamp_ntz, v int")
    assert [r[0] for r in stale.select(clean.is_stale("t", "v", F.lit("2024-01-03 12:00:00").cast("timestamp_ntz"), 24)).collect()] == [False if i in (1, 2) else True for i in range(4)]
