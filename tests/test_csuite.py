from pyspark.sql import functions as F

from lumbre.operators import cluster
from lumbre.plans import filings


def test_titles_of_the_reference(spark):
    yes = ["Chief Executive Officer", "ceo", "CFO", "Chief Financial Officer", "Chief Operating Officer", "COO", "President & CEO", "Chairman of the Board", "EVP and Chief Financial Officer"]
    no = ["Vice President of Sales", "Vice Chairman", "SVP, Finance", "EVP", "Director", "10% Owner", "", None]
    df = spark.createDataFrame([(t, True) for t in yes] + [(t, False) for t in no], "cargo string, want boolean")
    assert df.filter(cluster.mentions("cargo", *filings.CSUITE) != F.col("want")).collect() == []


def test_csuite_query_over_windows(spark, tmp_path, day):
    rows = [(e, n, t, "P", day(d)) for e, data in {
        1: [("A", "Director", 0), ("B", "CFO", 20), ("C", "Director", 40)],  # a CFO in the window
        2: [("Z", "CEO", 0), ("A", "Director", 1000), ("B", "Director", 1010), ("C", None, 1020)],  # the CEO is old
        3: [("A", "CEO", 0), ("A", "CEO", 1)],  # no cluster
        4: [("A", "COO", 0), ("B", "Director", 20), ("C", "Director", 60)],  # on the window's first day
        5: [("A", "Vice Chairman", 0), ("B", "Director", 1), ("C", "SVP, Finance", 2)],
        6: [("A", "Chairman", 0), ("B", "Director", 1), ("C", "Director", 2)],
    }.items() for n, t, d in data]
    spark.createDataFrame(rows, "empresa_id int, nombre_insider string, cargo string, tipo_transaccion string, fecha_transaccion date").write.parquet(str(tmp_path / "insider_transactions.parquet"))
    got = {r["empresa_id"]: r["alto_cargo"] for r in filings.w2_titles(spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}
