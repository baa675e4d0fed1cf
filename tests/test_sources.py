import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from lumbre.sources import cases, facts, form4, market, sinks

SUB = "ACCESSION_NUMBER\tFILING_DATE\tPERIOD_OF_REPORT\tISSUERCIK\tISSUERNAME\tISSUERTRADINGSYMBOL\tEXTRA\nA1\t31-MAR-2023\t\t320193\tAcme \"Inc\"\tacm\tz\nA2\t2023-04-01\t\t12345678901\t\tnone\tz\n"
OWN = "ACCESSION_NUMBER\tRPTOWNERCIK\tRPTOWNERNAME\tRPTOWNER_RELATIONSHIP\tRPTOWNER_TITLE\nA1\t1\tFirst Person\tDirector\t\nA1\t2\tSecond Person\tOfficer\tCEO\nA2\t3\tThird\tOfficer\tCFO\n"
TX = (
    "ACCESSION_NUMBER\tNONDERIV_TRANS_SK\tSECURITY_TITLE\tTRANS_DATE\tTRANS_CODE\tTRANS_SHARES\tTRANS_PRICEPERSHARE\tTRANS_ACQUIRED_DISP_CD\tSHRS_OWND_FOLWNG_TRANS\n"
    "A1\t1\tCommon\t15-MAR-2023\tp\t-100.0\t2.5\tA\t1e3\nA1\t2\tCommon\t02-APR-2023\tQQ\t0\t0\tX\tNaN\nA2\t1\tCommon\t2023-03-01\tS\t5\tabc\tD\t\n"
)


def check(rows):
    a1, a2, b1 = sorted(rows, key=lambda r: (r["accession_number"], r["trans_sk"]))
    assert (a1["cik"], a1["ticker"], a1["nombre_insider"], a1["cargo"], a1["tipo_transaccion"], a1["acciones"], float(a1["importe_total"]), a1["fecha_transaccion"]) == ("0000320193", "ACM", "First Person", "Director", "P", 100, 250.0, dt.date(2023, 3, 15))
    assert a2["fecha_transaccion"] is None and a2["tipo_transaccion"] is None and a2["acciones"] is None and a2["acciones_tras_tx"] is None and a2["adquirido_o_dispuesto"] is None
    assert b1["cik"] is None and b1["ticker"] is None and b1["precio_por_accion"] is None and b1["importe_total"] is None and b1["cargo"] == "CFO"


def test_plain_and_zipped_triplets(spark, tmp_path):
    for n, t in (("SUBMISSION.tsv", SUB), ("REPORTINGOWNER.tsv", OWN), ("NONDERIV_TRANS.tsv", TX)):
        (tmp_path / n).write_text(t)
    read = lambda n, c: form4.read_tsv(spark, str(tmp_path / n), c)
    check(form4.clean_transactions(read("SUBMISSION.tsv", form4.SUBMISSION), read("REPORTINGOWNER.tsv", form4.OWNER), read("NONDERIV_TRANS.tsv", form4.TRANSACTION), dt.date(2024, 1, 1), keep_invalid=True).collect())
    strict = form4.clean_transactions(read("SUBMISSION.tsv", form4.SUBMISSION), read("REPORTINGOWNER.tsv", form4.OWNER), read("NONDERIV_TRANS.tsv", form4.TRANSACTION), dt.date(2024, 1, 1)).collect()
    assert [(r["accession_number"], r["trans_sk"]) for r in strict] == [("A1", 1)]
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips" / "q1.zip", "w") as z:
        z.writestr("2023q1/submission.TSV", SUB)
        z.writestr("2023q1/reportingowner.tsv", OWN)
        z.writestr("2023q1/Nonderiv_Trans.tsv", TX)
    with zipfile.ZipFile(tmp_path / "zips" / "empty.zip", "w") as z:
        z.writestr("readme", "x")
    read = lambda n, c: form4.read_zipped_tsv(spark, str(tmp_path / "zips" / "*.zip"), n, c)
    check(form4.clean_transactions(read("submission.tsv", form4.SUBMISSION), read("reportingowner.tsv", form4.OWNER), read("nonderiv_trans.tsv", form4.TRANSACTION), dt.date(2024, 1, 1), keep_invalid=True).collect())


def fact(start, end, val, fy, fp, form="10-Q"):
    return {"start": start, "end": end, "val": val, "form": form, "fy": fy, "fp": fp}


def test_facts_to_quarters(spark, tmp_path):
    doc = {
        "cik": "1",
        "facts": {
            "us-gaap": {
                "SalesRevenueNet": {"units": {"USD": [fact("2017-01-01", "2017-03-31", 100, 2017, "Q1"), fact("2017-01-01", "2017-06-30", 210, 2017, "Q2"), fact("2017-04-01", "2017-06-30", 110, 2017, "Q2"), fact("2017-04-01", "2017-06-30", 111, 2018, "Q2"), fact("2011-01-01", "2011-03-31", 5, 2011, "Q1")]}},
                "RevenueFromContractWithCustomerExcludingAssessedTax": {"units": {"USD": [fact("2018-01-01", "2018-03-31", 130, None, None), fact("2018-01-01", "2018-03-31", 999, 2018, "Q1", "8-K")]}},
                "CostOfRevenue": {"units": {"USD": [fact("2017-01-01", "2017-03-31", 60, 2017, "Q1")]}},
                "CommonStockSharesOutstanding": {"units": {"shares": [fact(None, "2017-03-31", 7, 2017, "Q1")]}},
                "Unknown": {"units": {"USD": [fact(None, "2017-03-31", 7, 2017, "Q1")]}},
            }
        },
    }
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text("not json")
    read = facts.read_json(spark, str(tmp_path / "*.json"), facts.FACTS)
    s = facts.fact_series(read)
    rev = {str(r["fin"]): r["val"] for r in s.filter("campo = 'revenue'").collect()}
    assert rev == {"2017-03-31": 100, "2017-06-30": 111, "2018-03-31": 130, "2011-03-31": 5}
    q = {str(r["fecha_fin"]): r for r in facts.quarters(s).collect()}
    assert set(q) == {"2017-03-31", "2017-06-30", "2018-03-31"}
    a = q["2017-03-31"]
    assert (a["gross_profit"], a["shares_outstanding"], a["anio_fiscal"], a["trimestre"]) == (40, 7, 2017, 1)
    assert (q["2018-03-31"]["anio_fiscal"], q["2018-03-31"]["trimestre"]) == (2018, 1) and q["2017-06-30"]["anio_fiscal"] == 2018
    assert facts.quarters(s, window=1).count() == 1


def test_filing_index(spark, tmp_path):
    recent = {"form": ["10-Q", "8-K", "8-K/A", "8-K", "10-Q"], "accessionNumber": list("abcde"), "filingDate": ["2024-05-01", "2024-04-01", "2024-03-15", "2020-01-01", "2024-02-01"], "reportDate": ["2024-03-31", "", "", "2019-12-30", "2023-12-31"], "primaryDocument": list("vwxyz"), "items": ["", "1.01, 9.01", "1.01", "1.01", ""]}
    (tmp_path / "s.json").write_text(json.dumps({"cik": "1", "filings": {"recent": recent}}))
    idx = facts.filings(facts.read_json(spark, str(tmp_path / "s.json"), facts.SUBMISSIONS))
    assert facts.latest_of_form(idx, "10-Q").first()["accession_number"] == "a"
    assert facts.latest_of_form(idx, "10-Q", "2024-03-01").first()["accession_number"] == "e"
    r = facts.current_reports(idx, ["1.01", "5.02"], "2024-06-01", 12).collect()
    assert [(x["accession_number"], str(x["event_date"]), x["relevant"]) for x in r] == [("b", "2024-04-01", ["1.01"])]
    hits = {"cik": "1", "hits": {"hits": [{"_id": "x:doc.xml", "_source": {"adsh": "x", "form": "SC 13D", "file_date": "2024-01-02", "display_names": ["Issuer", "Filer"]}}, {"_id": "y", "_source": {"adsh": "y", "form": "SC 13G", "file_date": "2024-01-03", "display_names": ["Issuer"]}}]}}
    (tmp_path / "h.json").write_text(json.dumps(hits))
    got = {x["accession_number"]: (x["filer"], x["document"]) for x in facts.search_hits(facts.read_json(spark, str(tmp_path / "h.json"), facts.HITS)).collect()}
    assert got == {"x": ("Filer", "doc.xml"), "y": ("desconocido", "primary_doc.xml")}


def test_case_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ticker,cap_minima,tuvo_cluster,fecha_cluster\nAAA,1,True,2020-01-01\nBBB,2,False,2020-01-01\nCCC,3,1,\n")
    (tmp_path / "b.csv").write_text("empresa_id,ticker,fecha_deteccion,market_cap_historico\n5,ZZ,2021-01-01,9.5\n6,AA,2019-01-01,\n")
    a, b = cases.read_cases(spark, str(tmp_path / "a.csv")), cases.read_cases(spark, str(tmp_path / "b.csv"))
    assert [r["ticker"] for r in a.collect()] == ["AAA"]
    assert [r["ticker"] for r in cases.distinct_tickers(b).collect()] == ["ZZ", "AA"]  # as the list names them, not by date
    assert cases.read_cases(spark, str(tmp_path / "b.csv"), "zz").first()["empresa_id"] == 5
    cases.write_csv(b, str(tmp_path / "out"), ["ticker"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    assert a.unionByName(b).filter(F.col("market_cap").isNull()).count() == 1


def test_market_snapshots(spark, tmp_path):
    rows = [{"symbol": "A", "currentPrice": 5.0, "fiftyTwoWeekLow": 4.0, "fiftyTwoWeekHigh": 8.0, "marketCap": 10, "exchange": "NMS", "dateShortInterest": 1700000000}, {"symbol": "B", "regularMarketPrice": 3.0, "fiftyTwoWeekLow": 3.0, "fiftyTwoWeekHigh": 3.0, "fullExchangeName": "NASDAQ"}, {"symbol": "C"}]
    (tmp_path / "m.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = {r["ticker"]: r for r in market.snapshots(spark.read.schema(market.SNAPSHOT).json(str(tmp_path / "m.json"))).collect()}
    assert set(got) == {"A", "B"} and float(got["A"]["posicion_52w"]) == 0.25 and got["B"]["posicion_52w"] is None
    assert got["B"]["bolsa"] == "NASDAQ" and got["A"]["bolsa"] == "NMS" and got["A"]["fecha_short"] == dt.date(2023, 11, 14)


def test_sinks_are_atomic_and_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(5), path)
    sinks.replace_table(spark.read.parquet(path).filter("id < 3"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2]
    assert not list(tmp_path.glob("*staging*"))
    known = spark.createDataFrame([("1", 7)], "cik string, id long")
    new = spark.createDataFrame([("1", "A"), ("2", "B"), ("2", "B"), (None, "C")], "cik string, n string")
    both = sinks.register_entities(known, new, "cik", "id")
    assert {r["cik"] for r in both.collect()} == {"1", "2"} and both.filter("cik = '1'").first()["id"] == 7
    again = sinks.register_entities(both, new, "cik", "id")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in both.collect()}
    assert [r["id"] for r in sinks.with_foreign_key(new, both, "cik", "id").filter("cik = '1'").collect()] == [7]
    assert sinks.with_foreign_key(new, both, "cik", "id").count() == 3
