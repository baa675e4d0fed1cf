import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumbre.functions import clean, text


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "want"), [("320193.0", "0000320193"), ("320193", "0000320193"), ("12345678901", None), (" 12-3 ", "0000000123"), ("", None), (None, None), ("abc", None)])
def test_cik(spark, raw, want):
    assert one(spark, clean.cik("x"), raw) == want


@pytest.mark.parametrize(
    ("raw", "want"), [("15-MAR-2023", dt.date(2023, 3, 15)), ("2023-03-15", dt.date(2023, 3, 15)), ("2023-3-5", dt.date(2023, 3, 5)), ("03/15/2023", dt.date(2023, 3, 15)), ("2023-03-15T10:11:12", dt.date(2023, 3, 15)), ("NaN", None), ("rubbish", None), (None, None)]
)
def test_flexible_date(spark, raw, want):
    assert one(spark, clean.flexible_date("x"), raw) == want


def test_figures(spark):
    for raw, want in (("0", None), ("NaN", None), ("5000000", None), ("1000000", 1e6), ("12.5", 12.5), ("x", None), ("Infinity", None)):
        assert one(spark, clean.price("x"), raw) == want
    for raw, want in (("-100", 100), ("0.5", 0), ("0", None), ("1e15", None), (None, None)):
        assert one(spark, clean.shares("x"), raw) == want
    assert one(spark, clean.amount(F.lit(100), F.col("x").cast("double")), None) is None
    assert float(one(spark, clean.amount(F.lit(3), F.col("x").cast("double")), "0.125")) == 0.38
    for raw, want in (("x", "X"), ("QQ", None), (" p ", "P"), (None, None)):
        assert one(spark, clean.tx_code("x"), raw) == want
    for raw, want in ((" nan ", None), ("None", None), ("", None), (" a ", "a")):
        assert one(spark, clean.text_or_null("x"), raw) == want
    assert one(spark, clean.bounded_long("x"), "1e30") is None and one(spark, clean.bounded_long("x"), "12.9") == 12
    assert one(spark, clean.bounded_decimal("x", 99.0, 2), "98.765") == 98.77
    assert one(spark, clean.acquired_or_disposed("x"), "a") is None


def test_transaction_date(spark):
    df = spark.sql("SELECT date '2023-05-01' d, date '2023-04-01' f UNION ALL SELECT date '2099-01-01', null UNION ALL SELECT date '2008-05-01', null UNION ALL SELECT date '2023-05-01', null")
    assert [r[0] for r in df.select(clean.transaction_date("d", "f", F.lit("2024-01-01").cast("date"))).collect()] == [None, None, None, dt.date(2023, 5, 1)]


def test_periods_and_items(spark):
    df = spark.createDataFrame([("2017-01-01", "2017-04-02", "1.01, 9.01"), ("2017-01-01", "2017-07-01", ""), (None, "2017-04-02", None)], "a string, b string, i string")
    got = df.select(clean.is_quarterly("a", "b").alias("q"), clean.item_list("i").alias("i")).collect()
    assert [r["q"] for r in got] == [True, False, False] and [r["i"] for r in got] == [["1.01", "9.01"], [], []]


def test_html_to_text(spark):
    html = "<html><style>p{}</style><p>One&nbsp;&amp; two</p>\n\n\n<script>x()</script><b>three</b>   four"
    got = one(spark, text.html_to_text("x"), html)
    assert "One\xa0& two" in got and "x()" not in got and "p{}" not in got and "\n\n\n" not in got and "   " not in got
    assert one(spark, text.html_to_text("x"), None) is None and one(spark, text.html_to_text("x"), "") == ""


BODY = "words " * 200


@pytest.mark.parametrize("head", ["Item 2. Management's Discussion and Analysis", "ITEM 2: MANAGEMENT’S DISCUSSION AND ANALYSIS", "Item 2 - Managements Discussion and Analysis"])
@pytest.mark.parametrize("end", ["Item 3. Quantitative and Qualitative Disclosures", "Item 4. Controls and Procedures"])
def test_discussion_takes_the_widest_gap(spark, head, end):
    doc = f"{head} 12\n{end} 30\ncover\n{head}\n{BODY}\n{end}\nrest"
    got, isolated = one(spark, text.extract_discussion('x'), doc)
    assert isolated and got.startswith(head) and BODY.strip() in got and end not in got


def test_discussion_fallbacks(spark):
    section = lambda t, **k: tuple(one(spark, text.extract_discussion('x', **k), t))
    assert section(None) == (None, False)
    assert section("nothing here") == ("nothing here", False)
    loose = "should be read in conjunction with Management's Discussion and Analysis of Financial Condition in the report " + BODY
    assert section(loose)[1] is False
    real = "17\n\nManagement's Discussion and Analysis of Financial Condition\n" + BODY + "\nItem 4. Controls and Procedures"
    assert section(real)[1] is True
    assert len(section("x" * 60_000)[0]) == 50_000 and len(section("x" * 60_000, whole=None)[0]) == 60_000
    tail = "Item 2. Management's Discussion and Analysis" + "y" * 40_000
    assert len(section(tail)[0]) == 30_000 and section(tail, open_length=None) == (tail, True)


def test_item_section(spark):
    section = lambda t, i: tuple(spark.createDataFrame([(t, i)], 't string, i string').select(text.extract_item('t', 'i').alias('r')).first()[0])
    doc = "Item 1.01 and Item 9.01\n" + "Item 1.01 Entry\n" + BODY + "\nItem 9.01 Exhibits\nlist\nSIGNATURES\nx"
    got, ok = section(doc, "1.01")
    assert ok and got.startswith("Item 1.01 Entry") and "Exhibits" not in got
    last = "Item 5.02 Departure\n" + BODY + "\nPursuant to the requirements of the Securities Exchange Act of 1934\nx"
    assert "Pursuant" not in section(last, "5.02")[0]
    assert section("Item 1x01 " + BODY, "1.01")[1] is False
    assert section(None, "1.01") == (None, False) and section("abc", None) == ("abc", False)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Percent of class represented by amount in row (11): 9.9%", 9.9), ("<percentOfClass>9.9</percentOfClass>", 9.9), ("nothing", None), (None, None), ("interest rate is 12.5% per annum", None), ("percent of class\n\n 7,5 %", 7.5), ("<percentOfClass>900</percentOfClass> percent of class 5%", None)],
)
def test_percent_of_class(spark, raw, want):
    assert one(spark, text.percent_of_class("x"), raw) == want


def test_anonymised(spark):
    df = spark.createDataFrame([("Acme (US) Corp. said ACME (us) grew in 2019. ACM rose; ACMX not.", "Acme (US) Corp.", "ACM"), ("plain 1850", None, None), (None, "Abcd", "T")], "t string, n string, k string")
    got = [r[0] for r in df.select(text.anonymised(F.col("t"), F.col("n"), F.col("k"))).collect()]
    assert got[0] == "la Empresa said la Empresa grew in 20XX. XXXX rose; ACMX not." and got[1] == "plain 1850" and got[2] is None


def test_first_json(spark):
    first = lambda t: one(spark, text.first_json('x'), t)
    assert first('Sure: {"a": {"b": 1}} and more {') == '{"a": {"b": 1}}'
    assert first('{"a": "x } y"} rest') == '{"a": "x } y"}'
    assert first("none") is None and first(None) is None and first("{broken") is None


def test_citations(spark):
    src = "The company’s  Backlog grew to $10 million. Ünïcode too."
    rows = [
        (1, src, ["company's backlog GREW", "invented words here"]),
        (2, src, ["one invented", "two invented ones", "unicode too. [MD&A, Q1 2026]"]),
        (3, src, []),
        (4, src, None),
        (5, None, ["backlog grew to"]),
        (6, src, ["grew", None]),
    ]
    got = {r["k"]: r for r in text.verify_citations(spark.createDataFrame(rows, "k int, s string, q array<string>"), "k", "s", "q").collect()}
    assert (got[1]["citas_verificadas"], got[1]["porcentaje_verificado"], got[1]["alucinacion_detectada"]) == (1, 50.0, False)
    assert (got[2]["citas_verificadas"], got[2]["porcentaje_verificado"], got[2]["alucinacion_detectada"]) == (1, 33.3, True)
    assert (got[3]["citas_totales"], got[3]["porcentaje_verificado"], got[3]["alucinacion_detectada"]) == (0, 0.0, False)
    assert got[4]["citas_totales"] == 0 and got[5]["citas_verificadas"] == 0
    assert (got[6]["demasiado_cortas"], got[6]["citas_totales"]) == (2, 2)
    assert one(spark, text.folded("x"), "  HOLA   Mundo “é” ") == "hola mundo e" and one(spark, text.folded("x"), None) is None
