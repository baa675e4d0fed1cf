"""Nested company facts and filing indexes to flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clean import item_list, shelf_form

FACTS = (
    "cik string, facts struct<`us-gaap`: map<string, struct<units: map<string, array<struct<start: string, `end`: string, val: double, form: string, fy: int, fp: string>>>>>>"
)
SUBMISSIONS = (
    "cik string, sic string, sicDescription string, name string, filings struct<recent: struct<form: array<string>, accessionNumber: array<string>, filingDate: array<string>, reportDate: array<string>, primaryDocument: array<string>, items: array<string>>>"
)
HITS = "cik string, hits struct<hits: array<struct<_id: string, _source: struct<adsh: string, form: string, file_date: string, display_names: array<string>>>>>"

# The tags of each figure, first choice first.
TAGS = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet", "SalesRevenueGoodsNet", "RevenueFromContractWithCustomerIncludingAssessedTax"),
    "gross_profit": ("GrossProfit",),
    "cost_of_revenue": ("CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold", "CostOfServices"),
    "net_income": ("NetIncomeLoss", "NetIncomeLossAvailableToCommonStockholdersBasic", "ProfitLoss"),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"),
    "accounts_receivable": ("AccountsReceivableNetCurrent", "ReceivablesNetCurrent"),
    "shares_outstanding": ("CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding"),
}
FLOWS = ("revenue", "gross_profit", "net_income", "operating_cash_flow", "cost_of_revenue")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document per file by a declared schema; documents that are no JSON are null rows."""
    text = spark.read.text(path, wholetext=True).withColumn("_file", F.col("_metadata.file_path"))
    return text.select(F.from_json("value", schema).alias("d"), "_file").select("d.*", "_file")


def fact_series(facts: DataFrame) -> DataFrame:
    """(cik, campo, fin, inicio, val, fy, fp): one value per figure and end of period.

    Only periodic forms count, and for flows only periods of 80 to 100 days. Within
    a tag the latest fiscal year and period wins, between tags the first choice;
    later tags fill gaps."""
    tags = F.create_map(*[x for f, ts in TAGS.items() for i, t in enumerate(ts) for x in (F.lit(t), F.struct(F.lit(f).alias("campo"), F.lit(i).alias("orden")))])
    e = facts.select("cik", F.explode("facts.us-gaap").alias("tag", "t")).withColumn("k", F.try_element_at(tags, F.col("tag"))).filter("k is not null")
    usd, shares = F.try_element_at("t.units", F.lit("USD")), F.try_element_at("t.units", F.lit("shares"))
    e = e.withColumn("u", F.when(F.size(usd) > 0, usd).otherwise(shares)).select("cik", "k.campo", "k.orden", F.posexplode("u").alias("pos", "x"))
    e = e.select("cik", "campo", "orden", "pos", "x.*").filter(F.col("form").isin("10-Q", "10-K") & F.col("end").isNotNull())
    span = F.datediff(F.try_to_timestamp("end", F.lit("yyyy-MM-dd")).cast("date"), F.try_to_timestamp("start", F.lit("yyyy-MM-dd")).cast("date"))
    e = e.filter(~F.col("campo").isin(*FLOWS) | F.coalesce(span.between(80, 100), F.lit(False)))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in ("Q1", "Q2", "Q3", "Q4", "FY")]), F.col("fp")), F.lit(0))
    w = Window.partitionBy("cik", "campo", "end").orderBy("orden", F.coalesce("fy", F.lit(0)).desc(), rank.desc(), F.col("pos").desc())
    e = e.withColumn("r", F.row_number().over(w)).filter("r = 1")
    return e.select("cik", "campo", F.try_to_timestamp("end", F.lit("yyyy-MM-dd")).cast("date").alias("fin"), F.try_to_timestamp("start", F.lit("yyyy-MM-dd")).cast("date").alias("inicio"), "val", "fy", "fp")


def quarters(series: DataFrame, window: int = 12, since: str = "2012-06-15") -> DataFrame:
    """One row per company and quarter with all figures, for the ``window`` newest ends
    of the revenue series; those before ``since`` are then left out.

    Gross profit is derived from revenue and cost where not reported. Year and
    quarter come from the filing, else from the calendar; a missing start is 90
    days before the end. Rows of the same year and quarter: the newest end stays."""
    figures = [f for f in TAGS if f != "cost_of_revenue"]
    value = lambda f: F.max(F.when(F.col("campo") == f, F.col("val").cast("long")))
    rev = F.col("campo") == "revenue"
    p = series.groupBy("cik", "fin").agg(*[value(f).alias(f) for f in TAGS], F.max(rev).alias("has"), F.max(F.when(rev, F.col("fy"))).alias("fy"), F.max(F.when(rev, F.col("fp"))).alias("fp"), F.max(F.when(rev, F.col("inicio"))).alias("inicio"))
    p = p.filter("has").withColumn("r", F.row_number().over(Window.partitionBy("cik").orderBy(F.col("fin").desc()))).filter(F.col("r") <= window).filter(F.col("fin") >= F.lit(since).cast("date"))
    named = F.when(F.col("fp").rlike("^Q[1-4]$") & (F.col("fy") > 0), F.substring("fp", 2, 1).cast("int"))
    p = p.withColumn("trimestre", F.coalesce(named, F.quarter("fin"))).withColumn("anio_fiscal", F.when(named.isNotNull(), F.col("fy")).otherwise(F.year("fin")))
    p = p.withColumn("gross_profit", F.coalesce("gross_profit", F.col("revenue") - F.col("cost_of_revenue"))).withColumn("fecha_inicio", F.coalesce("inicio", F.date_sub("fin", 90)))
    p = p.withColumn("q", F.row_number().over(Window.partitionBy("cik", "anio_fiscal", "trimestre").orderBy(F.col("fin").desc()))).filter("q = 1")
    return p.select("cik", "anio_fiscal", "trimestre", "fecha_inicio", F.col("fin").alias("fecha_fin"), *figures)


def filings(submissions: DataFrame) -> DataFrame:
    """The parallel arrays of filing indexes as rows; ``pos`` 0 is the newest."""
    r = F.arrays_zip(*[F.col(f"filings.recent.{c}").alias(c) for c in ("form", "accessionNumber", "filingDate", "reportDate", "primaryDocument", "items")])
    e = submissions.select("cik", F.posexplode(r).alias("pos", "f")).select("cik", "pos", "f.*")
    day = lambda c: F.try_to_timestamp(F.nullif(F.col(c), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
    return e.select("cik", "pos", "form", F.col("accessionNumber").alias("accession_number"), day("filingDate").alias("filing_date"), day("reportDate").alias("report_date"), F.col("primaryDocument").alias("document"), "items")


def latest_of_form(index: DataFrame, form: str, until=None) -> DataFrame:
    """The newest filing of a form per company, of those up to ``until``."""
    f = index.filter(F.col("form") == form)
    if until is not None:
        f = f.filter(F.col("filing_date") <= F.lit(until).cast("date"))
    return f.groupBy("cik").agg(F.max_by(F.struct("accession_number", "filing_date", "document"), F.struct("filing_date", -F.col("pos"))).alias("f")).select("cik", "f.*")


def sectors(submissions: DataFrame) -> DataFrame:
    """(cik, sic, sector, nombre) of the companies whose documents name a sector code; of
    several documents of a company the first code in order counts."""
    named = submissions.filter(F.trim("sic") != "")
    return named.groupBy("cik").agg(F.min(F.struct(F.trim("sic").alias("sic"), F.nullif(F.trim("sicDescription"), F.lit("")).alias("sector"), F.col("name").alias("nombre"))).alias("x")).select("cik", "x.*")


def shelf_and_late(index: DataFrame, as_of, months: int) -> DataFrame:
    """(cik, fecha_shelf, fecha_nt): newest shelf form and newest late-filing notice of each
    company in the last ``months`` * 30 days, in one pass; null where there is none."""
    recent = F.col("filing_date").between(F.date_sub(F.lit(as_of).cast("date"), months * 30), F.lit(as_of).cast("date"))
    late = F.coalesce(F.upper(F.trim("form")).startswith("NT 10"), F.lit(False))
    newest = lambda which: F.max(F.when(recent & which, F.col("filing_date")))
    return index.groupBy("cik").agg(newest(shelf_form("form")).alias("fecha_shelf"), newest(late).alias("fecha_nt"))


def current_reports(index: DataFrame, items: list[str], as_of, months: int) -> DataFrame:
    """Current reports with one of ``items`` in the last ``months`` * 30 days."""
    hit = F.array_sort(F.array_intersect(item_list("items"), F.array(*[F.lit(i) for i in items])))
    since = F.date_sub(F.lit(as_of).cast("date"), months * 30)
    f = index.filter((F.col("form") == "8-K") & (F.col("filing_date") >= since)).withColumn("relevant", hit).filter(F.size("relevant") > 0)
    return f.select("cik", "accession_number", F.coalesce("report_date", "filing_date").alias("event_date"), "document", "relevant")


def search_hits(pages: DataFrame, default_document: str = "primary_doc.xml") -> DataFrame:
    """Hits of a full-text search: accession, form, date, filer (the second name) and document."""
    h = pages.select("cik", F.explode("hits.hits").alias("h"))
    doc = F.nullif(F.get(F.split("h._id", ":", 2), F.lit(1)), F.lit(""))
    return h.select(
        "cik", F.col("h._source.adsh").alias("accession_number"), F.col("h._source.form").alias("form"), F.try_to_timestamp("h._source.file_date", F.lit("yyyy-MM-dd")).cast("date").alias("file_date"),
        F.coalesce(F.get("h._source.display_names", F.lit(1)), F.lit("desconocido")).alias("filer"), F.coalesce(doc, F.lit(default_document)).alias("document"),
    )
