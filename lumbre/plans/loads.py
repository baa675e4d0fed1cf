"""Queries of the loads and writes: test tables laid out as the sources have them, read
back and put into tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import clean, text
from ..operators import upsert
from ..session import checkpoint_dir, table
from ..sources import facts, form4, market, sinks

AS_OF = "2026-11-20"
DAY = "yyyy-MM-dd"
#: What the loader accepts as an exchange, and what rules one out.
ACCEPT, REJECT = ("NASDAQ", "NYSE", "AMEX"), ("OTC", "PINK", "GREY", "EXPERT MARKET")


def _day(c):
    return F.date_format(c, DAY)


def _text(c):
    return F.col(c).cast("string").alias(c)


# Ownership forms ------------------------------------------------------------


def s2_tsv(s, d):
    """All transactions written as tab-separated files in the shared folder and read back."""
    path = f"{checkpoint_dir(s)}/tsv-{uuid.uuid4().hex}"
    t = table(s, d, "insider_transactions")
    t = t.select("accession_number", F.col("trans_sk").cast("string").alias("NONDERIV_TRANS_SK"), F.date_format("fecha_transaccion", "dd-MMM-yyyy").alias("TRANS_DATE"), F.col("acciones").cast("string").alias("TRANS_SHARES"), F.col("precio_por_accion").cast("string").alias("TRANS_PRICEPERSHARE"))
    t.write.option("sep", "\t").option("header", True).option("quote", "\u0000").csv(path)
    got = form4.read_tsv(s, path, ("accession_number", "nonderiv_trans_sk", "trans_date", "trans_shares", "trans_pricepershare", "security_title"))
    return got.select("accession_number", "nonderiv_trans_sk", _day(clean.flexible_date("trans_date")).alias("fecha"), "trans_shares", "trans_pricepershare", "security_title")


def _forms(s, d):
    """Submissions, owners and transactions as the three files have them."""
    e = table(s, d, "empresas").select(F.col("id").alias("empresa_id"), F.concat("cik", F.lit(".0")).alias("issuercik"), F.col("nombre").alias("issuername"), F.col("ticker").alias("issuertradingsymbol"))
    t = table(s, d, "insider_transactions").withColumn("_file", F.lit("f")).withColumn("_row", F.col("id"))
    filed = t.groupBy("accession_number").agg(F.min("empresa_id").alias("empresa_id"), F.max(F.to_date("fecha_registro")).alias("f"), F.lit("f").alias("_file"), F.min("_row").alias("_row"))
    sub = filed.join(e, "empresa_id").select("accession_number", F.date_format("f", "dd-MMM-yyyy").alias("filing_date"), F.lit(None).cast("string").alias("period_of_report"), "issuercik", "issuername", "issuertradingsymbol", "_file", "_row")
    own = t.select("accession_number", F.lit(None).cast("string").alias("rptownercik"), F.col("nombre_insider").alias("rptownername"), F.lit("Director").alias("rptowner_relationship"), F.col("cargo").alias("rptowner_title"), "_file", "_row")
    tx = t.select(
        "accession_number", F.col("trans_sk").cast("string").alias("nonderiv_trans_sk"), F.lit(None).cast("string").alias("security_title"), F.date_format("fecha_transaccion", "M/d/yyyy").alias("trans_date"), F.col("tipo_transaccion").alias("trans_code"),
        F.col("acciones").cast("string").alias("trans_shares"), F.col("precio_por_accion").cast("string").alias("trans_pricepershare"), F.col("adquirido_o_dispuesto").alias("trans_acquired_disp_cd"), F.col("acciones_tras_tx").cast("string").alias("shrs_ownd_folwng_trans"), "_file", "_row",
    )
    return sub, own, tx


def n16_form4(s, d):
    """Clean transactions with their filing, its first owner and the key of the company."""
    rows = form4.clean_transactions(*_forms(s, d), AS_OF)
    keyed = sinks.with_foreign_key(rows, table(s, d, "empresas").select("cik", F.col("id").alias("empresa_id")), "cik", "empresa_id")
    return keyed.select("accession_number", "trans_sk", "empresa_id", "nombre_insider", "cargo", "tipo_transaccion", _day("fecha_transaccion").alias("fecha"), "acciones", "precio_por_accion", F.col("importe_total").cast("double").alias("importe_total"))


def j2_first_owner(s, d):
    """Filings with the owner that comes first in the file, and how many it names."""
    _, own, _ = _forms(s, d)
    first = own.groupBy("accession_number").agg(F.min_by(F.struct("rptownername", "rptowner_title"), F.struct("_file", "_row")).alias("o"), F.count(F.lit(1)).alias("filas"))
    return first.select("accession_number", F.col("o.rptownername").alias("titular"), F.col("o.rptowner_title").alias("cargo"), "filas")


# Filing indexes and facts ---------------------------------------------------


def _index(s, d):
    """Filing indexes as nested documents, one page per company and month, and read flat.

    The table has no shelf forms or notices, so the number of a document decides them."""
    docs = table(s, d, "documents").filter("empresa_id is not null and fecha_doc is not null").select("doc_id", "empresa_id", "fecha_doc", "formulario")
    k = F.pmod("doc_id", F.lit(7))
    docs = docs.withColumn("form", F.when(k == 0, "S-3/A").when(k == 1, " 424b5 ").when(k == 2, "NT 10-Q").otherwise(F.col("formulario")))
    e = table(s, d, "empresas").select(F.col("id").alias("empresa_id"), "cik", "sic", "sector", "nombre")
    row = F.struct((-F.unix_date("fecha_doc")).alias("a"), (-F.col("doc_id")).alias("b"), F.col("form"), F.col("doc_id").cast("string").alias("accessionNumber"), _day("fecha_doc").alias("filingDate"))
    pages = docs.groupBy("empresa_id", F.trunc("fecha_doc", "month").alias("mes")).agg(F.array_sort(F.collect_list(row)).alias("r")).join(e, "empresa_id")
    none = F.transform("r", lambda x: F.lit(None).cast("string"))
    recent = F.struct(F.col("r.form").alias("form"), F.col("r.accessionNumber").alias("accessionNumber"), F.col("r.filingDate").alias("filingDate"), none.alias("reportDate"), none.alias("primaryDocument"), none.alias("items"))
    js = F.to_json(F.struct("cik", "sic", F.col("sector").alias("sicDescription"), F.col("nombre").alias("name"), F.struct(recent.alias("recent")).alias("filings")))
    return pages.select(F.from_json(js, facts.SUBMISSIONS).alias("x")).select("x.*")


def s4_sectors(s, d):
    return facts.sectors(_index(s, d))


def s6_latest_10q(s, d):
    f = facts.latest_of_form(facts.filings(_index(s, d)), "10-Q")
    return f.select("cik", "accession_number", _day("filing_date").alias("fecha"))


def s7_10q_as_of(s, d):
    """The last 10-Q filed up to a day, over all pages of the index."""
    f = facts.latest_of_form(facts.filings(_index(s, d)), "10-Q", until="2022-06-30")
    return f.select("cik", "accession_number", _day("filing_date").alias("fecha"))


def s10_shelf_and_late(s, d):
    f = facts.shelf_and_late(facts.filings(_index(s, d)), AS_OF, 36)
    return f.select("cik", _day("fecha_shelf").alias("fecha_shelf"), _day("fecha_nt").alias("fecha_nt"))


def s8_current_reports(s, d):
    """Current reports of the last 24 months with one of three items."""
    ev = table(s, d, "eventos_8k").filter("fecha_evento is not null").groupBy("accession_number").agg(F.min("empresa_id").cast("string").alias("cik"), F.max("fecha_evento").alias("filing_date"), F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"))
    idx = ev.withColumn("form", F.lit("8-K")).withColumn("report_date", F.lit(None).cast("date")).withColumn("document", F.lit("d.htm")).withColumn("pos", F.lit(0))
    got = facts.current_reports(idx, ["1.01", "2.01", "5.02"], AS_OF, 24)
    return got.select("cik", "accession_number", _day("event_date").alias("fecha"), F.array_join("relevant", "|").alias("items"))


def s11_hits(s, d):
    """Hits of a full-text search, one page per holding."""
    h = table(s, d, "participaciones_activistas")
    source = F.struct(F.col("accession_number").alias("adsh"), F.col("formulario").alias("form"), _day("fecha_evento").alias("file_date"), F.array(F.lit("Filer"), F.concat(F.lit("Fondo "), F.col("id").cast("string"))).alias("display_names"))
    ident = F.when(F.pmod("id", F.lit(2)) == 0, F.concat("accession_number", F.lit(":doc.htm"))).otherwise(F.col("accession_number"))
    pages = h.select(F.to_json(F.struct(F.col("empresa_id").cast("string").alias("cik"), F.struct(F.array(F.struct(ident.alias("_id"), source.alias("_source"))).alias("hits")).alias("hits"))).alias("js"))
    got = facts.search_hits(pages.select(F.from_json("js", facts.HITS).alias("x")).select("x.*"))
    return got.select("cik", "accession_number", "form", _day("file_date").alias("fecha"), "filer", "document")


def _facts(s, d):
    """Company facts, one nested document per company and end of period: revenue under a
    tag of the second choice where the id allows it, and always under one of the third."""
    m = table(s, d, "metricas_trimestrales").filter("fecha_fin is not null and empresa_id is not null")
    m = upsert.latest(m.select("id", "empresa_id", "anio_fiscal", "trimestre", "fecha_inicio", "fecha_fin", "revenue", "gross_profit", "shares_outstanding"), ["empresa_id", "fecha_fin"], [-F.col("id")])
    fact = lambda v, start: F.array(F.struct(_day(start).alias("start"), _day("fecha_fin").alias("end"), v.cast("double").alias("val"), F.lit("10-Q").alias("form"), F.col("anio_fiscal").alias("fy"), F.concat(F.lit("Q"), F.col("trimestre").cast("string")).alias("fp")))
    units = lambda u, v, start="fecha_inicio": F.struct(F.create_map(F.lit(u), fact(v, start)).alias("units"))
    tags = F.create_map(
        F.when((F.col("id") % 3 != 0) & F.col("revenue").isNotNull(), "Revenues").otherwise("-1"), units("USD", F.col("revenue")),
        F.when(F.col("revenue").isNotNull(), "SalesRevenueNet").otherwise("-2"), units("USD", F.col("revenue") + 1),
        F.when(F.col("gross_profit").isNotNull(), "GrossProfit").otherwise("-3"), units("USD", F.col("gross_profit")),
        F.when(F.col("shares_outstanding").isNotNull(), "CommonStockSharesOutstanding").otherwise("-4"), units("shares", F.col("shares_outstanding")),
    )
    return m.select(F.from_json(F.to_json(F.struct(F.col("empresa_id").cast("string").alias("cik"), F.struct(tags.alias("us-gaap")).alias("facts"))), facts.FACTS).alias("x")).select("x.*")


def n1_facts(s, d):
    """One value per figure and end of period."""
    f = facts.fact_series(_facts(s, d))
    return f.select("cik", "campo", _day("fin").alias("fin"), _day("inicio").alias("inicio"), F.col("val").cast("long").alias("val"), "fy", "fp")


def n2_quarters(s, d):
    """The twelve newest quarters of each company with their figures."""
    q = facts.quarters(facts.fact_series(_facts(s, d)), 12)
    return q.select("cik", "anio_fiscal", "trimestre", _day("fecha_inicio").alias("inicio"), _day("fecha_fin").alias("fin"), "revenue", "gross_profit", "shares_outstanding")


def s5_market(s, d):
    """Market documents with alternative fields; the exchange by its full name if there."""
    e = table(s, d, "empresas")
    odd = F.pmod("id", F.lit(2)) == 1
    num = lambda c: F.col(c).cast("double")
    raw = e.select(
        F.col("ticker").alias("symbol"), F.when(odd, num("precio_actual")).alias("currentPrice"), num("precio_actual").alias("regularMarketPrice"), num("precio_min_52w").alias("fiftyTwoWeekLow"), num("precio_max_52w").alias("fiftyTwoWeekHigh"), F.col("market_cap_usd").alias("marketCap"),
        F.col("volumen_medio_30d").alias("averageVolume"), F.lit("XX").alias("exchange"), F.when(odd, F.col("bolsa")).alias("fullExchangeName"), F.lit(None).cast("long").alias("sharesShort"), F.lit(None).cast("double").alias("shortPercentOfFloat"), F.lit(1700000000).cast("long").alias("dateShortInterest"),
    )
    got = market.snapshots(raw.select(F.from_json(F.to_json(F.struct("*")), market.SNAPSHOT).alias("x")).select("x.*"))
    return got.select("ticker", "market_cap_usd", "precio_actual", "bolsa", "posicion_52w", _day("fecha_short").alias("fecha_short"))


def s12_holding_texts(s, d):
    """Clean start and raw text of the extracts of holdings."""
    docs = table(s, d, "documents").filter("source = 'extracto_13dg'")
    return docs.select("doc_id", F.md5(F.substring(text.html_to_text("text"), 1, 8000)).alias("limpio"), F.md5("text").alias("bruto"))


# Predicates -----------------------------------------------------------------


def x01_exchange(s, d):
    return table(s, d, "empresas").select("id", clean.accepted("bolsa", ACCEPT, REJECT).alias("valida"))


def x07_shelf_forms(s, d):
    docs = table(s, d, "documents").withColumn("f", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit(" s-3"), "formulario")).otherwise(F.col("formulario")))
    return docs.select("doc_id", clean.shelf_form("f").alias("shelf"))


def x11_audited(s, d):
    """Theses that no report names by number: the reports are given the number of the thesis
    before them, as a key of their JSON."""
    docs = table(s, d, "documents").select("doc_id", "source")
    rep = docs.filter("source = 'informe_auditor'").select(F.to_json(F.struct((F.col("doc_id") - F.pmod("doc_id", F.lit(5))).cast("string").alias("detective_auditoria_id"))).alias("r"))
    named = rep.select(F.get_json_object(text.first_json("r"), "$.detective_auditoria_id").try_cast("long").alias("doc_id"))
    return docs.filter("source = 'tesis_detective'").join(named, "doc_id", "left_anti").select("doc_id")


def x14_stale(s, d):
    """Companies whose market data are missing or older than a day, last found first."""
    e = table(s, d, "empresas")
    now = F.lit("2022-01-01 00:00:00").cast("timestamp_ntz")
    return e.filter(clean.is_stale("ultimo_update", "market_cap_usd", now, 24)).select("id", "ticker")


def f8_numbers(s, d):
    t = table(s, d, "insider_transactions")
    return t.select("id", clean.bounded_long(F.concat(F.col("acciones_tras_tx").cast("string"), F.lit(".0"))).alias("entero"), clean.bounded_decimal(F.col("precio_por_accion").cast("string"), 99_999_999, 4).alias("numerico"), clean.bounded_decimal(F.col("importe_total").cast("string"), 9_999_999_999_999, 2).alias("importe"))


# Writes ---------------------------------------------------------------------


def k1_companies(s, d):
    """Companies that are new by their number, put to those known."""
    e = table(s, d, "empresas").select("cik", "nombre", "sector")
    known, new = e.filter(F.pmod(F.col("cik").cast("long"), F.lit(2)) == 0), e.withColumn("nombre", F.upper("nombre"))
    return upsert.insert_absent(known, new, ["cik"])


_FIGURES = ["fecha_inicio", "fecha_fin", "revenue", "gross_profit", "net_income", "operating_cash_flow", "accounts_receivable", "shares_outstanding"]


def k3_eight_columns(s, d):
    """Quarters first published up to 2020, their eight figures replaced by those published
    since; the JSON of a known quarter stays."""
    m = table(s, d, "metricas_trimestrales").select("empresa_id", "anio_fiscal", "trimestre", *_FIGURES, "metricas_sector", "fecha_filing", "id").filter("empresa_id is not null and anio_fiscal is not null and trimestre is not null")
    keys, order = ["empresa_id", "anio_fiscal", "trimestre"], [-F.unix_date("fecha_filing"), -F.col("id")]  # keep the first
    old = F.col("fecha_filing") < F.lit("2020-01-01").cast("date")
    got = upsert.upsert(upsert.latest(m.filter(old), keys, order), m.filter(~F.coalesce(old, F.lit(False))), keys, order, _FIGURES)
    return got.select(*keys, _day("fecha_inicio").alias("fecha_inicio"), _day("fecha_fin").alias("fecha_fin"), *_FIGURES[2:], "metricas_sector")


def k4_without_data(s, d):
    """Active companies without quarters, marked as left out."""
    e = table(s, d, "empresas").select("id", "activa", "motivo_baja")
    none = e.join(table(s, d, "metricas_trimestrales").filter("revenue is not null and fecha_fin >= date '2025-06-01'").select(F.col("empresa_id").alias("id")), "id", "left_anti")
    return upsert.mark(e, none, "id", F.col("activa"), activa=F.lit(False), motivo_baja=F.lit("sin datos"))


def k6_overwrite(s, d):
    """Snapshots overwritten, nulls too, for two companies in three."""
    e = table(s, d, "empresas").select("id", "precio_actual", "volumen_medio_30d", "bolsa")
    new = e.filter(F.pmod("id", F.lit(3)) != 0).select("id", F.when(F.pmod("id", F.lit(2)) == 0, F.col("precio_actual") + 1).cast("decimal(12,4)").alias("precio_actual"), (F.col("volumen_medio_30d") * 2).alias("volumen_medio_30d"))
    got = upsert.overwrite(e, new, ["id"], [F.col("precio_actual")], ["precio_actual", "volumen_medio_30d"])
    return got.withColumn("precio_actual", F.col("precio_actual").cast("double"))


def k8_replace(s, d):
    """Holdings of the companies with one since 2022 replaced by their latest."""
    h = table(s, d, "participaciones_activistas").select("empresa_id", "id", "formulario", _day("fecha_evento").alias("fecha"))
    new = upsert.latest(h.filter("fecha >= '2022-01-01'"), ["empresa_id"], [F.col("fecha"), F.col("id")])
    return upsert.replace_group(h, new, "empresa_id")


def k9_text(s, d):
    """Texts of events set by number, where their document is there."""
    ev = table(s, d, "eventos_8k").select("id", "item", "doc_id")
    docs = table(s, d, "documents").select("doc_id", F.md5("text").alias("texto"))
    new = ev.filter("doc_id is not null").join(docs, "doc_id").select("id", "texto")
    return upsert.overwrite(ev.withColumn("texto", F.lit("-")), new, ["id"], [F.col("texto")], ["texto"]).select("id", "item", "texto")


def k12_shelf(s, d):
    """Shelf flag and date set and unset from the filing indexes."""
    e = table(s, d, "empresas").select("cik", "shelf_activa", "fecha_ultimo_shelf")
    f = facts.shelf_and_late(facts.filings(_index(s, d)), AS_OF, 36)
    new = f.select("cik", F.col("fecha_shelf").isNotNull().alias("shelf_activa"), F.col("fecha_shelf").alias("fecha_ultimo_shelf"))
    got = upsert.overwrite(e, new, ["cik"], [F.col("fecha_ultimo_shelf")], ["shelf_activa", "fecha_ultimo_shelf"])
    return got.withColumn("fecha_ultimo_shelf", _day("fecha_ultimo_shelf"))


QUERIES = {f.__name__: f for f in (
    s2_tsv, n16_form4, j2_first_owner, s4_sectors, s6_latest_10q, s7_10q_as_of, s10_shelf_and_late, s8_current_reports, s11_hits, n1_facts, n2_quarters, s5_market, s12_holding_texts,
    x01_exchange, x07_shelf_forms, x11_audited, x14_stale, f8_numbers, k1_companies, k3_eight_columns, k4_without_data, k6_overwrite, k8_replace, k9_text, k12_shelf,
)}

# SQL ------------------------------------------------------------------------

_IDX = """idx AS (SELECT e.cik, d.doc_id, d.fecha_doc AS f, CASE d.doc_id % 7 WHEN 0 THEN 'S-3/A' WHEN 1 THEN ' 424b5 ' WHEN 2 THEN 'NT 10-Q' ELSE d.formulario END AS form
  FROM documents d JOIN empresas e ON e.id = d.empresa_id WHERE d.fecha_doc IS NOT NULL)"""
_SHELF = f"""sh AS (SELECT cik, max(f) FILTER (WHERE f BETWEEN DATE '{AS_OF}' - 1080 AND DATE '{AS_OF}' AND regexp_matches(upper(trim(form)), '^(S-3|424B)')) AS shelf,
  max(f) FILTER (WHERE f BETWEEN DATE '{AS_OF}' - 1080 AND DATE '{AS_OF}' AND upper(trim(form)) LIKE 'NT 10%') AS nt FROM idx GROUP BY 1)"""


def _latest(cond: str) -> str:
    return f"WITH {_IDX} SELECT cik, CAST(doc_id AS VARCHAR) AS accession_number, strftime(f, '%Y-%m-%d') AS fecha FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY f DESC, doc_id DESC) AS rn FROM idx WHERE form = '10-Q' AND {cond}) x WHERE rn = 1"


_EMPTY = "lower(trim({0})) IN ('nan', 'nat', 'none', '')"
_OR_NULL = "CASE WHEN NOT (lower(trim({0})) IN ('nan', 'nat', 'none', '')) THEN trim({0}) END"
_FACTS = """m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY empresa_id, fecha_fin ORDER BY id) AS rn FROM metricas_trimestrales WHERE fecha_fin IS NOT NULL AND empresa_id IS NOT NULL) t WHERE rn = 1),
ser AS (
  SELECT empresa_id, 'revenue' AS campo, fecha_fin, fecha_inicio, CASE WHEN id % 3 <> 0 THEN revenue ELSE revenue + 1 END AS val, anio_fiscal AS fy, 'Q' || trimestre AS fp FROM m WHERE revenue IS NOT NULL AND fecha_fin - fecha_inicio BETWEEN 80 AND 100
  UNION ALL SELECT empresa_id, 'gross_profit', fecha_fin, fecha_inicio, gross_profit, anio_fiscal, 'Q' || trimestre FROM m WHERE gross_profit IS NOT NULL AND fecha_fin - fecha_inicio BETWEEN 80 AND 100
  UNION ALL SELECT empresa_id, 'shares_outstanding', fecha_fin, fecha_inicio, shares_outstanding, anio_fiscal, 'Q' || trimestre FROM m WHERE shares_outstanding IS NOT NULL)"""

SQL = {
    "s2_tsv": "SELECT accession_number, CAST(trans_sk AS VARCHAR) AS nonderiv_trans_sk, strftime(fecha_transaccion, '%Y-%m-%d') AS fecha, CAST(acciones AS VARCHAR) AS trans_shares, CAST(precio_por_accion AS VARCHAR) AS trans_pricepershare, CAST(NULL AS VARCHAR) AS security_title FROM insider_transactions",
    "n16_form4": f"""
WITH sub AS (SELECT accession_number, min(empresa_id) AS empresa_id, max(CAST(fecha_registro AS DATE)) AS filed FROM insider_transactions GROUP BY 1),
own AS (SELECT accession_number, nombre_insider AS n, cargo AS c FROM (SELECT *, row_number() OVER (PARTITION BY accession_number ORDER BY id) AS rn FROM insider_transactions) t WHERE rn = 1),
t AS (SELECT t.*, s.empresa_id AS e, s.filed, o.n, o.c FROM insider_transactions t JOIN sub s ON s.accession_number = t.accession_number JOIN own o ON o.accession_number = t.accession_number JOIN empresas x ON x.id = s.empresa_id),
v AS (SELECT *, CASE WHEN acciones <> 0 AND abs(acciones) <= 100000000000000 THEN abs(acciones) END AS a, CASE WHEN precio_por_accion > 0 AND precio_por_accion <= 1000000 THEN precio_por_accion END AS p FROM t)
SELECT accession_number, trans_sk, e AS empresa_id, {_OR_NULL.format('n')} AS nombre_insider, coalesce({_OR_NULL.format('c')}, 'Director') AS cargo,
  CASE WHEN upper(trim(tipo_transaccion)) IN ('P', 'S', 'A', 'M', 'F', 'G', 'X', 'D', 'C', 'E', 'H', 'I', 'J', 'K', 'L', 'O', 'U', 'V', 'W', 'Z') THEN upper(trim(tipo_transaccion)) END AS tipo_transaccion, strftime(fecha_transaccion, '%Y-%m-%d') AS fecha, a AS acciones, CAST(p AS DOUBLE) AS precio_por_accion,
  CASE WHEN abs(round(CAST(a AS DECIMAL(18,0)) * p, 2)) <= 100000000000000 THEN CAST(round(CAST(a AS DECIMAL(18,0)) * p, 2) AS DOUBLE) END AS importe_total
FROM v WHERE fecha_transaccion <= DATE '{AS_OF}' AND year(fecha_transaccion) >= 2009 AND (filed IS NULL OR fecha_transaccion <= filed)""",
    "j2_first_owner": "SELECT accession_number, nombre_insider AS titular, cargo, n AS filas FROM (SELECT *, row_number() OVER (PARTITION BY accession_number ORDER BY id) AS rn, count(*) OVER (PARTITION BY accession_number) AS n FROM insider_transactions) t WHERE rn = 1",
    "s4_sectors": "SELECT cik, trim(sic) AS sic, nullif(trim(sector), '') AS sector, nombre FROM empresas e WHERE trim(sic) <> '' AND EXISTS (SELECT 1 FROM documents d WHERE d.empresa_id = e.id AND d.fecha_doc IS NOT NULL)",
    "s6_latest_10q": _latest("TRUE"),
    "s7_10q_as_of": _latest("f <= DATE '2022-06-30'"),
    "s10_shelf_and_late": f"WITH {_IDX}, {_SHELF} SELECT cik, strftime(shelf, '%Y-%m-%d') AS fecha_shelf, strftime(nt, '%Y-%m-%d') AS fecha_nt FROM sh",
    "s8_current_reports": f"""
WITH e AS (SELECT accession_number, CAST(min(empresa_id) AS VARCHAR) AS cik, max(fecha_evento) AS f, string_agg(DISTINCT item, '|' ORDER BY item) FILTER (WHERE item IN ('1.01', '2.01', '5.02')) AS items FROM eventos_8k WHERE fecha_evento IS NOT NULL GROUP BY 1)
SELECT cik, accession_number, strftime(f, '%Y-%m-%d') AS fecha, items FROM e WHERE f >= DATE '{AS_OF}' - 720 AND items IS NOT NULL""",
    "s11_hits": "SELECT CAST(empresa_id AS VARCHAR) AS cik, accession_number, formulario AS form, strftime(fecha_evento, '%Y-%m-%d') AS fecha, 'Fondo ' || id AS filer, CASE WHEN id % 2 = 0 THEN 'doc.htm' ELSE 'primary_doc.xml' END AS document FROM participaciones_activistas",
    "n1_facts": f"WITH {_FACTS} SELECT CAST(empresa_id AS VARCHAR) AS cik, campo, strftime(fecha_fin, '%Y-%m-%d') AS fin, strftime(fecha_inicio, '%Y-%m-%d') AS inicio, val, fy, fp FROM ser",
    "n2_quarters": f"""
WITH {_FACTS},
r AS (SELECT *, row_number() OVER (PARTITION BY empresa_id ORDER BY fecha_fin DESC) AS rn FROM ser WHERE campo = 'revenue'),
p AS (SELECT r.empresa_id, r.fecha_fin, r.fecha_inicio, r.val AS revenue, g.val AS gross_profit, s.val AS shares_outstanding, CASE WHEN r.fy > 0 AND regexp_matches(r.fp, '^Q[1-4]$') THEN r.fy ELSE year(r.fecha_fin) END AS y, CASE WHEN r.fy > 0 AND regexp_matches(r.fp, '^Q[1-4]$') THEN CAST(r.fp[2:] AS INTEGER) ELSE quarter(r.fecha_fin) END AS q
  FROM r LEFT JOIN ser g ON g.empresa_id = r.empresa_id AND g.fecha_fin = r.fecha_fin AND g.campo = 'gross_profit' LEFT JOIN ser s ON s.empresa_id = r.empresa_id AND s.fecha_fin = r.fecha_fin AND s.campo = 'shares_outstanding' WHERE r.rn <= 12 AND r.fecha_fin >= DATE '2012-06-15')
SELECT CAST(empresa_id AS VARCHAR) AS cik, CAST(y AS INTEGER) AS anio_fiscal, CAST(q AS INTEGER) AS trimestre, strftime(coalesce(fecha_inicio, fecha_fin - 90), '%Y-%m-%d') AS inicio, strftime(fecha_fin, '%Y-%m-%d') AS fin, revenue, gross_profit, shares_outstanding
FROM (SELECT *, row_number() OVER (PARTITION BY empresa_id, y, q ORDER BY fecha_fin DESC) AS k FROM p) x WHERE k = 1""",
    "s5_market": """
SELECT ticker, market_cap_usd, CAST(precio_actual AS DOUBLE) AS precio_actual, CASE WHEN id % 2 = 1 AND bolsa IS NOT NULL THEN bolsa ELSE 'XX' END AS bolsa,
  CASE WHEN precio_max_52w > precio_min_52w THEN round((CAST(precio_actual AS DOUBLE) - precio_min_52w) / (CAST(precio_max_52w AS DOUBLE) - precio_min_52w), 4) END AS posicion_52w, '2023-11-14' AS fecha_short
FROM empresas WHERE market_cap_usd IS NOT NULL OR precio_actual IS NOT NULL""",
    "x01_exchange": "SELECT id, coalesce(" + " AND ".join(["(" + " OR ".join(f"contains(upper(bolsa), '{w}')" for w in ACCEPT) + ")", *[f"NOT contains(upper(bolsa), '{w}')" for w in REJECT]]) + ", FALSE) AS valida FROM empresas",
    "x07_shelf_forms": "SELECT doc_id, coalesce(regexp_matches(upper(trim(CASE WHEN doc_id % 3 = 0 THEN ' s-3' || formulario ELSE formulario END)), '^(S-3|424B)'), FALSE) AS shelf FROM documents",
    "x11_audited": "SELECT doc_id FROM documents WHERE source = 'tesis_detective' AND doc_id NOT IN (SELECT doc_id - doc_id % 5 FROM documents WHERE source = 'informe_auditor')",
    "x14_stale": "SELECT id, ticker FROM empresas WHERE market_cap_usd IS NULL OR ultimo_update < TIMESTAMP '2022-01-01' - INTERVAL 24 HOUR",
    "f8_numbers": "SELECT id, acciones_tras_tx AS entero, CASE WHEN abs(precio_por_accion) <= 99999999 THEN CAST(precio_por_accion AS DOUBLE) END AS numerico, CASE WHEN abs(importe_total) <= 9999999999999 THEN CAST(importe_total AS DOUBLE) END AS importe FROM insider_transactions",
    "k1_companies": "SELECT cik, CASE WHEN CAST(cik AS BIGINT) % 2 = 0 THEN nombre ELSE upper(nombre) END AS nombre, sector FROM empresas",
    "k3_eight_columns": f"""
WITH t AS (SELECT *, fecha_filing IS NOT NULL AND fecha_filing < DATE '2020-01-01' AS old FROM metricas_trimestrales WHERE empresa_id IS NOT NULL AND anio_fiscal IS NOT NULL AND trimestre IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY empresa_id, anio_fiscal, trimestre, old ORDER BY fecha_filing IS NULL, fecha_filing, id) AS rn FROM t),
o AS (SELECT * FROM l WHERE old AND rn = 1), n AS (SELECT * FROM l WHERE NOT old AND rn = 1)
SELECT coalesce(o.empresa_id, n.empresa_id) AS empresa_id, coalesce(o.anio_fiscal, n.anio_fiscal) AS anio_fiscal, coalesce(o.trimestre, n.trimestre) AS trimestre,
  {', '.join(f"strftime(CASE WHEN n.id IS NULL THEN o.{c} ELSE n.{c} END, '%Y-%m-%d') AS {c}" for c in _FIGURES[:2])}, {', '.join(f"CASE WHEN n.id IS NULL THEN o.{c} ELSE n.{c} END AS {c}" for c in _FIGURES[2:])}, CASE WHEN o.id IS NULL THEN n.metricas_sector ELSE o.metricas_sector END AS metricas_sector
FROM o FULL JOIN n ON o.empresa_id = n.empresa_id AND o.anio_fiscal = n.anio_fiscal AND o.trimestre = n.trimestre""",
    "k4_without_data": """
SELECT id, CASE WHEN hit THEN FALSE ELSE activa END AS activa, CASE WHEN hit THEN 'sin datos' ELSE motivo_baja END AS motivo_baja
FROM (SELECT *, coalesce(activa, FALSE) AND NOT EXISTS (SELECT 1 FROM metricas_trimestrales m WHERE m.empresa_id = e.id AND m.revenue IS NOT NULL AND m.fecha_fin >= DATE '2025-06-01') AS hit FROM empresas e) x""",
    "k6_overwrite": "SELECT id, CAST(CASE WHEN id % 3 = 0 THEN precio_actual WHEN id % 2 = 0 THEN precio_actual + 1 END AS DOUBLE) AS precio_actual, CASE WHEN id % 3 = 0 THEN volumen_medio_30d ELSE volumen_medio_30d * 2 END AS volumen_medio_30d, bolsa FROM empresas",
    "k8_replace": """
WITH h AS (SELECT empresa_id, id, formulario, strftime(fecha_evento, '%Y-%m-%d') AS fecha FROM participaciones_activistas),
n AS (SELECT empresa_id, id, formulario, fecha FROM (SELECT *, row_number() OVER (PARTITION BY empresa_id ORDER BY fecha DESC, id DESC) AS rn FROM h WHERE fecha >= '2022-01-01') x WHERE rn = 1)
SELECT * FROM h WHERE empresa_id NOT IN (SELECT empresa_id FROM n) UNION ALL SELECT * FROM n""",
    "k9_text": "SELECT e.id, e.item, CASE WHEN d.doc_id IS NULL THEN '-' ELSE md5(d.text) END AS texto FROM eventos_8k e LEFT JOIN documents d ON d.doc_id = e.doc_id",
    "k12_shelf": f"""
WITH {_IDX}, {_SHELF}
SELECT e.cik, CASE WHEN sh.cik IS NULL THEN e.shelf_activa ELSE sh.shelf IS NOT NULL END AS shelf_activa, strftime(CASE WHEN sh.cik IS NULL THEN e.fecha_ultimo_shelf ELSE sh.shelf END, '%Y-%m-%d') AS fecha_ultimo_shelf FROM empresas e LEFT JOIN sh ON sh.cik = e.cik""",
}


def _s12() -> str:
    from .filings import _html_sql

    return f"SELECT doc_id, md5(substring({_html_sql('text')}, 1, 8000)) AS limpio, md5(text) AS bruto FROM documents WHERE source = 'extracto_13dg'"


SQL["s12_holding_texts"] = _s12()
