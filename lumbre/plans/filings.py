"""Queries of the data-processing operators over the filing tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean, quality, register, text
from ..operators import asof as joins
from ..operators import cluster, pit, series, upsert
from ..session import cut_lineage, left_join, table
from ..sources import market, sinks

DAY = "yyyy-MM-dd"
#: Words of a C-suite title, the vice ranks taken out before they are looked for.
CSUITE = (("CHIEF EXECUTIVE", "CEO", "CHIEF FINANCIAL", "CFO", "CHIEF OPERATING", "COO", "PRESIDENT", "CHAIRMAN"), ("VICE PRESIDENT", "VICE CHAIRMAN"), r"\b[SEA]?VP\b")


def _day(c) -> F.Column:
    return F.date_format(c, DAY)


def _buys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "insider_transactions").filter((clean.tx_code("tipo_transaccion") == "P") & F.col("fecha_transaccion").isNotNull())


def _quarters(s: SparkSession, d: str) -> DataFrame:
    """One row per empresa and quarter: the first published."""
    m = table(s, d, "metricas_trimestrales").withColumn("q", clean.quarter_index("anio_fiscal", "trimestre"))
    return upsert.latest(m, ["empresa_id", "q"], [F.col("fecha_filing").isNotNull(), -F.unix_date("fecha_filing"), -F.col("id")])


# Clusters -------------------------------------------------------------------


def w1_clusters(s, d):
    c = cluster.first_clusters(_buys(s, d), "empresa_id", "nombre_insider", "fecha_transaccion", 60, 3)
    return c.select("empresa_id", "found", "members_max", _day("anchor").alias("anchor"), _day("detected").alias("detected"))


def w1_orders(s, d):
    o = table(s, d, "orders").filter("o_orderstatus = 'F'").withColumn("d", F.to_date("o_orderdate"))
    c = cluster.first_clusters(o, "o_custkey", "o_orderpriority", "d", 180, 3)
    return c.select("o_custkey", "found", "members_max", _day("anchor").alias("anchor"), _day("detected").alias("detected"))


def w10_before(s, d):
    """Clusters among the purchases before 2020 only."""
    b = _buys(s, d).filter(F.col("fecha_transaccion") < F.lit("2020-01-01").cast("date"))
    return cluster.first_clusters(b, "empresa_id", "nombre_insider", "fecha_transaccion", 60, 3).filter("found").select("empresa_id", "members_max", _day("detected").alias("detected"))


def _windowed(s, d):
    b = _buys(s, d)
    return cluster.within_window(b, cluster.first_clusters(b, "empresa_id", "nombre_insider", "fecha_transaccion", 60, 3), "empresa_id", "fecha_transaccion", 60)


def a1_window_totals(s, d):
    w = _windowed(s, d)
    name = F.when(F.col("nombre_insider") != "", F.col("nombre_insider"))
    return w.groupBy("empresa_id").agg(F.count_distinct(name).alias("insiders"), F.coalesce(F.sum("importe_total"), F.lit(0)).cast("double").alias("importe"))


def w2_titles(s, d):
    """Whether the cluster window of each entity holds a C-suite title, vice ranks
    apart; false without a cluster."""
    b = _buys(s, d)
    c = cluster.first_clusters(b, "empresa_id", "nombre_insider", "fecha_transaccion", 60, 3)
    return cluster.any_in_window(b, c, "empresa_id", "fecha_transaccion", 60, cluster.mentions("cargo", *CSUITE), "alto_cargo")


# Series ---------------------------------------------------------------------


def w3_growth(s, d):
    g = series.growth_halves(_quarters(s, d), "empresa_id", "q", "revenue", 8)
    return g.select("empresa_id", F.col("tasas").cast("int").alias("tasas"), F.round("media_antigua", 6).alias("media_antigua"), F.round("media_reciente", 6).alias("media_reciente"))


def w4_margins(s, d):
    m = _quarters(s, d).filter("revenue > 0 and gross_profit is not null").withColumn("v", F.col("gross_profit") / F.col("revenue"))
    a = m.groupBy("empresa_id").agg(F.transform(series.ordered("v", "q", 8), lambda x: x["v"]).alias("s")).filter(F.size("s") >= 4)
    old, new = series.half_means(F.col("s"))
    return a.select("empresa_id", F.round(old, 6).alias("margen_antiguo"), F.round(new, 6).alias("margen_reciente"))


def w4_cash(s, d):
    q = series.last_k(_quarters(s, d).filter("operating_cash_flow is not null"), ["empresa_id"], [F.col("q").desc()], 4)
    e = q.groupBy("empresa_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("operating_cash_flow", "q").alias("ultimo"), F.min_by("operating_cash_flow", "q").alias("primero"))
    return e.filter("n = 4").select("empresa_id", "primero", "ultimo", (F.col("ultimo") > F.col("primero")).alias("mejora"))


def w7_labels(s, d):
    """The last 8 quarters up to each case's date, labelled T-7 to T-0."""
    return _case_quarters(s, d, 8).select("caso_id", F.concat(F.lit("T-"), (F.col("rn") - 1).cast("string")).alias("etiqueta"), "revenue", "net_income")


def _case_quarters(s, d, k):
    cases = pit.with_entity(table(s, d, "validadas_historicas"), table(s, d, "empresas")).select("caso_id", F.col("empresa_id").alias("e"), "fecha_deteccion")
    q = _quarters(s, d).filter("fecha_fin is not null")
    j = cases.join(q, (F.col("e") == F.col("empresa_id")) & (F.col("fecha_fin") <= F.col("fecha_deteccion")))
    return series.last_k(j, ["caso_id"], [F.col("fecha_fin").desc(), F.col("q").desc()], k)


def w9_sample(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    return series.systematic_sample(o, [F.col("o_orderkey")], 100)


# Joins ----------------------------------------------------------------------


def j6_quarter_of_filing(s, d):
    docs = table(s, d, "documents").select("doc_id", "empresa_id", "fecha_doc")
    m = table(s, d, "metricas_trimestrales").withColumn("fin", F.col("fecha_fin"))
    got = joins.asof(docs, m, "empresa_id", "fecha_doc", "fecha_fin", ["id", "fin"], tie=[-F.col("id")])
    return got.select("doc_id", F.col("id").alias("metrica_id"), _day("fin").alias("fin"))


def j7_shares(s, d):
    """Shares above 10,000 of the last quarter up to each case's date."""
    cases = pit.with_entity(table(s, d, "validadas_historicas"), table(s, d, "empresas")).select("caso_id", "empresa_id", "fecha_deteccion")
    m = table(s, d, "metricas_trimestrales").filter("shares_outstanding > 10000")
    got = joins.asof(cases, m, "empresa_id", "fecha_deteccion", "fecha_fin", ["id", "shares_outstanding"], tie=[-F.col("id")])
    return got.select("caso_id", "shares_outstanding")


def _rounded(c, n):
    """Doubles rounded as the SQL does it: 67.49125 is 674912.4999... ten-thousandths, so 67.4912;
    F.round goes by the digits and says 67.4913."""
    return F.round(c * F.lit(10.0**n), 0) / F.lit(10.0**n)


def _mean_value():
    """Aggregate: the mean value of events; their sum is exact, so the order of rows changes nothing."""
    return _rounded(F.try_divide(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), F.count("value")), 4)


def _prices(s, d):
    e = table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("dia")).agg(_mean_value().alias("cierre"))
    return e.withColumn("visto", F.col("dia"))


def _asks(s, d):
    e = table(s, d, "events").filter("event_type = 'purchase'")
    return e.select("event_id", "user_id", F.to_date("ts").alias("d0"))


def j8_price_before(s, d):
    a = _asks(s, d).withColumn("d1", F.date_sub("d0", 1))
    got = joins.asof(a, _prices(s, d), "user_id", "d1", "dia", ["cierre", "visto"], tolerance=10)
    return got.select("event_id", "cierre", _day("visto").alias("dia"))


def j9_price_after(s, d):
    a = _asks(s, d).withColumn("d1", F.date_add("d0", 5))
    got = joins.asof(a, _prices(s, d), "user_id", "d1", "dia", ["cierre", "visto"], forward=True, tolerance=11)
    return got.select("event_id", "cierre", _day("visto").alias("dia"))


def j11_purchases_before(s, d):
    cases = pit.with_entity(table(s, d, "validadas_historicas"), table(s, d, "empresas")).select("caso_id", "empresa_id", "fecha_deteccion")
    j = joins.interval_join(cases, _buys(s, d), "empresa_id", "fecha_deteccion", "fecha_transaccion", 60, 0, ["id", "importe_total"])
    return j.groupBy("caso_id").agg(F.count(F.lit(1)).alias("compras"), F.sum("importe_total").cast("double").alias("importe"))


def a2_worklist(s, d):
    docs = table(s, d, "documents").filter("source in ('tesis_detective', 'informe_auditor') and empresa_id is not null")
    done = docs.select("empresa_id", F.col("source").alias("modelo"), F.col("fecha_registro").alias("t"))
    news = [table(s, d, t).select("empresa_id", F.col("fecha_registro").alias("t")) for t in ("eventos_8k", "participaciones_activistas")]
    cand = table(s, d, "empresas").filter("activa").select(F.col("id").alias("empresa_id"))
    return series.pending_work(cand, done, news, "empresa_id", ["tesis_detective", "informe_auditor"], "modelo", "t").select("empresa_id", "modelo")


def l7_group_limit(s, d):
    """All pending kinds of the 20 first entities by capitalisation."""
    w = a2_worklist(s, d).join(table(s, d, "empresas").select(F.col("id").alias("empresa_id"), F.coalesce("market_cap_usd", F.lit(-1)).alias("cap")), "empresa_id")
    top = w.select("empresa_id", "cap").distinct().orderBy(F.col("cap").desc(), "empresa_id").limit(20)
    return w.join(F.broadcast(top.select("empresa_id")), "empresa_id", "left_semi").select("empresa_id", "modelo", "cap")


def j16_no_recent_quarter(s, d):
    e = table(s, d, "empresas").select("id", "ticker")
    return series.missing_since(e, table(s, d, "metricas_trimestrales"), "id", "empresa_id", "fecha_fin", F.lit("2026-03-01").cast("date"))


def j17_with_shares(s, d):
    m = table(s, d, "metricas_trimestrales").filter("shares_outstanding is not null").select(F.col("empresa_id").alias("id"))
    return table(s, d, "empresas").select("id", "ticker").join(m, "id", "left_semi")


def j20_history(s, d):
    m = table(s, d, "metricas_trimestrales").groupBy(F.col("empresa_id").alias("id")).agg(F.max("fecha_fin").alias("u"), F.count(F.lit(1)).alias("n"))
    return table(s, d, "empresas").join(m, "id", "left").select("id", "cik", _day("u").alias("ultimo"), F.coalesce("n", F.lit(0).cast("long")).alias("trimestres"))


def j18_documents(s, d):
    e = table(s, d, "empresas").select(F.col("id").alias("empresa_id"), "ticker")
    return table(s, d, "documents").join(e, "empresa_id").groupBy("ticker", "source").agg(F.count(F.lit(1)).alias("documentos"), F.max("doc_id").alias("ultimo"))


# Versions -------------------------------------------------------------------


def k2_upsert(s, d):
    """Transactions registered before 2022, upserted with those since."""
    t = table(s, d, "insider_transactions").select("accession_number", "trans_sk", "id", "empresa_id", "acciones", "precio_por_accion", "fecha_registro")
    cut = F.lit("2022-01-01").cast("timestamp_ntz")
    order = [F.col("fecha_registro"), F.col("id")]
    keys = ["accession_number", "trans_sk"]
    old = upsert.latest(t.filter(F.col("fecha_registro") < cut), keys, order)
    return upsert.upsert(old, t.filter(F.col("fecha_registro") >= cut), keys, order, ["id", "acciones", "precio_por_accion", "fecha_registro"]).drop("fecha_registro").withColumn("precio_por_accion", F.col("precio_por_accion").cast("double"))


def k10_insert(s, d):
    """Events, and of holdings those whose accession number is new, as one table."""
    a = table(s, d, "eventos_8k").select("accession_number", "empresa_id").groupBy("accession_number").agg(F.min("empresa_id").alias("empresa_id"))
    b = table(s, d, "participaciones_activistas").select("accession_number", "empresa_id")
    return upsert.insert_absent(a, b, ["accession_number"])


def k3_quarters(s, d):
    return _quarters(s, d).select("empresa_id", "anio_fiscal", "trimestre", "id", "revenue", "net_income")


# Aggregates and reports -----------------------------------------------------


def a3_funnel(s, d):
    e = table(s, d, "empresas")
    when = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return e.agg(F.count(F.lit(1)).alias("total"), when(F.col("activa")).alias("activas"), when(F.col("market_cap_usd").isNotNull()).alias("con_mercado"), when(F.col("shelf_activa")).alias("con_shelf"), F.count_distinct("sic").alias("sectores"))


def a5_columns(s, d):
    """Means and counts over the quarters of a fiscal year."""
    return _quarters(s, d).groupBy("anio_fiscal").agg(F.count(F.lit(1)).alias("n"), F.count("revenue").alias("con_ventas"), F.round(F.avg(F.col("revenue").cast("decimal(28,4)")), 2).cast("double").alias("media"))


def a6_upper_median(s, d):
    p = table(s, d, "insider_transactions").filter("precio_por_accion is not null").withColumn("t", clean.tx_code("tipo_transaccion"))
    return series.medians(p.filter("t is not null"), ["t"], "precio_por_accion").select("t", "n", F.col("alto").cast("double").alias("mediana_alta"))


def a7_median(s, d):
    v = table(s, d, "validadas_historicas").withColumn("anio", F.year("fecha_deteccion"))
    m = series.medians(v, ["anio"], "market_cap_historico").select(F.col("anio").alias("a"), F.round((F.col("bajo") + F.col("alto")) / 2, 2).alias("mediana"))
    n = v.groupBy("anio").agg(F.count(F.lit(1)).alias("casos"))
    return n.join(m, F.col("a").eqNullSafe(F.col("anio")), "left").select("anio", "casos", "mediana")


def a8_recall(s, d):
    """Share of the cases whose empresa had a cluster before its date."""
    cases = pit.with_entity(table(s, d, "validadas_historicas"), table(s, d, "empresas"))
    c = cluster.first_clusters(_buys(s, d), "empresa_id", "nombre_insider", "fecha_transaccion", 60, 3).filter("found").select("empresa_id", "detected")
    j = cases.join(c, "empresa_id", "left").withColumn("hit", F.coalesce(F.col("detected") <= F.col("fecha_deteccion"), F.lit(False)).cast("int"))
    return j.agg(F.count(F.lit(1)).alias("casos"), F.sum("hit").alias("con_senal"), F.round(F.sum("hit") / F.count(F.lit(1)), 6).alias("recall"))


def a9_smallest(s, d):
    v = pit.with_entity(table(s, d, "validadas_historicas"), table(s, d, "empresas")).filter("market_cap_historico between 5e7 and 2e9")
    best = F.min(F.struct("market_cap_historico", "fecha_deteccion", "caso_id"))
    return v.groupBy("empresa_id").agg(best.alias("b")).select("empresa_id", "b.caso_id", F.round("b.market_cap_historico", 2).alias("capitalizacion"), _day("b.fecha_deteccion").alias("fecha"))


def a10_buckets(s, d):
    c = F.col("market_cap_historico")
    b = F.when(c.isNull(), "sin_dato").when(c < 5e7, "menor").when(c <= 2e9, "dentro").otherwise("mayor")
    return table(s, d, "validadas_historicas").groupBy(b.alias("grupo")).agg(F.count(F.lit(1)).alias("n"))


def l1_top(s, d):
    return table(s, d, "empresas").filter("market_cap_usd is not null").orderBy(F.col("market_cap_usd").desc(), "id").select("id", "ticker", "market_cap_usd").limit(15)


def l5_latest_purchases(s, d):
    k = series.last_k(_buys(s, d), ["empresa_id"], [F.col("fecha_transaccion").desc_nulls_first(), F.col("id").desc()], 10)
    return k.select("empresa_id", F.col("rn").cast("int").alias("rn"), "id", _day("fecha_transaccion").alias("fecha"))


def n8_context(s, d):
    """One row per empresa with its latest events, holdings and purchases as lists."""
    def lst(df, t, k, name):
        df = series.last_k(df.filter(F.col(t).isNotNull()), ["empresa_id"], [F.col(t).desc(), F.col("id").desc()], k)
        a = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col("id").cast("string").alias("x")))), lambda z: z["x"]), ",")
        return df.groupBy("empresa_id").agg(a.alias(name))

    ev = lst(table(s, d, "eventos_8k"), "fecha_evento", 5, "eventos")
    ho = lst(table(s, d, "participaciones_activistas"), "fecha_evento", 3, "participaciones")
    bu = lst(_buys(s, d), "fecha_transaccion", 10, "compras")
    e = table(s, d, "empresas").select(F.col("id").alias("empresa_id"), "ticker")
    return e.join(ev, "empresa_id", "left").join(ho, "empresa_id", "left").join(bu, "empresa_id", "left").select("empresa_id", "ticker", "eventos", "participaciones", "compras")


def u2_drilldown(s, d):
    q = _quarters(s, d).filter("revenue > 0")
    return q.select("empresa_id", "anio_fiscal", "trimestre", "revenue", (F.round(F.lit(100.0) * F.col("gross_profit") / F.col("revenue"), 1) + 0.0).alias("margen_pct"))


def u4_parameters(s, d):
    table(s, d, "empresas").createOrReplaceTempView("lumbre_empresas")
    return s.sql("SELECT id, ticker, sic FROM lumbre_empresas WHERE market_cap_usd BETWEEN :low AND :high", args={"low": 50_000_000, "high": 500_000_000})


# Returns --------------------------------------------------------------------


def _returns(s, d, entry_days, days, exit_):
    """Purchases with the values at their entry (the first from ``entry_days`` after them, at
    most 11 days later) and exit (``days`` after that, looked up as ``exit_`` says)."""
    a = _asks(s, d).withColumn("d1", F.date_add("d0", entry_days)).withColumn("d2", F.date_add("d1", days))
    p = _prices(s, d)
    both = a.select("user_id", F.explode(F.array("d1", "d2")).alias("day"))
    got = joins.lookups(both, p, "user_id", "day", "dia", "cierre", {"entra": ("first", 0, 11), "sale": exit_})
    one = got.select("user_id", F.col("day").alias("d1"), F.col("entra").alias("in_cierre"))
    two = got.select("user_id", F.col("day").alias("d2"), F.col("sale").alias("out_cierre"))
    return left_join(left_join(a, one, ["user_id", "d1"]), two, ["user_id", "d2"])


def f24_returns(s, d):
    """Entry at the first price from day 5, exit at the first from day 10 after it."""
    r = _returns(s, d, 5, 10, ("first", 0, 11))
    ok = (F.col("in_cierre") > 0) & (F.col("out_cierre") > 0)
    return r.select("event_id", F.when(ok, F.round((F.col("out_cierre") - F.col("in_cierre")) / F.col("in_cierre"), 6)).alias("retorno"))


def _growth(out, first):
    """Growth as the SQL has it: infinite over zero, NaN from zero to zero."""
    return F.when(F.col(first) == 0, F.col(out) * F.lit(float("inf"))).otherwise(F.col(out) / F.col(first)) - 1


def f26_excess(s, d):
    """Entry from day 7, exit at the last price up to day 12 after it, at most 5 days
    stale; the excess is over the mean of all users on the same days."""
    r = _returns(s, d, 7, 12, ("last", -5, 0)).withColumn("ret", _growth("out_cierre", "in_cierre"))
    m = table(s, d, "events").groupBy(F.to_date("ts").alias("dia")).agg(_mean_value().alias("media"))
    days = _asks(s, d).select("d0").distinct()
    days = days.select(F.explode(F.array(F.date_add("d0", 7), F.date_add("d0", 19))).alias("day"))
    b = joins.lookups(days, m, None, "day", "dia", "media", {"entra": ("first", 0, 11), "sale": ("last", -5, 0)})
    r = left_join(r, b.select(F.col("day").alias("d1"), F.col("entra").alias("in_media")), ["d1"])
    r = left_join(r, b.select(F.col("day").alias("d2"), F.col("sale").alias("out_media")), ["d2"])
    ref = _growth("out_media", "in_media")
    return r.select("event_id", _rounded(F.col("ret"), 6).alias("retorno"), _rounded(F.col("ret") - ref, 6).alias("exceso"))


def w8_peaks(s, d):
    """Highest later price over the price at each purchase, and its place in the range of 14 days."""
    a = _asks(s, d)
    got = joins.lookups(a, _prices(s, d), "user_id", "d0", "dia", "cierre", {"base": ("first", 0, None), "top": ("max", 0, 400), "lo": ("min", -14, 0), "hi": ("max", -14, 0), "n": ("count", -14, 0)})
    # a purchase with no price within reach, before or after, has no row
    g = a.join(got.filter((F.col("base") > 0) & (F.col("top").isNotNull() | (F.col("n") > 0))), ["user_id", "d0"])
    place = F.when((F.col("n") >= 5) & (F.col("hi") > F.col("lo")), F.round((F.col("base") - F.col("lo")) / (F.col("hi") - F.col("lo")), 2))
    return g.select("event_id", F.round(F.col("top") / F.col("base"), 1).alias("multiplo"), place.alias("posicion"))


# Values and texts -----------------------------------------------------------


def f_clean(s, d):
    t = table(s, d, "insider_transactions")
    raw = F.concat(F.col("precio_por_accion").cast("string"), F.lit(""))
    return t.select(
        "id",
        clean.cik(F.concat(F.col("empresa_id").cast("string"), F.lit(".0"))).alias("cik"),
        _day(clean.flexible_date(F.date_format("fecha_transaccion", "MM/dd/yyyy"))).alias("fecha"),
        clean.price(raw).alias("precio"),
        clean.shares(F.concat(F.lit("-"), F.col("acciones").cast("string"))).alias("acciones"),
        clean.amount("acciones", "precio_por_accion").cast("double").alias("importe"),
        clean.tx_code("tipo_transaccion").alias("codigo"),
        clean.text_or_null("cargo").alias("cargo"),
        clean.acquired_or_disposed("adquirido_o_dispuesto").alias("ad"),
        _day(clean.transaction_date("fecha_transaccion", F.to_date("fecha_registro"), F.lit("2026-11-20").cast("date"))).alias("valida"),
    )


def f13_quarters(s, d):
    m = table(s, d, "metricas_trimestrales")
    q = clean.calendar_quarter("fecha_fin")
    return m.select("id", q["year"].alias("anio"), q["quarter"].alias("trim"), clean.is_quarterly("fecha_inicio", "fecha_fin").alias("es_trimestral"), clean.months_between_calendar(F.lit("2026-11-20").cast("date"), F.col("fecha_fin")).alias("meses"))


def f15_items(s, d):
    e = table(s, d, "eventos_8k").groupBy("accession_number").agg(F.array_join(F.array_sort(F.collect_list("item")), " , ").alias("items"))
    return e.select("accession_number", F.array_join(clean.item_list("items"), "|").alias("lista"), F.array_join(F.array_sort(F.array_intersect(clean.item_list("items"), F.array(F.lit("1.01"), F.lit("5.02")))), "|").alias("relevantes"))


def f17_percent(s, d):
    """Declared percentages of every document."""
    return table(s, d, "documents").select("doc_id", text.percent_of_class("text").alias("pct"))


def f19_anonymous(s, d):
    e = table(s, d, "empresas").select(F.col("id").alias("empresa_id"), "nombre", "ticker")
    t = table(s, d, "documents").join(e, "empresa_id")
    return t.select("doc_id", F.md5(text.anonymised(F.col("text"), F.col("nombre"), F.col("ticker"))).alias("huella"))


def n1_sector_json(s, d):
    m = table(s, d, "metricas_trimestrales").filter("metricas_sector is not null")
    ok = F.try_parse_json("metricas_sector").isNotNull()
    return m.select("id", ok.alias("legible"), F.when(ok, F.get_json_object("metricas_sector", "$.cash_runway_months")).try_cast("long").alias("meses_caja"))


def n4_sections(s, d):
    """Discussion sections of all documents."""
    t = table(s, d, "documents").select("doc_id", text.extract_discussion(text.html_to_text("text")).alias("x"))
    return t.select("doc_id", F.col("x.aislada").alias("aislada"), F.length("x.texto").alias("largo"), F.md5("x.texto").alias("huella"))


def n5_items(s, d):
    """The item of every event; the text of a document is read once, then meets its events."""
    ev = table(s, d, "eventos_8k").filter("doc_id is not null").select("id", "doc_id", "item")
    docs = table(s, d, "documents").join(ev.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", text.html_to_text("text").alias("t"))
    j = ev.join(docs, "doc_id").select("id", text.extract_item("t", "item").alias("x"))
    return j.select("id", F.col("x.aislada").alias("aislada"), F.length("x.texto").alias("largo"), F.md5("x.texto").alias("huella"))


def n7_citations(s, d):
    """Three quotes for every document: a piece of its text, too short to count in
    short texts, one never written and a short one."""
    docs = table(s, d, "documents")
    quotes = F.array(F.concat(F.upper(F.substring("text", 20, 60)), F.lit(" [MD&A]")), F.lit("this sentence was never written by anyone"), F.lit("short"))
    return text.verify_citations(docs.withColumn("q", quotes), "doc_id", "text", "q")


def f18_folded(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.folded("text")).alias("huella"))


def s5_snapshot(s, d):
    """Place of the stored prices in their ranges."""
    e = table(s, d, "empresas").select("id", *[F.col(c).cast("double").alias(c) for c in ("precio_actual", "precio_min_52w", "precio_max_52w")])
    return e.select("id", market.position("precio_actual", "precio_min_52w", "precio_max_52w").alias("posicion"))


def s10_latest_by_form(s, d):
    """Latest dates of several kinds of form per empresa, in one pass."""
    f = F.upper(F.trim("formulario"))
    kinds = {"trimestral": "^10-Q", "actual": "^8-K", "participacion": "^(SC|SCHEDULE) 13[DG]", "propiedad": "^4"}
    docs = table(s, d, "documents").filter("empresa_id is not null")
    return docs.groupBy("empresa_id").agg(*[_day(F.max(F.when(f.rlike(p), F.col("fecha_doc")))).alias(k) for k, p in kinds.items()])


def j4_with_verdict(s, d):
    """Entities whose theses carry a verdict: JSON key, distinct join."""
    t = table(s, d, "documents").filter("source = 'tesis_detective'").withColumn("v", F.get_json_object(text.first_json("text"), "$.veredicto_preliminar")).filter("v is not null")
    e = table(s, d, "empresas").select(F.col("id").alias("empresa_id"), "ticker")
    return e.join(t.select("empresa_id", "v"), "empresa_id").select("empresa_id", "ticker", F.col("v").alias("veredicto")).distinct()


def x17_unaudited(s, d):
    """The newest thesis of each entity that no later report audits."""
    docs = table(s, d, "documents").filter("empresa_id is not null and fecha_registro is not null").select("doc_id", "source", "empresa_id", "fecha_registro")
    t = upsert.latest(docs.filter("source = 'tesis_detective'"), ["empresa_id"], [F.col("fecha_registro"), F.col("doc_id")])
    a = docs.filter("source = 'informe_auditor'").select(F.col("empresa_id").alias("ae"), F.col("fecha_registro").alias("af"))
    return t.join(a, (F.col("ae") == F.col("empresa_id")) & (F.col("af") >= F.col("fecha_registro")), "left_anti").select("empresa_id", "doc_id")


def k5_fill(s, d):
    """Empty sectors filled from the most frequent sector of their code."""
    e = table(s, d, "empresas").select("id", "sic", "sector")
    n = e.filter("sector is not null and sic is not null").groupBy("sic", "sector").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("sic").agg(F.min_by("sector", F.struct(-F.col("n"), F.col("sector"))).alias("sector"))
    return sinks.fill_empty(e, best, "sic", "sector").select("id", "sic", "sector")


def _clustered(s, d):
    """Entities with a cluster; ``grande`` if above the limit, a null capitalisation not."""
    c = cluster.first_clusters(_buys(s, d), "empresa_id", "nombre_insider", "fecha_transaccion", 60, 3).filter("found")
    j = c.join(table(s, d, "empresas").select(F.col("id").alias("empresa_id"), "ticker", "market_cap_usd"), "empresa_id")
    return j.withColumn("grande", F.coalesce(F.col("market_cap_usd") > 2000000000, F.lit(False)))


def a11_split(s, d):
    """The report of large entities with a cluster, at most 40; all of them and the rest are in a11_groups."""
    return _clustered(s, d).filter("grande").orderBy(F.col("market_cap_usd").desc(), "empresa_id").limit(40).select("empresa_id", "ticker", "market_cap_usd", _day("detected").alias("detected"))


def a11_groups(s, d):
    """Every entity with a cluster and its group, with the counts of both groups."""
    j = cut_lineage(_clustered(s, d))
    n = j.agg(F.count_if("grande").alias("grandes"), F.count_if(~F.col("grande")).alias("resto")).first()
    counts = [F.lit(n[c]).cast("long").alias(c) for c in ("grandes", "resto")]
    return j.select("empresa_id", "ticker", "market_cap_usd", _day("detected").alias("detected"), F.when(F.col("grande"), "grande").otherwise("resto").alias("grupo"), *counts)


def fn_sql(s, d):
    """The registered functions, from SQL."""
    register.register_functions(s)
    table(s, d, "empresas").createOrReplaceTempView("lumbre_fn_empresas")
    return s.sql(
        "SELECT id, lumbre_cik(cik || '.0') AS cik, lumbre_precio(CAST(precio_actual AS STRING)) AS precio, lumbre_texto(sector) AS sector, "
        "lumbre_posicion(CAST(precio_actual AS DOUBLE), CAST(precio_min_52w AS DOUBLE), CAST(precio_max_52w AS DOUBLE)) AS posicion, length(lumbre_normalizado(ticker)) AS largo FROM lumbre_fn_empresas"
    )


def fn_numbers(s, d):
    """Registered functions of figures and codes, from SQL."""
    register.register_functions(s)
    table(s, d, "insider_transactions").createOrReplaceTempView("lumbre_fn_tx")
    return s.sql(
        "SELECT id, lumbre_acciones(CAST(acciones AS STRING)) AS acciones, lumbre_numerico(CAST(precio_por_accion AS STRING)) AS precio, lumbre_importe(CAST(importe_total AS STRING)) AS importe, lumbre_entero(CAST(acciones_tras_tx AS STRING)) AS tras, "
        "lumbre_codigo(tipo_transaccion) AS codigo, lumbre_signo(adquirido_o_dispuesto) AS signo, lumbre_trimestre(fecha_transaccion) AS trimestre FROM lumbre_fn_tx"
    )


def fn_texts(s, d):
    """Registered functions of texts, from SQL."""
    register.register_functions(s)
    table(s, d, "documents").createOrReplaceTempView("lumbre_fn_docs")
    return s.sql(
        "SELECT doc_id, md5(lumbre_normalizado(text)) AS plegado, md5(lumbre_html_a_texto(text)) AS plano, md5(lumbre_seccion_mda(lumbre_html_a_texto(text)).texto) AS seccion, "
        "get_json_object(lumbre_primer_json(text), '$.veredicto_preliminar') AS veredicto FROM lumbre_fn_docs"
    )


def dq_rules(s, d):
    """Rows that break the declared rules of three tables."""
    out = None
    for t, rules in quality.RULES.items():
        v = quality.violations(table(s, d, t), rules).withColumn("tabla", F.lit(t))
        out = v if out is None else out.unionByName(v)
    return out.select("tabla", "regla", "incumplen", "nulos")


def dq_nulls(s, d):
    """Null shares per column of the quarterly table."""
    m = table(s, d, "metricas_trimestrales")
    cols = ["fecha_inicio", "fecha_fin", "revenue", "gross_profit", "net_income", "operating_cash_flow", "accounts_receivable", "shares_outstanding", "metricas_sector", "fecha_filing"]
    one = m.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("columna"), F.col(c).alias("nulos")) for c in cols])).alias("x")).select("x.*")


def s9_text(s, d):
    """Plain text of every document."""
    return table(s, d, "documents").select("doc_id", F.md5(text.html_to_text("text")).alias("huella"))


def f20_json(s, d):
    """The first JSON object of every text, with words around it in every other document."""
    docs = table(s, d, "documents").withColumn("t", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Respuesta: "), "text", F.lit(" -- fin {"))).otherwise(F.col("text")))
    x = text.first_json("t")
    return docs.select("doc_id", F.get_json_object(x, "$.veredicto_preliminar").alias("veredicto"), x.isNotNull().alias("hallado"))


QUERIES = {f.__name__: f for f in (
    w1_clusters, w1_orders, w10_before, a1_window_totals, w2_titles, w3_growth, w4_margins, w4_cash, w7_labels, w9_sample, j6_quarter_of_filing, j7_shares, j8_price_before, j9_price_after, j11_purchases_before, a2_worklist,
    l7_group_limit, j16_no_recent_quarter, j17_with_shares, j20_history, j18_documents, k2_upsert, k10_insert, k3_quarters, a3_funnel, a5_columns, a6_upper_median, a7_median, a8_recall, a9_smallest, a10_buckets, l1_top,
    l5_latest_purchases, n8_context, u2_drilldown, u4_parameters, f24_returns, f26_excess, w8_peaks, f_clean, f13_quarters, f15_items, f17_percent, f19_anonymous, n1_sector_json, s5_snapshot, s10_latest_by_form, j4_with_verdict, x17_unaudited, k5_fill, a11_split, a11_groups, fn_sql, fn_numbers, fn_texts, dq_rules, dq_nulls, n4_sections, n5_items, n7_citations, f18_folded, s9_text, f20_json,
)}

# SQL ------------------------------------------------------------------------

_CODE = "upper(trim(tipo_transaccion))"
_BUYS = f"buys AS (SELECT * FROM insider_transactions WHERE {_CODE} = 'P' AND fecha_transaccion IS NOT NULL)"
_CASES = """cases AS (
  SELECT v.caso_id, v.ticker, v.fecha_deteccion, v.market_cap_historico, coalesce(v.empresa_id, e.id) AS empresa_id FROM validadas_historicas v
  LEFT JOIN (SELECT ticker, min(id) AS id FROM empresas WHERE ticker IS NOT NULL GROUP BY ticker) e ON v.empresa_id IS NULL AND v.ticker = e.ticker)"""
_Q = """quarters AS (SELECT * FROM (
  SELECT *, anio_fiscal * 4 + trimestre - 1 AS q, row_number() OVER (PARTITION BY empresa_id, anio_fiscal, trimestre ORDER BY fecha_filing IS NULL, fecha_filing, id) AS pick
  FROM metricas_trimestrales) t WHERE pick = 1)"""


def _cluster_sql(src: str, key: str, member: str, day: str, w: int, n: int) -> str:
    return f"""
acts AS (SELECT {key} AS e, coalesce('=' || {member}, '') AS m, {day} AS d FROM {src}),
size AS (SELECT e, count(*) AS n FROM acts GROUP BY e),
band AS (SELECT a.e, a.d AS anchor, b.m, min(b.d) AS f FROM (SELECT DISTINCT e, d FROM acts) a JOIN acts b ON a.e = b.e AND b.d BETWEEN a.d AND a.d + {w} GROUP BY 1, 2, 3),
nth AS (SELECT e, anchor, count(*) OVER (PARTITION BY e, anchor) AS members, f, row_number() OVER (PARTITION BY e, anchor ORDER BY f, m) AS r FROM band),
per AS (SELECT e, anchor, max(members) AS members, max(CASE WHEN r = {n} THEN f END) AS detected FROM nth GROUP BY e, anchor),
hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY anchor) AS k FROM per WHERE members >= {n}) t WHERE k = 1),
clusters AS (
  SELECT s.e, h.e IS NOT NULL AND s.n >= {n} AS found, CAST(CASE WHEN s.n < {n} THEN 0 ELSE coalesce(h.members, p.top) END AS INTEGER) AS members_max,
    CASE WHEN s.n >= {n} THEN h.anchor END AS anchor, CASE WHEN s.n >= {n} THEN h.detected END AS detected
  FROM size s LEFT JOIN hit h ON h.e = s.e JOIN (SELECT e, max(members) AS top FROM per GROUP BY e) p ON p.e = s.e)"""


_CL = "WITH " + _BUYS + "," + _cluster_sql("buys", "empresa_id", "nombre_insider", "fecha_transaccion", 60, 3)
_CLS = "strftime(anchor, '%Y-%m-%d') AS anchor, strftime(detected, '%Y-%m-%d') AS detected"
_IN = _CL + """,
inside AS (SELECT b.* FROM buys b JOIN clusters c ON c.e = b.empresa_id WHERE c.detected IS NULL OR b.fecha_transaccion BETWEEN c.detected - 60 AND c.detected)
"""
_PR = "prices AS (SELECT user_id, CAST(ts AS DATE) AS dia, CAST(round(CAST(avg(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 4) AS DOUBLE) AS cierre FROM events GROUP BY 1, 2), asks AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d0 FROM events WHERE event_type = 'purchase')"


def _look(name: str, src: str, day: str, forward: bool, tol: int | None, ref: str = "prices", key: str = "user_id", value: str = "cierre") -> str:
    op, far, order = (">=", "p.dia - a.{d}", "p.dia") if forward else ("<=", "a.{d} - p.dia", "p.dia DESC")
    cond = f" AND {far.format(d=day)} <= {tol}" if tol is not None else ""
    return f"""{name} AS (SELECT a.*, x.v AS {name}_v, x.dia AS {name}_d FROM {src} a LEFT JOIN LATERAL (
  SELECT p.{value} AS v, p.dia FROM {ref} p WHERE p.{key} = a.{key} AND p.dia {op} a.{day}{cond} ORDER BY {order} LIMIT 1) x ON TRUE)"""


SQL = {
    "w1_clusters": _CL + f" SELECT e AS empresa_id, found, members_max, {_CLS} FROM clusters",
    "w1_orders": "WITH o AS (SELECT o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F'),"
    + _cluster_sql("o", "o_custkey", "o_orderpriority", "d", 180, 3)
    + f" SELECT e AS o_custkey, found, members_max, {_CLS} FROM clusters",
    "w10_before": "WITH " + _BUYS + "," + _cluster_sql("(SELECT * FROM buys WHERE fecha_transaccion < DATE '2020-01-01')", "empresa_id", "nombre_insider", "fecha_transaccion", 60, 3)
    + " SELECT e AS empresa_id, members_max, strftime(detected, '%Y-%m-%d') AS detected FROM clusters WHERE found",
    "a1_window_totals": _IN + "SELECT empresa_id, count(DISTINCT nullif(nombre_insider, '')) AS insiders, CAST(coalesce(sum(importe_total), 0) AS DOUBLE) AS importe FROM inside GROUP BY empresa_id",
    "w2_titles": _IN
    + f"""SELECT c.e AS empresa_id, coalesce(bool_or(c.found AND ({' OR '.join(f"contains(t, '{w}')" for w in CSUITE[0])})), FALSE) AS alto_cargo
FROM clusters c LEFT JOIN (SELECT empresa_id, regexp_replace(replace(replace(upper(cargo), 'VICE PRESIDENT', ''), 'VICE CHAIRMAN', ''), '{CSUITE[2]}', '', 'g') AS t FROM inside) x ON x.empresa_id = c.e GROUP BY c.e""",
    "w3_growth": "WITH " + _Q + """,
s AS (SELECT * FROM (SELECT empresa_id, q, CAST(revenue AS DOUBLE) AS v, row_number() OVER (PARTITION BY empresa_id ORDER BY q DESC) AS rn, count(*) OVER (PARTITION BY empresa_id) AS n FROM quarters WHERE revenue > 0) t WHERE rn <= 8),
g AS (SELECT empresa_id, q, n, (v - lag(v) OVER w) / lag(v) OVER w AS g, q - lag(q) OVER w AS step FROM s WINDOW w AS (PARTITION BY empresa_id ORDER BY q)),
r AS (SELECT empresa_id, g, row_number() OVER (PARTITION BY empresa_id ORDER BY q) AS i, count(*) OVER (PARTITION BY empresa_id) AS k FROM g WHERE step = 1 AND n >= 4)
SELECT e.empresa_id, CAST(coalesce(max(k), 0) AS INTEGER) AS tasas, round(avg(CASE WHEN k >= 3 AND i <= k // 2 THEN g END), 6) AS media_antigua, round(avg(CASE WHEN k >= 3 AND i > k // 2 THEN g END), 6) AS media_reciente
FROM (SELECT DISTINCT empresa_id FROM s WHERE n >= 4) e LEFT JOIN r ON r.empresa_id = e.empresa_id GROUP BY 1""",
    "w4_margins": "WITH " + _Q + """,
s AS (SELECT empresa_id, q, CAST(gross_profit AS DOUBLE) / revenue AS v, row_number() OVER (PARTITION BY empresa_id ORDER BY q DESC) AS rn FROM quarters WHERE revenue > 0 AND gross_profit IS NOT NULL),
r AS (SELECT empresa_id, v, row_number() OVER (PARTITION BY empresa_id ORDER BY q) AS i, count(*) OVER (PARTITION BY empresa_id) AS k FROM s WHERE rn <= 8)
SELECT empresa_id, round(avg(CASE WHEN i <= k // 2 THEN v END), 6) AS margen_antiguo, round(avg(CASE WHEN i > k // 2 THEN v END), 6) AS margen_reciente FROM r WHERE k >= 4 GROUP BY 1""",
    "w4_cash": "WITH " + _Q + """,
s AS (SELECT empresa_id, q, operating_cash_flow AS v, row_number() OVER (PARTITION BY empresa_id ORDER BY q DESC) AS rn FROM quarters WHERE operating_cash_flow IS NOT NULL),
e AS (SELECT empresa_id, count(*) AS n, max(CASE WHEN rn = 1 THEN v END) AS ultimo, max(CASE WHEN rn = 4 THEN v END) AS primero FROM s WHERE rn <= 4 GROUP BY 1)
SELECT empresa_id, primero, ultimo, ultimo > primero AS mejora FROM e WHERE n = 4""",
    "w7_labels": "WITH " + _Q + "," + _CASES + """,
j AS (SELECT c.caso_id, m.revenue, m.net_income, row_number() OVER (PARTITION BY c.caso_id ORDER BY m.fecha_fin DESC, m.q DESC) AS rn
      FROM cases c JOIN quarters m ON m.empresa_id = c.empresa_id AND m.fecha_fin <= c.fecha_deteccion)
SELECT caso_id, 'T-' || (rn - 1) AS etiqueta, revenue, net_income FROM j WHERE rn <= 8""",
    "w9_sample": """WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_custkey FROM o WHERE p IN (SELECT CAST(floor(i * n / 100.0) AS BIGINT) FROM (SELECT unnest(range(0, 100)) AS i), (SELECT count(*) AS n FROM orders))""",
    "j6_quarter_of_filing": """
SELECT d.doc_id, m.id AS metrica_id, strftime(m.fecha_fin, '%Y-%m-%d') AS fin FROM documents d
LEFT JOIN (SELECT doc_id, m.id, m.fecha_fin, row_number() OVER (PARTITION BY doc_id ORDER BY m.fecha_fin DESC, m.id) AS rn
           FROM documents d JOIN metricas_trimestrales m ON m.empresa_id = d.empresa_id AND m.fecha_fin <= d.fecha_doc) m ON m.doc_id = d.doc_id AND m.rn = 1""",
    "j7_shares": "WITH " + _CASES + """
SELECT c.caso_id, m.shares_outstanding FROM cases c LEFT JOIN (
  SELECT c.caso_id, m.shares_outstanding, row_number() OVER (PARTITION BY c.caso_id ORDER BY m.fecha_fin DESC, m.id) AS rn
  FROM cases c JOIN metricas_trimestrales m ON m.empresa_id = c.empresa_id AND m.shares_outstanding > 10000 AND m.fecha_fin <= c.fecha_deteccion) m ON m.caso_id = c.caso_id AND m.rn = 1""",
    "j8_price_before": "WITH " + _PR + ", a1 AS (SELECT *, CAST(d0 - 1 AS DATE) AS d1 FROM asks)," + _look("x", "a1", "d1", False, 10) + " SELECT event_id, x_v AS cierre, strftime(x_d, '%Y-%m-%d') AS dia FROM x",
    "j9_price_after": "WITH " + _PR + ", a1 AS (SELECT *, CAST(d0 + 5 AS DATE) AS d1 FROM asks)," + _look("x", "a1", "d1", True, 11) + " SELECT event_id, x_v AS cierre, strftime(x_d, '%Y-%m-%d') AS dia FROM x",
    "j11_purchases_before": "WITH " + _BUYS + "," + _CASES + """
SELECT c.caso_id, count(*) AS compras, CAST(sum(b.importe_total) AS DOUBLE) AS importe FROM cases c JOIN buys b ON b.empresa_id = c.empresa_id AND b.fecha_transaccion BETWEEN c.fecha_deteccion - 60 AND c.fecha_deteccion GROUP BY 1""",
    "j16_no_recent_quarter": "SELECT id, ticker FROM empresas e WHERE NOT EXISTS (SELECT 1 FROM metricas_trimestrales m WHERE m.empresa_id = e.id AND m.fecha_fin >= DATE '2026-03-01')",
    "j17_with_shares": "SELECT id, ticker FROM empresas e WHERE EXISTS (SELECT 1 FROM metricas_trimestrales m WHERE m.empresa_id = e.id AND m.shares_outstanding IS NOT NULL)",
    "j18_documents": "SELECT e.ticker, d.source, count(*) AS documentos, max(d.doc_id) AS ultimo FROM documents d JOIN empresas e ON e.id = d.empresa_id GROUP BY 1, 2",
    "j20_history": "SELECT id, cik, strftime((SELECT max(fecha_fin) FROM metricas_trimestrales m WHERE m.empresa_id = e.id), '%Y-%m-%d') AS ultimo, (SELECT count(*) FROM metricas_trimestrales m WHERE m.empresa_id = e.id) AS trimestres FROM empresas e",
    "k2_upsert": """
WITH t AS (SELECT *, fecha_registro >= TIMESTAMP '2022-01-01' AS late FROM insider_transactions),
l AS (SELECT *, row_number() OVER (PARTITION BY accession_number, trans_sk, late ORDER BY fecha_registro DESC, id DESC) AS rn FROM t),
o AS (SELECT * FROM l WHERE NOT late AND rn = 1), n AS (SELECT * FROM l WHERE late AND rn = 1)
SELECT coalesce(o.accession_number, n.accession_number) AS accession_number, coalesce(o.trans_sk, n.trans_sk) AS trans_sk, CASE WHEN n.id IS NULL THEN o.id ELSE n.id END AS id, CASE WHEN o.id IS NULL THEN n.empresa_id ELSE o.empresa_id END AS empresa_id,
  CASE WHEN n.id IS NULL THEN o.acciones ELSE n.acciones END AS acciones, CAST(CASE WHEN n.id IS NULL THEN o.precio_por_accion ELSE n.precio_por_accion END AS DOUBLE) AS precio_por_accion
FROM o FULL JOIN n ON o.accession_number = n.accession_number AND o.trans_sk = n.trans_sk""",
    "k10_insert": """
WITH a AS (SELECT accession_number, min(empresa_id) AS empresa_id FROM eventos_8k GROUP BY 1)
SELECT * FROM a UNION ALL SELECT accession_number, max(empresa_id) FROM participaciones_activistas WHERE accession_number NOT IN (SELECT accession_number FROM a) GROUP BY 1""",
    "k3_quarters": "WITH " + _Q + " SELECT empresa_id, anio_fiscal, trimestre, id, revenue, net_income FROM quarters",
    "a2_worklist": """
WITH done AS (SELECT empresa_id, source AS modelo, max(fecha_registro) AS ultima FROM documents WHERE source IN ('tesis_detective', 'informe_auditor') AND empresa_id IS NOT NULL GROUP BY 1, 2),
c AS (SELECT e.id AS empresa_id, m.modelo FROM empresas e, (VALUES ('tesis_detective'), ('informe_auditor')) m(modelo) WHERE e.activa)
SELECT c.empresa_id, c.modelo FROM c LEFT JOIN done d ON d.empresa_id = c.empresa_id AND d.modelo = c.modelo
WHERE d.ultima IS NULL OR EXISTS (SELECT 1 FROM eventos_8k v WHERE v.empresa_id = c.empresa_id AND v.fecha_registro > d.ultima)
   OR EXISTS (SELECT 1 FROM participaciones_activistas v WHERE v.empresa_id = c.empresa_id AND v.fecha_registro > d.ultima)""",
    "a3_funnel": "SELECT count(*) AS total, count(*) FILTER (WHERE activa) AS activas, count(*) FILTER (WHERE market_cap_usd IS NOT NULL) AS con_mercado, count(*) FILTER (WHERE shelf_activa) AS con_shelf, count(DISTINCT sic) AS sectores FROM empresas",
    "a5_columns": "WITH " + _Q + " SELECT anio_fiscal, count(*) AS n, count(revenue) AS con_ventas, round(CAST(sum(CAST(revenue AS HUGEINT)) AS DOUBLE) / count(revenue), 2) AS media FROM quarters GROUP BY 1",
    "a6_upper_median": f"""
SELECT t, count(*) AS n, CAST(list_sort(list(p))[len(list(p)) // 2 + 1] AS DOUBLE) AS mediana_alta
FROM (SELECT {_CODE} AS t, precio_por_accion AS p FROM insider_transactions WHERE precio_por_accion IS NOT NULL AND tipo_transaccion IS NOT NULL) x GROUP BY t""",
    "a7_median": "SELECT CAST(year(fecha_deteccion) AS INTEGER) AS anio, count(*) AS casos, round(median(market_cap_historico), 2) AS mediana FROM validadas_historicas GROUP BY 1",
    "a8_recall": _CL + "," + _CASES + """
SELECT count(*) AS casos, CAST(sum(CASE WHEN c.detected <= v.fecha_deteccion THEN 1 ELSE 0 END) AS BIGINT) AS con_senal, round(sum(CASE WHEN c.detected <= v.fecha_deteccion THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS recall
FROM cases v LEFT JOIN clusters c ON c.e = v.empresa_id AND c.found""",
    "a9_smallest": "WITH " + _CASES + """,
r AS (SELECT *, row_number() OVER (PARTITION BY empresa_id ORDER BY market_cap_historico, fecha_deteccion, caso_id) AS rn FROM cases WHERE market_cap_historico BETWEEN 5e7 AND 2e9)
SELECT empresa_id, caso_id, round(market_cap_historico, 2) AS capitalizacion, strftime(fecha_deteccion, '%Y-%m-%d') AS fecha FROM r WHERE rn = 1""",
    "a10_buckets": "SELECT CASE WHEN market_cap_historico IS NULL THEN 'sin_dato' WHEN market_cap_historico < 5e7 THEN 'menor' WHEN market_cap_historico <= 2e9 THEN 'dentro' ELSE 'mayor' END AS grupo, count(*) AS n FROM validadas_historicas GROUP BY 1",
    "l1_top": "SELECT id, ticker, market_cap_usd FROM empresas WHERE market_cap_usd IS NOT NULL ORDER BY market_cap_usd DESC, id LIMIT 15",
    "l5_latest_purchases": "WITH " + _BUYS + """
SELECT empresa_id, CAST(rn AS INTEGER) AS rn, id, strftime(fecha_transaccion, '%Y-%m-%d') AS fecha FROM (SELECT *, row_number() OVER (PARTITION BY empresa_id ORDER BY fecha_transaccion DESC, id DESC) AS rn FROM buys) t WHERE rn <= 10""",
    "u2_drilldown": "WITH " + _Q + " SELECT empresa_id, anio_fiscal, trimestre, revenue, round(100.0::DOUBLE * gross_profit / revenue, 1) + 0.0 AS margen_pct FROM quarters WHERE revenue > 0",
    "u4_parameters": "SELECT id, ticker, sic FROM empresas WHERE market_cap_usd BETWEEN 50000000 AND 500000000",
    "f_clean": f"""
SELECT id, lpad(CAST(empresa_id AS VARCHAR), 10, '0') AS cik, strftime(fecha_transaccion, '%Y-%m-%d') AS fecha,
  CASE WHEN precio_por_accion > 0 AND precio_por_accion <= 1000000 THEN CAST(precio_por_accion AS DOUBLE) END AS precio, CASE WHEN acciones <> 0 AND abs(acciones) <= 100000000000000 THEN abs(acciones) END AS acciones,
  CASE WHEN abs(round(CAST(acciones AS DECIMAL(18,0)) * precio_por_accion, 2)) <= 100000000000000 THEN CAST(round(CAST(acciones AS DECIMAL(18,0)) * precio_por_accion, 2) AS DOUBLE) END AS importe,
  {_CODE} AS codigo, nullif(CASE WHEN lower(trim(cargo)) IN ('nan', 'nat', 'none') THEN NULL ELSE trim(cargo) END, '') AS cargo,
  CASE WHEN adquirido_o_dispuesto IN ('A', 'D') THEN adquirido_o_dispuesto END AS ad,
  CASE WHEN fecha_transaccion <= DATE '2026-11-20' AND year(fecha_transaccion) >= 2009 AND (fecha_registro IS NULL OR fecha_transaccion <= CAST(fecha_registro AS DATE)) THEN strftime(fecha_transaccion, '%Y-%m-%d') END AS valida
FROM insider_transactions""",
    "f13_quarters": """
SELECT id, CAST(year(fecha_fin) AS INTEGER) AS anio, CAST(quarter(fecha_fin) AS INTEGER) AS trim, coalesce(fecha_fin - fecha_inicio BETWEEN 80 AND 100, FALSE) AS es_trimestral,
  CAST((2026 - year(fecha_fin)) * 12 + 11 - month(fecha_fin) AS INTEGER) AS meses FROM metricas_trimestrales""",
    "f15_items": "SELECT accession_number, string_agg(item, '|' ORDER BY item) AS lista, coalesce(string_agg(DISTINCT item, '|' ORDER BY item) FILTER (WHERE item IN ('1.01', '5.02')), '') AS relevantes FROM eventos_8k GROUP BY 1",
    "f17_percent": f"""
SELECT doc_id, CASE WHEN v BETWEEN 0 AND 100 THEN v END AS pct FROM (
  SELECT doc_id, try_cast(replace(coalesce(nullif(regexp_extract(text, '{text.PERCENT_TAG}', 1), ''), nullif(regexp_extract(text, '{text.PERCENT_PROSE}', 1), '')), ',', '.') AS DOUBLE) AS v FROM documents) x""",
    "n1_sector_json": "SELECT id, json_valid(metricas_sector) AS legible, CASE WHEN json_valid(metricas_sector) THEN try_cast(json_extract_string(metricas_sector, '$.cash_runway_months') AS BIGINT) END AS meses_caja FROM metricas_trimestrales WHERE metricas_sector IS NOT NULL",
    "f24_returns": "WITH " + _PR + ", a1 AS (SELECT *, CAST(d0 + 5 AS DATE) AS d1, CAST(d0 + 15 AS DATE) AS d2 FROM asks)," + _look("i", "a1", "d1", True, 11) + "," + _look("o", "i", "d2", True, 11)
    + " SELECT event_id, CASE WHEN i_v > 0 AND o_v > 0 THEN round((o_v - i_v) / i_v, 6) END AS retorno FROM o",
    "f26_excess": "WITH " + _PR + ", bench AS (SELECT 1 AS k, CAST(ts AS DATE) AS dia, round(CAST(avg(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 4) AS media FROM events GROUP BY 2), a1 AS (SELECT *, 1 AS k, CAST(d0 + 7 AS DATE) AS d1, CAST(d0 + 19 AS DATE) AS d2 FROM asks),"
    + _look("i", "a1", "d1", True, 11) + "," + _look("o", "i", "d2", False, 5) + "," + _look("bi", "o", "d1", True, 11, "bench", "k", "media") + "," + _look("bo", "bi", "d2", False, 5, "bench", "k", "media")
    + " SELECT event_id, round(o_v / i_v - 1, 6) AS retorno, round((o_v / i_v - 1) - (bo_v / bi_v - 1), 6) AS exceso FROM bo",
    "w8_peaks": "WITH " + _PR + "," + _look("b", "asks", "d0", True, None) + """,
g AS (SELECT b.event_id, b.b_v AS base, max(CASE WHEN p.dia >= b.d0 THEN p.cierre END) AS top, min(CASE WHEN p.dia <= b.d0 THEN p.cierre END) AS lo, max(CASE WHEN p.dia <= b.d0 THEN p.cierre END) AS hi, count(CASE WHEN p.dia <= b.d0 THEN 1 END) AS n
      FROM b JOIN prices p ON p.user_id = b.user_id AND p.dia BETWEEN b.d0 - 14 AND b.d0 + 400 WHERE b.b_v > 0 GROUP BY 1, 2)
SELECT event_id, round(top / base, 1) AS multiplo, CASE WHEN n >= 5 AND hi > lo THEN round((base - lo) / (hi - lo), 2) END AS posicion FROM g""",
}
SQL["l7_group_limit"] = "WITH w AS (" + SQL["a2_worklist"] + """), c AS (SELECT w.*, coalesce(e.market_cap_usd, -1) AS cap FROM w JOIN empresas e ON e.id = w.empresa_id),
r AS (SELECT *, dense_rank() OVER (ORDER BY cap DESC, empresa_id) AS k FROM c) SELECT empresa_id, modelo, cap FROM r WHERE k <= 20"""


def _top(src: str, day: str, k: int, name: str) -> str:
    return f"""{name} AS (SELECT empresa_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) AS {name} FROM (
  SELECT empresa_id, id, row_number() OVER (PARTITION BY empresa_id ORDER BY {day} DESC, id DESC) AS rn FROM {src} WHERE {day} IS NOT NULL) t WHERE rn <= {k} GROUP BY 1)"""


SQL["n8_context"] = "WITH " + _BUYS + "," + _top("eventos_8k", "fecha_evento", 5, "eventos") + "," + _top("participaciones_activistas", "fecha_evento", 3, "participaciones") + "," + _top("buys", "fecha_transaccion", 10, "compras") + """
SELECT e.id AS empresa_id, e.ticker, a.eventos, b.participaciones, c.compras FROM empresas e LEFT JOIN eventos a ON a.empresa_id = e.id LEFT JOIN participaciones b ON b.empresa_id = e.id LEFT JOIN compras c ON c.empresa_id = e.id"""
SQL["f19_anonymous"] = f"""
WITH j AS (SELECT d.doc_id, d.text, e.nombre, e.ticker, regexp_replace(trim(e.nombre), '(?i){text.LEGAL_SUFFIX}', '') AS base FROM documents d JOIN empresas e ON e.id = d.empresa_id),
a AS (SELECT *, CASE WHEN length(nombre) >= 4 THEN regexp_replace(text, '(?i)' || regexp_escape(nombre), 'la Empresa', 'g') ELSE text END AS t1 FROM j),
b AS (SELECT *, CASE WHEN length(base) >= 4 THEN regexp_replace(t1, '(?i)' || regexp_escape(base), 'la Empresa', 'g') ELSE t1 END AS t2 FROM a),
c AS (SELECT *, CASE WHEN length(ticker) >= 2 THEN regexp_replace(t2, '\\b' || regexp_escape(ticker) || '\\b', 'XXXX', 'g') ELSE t2 END AS t3 FROM b)
SELECT doc_id, md5(regexp_replace(t3, '\\b(19\\d{{2}}|20\\d{{2}})\\b', '20XX', 'g')) AS huella FROM c"""


def _folded_sql(x: str) -> str:
    """Letters without marks; the compatibility forms the texts hold are written out."""
    plain = f"regexp_replace({x}, '[''’‘\"“”]', '', 'g')"
    for a, b in (("…", "..."), ("\u00a0", " "), ("½", "12"), ("™", "TM")):
        plain = f"replace({plain}, '{a}', '{b}')"
    return f"trim(regexp_replace(lower(regexp_replace(strip_accents({plain}), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g'))"


SQL["f18_folded"] = f"SELECT doc_id, md5({_folded_sql('text')}) AS huella FROM documents"
SQL["n7_citations"] = f"""
WITH t AS (SELECT doc_id, {_folded_sql("coalesce(text, '')")} AS src, {_folded_sql("upper(substring(text, 20, 60))")} AS q FROM documents),
h AS (SELECT doc_id, CAST(coalesce(length(q) >= 8 AND contains(src, q), FALSE) AS INTEGER) AS hit, CAST(coalesce(length(q) < 8, TRUE) AS INTEGER) AS corta FROM t)
SELECT doc_id, hit AS citas_verificadas, CAST(3 AS INTEGER) AS citas_totales, CAST(1 + corta AS INTEGER) AS demasiado_cortas, round(hit / 3.0::DOUBLE * 100, 1) AS porcentaje_verificado, hit / 3.0::DOUBLE * 100 < 50 AS alucinacion_detectada FROM h"""


def _html_sql(x: str) -> str:
    q = lambda v: "'" + v.replace("'", "''") + "'"
    hidden, ends, tags = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->", r"^(?:<[/!?]?[A-Za-z][^<>]*>)+|(?:<[/!?]?[A-Za-z][^<>]*>)+$", r"(?:<[/!?]?[A-Za-z][^<>]*>)+"
    t = f"regexp_replace(regexp_replace(regexp_replace({x}, '{hidden}', '<x>', 'g'), '{ends}', '', 'g'), '{tags}', chr(10), 'g')"
    for name, char in text.ENTITIES.items():
        t = f"replace({t}, {q(name)}, {q(char)})"
    return f"regexp_replace(regexp_replace({t}, '\\n\\s*\\n', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')"


def _places(name: str, src: str, pattern: str) -> str:
    """Places (from, to) of all matches, from the lengths of what lies between them."""
    q = pattern.replace("'", "''")
    return f"""{name} AS (SELECT id, i, sum(length(parts[i])) OVER w + coalesce(sum(length(hits[i])) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, hits[i] AS hit
  FROM (SELECT id, parts, hits, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT id, string_split_regex(t, '{q}') AS parts, regexp_extract_all(t, '{q}') AS hits FROM {src}) x) y WINDOW w AS (PARTITION BY id ORDER BY i))"""


_XREF = " OR ".join(f"contains(near, '{p}')" for p in text.CROSS_REFERENCES)
SQL["s9_text"] = f"SELECT doc_id, md5({_html_sql('text')}) AS huella FROM documents"
SQL["n4_sections"] = f"""
WITH docs AS (SELECT doc_id AS id, {_html_sql('text')} AS t FROM documents),
{_places('strict', 'docs', '(?i)' + text.MDA_START)}, {_places('loose', 'docs', '(?i)' + text.MDA_LOOSE)},
{_places('item3', 'docs', '(?i)' + text.MDA_END)}, {_places('item4', 'docs', '(?i)' + text.MDA_END_OTHER)},
free AS (SELECT l.id, l.a, l.hit FROM (SELECT l.*, lower(right(substring(t, 1, CAST(a AS BIGINT)), {text.REFERENCE_REACH})) AS near FROM loose l JOIN docs d ON d.id = l.id) l WHERE NOT ({_XREF})),
starts AS (SELECT id, a, hit, {text.LEAST_DISCUSSION} AS least FROM strict UNION ALL SELECT id, a, hit, {text.LEAST_LOOSE} FROM free WHERE id NOT IN (SELECT id FROM strict)),
stops AS (SELECT s.*, coalesce((SELECT min(e.a) FROM item3 e WHERE e.id = s.id AND e.a >= s.a + length(s.hit)), (SELECT min(e.a) FROM item4 e WHERE e.id = s.id AND e.a >= s.a + length(s.hit))) AS z FROM starts s),
gaps AS (SELECT *, coalesce(z - a - length(hit), {text.OPEN_DISCUSSION}) AS gap FROM stops),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap DESC, a) AS rn FROM gaps) x WHERE rn = 1 AND gap >= least),
out AS (SELECT d.id, b.id IS NOT NULL AS ok, CASE WHEN b.id IS NULL THEN substring(t, 1, {text.WHOLE_DISCUSSION}) ELSE trim(regexp_replace(substring(t, CAST(b.a + 1 AS BIGINT), CAST(coalesce(b.z - b.a, {text.OPEN_DISCUSSION}) AS BIGINT)), '^\\s+|\\s+$', '', 'g')) END AS x FROM docs d LEFT JOIN best b ON b.id = d.id)
SELECT id AS doc_id, ok AS aislada, CAST(length(x) AS INTEGER) AS largo, md5(x) AS huella FROM out"""
SQL["n5_items"] = f"""
WITH docs AS (SELECT e.id, e.item, {_html_sql('text')} AS t FROM eventos_8k e JOIN documents d ON d.doc_id = e.doc_id),
{_places('heads', 'docs', '(?i)' + text.ITEM_HEADING)}, {_places('stops', 'docs', '(?i)' + text.ITEM_HEADING + '|' + text.SIGNATURES)},
starts AS (SELECT h.* FROM heads h JOIN docs d ON d.id = h.id WHERE regexp_matches(h.hit, '(?i)item\\s*' || regexp_escape(d.item))),
gaps AS (SELECT s.id, s.a, s.hit, min(e.a) AS z FROM starts s LEFT JOIN stops e ON e.id = s.id AND e.a >= s.a + length(s.hit) GROUP BY 1, 2, 3),
best AS (SELECT * FROM (SELECT *, coalesce(z - a - length(hit), {text.OPEN_ITEM}) AS gap, row_number() OVER (PARTITION BY id ORDER BY coalesce(z - a - length(hit), {text.OPEN_ITEM}) DESC, a) AS rn FROM gaps) x WHERE rn = 1 AND gap >= {text.LEAST_ITEM}),
out AS (SELECT d.id, b.id IS NOT NULL AS ok, CASE WHEN b.id IS NULL THEN substring(t, 1, {text.WHOLE_ITEM}) ELSE trim(regexp_replace(substring(t, CAST(b.a + 1 AS BIGINT), CAST(coalesce(b.z - b.a, {text.OPEN_ITEM}) AS BIGINT)), '^\\s+|\\s+$', '', 'g')) END AS x FROM docs d LEFT JOIN best b ON b.id = d.id)
SELECT id, ok AS aislada, CAST(length(x) AS INTEGER) AS largo, md5(x) AS huella FROM out"""
SQL["f20_json"] = """
SELECT doc_id, CASE WHEN json_valid(text) AND text LIKE '{%' THEN json_extract_string(text, '$.veredicto_preliminar') END AS veredicto, coalesce(json_valid(text) AND text LIKE '{%', FALSE) AS hallado FROM documents"""
SQL["s5_snapshot"] = "SELECT id, CASE WHEN precio_max_52w > precio_min_52w THEN round((CAST(precio_actual AS DOUBLE) - precio_min_52w) / (CAST(precio_max_52w AS DOUBLE) - precio_min_52w), 4) END AS posicion FROM empresas"
SQL["s10_latest_by_form"] = """
SELECT empresa_id, strftime(max(CASE WHEN regexp_matches(f, '^10-Q') THEN fecha_doc END), '%Y-%m-%d') AS trimestral, strftime(max(CASE WHEN regexp_matches(f, '^8-K') THEN fecha_doc END), '%Y-%m-%d') AS actual,
  strftime(max(CASE WHEN regexp_matches(f, '^(SC|SCHEDULE) 13[DG]') THEN fecha_doc END), '%Y-%m-%d') AS participacion, strftime(max(CASE WHEN regexp_matches(f, '^4') THEN fecha_doc END), '%Y-%m-%d') AS propiedad
FROM (SELECT *, upper(trim(formulario)) AS f FROM documents WHERE empresa_id IS NOT NULL) t GROUP BY 1"""
SQL["j4_with_verdict"] = """
SELECT DISTINCT e.id AS empresa_id, e.ticker, json_extract_string(t.text, '$.veredicto_preliminar') AS veredicto
FROM (SELECT * FROM documents WHERE source = 'tesis_detective' AND json_valid(text)) t JOIN empresas e ON e.id = t.empresa_id WHERE json_extract_string(t.text, '$.veredicto_preliminar') IS NOT NULL"""
SQL["x17_unaudited"] = """
WITH d AS (SELECT doc_id, source, empresa_id, fecha_registro FROM documents WHERE empresa_id IS NOT NULL AND fecha_registro IS NOT NULL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY empresa_id ORDER BY fecha_registro DESC, doc_id DESC) AS rn FROM d WHERE source = 'tesis_detective') x WHERE rn = 1)
SELECT empresa_id, doc_id FROM t WHERE NOT EXISTS (SELECT 1 FROM d a WHERE a.source = 'informe_auditor' AND a.empresa_id = t.empresa_id AND a.fecha_registro >= t.fecha_registro)"""
SQL["k5_fill"] = """
WITH n AS (SELECT sic, sector, count(*) AS n FROM empresas WHERE sector IS NOT NULL AND sic IS NOT NULL GROUP BY 1, 2),
b AS (SELECT sic, sector FROM (SELECT *, row_number() OVER (PARTITION BY sic ORDER BY n DESC, sector) AS rn FROM n) t WHERE rn = 1)
SELECT e.id, e.sic, coalesce(nullif(e.sector, ''), b.sector) AS sector FROM empresas e LEFT JOIN b ON b.sic = e.sic"""
SQL["a11_split"] = _CL + """
SELECT c.e AS empresa_id, e.ticker, e.market_cap_usd, strftime(c.detected, '%Y-%m-%d') AS detected FROM clusters c JOIN empresas e ON e.id = c.e
WHERE c.found AND e.market_cap_usd > 2000000000 ORDER BY e.market_cap_usd DESC, c.e LIMIT 40"""
SQL["a11_groups"] = _CL + """
SELECT c.e AS empresa_id, e.ticker, e.market_cap_usd, strftime(c.detected, '%Y-%m-%d') AS detected, CASE WHEN e.market_cap_usd > 2000000000 THEN 'grande' ELSE 'resto' END AS grupo,
  count(CASE WHEN e.market_cap_usd > 2000000000 THEN 1 END) OVER () AS grandes, count(CASE WHEN e.market_cap_usd > 2000000000 THEN NULL ELSE 1 END) OVER () AS resto
FROM clusters c JOIN empresas e ON e.id = c.e WHERE c.found"""
SQL["fn_sql"] = """
SELECT id, cik, CASE WHEN precio_actual > 0 AND precio_actual <= 1000000 THEN CAST(precio_actual AS DOUBLE) END AS precio, nullif(trim(sector), '') AS sector,
  CASE WHEN precio_max_52w > precio_min_52w THEN round((CAST(precio_actual AS DOUBLE) - precio_min_52w) / (CAST(precio_max_52w AS DOUBLE) - precio_min_52w), 4) END AS posicion, CAST(length(ticker) AS INTEGER) AS largo FROM empresas"""
SQL["fn_numbers"] = f"""
SELECT id, CASE WHEN acciones <> 0 AND abs(acciones) <= 100000000000000 THEN abs(acciones) END AS acciones, CASE WHEN abs(precio_por_accion) <= 99999999 THEN CAST(precio_por_accion AS DOUBLE) END AS precio, CASE WHEN abs(importe_total) <= 9999999999999 THEN CAST(importe_total AS DOUBLE) END AS importe,
  acciones_tras_tx AS tras, nullif({_CODE}, '') AS codigo, CASE WHEN upper(trim(adquirido_o_dispuesto)) IN ('A', 'D') THEN upper(trim(adquirido_o_dispuesto)) END AS signo, CAST(quarter(fecha_transaccion) AS INTEGER) AS trimestre FROM insider_transactions"""
SQL["fn_texts"] = f"""
WITH a AS ({SQL["f18_folded"]}), b AS ({SQL["s9_text"]}), c AS ({SQL["n4_sections"]}), e AS ({SQL["f20_json"]})
SELECT a.doc_id, a.huella AS plegado, b.huella AS plano, c.huella AS seccion, e.veredicto FROM a JOIN b ON b.doc_id = a.doc_id JOIN c ON c.doc_id = a.doc_id JOIN e ON e.doc_id = a.doc_id"""
_DQ = {
    "empresas": {"ticker_largo": "length(ticker) <= 10", "bolsa_largo": "length(bolsa) <= 20", "cik_formato": "regexp_matches(cik, '^[0-9]{10}$')"},
    "metricas_trimestrales": {"trimestre_dominio": "trimestre BETWEEN 1 AND 4", "periodo_orden": "fecha_inicio < fecha_fin", "publicada_despues": "fecha_filing >= fecha_fin"},
    "insider_transactions": {"cargo_largo": "length(cargo) <= 100", "ad_dominio": "adquirido_o_dispuesto IN ('A', 'D')", "importe_positivo": "importe_total >= 0"},
}
SQL["dq_rules"] = " UNION ALL ".join(f"SELECT '{t}' AS tabla, '{n}' AS regla, count(*) FILTER (WHERE NOT ({r})) AS incumplen, count(*) FILTER (WHERE ({r}) IS NULL) AS nulos FROM {t}" for t, rs in _DQ.items() for n, r in rs.items())
SQL["dq_nulls"] = " UNION ALL ".join(
    f"SELECT '{c}' AS columna, count(*) FILTER (WHERE {c} IS NULL) AS nulos FROM metricas_trimestrales"
    for c in ("fecha_inicio", "fecha_fin", "revenue", "gross_profit", "net_income", "operating_cash_flow", "accounts_receivable", "shares_outstanding", "metricas_sector", "fecha_filing")
)
