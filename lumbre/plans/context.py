"""Queries that bring together what is known of a company or a case, and reports over
outcomes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import asof, cluster, pit, series
from ..session import left_join, table
from .config import Config
from .filings import _BUYS, _CASES, _PR, _asks, _buys, _look, _mean_value, _prices, _rounded
from .filings import SQL as FILINGS
from .filings import n7_citations as _citations

DAY = "yyyy-MM-dd"
#: Public names of items of current reports.
ITEMS = {"1.01": "Entry into a Material Definitive Agreement", "1.02": "Termination of a Material Definitive Agreement", "2.01": "Completion of Acquisition or Disposition of Assets", "3.02": "Unregistered Sales of Equity Securities", "5.02": "Departure or Election of Directors or Officers"}
#: Characters of an event, of a holding, that go into a block.
EVENT_CHARS, HOLDING_CHARS = 3000, 1500
#: Oldest text of a case, in days; days of purchases before it.
STALE, BEFORE = 365, 60


def _day(c):
    return F.date_format(c, DAY)


def _block(df, by, line, name, sep="\n"):
    """The ranked rows of each group as one text, in order of rank."""
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("x")))), lambda z: z["x"])
    return df.groupBy(by).agg(F.array_join(all_, sep).alias(name))


def _latest(df, t, k):
    return series.last_k(df.filter(F.col(t).isNotNull()), ["empresa_id"], [F.col(t).desc(), F.col("id").desc()], k)


def _events(s, d):
    ev = _latest(table(s, d, "eventos_8k").select("id", "empresa_id", "item", "fecha_evento", "doc_id"), "fecha_evento", 5)
    # only the ranked rows meet the texts
    ev = left_join(ev, table(s, d, "documents").select("doc_id", F.substring(text.html_to_text("text"), 1, EVENT_CHARS).alias("t")), ["doc_id"])
    names = F.create_map(*[F.lit(x) for kv in ITEMS.items() for x in kv])
    line = F.concat(_day("fecha_evento"), F.lit(" "), F.col("item"), F.lit(" "), F.coalesce(F.try_element_at(names, F.col("item")), F.lit("-")), F.lit("\n"), F.coalesce("t", F.lit("")))
    return _block(ev, "empresa_id", line, "eventos")


def _holdings(s, d):
    h = _latest(table(s, d, "participaciones_activistas").select("id", "empresa_id", "formulario", "pct_participacion", "fecha_evento", "doc_id"), "fecha_evento", 3)
    h = left_join(h, table(s, d, "documents").select("doc_id", F.substring(text.html_to_text("text"), 1, HOLDING_CHARS).alias("t")), ["doc_id"])
    line = F.concat(_day("fecha_evento"), F.lit(" "), F.col("formulario"), F.lit(" "), F.coalesce(F.col("pct_participacion").cast("string"), F.lit("-")), F.lit("\n"), F.coalesce("t", F.lit("")))
    return _block(h, "empresa_id", line, "participaciones")


def _signals(s, d):
    """Lines on shelf, price range and holdings; what is not known has no line."""
    e = table(s, d, "empresas").select(F.col("id").alias("empresa_id"), "ticker", "shelf_activa", "fecha_ultimo_shelf", "posicion_52w").join(_holdings(s, d), "empresa_id", "left")
    shelf = F.when(F.col("shelf_activa"), F.concat(F.lit("shelf "), F.coalesce(_day("fecha_ultimo_shelf"), F.lit("-"))))
    place = F.when(F.col("posicion_52w").isNotNull(), F.concat(F.lit("posicion "), F.col("posicion_52w").cast("string")))
    return e.select("empresa_id", "ticker", F.concat_ws("\n", shelf, place, "participaciones").alias("senales"))


def _discussion(s, d):
    docs = table(s, d, "documents").filter("source = 'mda_10q' and empresa_id is not null and fecha_doc is not null")
    newest = docs.groupBy("empresa_id").agg(F.max_by("doc_id", F.struct("fecha_doc", "doc_id")).alias("doc_id"))
    return newest.join(docs.select("doc_id", "text"), "doc_id").select("empresa_id", F.col("doc_id").alias("mda_doc"), F.col("text").alias("mda"))


def n9_events(s, d):
    """The five latest events of each company as a text."""
    return _events(s, d).select("empresa_id", F.length("eventos").alias("largo"), F.md5("eventos").alias("huella"))


def n10_signals(s, d):
    return _signals(s, d).select("empresa_id", F.length("senales").alias("largo"), F.md5("senales").alias("huella"))


def n6_citation_source(s, d):
    """What quotes on a company may be taken from: its discussion, events and signals."""
    x = _signals(s, d).join(_discussion(s, d), "empresa_id", "left").join(_events(s, d), "empresa_id", "left")
    x = x.withColumn("fuente", F.concat_ws("\n\n", "mda", "eventos", F.nullif("senales", F.lit(""))))
    return x.select("empresa_id", F.length("fuente").alias("largo"), F.md5("fuente").alias("huella"))


def n8_company(s, d):
    """One nested row per company: its latest discussion, events, holdings, purchases and signals."""
    buys = _latest(_buys(s, d).select("id", "empresa_id", "nombre_insider", "importe_total", "fecha_transaccion"), "fecha_transaccion", 10)
    line = F.concat_ws("|", F.col("id").cast("string"), _day("fecha_transaccion"), F.coalesce("nombre_insider", F.lit("-")), F.coalesce(F.col("importe_total").cast("string"), F.lit("-")))
    x = _signals(s, d).join(_discussion(s, d), "empresa_id", "left").join(_events(s, d), "empresa_id", "left").join(_block(buys, "empresa_id", line, "compras"), "empresa_id", "left")
    return x.select("empresa_id", "ticker", "mda_doc", F.md5("mda").alias("mda"), F.md5("eventos").alias("eventos"), F.md5("senales").alias("senales"), "compras")


def _case_rows(s, d):
    return pit.with_entity(table(s, d, "validadas_historicas"), table(s, d, "empresas")).select("caso_id", "empresa_id", "fecha_deteccion")


def n15_case(s, d):
    """Every case with the discussion known at its date, at most a year old, and the
    purchases of the days before it."""
    cases = _case_rows(s, d)
    docs = table(s, d, "documents").filter("source = 'mda_10q'").select("doc_id", "empresa_id", "fecha_doc", F.length("text").alias("largo"))
    got = asof.asof(cases, docs, "empresa_id", "fecha_deteccion", "fecha_doc", ["doc_id", "largo"], tolerance=STALE, tie=[-F.col("doc_id")])
    buys = asof.interval_join(cases, _buys(s, d), "empresa_id", "fecha_deteccion", "fecha_transaccion", BEFORE, 0, ["id", "importe_total"])
    buys = buys.groupBy("caso_id").agg(F.count(F.lit(1)).alias("compras"), F.sum("importe_total").cast("double").alias("importe"))
    return got.join(buys, "caso_id", "left").select("caso_id", "doc_id", "largo", F.coalesce("compras", F.lit(0).cast("long")).alias("compras"), "importe")


def f23_anonymous_buyers(s, d):
    """The purchases before each case with letters for the buyers, largest first; letters
    come round again after the 26th."""
    j = asof.interval_join(_case_rows(s, d), _buys(s, d), "empresa_id", "fecha_deteccion", "fecha_transaccion", BEFORE, 0, ["id", "importe_total"], prefix="c_")
    j = series.last_k(j, ["caso_id"], [F.col("c_importe_total").desc_nulls_last(), F.col("c_id")], (1 << 31) - 1)
    line = F.concat(F.char(F.lit(65) + F.pmod(F.col("rn") - 1, F.lit(26))), F.lit(": "), F.coalesce(F.format_number("c_importe_total", 2), F.lit("-")))
    return _block(j, "caso_id", line, "compras", "; ")


def a6_horizons(s, d):
    """Returns and excess per horizon: means, share above, upper median and what is left out.

    Over a first value of zero there is no return: such purchases are left out too (the SQL
    has no result then, as it takes sums of decimals). The share is NaN where none is left."""
    m = table(s, d, "events").groupBy(F.to_date("ts").alias("dia")).agg(_mean_value().alias("media"))
    a = _asks(s, d)
    # all horizons in one pass: entry at the first value from day 7 after the purchase, at most 11
    # days later; exit at the last up to ``n`` days after day 7, at most 5 days stale
    frames = {"entra": ("first", 7, 18)} | {f"sale{n}": ("last", n + 2, n + 7) for n in (12, 24)}
    v = asof.lookups(a, _prices(s, d), "user_id", "d0", "dia", "cierre", frames)
    b = asof.lookups(a, m, None, "d0", "dia", "media", frames).select("d0", *[F.col(c).alias(f"m_{c}") for c in frames])
    r = left_join(left_join(a, v, ["user_id", "d0"]), b, ["d0"])
    growth = lambda out, first: _rounded(F.try_divide(out, first) - 1, 6)
    r = r.select(F.inline(F.array(*[F.struct(F.lit(n).alias("dias"), growth(f"sale{n}", "entra").alias("ret"), growth(f"m_sale{n}", "m_entra").alias("ref")) for n in (12, 24)])))
    parts = r.withColumn("exceso", _rounded(F.col("ret") - F.col("ref"), 6))
    # sums of decimals, so that the order of rows changes nothing
    mean = lambda c: _rounded(F.try_divide(F.sum(F.when(F.col("exceso").isNotNull(), F.col(c)).cast("decimal(20,6)")).cast("double"), F.count("exceso")), 4)
    a = parts.groupBy("dias").agg(F.count("exceso").alias("n"), mean("ret").alias("retorno"), mean("ref").alias("referencia"), mean("exceso").alias("exceso"), F.coalesce(_rounded(F.try_divide(F.count_if(F.col("exceso") > 0), F.count("exceso")), 6), F.lit(float("nan"))).alias("superan"), (F.count(F.lit(1)) - F.count("exceso")).alias("excluidos"))
    med = series.medians(parts, ["dias"], "exceso").select(F.col("dias"), F.col("alto").alias("mediana_alta"))
    return a.join(med, "dias", "left")


def a7_verdicts(s, d):
    """Per verdict the theses, the median capitalisation of their companies and how many
    have none."""
    t = table(s, d, "documents").filter("source = 'tesis_detective'").select("empresa_id", F.get_json_object(text.first_json("text"), "$.veredicto_preliminar").alias("veredicto"))
    e = table(s, d, "empresas").select(F.col("id").alias("empresa_id"), "market_cap_usd")
    j = left_join(t, e, ["empresa_id"]).withColumn("veredicto", F.coalesce("veredicto", F.lit("ilegible")))
    n = j.groupBy("veredicto").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("market_cap_usd").isNull()).alias("sin_cap"))
    med = series.medians(j, ["veredicto"], "market_cap_usd").select("veredicto", ((F.col("bajo") + F.col("alto")) / 2).alias("mediana"))
    return n.join(med, "veredicto", "left")


def a12_citations(s, d):
    """Quotes verified per source of documents."""
    j = _citations(s, d).join(table(s, d, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.sum("citas_verificadas").alias("verificadas"), F.sum("citas_totales").alias("totales"), F.sum("demasiado_cortas").alias("cortas"), F.count_if("alucinacion_detectada").alias("alucinan"))


def a13_tags(s, d):
    """Documents by the tag their form begins with."""
    tag = F.coalesce(F.upper(F.regexp_extract(F.trim("formulario"), r"^[^ /-]+", 0)), F.lit("SIN"))
    return table(s, d, "documents").groupBy(tag.alias("etiqueta")).agg(F.count(F.lit(1)).alias("n"))


def a14_companies(s, d):
    """Per company: filings first seen, seen again, without a section of their own, without text."""
    ev = table(s, d, "eventos_8k")
    first = ev.groupBy("accession_number", "item").agg(F.min("id").alias("id")).select("id", F.lit(1).alias("primera"))
    j = ev.join(first, "id", "left")
    return j.groupBy("empresa_id").agg(F.count("primera").alias("nuevos"), F.count_if(F.col("primera").isNull()).alias("existentes"), F.count_if(~F.coalesce("seccion_aislada", F.lit(False))).alias("sin_seccion"), F.count_if(F.col("doc_id").isNull()).alias("sin_texto"))


def l4_outside(s, d):
    """The 15 smallest capitalisations outside the range."""
    v = table(s, d, "validadas_historicas").filter("market_cap_historico is not null and not (market_cap_historico between 5e7 and 2e9)")
    return v.orderBy("market_cap_historico", "caso_id").limit(15).select("caso_id", F.round("market_cap_historico", 2).alias("cap"))


def u5_cutoff(s, d):
    """Companies with a cluster of as many members as a table of parameters asks for."""
    cfg = Config.read(s.createDataFrame([("cluster_members", "4"), ("other", "x")], "clave string, valor string"))
    c = cluster.first_clusters(_buys(s, d), "empresa_id", "nombre_insider", "fecha_transaccion", cfg.cluster_window_days, cfg.cluster_members)
    return c.filter("found").select("empresa_id", "members_max")


QUERIES = {f.__name__: f for f in (n9_events, n10_signals, n6_citation_source, n8_company, n15_case, f23_anonymous_buyers, a6_horizons, a7_verdicts, a12_citations, a13_tags, a14_companies, l4_outside, u5_cutoff)}

# SQL ------------------------------------------------------------------------


def _sql() -> dict[str, str]:
    from .filings import _cluster_sql, _html_sql

    plain = _html_sql("text")
    items = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ITEMS.items())
    ev = f"""ev AS (SELECT empresa_id, string_agg(strftime(fecha_evento, '%Y-%m-%d') || ' ' || item || ' ' || CASE item {items} ELSE '-' END || chr(10) || coalesce(t, ''), chr(10) ORDER BY rn) AS eventos FROM (
  SELECT e.*, d.t, row_number() OVER (PARTITION BY e.empresa_id ORDER BY e.fecha_evento DESC, e.id DESC) AS rn FROM eventos_8k e LEFT JOIN plain d ON d.doc_id = e.doc_id WHERE e.fecha_evento IS NOT NULL) x WHERE rn <= 5 GROUP BY 1)"""
    plain_e = f"plain AS (SELECT doc_id, substring({plain}, 1, {EVENT_CHARS}) AS t, substring({plain}, 1, {HOLDING_CHARS}) AS h FROM documents)"
    ho = """ho AS (SELECT empresa_id, string_agg(strftime(fecha_evento, '%Y-%m-%d') || ' ' || formulario || ' ' || coalesce(CAST(pct_participacion AS VARCHAR), '-') || chr(10) || coalesce(h, ''), chr(10) ORDER BY rn) AS participaciones FROM (
  SELECT p.*, d.h, row_number() OVER (PARTITION BY p.empresa_id ORDER BY p.fecha_evento DESC, p.id DESC) AS rn FROM participaciones_activistas p LEFT JOIN plain d ON d.doc_id = p.doc_id WHERE p.fecha_evento IS NOT NULL) x WHERE rn <= 3 GROUP BY 1)"""
    sig = """sig AS (SELECT e.id AS empresa_id, e.ticker, concat_ws(chr(10), CASE WHEN shelf_activa THEN 'shelf ' || coalesce(strftime(fecha_ultimo_shelf, '%Y-%m-%d'), '-') END, 'posicion ' || CAST(posicion_52w AS VARCHAR), ho.participaciones) AS senales FROM empresas e LEFT JOIN ho ON ho.empresa_id = e.id)"""
    mda = """mda AS (SELECT empresa_id, doc_id AS mda_doc, text AS mda FROM (SELECT *, row_number() OVER (PARTITION BY empresa_id ORDER BY fecha_doc DESC, doc_id DESC) AS rn FROM documents WHERE source = 'mda_10q' AND empresa_id IS NOT NULL AND fecha_doc IS NOT NULL) x WHERE rn = 1)"""
    all_ = f"{plain_e}, {ev}, {ho}, {sig}, {mda}"

    def excess(days: int) -> str:
        return (
            "WITH " + _PR + f", bench AS (SELECT 1 AS k, CAST(ts AS DATE) AS dia, round(CAST(avg(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 4) AS media FROM events GROUP BY 2), a1 AS (SELECT *, 1 AS k, CAST(d0 + 7 AS DATE) AS d1, CAST(d0 + {7 + days} AS DATE) AS d2 FROM asks),"
            + _look("i", "a1", "d1", True, 11) + "," + _look("o", "i", "d2", False, 5) + "," + _look("bi", "o", "d1", True, 11, "bench", "k", "media") + "," + _look("bo", "bi", "d2", False, 5, "bench", "k", "media")
            + f" SELECT {days} AS dias, round(o_v / i_v - 1, 6) AS ret, round(bo_v / bi_v - 1, 6) AS ref FROM bo"
        )

    dec = lambda c: f"round(CAST(sum(CAST({c} AS DECIMAL(20,6))) FILTER (WHERE exceso IS NOT NULL) AS DOUBLE) / count(exceso), 4)"
    return {
        "n9_events": f"WITH {plain_e}, {ev} SELECT empresa_id, CAST(length(eventos) AS INTEGER) AS largo, md5(eventos) AS huella FROM ev",
        "n10_signals": f"WITH {plain_e}, {ho}, {sig} SELECT empresa_id, CAST(length(senales) AS INTEGER) AS largo, md5(senales) AS huella FROM sig",
        "n6_citation_source": f"WITH {all_}, f AS (SELECT s.empresa_id, concat_ws(chr(10) || chr(10), mda.mda, ev.eventos, nullif(s.senales, '')) AS x FROM sig s LEFT JOIN mda ON mda.empresa_id = s.empresa_id LEFT JOIN ev ON ev.empresa_id = s.empresa_id) SELECT empresa_id, CAST(length(x) AS INTEGER) AS largo, md5(x) AS huella FROM f",
        "n8_company": f"""WITH {_BUYS}, {all_},
b AS (SELECT empresa_id, string_agg(id || '|' || strftime(fecha_transaccion, '%Y-%m-%d') || '|' || coalesce(nombre_insider, '-') || '|' || coalesce(CAST(importe_total AS VARCHAR), '-'), chr(10) ORDER BY rn) AS compras FROM (
  SELECT *, row_number() OVER (PARTITION BY empresa_id ORDER BY fecha_transaccion DESC, id DESC) AS rn FROM buys) x WHERE rn <= 10 GROUP BY 1)
SELECT s.empresa_id, s.ticker, mda.mda_doc, md5(mda.mda) AS mda, md5(ev.eventos) AS eventos, md5(s.senales) AS senales, b.compras FROM sig s LEFT JOIN mda ON mda.empresa_id = s.empresa_id LEFT JOIN ev ON ev.empresa_id = s.empresa_id LEFT JOIN b ON b.empresa_id = s.empresa_id""",
        "n15_case": f"""WITH {_BUYS}, {_CASES},
t AS (SELECT * FROM (SELECT c.caso_id, d.doc_id, CAST(length(d.text) AS INTEGER) AS largo, row_number() OVER (PARTITION BY c.caso_id ORDER BY d.fecha_doc DESC, d.doc_id) AS rn FROM cases c JOIN documents d ON d.empresa_id = c.empresa_id AND d.source = 'mda_10q' AND d.fecha_doc BETWEEN c.fecha_deteccion - {STALE} AND c.fecha_deteccion) x WHERE rn = 1),
b AS (SELECT c.caso_id, count(*) AS compras, CAST(sum(b.importe_total) AS DOUBLE) AS importe FROM cases c JOIN buys b ON b.empresa_id = c.empresa_id AND b.fecha_transaccion BETWEEN c.fecha_deteccion - {BEFORE} AND c.fecha_deteccion GROUP BY 1)
SELECT c.caso_id, t.doc_id, t.largo, coalesce(b.compras, 0) AS compras, b.importe FROM cases c LEFT JOIN t ON t.caso_id = c.caso_id LEFT JOIN b ON b.caso_id = c.caso_id""",
        "f23_anonymous_buyers": f"""WITH {_BUYS}, {_CASES},
j AS (SELECT c.caso_id, b.importe_total AS x, row_number() OVER (PARTITION BY c.caso_id ORDER BY b.importe_total DESC NULLS LAST, b.id) AS rn FROM cases c JOIN buys b ON b.empresa_id = c.empresa_id AND b.fecha_transaccion BETWEEN c.fecha_deteccion - {BEFORE} AND c.fecha_deteccion)
SELECT caso_id, string_agg(chr(CAST(65 + (rn - 1) % 26 AS INTEGER)) || ': ' || coalesce(format('{{:,.2f}}', CAST(x AS DOUBLE)), '-'), '; ' ORDER BY rn) AS compras FROM j GROUP BY 1""",
        "a6_horizons": f"""WITH x AS (SELECT * FROM ({excess(12)}) UNION ALL SELECT * FROM ({excess(24)})), e AS (SELECT *, round(ret - ref, 6) AS exceso FROM x)
SELECT CAST(dias AS INTEGER) AS dias, count(exceso) AS n, {dec('ret')} AS retorno, {dec('ref')} AS referencia, {dec('exceso')} AS exceso, round(count(*) FILTER (WHERE exceso > 0) / CAST(count(exceso) AS DOUBLE), 6) AS superan, count(*) - count(exceso) AS excluidos,
  list_sort(list(exceso) FILTER (WHERE exceso IS NOT NULL))[count(exceso) // 2 + 1] AS mediana_alta FROM e GROUP BY 1""",
        "a7_verdicts": """
WITH t AS (SELECT coalesce(CASE WHEN json_valid(text) AND text LIKE '{%' THEN json_extract_string(text, '$.veredicto_preliminar') END, 'ilegible') AS veredicto, e.market_cap_usd AS c FROM documents d LEFT JOIN empresas e ON e.id = d.empresa_id WHERE source = 'tesis_detective')
SELECT veredicto, count(*) AS n, count(*) FILTER (WHERE c IS NULL) AS sin_cap, median(c) AS mediana FROM t GROUP BY 1""",
        "a12_citations": f"WITH q AS ({FILINGS['n7_citations']}) SELECT d.source, CAST(sum(citas_verificadas) AS BIGINT) AS verificadas, CAST(sum(citas_totales) AS BIGINT) AS totales, CAST(sum(demasiado_cortas) AS BIGINT) AS cortas, count(*) FILTER (WHERE alucinacion_detectada) AS alucinan FROM q JOIN documents d ON d.doc_id = q.doc_id GROUP BY 1",
        "a13_tags": "SELECT coalesce(upper(regexp_extract(trim(formulario), '^[^ /-]+', 0)), 'SIN') AS etiqueta, count(*) AS n FROM documents GROUP BY 1",
        "a14_companies": """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY accession_number, item ORDER BY id) AS k FROM eventos_8k)
SELECT empresa_id, count(*) FILTER (WHERE k = 1) AS nuevos, count(*) FILTER (WHERE k > 1) AS existentes, count(*) FILTER (WHERE NOT coalesce(seccion_aislada, FALSE)) AS sin_seccion, count(*) FILTER (WHERE doc_id IS NULL) AS sin_texto FROM e GROUP BY 1""",
        "l4_outside": "SELECT caso_id, round(market_cap_historico, 2) AS cap FROM validadas_historicas WHERE market_cap_historico IS NOT NULL AND NOT (market_cap_historico BETWEEN 5e7 AND 2e9) ORDER BY market_cap_historico, caso_id LIMIT 15",
        "u5_cutoff": "WITH " + _BUYS + "," + _cluster_sql("buys", "empresa_id", "nombre_insider", "fecha_transaccion", 60, 4) + " SELECT e AS empresa_id, members_max FROM clusters WHERE found",
    }


SQL = _sql()
