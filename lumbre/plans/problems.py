"""Queries of the general training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pit, rolling, spikes
from ..operators.upsert import latest
from ..session import cut_lineage, table


def text_day(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


def purchases(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Purchases of the latest loaded version of each transaction, with the insider's
    key and the columns ``more``."""
    tx = table(spark, d, "insider_transactions").select("accession_number", "trans_sk", "fecha_registro", "id", "empresa_id", "nombre_insider", "tipo_transaccion", "fecha_transaccion", *more)
    now = latest(tx, ["accession_number", "trans_sk"], [F.col("fecha_registro"), F.col("id")])
    name = F.upper(F.trim(F.regexp_replace("nombre_insider", r"^\s+|\s+$", "")))
    return (
        now.filter(F.upper(F.trim("tipo_transaccion")) == "P")
        .withColumn("insider", F.coalesce(F.concat(F.lit("="), name), F.lit("")))
        .withColumn("dia", F.unix_date("fecha_transaccion"))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_implausible(table(spark, d, "metricas_trimestrales")).select(F.col("id").cast("long").alias("metrica_id"), "campo")


def p1_resumen(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_implausible(table(spark, d, "metricas_trimestrales")).groupBy("campo", "motivo").agg(F.count(F.lit(1)).alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    days = rolling.days_with_members(purchases(spark, d), "empresa_id", "insider", "dia", (7, 30), 3)
    return days.select("empresa_id", text_day(F.date_from_unix_date("dia")).alias("fecha"), F.col("window").alias("dias"))


def p2_totales(spark: SparkSession, d: str) -> DataFrame:
    """Every empresa, with purchases or not, and every day from the first purchase
    of any to the last day known: 29 days after the last purchase of any, or the
    last registration of one if later, with totals and daily averages."""
    buys = purchases(spark, d, "acciones", "importe_total").filter("empresa_id is not null and dia is not null")
    cents = F.round(F.col("importe_total") * 100, 0).cast("long")
    leaves = buys.groupBy("empresa_id", "dia").agg(
        F.count(F.lit(1)).alias("compras"), F.sum(F.coalesce("acciones", F.lit(0))).alias("acciones"), F.sum(F.coalesce(cents, F.lit(0))).alias("centimos"), F.max(F.unix_date(F.to_date("fecha_registro"))).alias("registro")
    )
    moves = rolling.presence_deltas(buys, "empresa_id", "insider", "dia", (7, 30))
    moves = moves.select(F.col("e").alias("empresa_id"), F.col("d").alias("dia"), *[F.when(F.col("w") == w, F.col("delta")).otherwise(0).cast("long").alias(f"c{w}") for w in (7, 30)])
    leaves = cut_lineage(leaves)  # one row per empresa and day, for the ends of the calendar and for the trees
    ends = leaves.agg(F.min("dia").alias("a"), F.greatest(F.max("dia") + 29, F.max("registro")).alias("z")).first()
    every = table(spark, d, "empresas").select(F.col("id").alias("empresa_id")).unionByName(leaves.select("empresa_id")).filter("empresa_id is not null").distinct()
    edges = every.select("empresa_id", F.explode(F.array(F.lit(ends["a"]).cast("int"), F.lit(ends["z"]).cast("int"))).alias("dia")).filter("dia is not null")
    moves = moves.filter(F.col("dia") <= F.lit(ends["z"]).cast("int"))  # the last buyers leave after the last day
    both = leaves.drop("registro").unionByName(moves, allowMissingColumns=True).unionByName(edges, allowMissingColumns=True)
    names = ["compras", "acciones", "centimos", "c7", "c30"]
    both = both.groupBy("empresa_id", "dia").agg(*[F.sum(F.coalesce(F.col(v), F.lit(0))).alias(v) for v in names])
    got = rolling.trailing_totals(both, "empresa_id", "dia", names[:3], (7, 30), running=("c7", "c30"))
    out = [F.col("empresa_id").cast("int").alias("empresa_id"), text_day(F.date_from_unix_date("dia")).alias("fecha")]
    for w in (7, 30):
        totals = {"compras": f"compras_{w}", "acciones": f"acciones_{w}", "centimos": f"centimos_{w}", "compradores": f"c{w}"}
        out += [F.col(c).alias(f"{n}_{w}") for n, c in totals.items()] + [F.round(F.col(c) / w, 6).alias(f"{n}_dia_{w}") for n, c in totals.items()]
    return got.select(*out)


def p2_correcciones(spark: SparkSession, d: str) -> DataFrame:
    """Shares bought in the last 30 days of each purchase day, from trees built
    before 2022 and then corrected by what was registered later."""
    buys = purchases(spark, d, "acciones").select("empresa_id", "dia", "acciones", "fecha_registro")
    early = F.coalesce(F.col("fecha_registro") < F.lit("2022-01-01").cast("timestamp_ntz"), F.lit(True))
    nodes = rolling.tree_nodes(buys.filter(early), "empresa_id", "dia", ["acciones"])
    nodes = rolling.correct_nodes(nodes, buys.filter(~early), "empresa_id", "dia", ["acciones"])
    asked = buys.filter("empresa_id is not null and dia is not null").select("empresa_id", F.col("dia").alias("hasta")).distinct().withColumn("desde", F.col("hasta") - 29)
    got = rolling.query_nodes(nodes, asked, "empresa_id", "desde", "hasta", ["acciones"])
    return got.select("empresa_id", text_day(F.date_from_unix_date("hasta")).alias("fecha"), F.col("acciones").alias("acciones_30"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    cases = pit.with_entity(table(spark, d, "validadas_historicas"), table(spark, d, "empresas"))
    attrs = table(spark, d, "metricas_trimestrales").filter("fecha_fin is not null and shares_outstanding is not null")
    return pit.as_known(
        cases, attrs, "empresa_id", "fecha_deteccion", "empresa_id", "fecha_filing", [F.col("fecha_fin"), F.col("fecha_filing")], "id", ["id", "shares_outstanding", "fecha_fin", "fecha_filing"], "m_"
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d).filter("m_id is not null").select("caso_id", F.col("m_id").cast("long").alias("metrica_id"))


def p4_casos(spark: SparkSession, d: str) -> DataFrame:
    """All cases with the shares known on their day and the price they imply."""
    k = _known(spark, d)
    price = F.when(F.col("m_shares_outstanding") > 0, F.round(F.col("market_cap_historico") / F.col("m_shares_outstanding"), 4))
    return k.select("caso_id", "empresa_id", text_day("fecha_deteccion").alias("fecha"), F.col("m_shares_outstanding").alias("acciones_conocidas"), text_day("m_fecha_fin").alias("trimestre_conocido"), price.alias("precio_implicito"))


QUERIES = {
    "p1_found": p1_found,
    "p1_resumen": p1_resumen,
    "p2_found": p2_found,
    "p2_totales": p2_totales,
    "p2_correcciones": p2_correcciones,
    "p4_found": p4_found,
    "p4_casos": p4_casos,
}

_BUYS = """
buys AS (
  SELECT empresa_id, fecha_transaccion AS f, acciones, importe_total, fecha_registro,
         CASE WHEN nombre_insider IS NULL THEN '' ELSE '=' || upper(trim(nombre_insider)) END AS insider
  FROM (SELECT *, row_number() OVER (PARTITION BY accession_number, trans_sk ORDER BY fecha_registro DESC NULLS LAST, id DESC) AS rn
        FROM insider_transactions) t
  WHERE rn = 1 AND upper(trim(tipo_transaccion)) = 'P' AND empresa_id IS NOT NULL AND fecha_transaccion IS NOT NULL)
"""

_CASES = """
cases AS (
  SELECT v.caso_id, v.fecha_deteccion, v.market_cap_historico, coalesce(v.empresa_id, e.id) AS empresa_id
  FROM validadas_historicas v
  LEFT JOIN (SELECT ticker, min(id) AS id FROM empresas WHERE ticker IS NOT NULL GROUP BY ticker) e
    ON v.empresa_id IS NULL AND v.ticker = e.ticker)
"""

_KNOWN = f"""
WITH {_CASES},
m AS (SELECT * FROM metricas_trimestrales WHERE fecha_fin IS NOT NULL AND shares_outstanding IS NOT NULL AND fecha_filing IS NOT NULL),
best AS (
  SELECT c.caso_id, m.id, m.shares_outstanding, m.fecha_fin,
         row_number() OVER (PARTITION BY c.caso_id ORDER BY m.fecha_fin DESC, m.fecha_filing DESC, m.id) AS rn
  FROM cases c JOIN m ON m.empresa_id = c.empresa_id AND m.fecha_filing <= c.fecha_deteccion)
"""

SQL = {
    "p2_found": f"""
WITH {_BUYS},
w AS (SELECT unnest([7, 30]) AS dias),
near AS (
  SELECT DISTINCT b.empresa_id, w.dias, CAST(b.f + CAST(k AS INTEGER) AS DATE) AS dia, b.insider
  FROM buys b, w, (SELECT unnest(range(0, 30)) AS k) o WHERE k < w.dias)
SELECT empresa_id, strftime(dia, '%Y-%m-%d') AS fecha, dias
FROM near GROUP BY empresa_id, dias, dia HAVING count(DISTINCT insider) >= 3""",
    "p2_totales": f"""
WITH {_BUYS},
leaf AS (SELECT empresa_id, f AS dia, count(*) AS compras, sum(coalesce(acciones, 0)) AS acciones, sum(coalesce(CAST(round(importe_total * 100, 0) AS BIGINT), 0)) AS centimos FROM buys GROUP BY 1, 2),
known AS (SELECT min(f) AS a, greatest(max(f) + 29, max(CAST(fecha_registro AS DATE))) AS z FROM buys),
every AS (SELECT id AS empresa_id FROM empresas WHERE id IS NOT NULL UNION SELECT empresa_id FROM buys),
cal AS (SELECT empresa_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS dia FROM every, known WHERE a IS NOT NULL),
near AS (SELECT b.empresa_id, w.dias, CAST(b.f + CAST(k AS INTEGER) AS DATE) AS dia, count(DISTINCT b.insider) AS c
  FROM buys b, (SELECT unnest([7, 30]) AS dias) w, (SELECT unnest(range(0, 30)) AS k) o WHERE k < w.dias GROUP BY 1, 2, 3),
d AS (SELECT c.empresa_id, c.dia, coalesce(compras, 0) AS n, coalesce(acciones, 0) AS a, coalesce(centimos, 0) AS c FROM cal c LEFT JOIN leaf l ON l.empresa_id = c.empresa_id AND l.dia = c.dia),
s AS (SELECT empresa_id, dia, sum(n) OVER v AS n7, sum(a) OVER v AS a7, sum(c) OVER v AS c7, sum(n) OVER m AS n30, sum(a) OVER m AS a30, sum(c) OVER m AS c30
      FROM d WINDOW v AS (PARTITION BY empresa_id ORDER BY dia ROWS 6 PRECEDING), m AS (PARTITION BY empresa_id ORDER BY dia ROWS 29 PRECEDING))
SELECT s.empresa_id, strftime(s.dia, '%Y-%m-%d') AS fecha, coalesce(x.c, 0) AS compradores_7, coalesce(y.c, 0) AS compradores_30,
  CAST(n7 AS BIGINT) AS compras_7, CAST(a7 AS BIGINT) AS acciones_7, CAST(c7 AS BIGINT) AS centimos_7, CAST(n30 AS BIGINT) AS compras_30, CAST(a30 AS BIGINT) AS acciones_30, CAST(c30 AS BIGINT) AS centimos_30,
  round(CAST(n7 AS DOUBLE) / 7, 6) AS compras_dia_7, round(CAST(a7 AS DOUBLE) / 7, 6) AS acciones_dia_7, round(CAST(c7 AS DOUBLE) / 7, 6) AS centimos_dia_7, round(CAST(coalesce(x.c, 0) AS DOUBLE) / 7, 6) AS compradores_dia_7,
  round(CAST(n30 AS DOUBLE) / 30, 6) AS compras_dia_30, round(CAST(a30 AS DOUBLE) / 30, 6) AS acciones_dia_30, round(CAST(c30 AS DOUBLE) / 30, 6) AS centimos_dia_30, round(CAST(coalesce(y.c, 0) AS DOUBLE) / 30, 6) AS compradores_dia_30
FROM s LEFT JOIN near x ON x.empresa_id = s.empresa_id AND x.dia = s.dia AND x.dias = 7 LEFT JOIN near y ON y.empresa_id = s.empresa_id AND y.dia = s.dia AND y.dias = 30""",
    "p2_correcciones": f"""
WITH {_BUYS},
leaf AS (SELECT empresa_id, f, sum(coalesce(acciones, 0)) AS a FROM buys GROUP BY 1, 2)
SELECT empresa_id, strftime(f, '%Y-%m-%d') AS fecha,
  CAST(sum(a) OVER (PARTITION BY empresa_id ORDER BY f RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS acciones_30
FROM leaf""",
    "p4_found": _KNOWN + "SELECT caso_id, id AS metrica_id FROM best WHERE rn = 1",
    "p4_casos": _KNOWN
    + """SELECT c.caso_id, c.empresa_id, strftime(c.fecha_deteccion, '%Y-%m-%d') AS fecha, b.shares_outstanding AS acciones_conocidas,
  strftime(b.fecha_fin, '%Y-%m-%d') AS trimestre_conocido,
  CASE WHEN b.shares_outstanding > 0 THEN round(c.market_cap_historico / b.shares_outstanding, 4) END AS precio_implicito
FROM cases c LEFT JOIN best b ON b.caso_id = c.caso_id AND b.rn = 1""",
}
