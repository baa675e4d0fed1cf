"""Queries of the operators for language-model training data and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pit import with_entity
from ..session import table
from . import mixing, names, nearest, packing, tokens, truncation

#: Kinds of containers laid out at once; their table has four.
MOST_KINDS = 1000


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    cases = with_entity(table(spark, d, "validadas_historicas"), table(spark, d, "empresas"))
    return nearest.nearest_in_time(cases, table(spark, d, "metricas_trimestrales"), "empresa_id", "fecha_deteccion", "empresa_id", "fecha_fin", "id", 50)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).filter("match_id is not null").select("caso_id", F.col("match_id").alias("metrica_id"))


def p3_casos(spark: SparkSession, d: str) -> DataFrame:
    """All cases with the distance of their quarter, or null."""
    return _nearest(spark, d).select("caso_id", "empresa_id", F.col("match_id").alias("metrica_id"), F.col("match_days").alias("dias"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    tx = table(spark, d, "insider_transactions")
    people = names.pairs_of(names.name_variants(tx, "empresa_id", "nombre_insider"), ["empresa_id"], "nombre_insider").withColumn("campo", F.lit("nombre_insider"))
    offices = names.pairs_of(names.title_variants(tx, "cargo"), [], "cargo").withColumn("empresa_id", F.lit(0)).withColumn("campo", F.lit("cargo"))
    cols = [F.col("empresa_id").cast("int").alias("empresa_id"), "campo", "texto_a", "texto_b"]
    return people.select(*cols).unionByName(offices.select(*cols))


def p5_grupos(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the groups of spellings, per field."""
    tx = table(spark, d, "insider_transactions")
    people = names.name_variants(tx, "empresa_id", "nombre_insider").select(F.lit("nombre_insider").alias("campo"), "grupo")
    offices = names.title_variants(tx, "cargo").select(F.lit("cargo").alias("campo"), "grupo")
    return people.unionByName(offices).groupBy("campo", "grupo").agg(F.count(F.lit(1)).alias("grafias")).groupBy("campo", "grafias").agg(F.count(F.lit(1)).alias("grupos"))


def p5_miembros(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with the group it belongs to, per field."""
    tx = table(spark, d, "insider_transactions")
    people = names.name_variants(tx, "empresa_id", "nombre_insider").select(F.lit("nombre_insider").alias("campo"), "empresa_id", F.col("nombre_insider").alias("texto"), "grupo")
    offices = names.title_variants(tx, "cargo").select(F.lit("cargo").alias("campo"), F.lit(0).alias("empresa_id"), F.col("cargo").alias("texto"), "grupo")
    return people.unionByName(offices)


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", tokens.token_count("text").alias("tokens"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "contenedores").select("contenedor", "capacidad_tokens").limit(MOST_KINDS + 1).collect()
    if len(rows) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    caps = {r["contenedor"]: r["capacidad_tokens"] for r in rows}
    return packing.pack(_sizes(spark, d), "doc_id", "tokens", caps)


def p6_cajas(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_llenado(spark: SparkSession, d: str) -> DataFrame:
    return packing.fills(_packed(spark, d))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_sizes(spark, d), "doc_id", "source", "tokens", table(spark, d, "mezclas_objetivo"))


def p7_seleccion(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p7_cuotas(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def _endings(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judge_endings(table(spark, d, "documents"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _endings(spark, d).filter("cortado").select("doc_id")


def p8_fuentes(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates, and how often at a significant length."""
    cut = F.col("cortado").cast("int")
    return _endings(spark, d).groupBy("source").agg(
        F.count(F.lit(1)).alias("documentos"), F.sum(cut).alias("cortados"), F.sum(cut * F.col("limite").cast("int")).alias("en_limite"), F.round(F.avg(cut), 6).alias("tasa")
    )


def p8_riesgos(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the sources: texts without a closed sentence at the end (the events),
    texts at risk, expected events, the logarithm of p and what passed the test."""
    docs = table(spark, d, "documents").filter("text is not null")
    docs = docs.select("source", F.length("text").alias("largo"), (~F.col("text").rlike(r"[.!?][\"'”’»)\]]*\s*$")).alias("abierto"))
    h = truncation.length_hazards(docs, "source", "largo", "abierto")
    return h.select("source", F.col("largo").cast("long").alias("largo"), "docs", F.col("events").alias("abiertos"), "at_risk", F.round("expected", 6).alias("esperados"), F.round(F.log10(F.greatest("p", F.lit(1e-300))), 3).alias("log_p"), F.col("significant").alias("significativo"))


QUERIES = {
    "p3_found": p3_found,
    "p3_casos": p3_casos,
    "p5_found": p5_found,
    "p5_grupos": p5_grupos,
    "p5_miembros": p5_miembros,
    "p6_cajas": p6_cajas,
    "p6_llenado": p6_llenado,
    "p7_seleccion": p7_seleccion,
    "p7_cuotas": p7_cuotas,
    "p8_found": p8_found,
    "p8_fuentes": p8_fuentes,
    "p8_riesgos": p8_riesgos,
}

_NEAR = """
WITH cases AS (
  SELECT v.caso_id, v.fecha_deteccion AS f, coalesce(v.empresa_id, e.id) AS empresa_id
  FROM validadas_historicas v
  LEFT JOIN (SELECT ticker, min(id) AS id FROM empresas WHERE ticker IS NOT NULL GROUP BY ticker) e
    ON v.empresa_id IS NULL AND v.ticker = e.ticker),
near AS (
  SELECT c.caso_id, m.id, abs(m.fecha_fin - c.f) AS dias,
    row_number() OVER (PARTITION BY c.caso_id ORDER BY abs(m.fecha_fin - c.f), m.fecha_fin, m.id) AS rn
  FROM cases c JOIN metricas_trimestrales m ON m.empresa_id = c.empresa_id AND abs(m.fecha_fin - c.f) <= 50)
"""

SQL = {
    "p3_found": _NEAR + "SELECT caso_id, id AS metrica_id FROM near WHERE rn = 1",
    "p3_casos": _NEAR + "SELECT c.caso_id, c.empresa_id, n.id AS metrica_id, CAST(n.dias AS INTEGER) AS dias FROM cases c LEFT JOIN near n ON n.caso_id = c.caso_id AND n.rn = 1",
    "p8_riesgos": r"""
WITH n AS (SELECT source, CAST(length(text) AS BIGINT) AS largo, count(*) AS docs, count(*) FILTER (WHERE NOT regexp_matches(text, '[.!?]["''”’»)\]]*\s*$')) AS ev FROM documents WHERE text IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(docs) OVER (PARTITION BY source ORDER BY largo DESC ROWS UNBOUNDED PRECEDING) AS at_risk FROM n),
e AS (SELECT *, (sum(ev) OVER w - ev + 0.5) / 120.0 * at_risk / avg(at_risk) OVER w AS m FROM r WINDOW w AS (PARTITION BY source ORDER BY largo RANGE BETWEEN 60 PRECEDING AND 60 FOLLOWING)),
p AS (SELECT *, CASE WHEN ev = 0 THEN 1.0 ELSE least(1.0, list_sum([exp(-m + (ev + i) * ln(m) - lgamma(ev + i + 1)) for i in range(0, 400)])) END AS p FROM (SELECT * REPLACE (CAST(m AS DOUBLE) AS m) FROM e) x),
k AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS total FROM p),
b AS (SELECT max(p) AS cut FROM k WHERE p <= 0.001 * rk / total AND p <= 0.001)
SELECT source, largo, docs, ev AS abiertos, CAST(at_risk AS BIGINT) AS at_risk, round(m, 6) AS esperados, round(log10(greatest(p, 1e-300)), 3) AS log_p, coalesce(p <= cut, FALSE) AND ev >= 3 AS significativo FROM p, b""",
}
