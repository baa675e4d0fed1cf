"""Declared rules of the tables and what violates them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths and domains the tables declare.
RULES: dict[str, dict[str, str]] = {
    "empresas": {"ticker_largo": "length(ticker) <= 10", "bolsa_largo": "length(bolsa) <= 20", "cik_formato": "cik rlike '^[0-9]{10}$'"},
    "metricas_trimestrales": {"trimestre_dominio": "trimestre between 1 and 4", "periodo_orden": "fecha_inicio < fecha_fin", "publicada_despues": "fecha_filing >= fecha_fin"},
    "insider_transactions": {"cargo_largo": "length(cargo) <= 100", "ad_dominio": "adquirido_o_dispuesto in ('A', 'D')", "importe_positivo": "importe_total >= 0"},
}


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(regla, incumplen, nulos): rows for which a rule is false, and for which it
    cannot be told because of a null. One pass whatever the number of rules."""
    aggs: list[Column] = []
    for name, rule in rules.items():
        aggs += [F.count_if(~F.expr(rule)).alias(f"{name}__v"), F.count_if(F.expr(rule).isNull()).alias(f"{name}__n")]
    one = df.agg(*aggs)
    out = F.array(*[F.struct(F.lit(n).alias("regla"), F.col(f"{n}__v").alias("incumplen"), F.col(f"{n}__n").alias("nulos")) for n in rules])
    return one.select(F.explode(out).alias("x")).select("x.*")


def assert_domain(df: DataFrame, column: str, values: list[str]) -> None:
    """Raise if a non-null value of ``column`` is not one of ``values``."""
    bad = df.filter(~F.col(column).isin(*values)).select(column).limit(1).collect()
    if bad:
        raise ValueError(f"{column} has {bad[0][0]!r}, which is none of {values}")
