"""Case lists in CSV, of either layout, and the CSV sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import flexible_date
from .place import file_place


def read_cases(spark: SparkSession, path: str, ticker: str | None = None) -> DataFrame:
    """(empresa_id, ticker, fecha_deteccion, market_cap, _place) of a case list, _place
    being the row's place in its file.

    A list with ``fecha_cluster`` is one of winners: only rows with a cluster and a
    date are cases. Otherwise rows have ``fecha_deteccion``. Rows without a date
    that can be read are left out."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    raw = raw.select("*", file_place().alias("_place"))
    null = F.lit(None).cast("string")
    col = lambda c: F.col(c) if c in raw.columns else null
    if "fecha_cluster" in raw.columns:
        raw = raw.filter(F.lower(F.trim("tuvo_cluster")).isin("true", "1"))
        day, cap = "fecha_cluster", "cap_minima"
    else:
        day, cap = "fecha_deteccion", "market_cap_historico"
    out = raw.select(col("empresa_id").try_cast("int").alias("empresa_id"), F.trim(col("ticker")).alias("ticker"), flexible_date(col(day)).alias("fecha_deteccion"), col(cap).try_cast("double").alias("market_cap"), "_place")
    out = out.filter("fecha_deteccion is not null")
    return out if ticker is None else out.filter(F.upper("ticker") == ticker.upper())


def distinct_tickers(cases: DataFrame) -> DataFrame:
    """Tickers, each once, in the order in which the list first names them, with the date of
    their first case."""
    first = cases.filter("ticker is not null").groupBy("ticker").agg(F.min("_place").alias("p"), F.min("fecha_deteccion").alias("primera"))
    return first.orderBy("p").drop("p")


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    df.drop("_place").orderBy(*order).write.mode("overwrite").option("header", True).csv(path)
