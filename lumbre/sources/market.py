"""Market snapshots: flat documents with alternative fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SNAPSHOT = (
    "symbol string, currentPrice double, regularMarketPrice double, fiftyTwoWeekLow double, fiftyTwoWeekHigh double, marketCap bigint, averageVolume bigint, exchange string, fullExchangeName string, "
    "sharesShort bigint, shortPercentOfFloat double, dateShortInterest bigint"
)


def position(price: str, low: str, high: str) -> F.Column:
    """Place of a price in its range, not clamped; null for an empty range."""
    span = F.col(high) - F.col(low)
    return F.when(span > 0, F.round((F.col(price) - F.col(low)) / span, 4))


def snapshots(raw: DataFrame) -> DataFrame:
    """One row per symbol with a capitalisation or a price; the first field that is
    there counts."""
    t = raw.select(
        F.col("symbol").alias("ticker"),
        F.col("marketCap").alias("market_cap_usd"),
        F.coalesce("currentPrice", "regularMarketPrice").alias("precio_actual"),
        F.col("fiftyTwoWeekLow").alias("precio_min_52w"),
        F.col("fiftyTwoWeekHigh").alias("precio_max_52w"),
        F.col("averageVolume").alias("volumen_medio_30d"),
        F.coalesce("fullExchangeName", "exchange").alias("bolsa"),
        F.col("sharesShort").alias("acciones_short"),
        F.col("shortPercentOfFloat").alias("pct_float"),
        F.to_date(F.timestamp_seconds("dateShortInterest")).alias("fecha_short"),
    )
    return t.filter("market_cap_usd is not null or precio_actual is not null").withColumn("posicion_52w", position("precio_actual", "precio_min_52w", "precio_max_52w"))
