"""Parameters from a key/value table."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    cluster_window_days: int = 60
    cluster_members: int = 3
    last_quarters: int = 8
    nearest_tolerance_days: int = 50
    implausible_risk: float = 8e-3
    cutoff_date: str = ""

    @classmethod
    def read(cls, table: DataFrame, key: str = "clave", value: str = "valor") -> Config:
        """Known keys of the table over the defaults; others are ignored, and a value
        that does not fit its type raises. Rows of a key that repeat one value count
        once, different values of a key raise; null values leave the default."""
        known = {f.name: f.type for f in fields(cls)}
        found = table.filter(F.col(key).isin(*known) & F.col(value).isNotNull()).groupBy(F.col(key).alias("k"))
        rows = found.agg(F.min(F.col(value).cast("string")).alias("v"), F.max(F.col(value).cast("string")).alias("w")).collect()  # at most one per known key
        if twice := sorted(r["k"] for r in rows if r["v"] != r["w"]):
            raise ValueError(f"several values of {', '.join(twice)}")
        kinds = {"int": int, "float": float, "str": str}
        return cls(**{r["k"]: kinds[known[r["k"]]](r["v"]) for r in rows})
