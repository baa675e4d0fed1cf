"""Pairing of records with the nearest record in time of the same entity."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import left_join

#: Rows of both sides for which there is one Arrow group.
GROUP_ROWS = 50_000

_SQL = """
WITH b AS (SELECT l.e, l.b, l.d, r.d AS rd, r.id FROM l ASOF JOIN r ON l.e = r.e AND l.b = r.b AND l.d >= r.d),
     f AS (SELECT l.e, l.b, l.d, r.d AS rd, r.id FROM l ASOF JOIN r ON l.e = r.e AND l.b = r.b AND l.d <= r.d),
     c AS (SELECT * FROM b UNION ALL SELECT * FROM f)
SELECT e, d, arg_min(id, (abs(d - rd), rd)) AS id, min(abs(d - rd)) AS dist
FROM c WHERE abs(d - rd) <= {tol} GROUP BY e, d
"""

_OUT = pa.schema([("e", pa.int64()), ("d", pa.int32()), ("id", pa.int64()), ("dist", pa.int32())])


def _pair(tolerance: int):
    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _OUT.empty_table()
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        try:
            con.register("l", left)
            con.register("r", right)
            rel = con.sql(_SQL.format(tol=int(tolerance)))
            fetch = getattr(rel, "to_arrow_table", None) or rel.arrow  # by DuckDB's version
            return fetch().cast(_OUT)
        finally:
            con.close()

    return pair


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    left_entity: str,
    left_date: str,
    right_entity: str,
    right_date: str,
    right_id: str,
    tolerance: int,
    block_days: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """``left`` with ``match_id`` and ``match_days``: the nearest row of ``right`` of
    the same entity at most ``tolerance`` days away, before or after.

    Of two equally near dates the earlier wins, of several rows of a date the
    lowest id. Both sides are first reduced to one row per entity and day, then
    hashed by entity and time block into Arrow groups (as many as the rows need, see
    ``GROUP_ROWS``), in each of which DuckDB
    joins backward and forward. A right row goes to every block within the
    tolerance, so the blocks of a hot entity are matched apart from each other
    and none holds more than its days.

    All left rows stay, with nulls where nothing is near or the entity or date is
    null; repeated left rows each get the match; right rows without entity, date
    or id are never a match. Dates must be of type date, entities and ids
    integers. An empty side gives no matches. Other columns may have any names.
    """
    for df, c in ((left, left_date), (right, right_date)):
        if not isinstance(df.schema[c].dataType, T.DateType):
            raise TypeError(f"{c} must be a date")
    spark = left.sparkSession
    width = block_days or max(4 * tolerance, 1)
    n = buckets or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((left.count() + right.count()) / GROUP_ROWS))
    lk = left.filter(F.col(left_entity).isNotNull() & F.col(left_date).isNotNull()).select(F.col(left_entity).cast("long").alias("e"), F.unix_date(left_date).alias("d")).distinct()
    lk = lk.withColumn("b", F.floor(F.col("d") / width).cast("int"))
    rk = right.filter(F.col(right_entity).isNotNull() & F.col(right_date).isNotNull() & F.col(right_id).isNotNull())
    rk = rk.groupBy(F.col(right_entity).cast("long").alias("e"), F.unix_date(right_date).alias("d")).agg(F.min(F.col(right_id).cast("long")).alias("id"))
    span = F.sequence(F.floor((F.col("d") - tolerance) / width).cast("int"), F.floor((F.col("d") + tolerance) / width).cast("int"))
    rk = rk.withColumn("b", F.explode(span))
    bucket = F.pmod(F.xxhash64("e", "b"), F.lit(n)).cast("int").alias("g")
    got = lk.withColumn("g", bucket).groupBy("g").cogroup(rk.withColumn("g", bucket).groupBy("g")).applyInArrow(_pair(tolerance), "e long, d int, id long, dist int")
    got = got.select(F.col("e").alias("__e"), F.col("d").alias("__d"), F.col("id").alias("match_id"), F.col("dist").alias("match_days"))
    keyed = left.withColumn("__e", F.col(left_entity).cast("long")).withColumn("__d", F.unix_date(left_date))
    return left_join(keyed, got, ["__e", "__d"]).drop("__e", "__d")
