"""Writers that leave either the old table or the new one, and entity keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write ``df`` beside ``path`` and then put it in its place; ``df`` may read from
    ``path``. A failed write leaves the old table as it was."""
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(staging)
    spark = df.sparkSession
    jvm = spark._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(path)
    fs = dst.getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{staging}-old")
    had = fs.exists(dst)
    if had and not fs.rename(dst, old):
        raise OSError(f"could not move {path} aside")
    try:
        moved = fs.rename(src, dst)
    except Exception:
        moved = False
    if not moved:
        if had:
            fs.rename(old, dst)
        raise OSError(f"could not move {staging} to {path}; the old table is back in its place")
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def register_entities(known: DataFrame, incoming: DataFrame, natural: str, key: str) -> DataFrame:
    """(natural, key) of all known entities and those that are new; a new key is a
    hash of the natural one, so running it again, or in parallel, gives the same."""
    new = incoming.filter(F.col(natural).isNotNull()).select(natural).distinct().join(known.select(natural), natural, "left_anti")
    return known.select(natural, F.col(key).cast("long").alias(key)).unionByName(new.select(natural, F.xxhash64(natural).alias(key)))


def with_foreign_key(rows: DataFrame, entities: DataFrame, natural: str, key: str) -> DataFrame:
    """``rows`` with the key of their entity; rows of unknown entities are left out."""
    return rows.join(entities.select(natural, key), natural)


def fill_empty(target: DataFrame, source: DataFrame, on: str, column: str) -> DataFrame:
    """``target`` with ``column`` from ``source`` where it is null or empty."""
    s = source.select(on, F.col(column).alias("__new"))
    return target.join(s, on, "left").withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), F.col("__new"))).drop("__new").select(*target.columns)
