"""Keyed versions: keep-latest, insert-if-absent and column-preserving upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the greatest by ``order``.

    A maximum of structs instead of a window, so versions collapse before the
    shuffle and no task sorts a hot key. A null is a key value of its own here;
    null order values come before all others."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[F.col(f"`{c}`") for c in rest]).alias("r")))
    got = df.groupBy(*keys).agg(pick.alias("__m"))
    return got.select(*keys, *[F.col(f"__m.r.`{c}`").alias(c) for c in rest]).select(*df.columns)


def insert_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` and those rows of ``new`` whose key it lacks; of several new rows
    of a key one stays. Running it twice adds nothing; null keys are never equal
    and always inserted."""
    fresh = new.join(target.select(*keys).distinct(), keys, "left_anti")
    return target.unionByName(latest(fresh, keys, [F.struct(*[F.col(c) for c in new.columns if c not in keys])]))


def upsert(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column], update: list[str] | None = None) -> DataFrame:
    """``target`` with the columns ``update`` (all but the keys by default) replaced
    from the latest new row of a key, and new keys appended; columns outside
    ``update`` keep what the target has. Idempotent; keys must not be null in
    ``target`` twice."""
    cols = [c for c in target.columns if c not in keys]
    update = cols if update is None else update
    last = latest(new, keys, order)
    src = last.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in cols], F.lit(True).alias("__hit"))
    joined = target.withColumn("__old", F.lit(True)).join(src, keys, "full_outer")
    take = lambda c: F.when(F.col("__hit") & (F.col("__old").isNull() | F.lit(c in update)), F.col(f"__n_{c}")).otherwise(F.col(c))
    return joined.select(*keys, *[take(c).alias(c) for c in cols]).select(*target.columns)


def overwrite(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """``target`` with ``columns`` replaced, nulls too, from the latest new row of a key; no
    row is added, and rows without a new one stay as they are. Idempotent."""
    last = latest(new, keys, order).select(*keys, *[F.col(c).alias(f"__n_{c}") for c in columns], F.lit(True).alias("__hit"))
    j = target.join(last, keys, "left")
    return j.select(*[F.when(F.col("__hit"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def replace_group(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``target`` without the rows of the groups in ``new``, and the rows of ``new``: delete
    and insert per group. A group that ``new`` lacks stays; rows with a null key stay."""
    return target.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*target.columns))


def mark(target: DataFrame, which: DataFrame, key: str, only: Column, **values: Column) -> DataFrame:
    """``target`` with ``values`` set in the rows whose key is in ``which`` and for which
    ``only`` holds; a second run changes nothing if ``only`` then no longer holds."""
    j = target.join(which.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    hit = F.coalesce(F.col("__hit") & only, F.lit(False))
    return j.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])
