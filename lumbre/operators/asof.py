"""As-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import left_join


def asof(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_day: str,
    right_day: str,
    values: list[str],
    forward: bool = False,
    tolerance: int | None = None,
    tie: list[Column] | None = None,
    prefix: str = "",
    block: int = 64,
) -> DataFrame:
    """``left`` with the ``values`` of the right row of the same key that is last on or
    before its day (``forward``: first on or after), at most ``tolerance`` days away.

    Of several right rows of a day the greatest by ``tie`` counts (by the values
    themselves where None). Days are dates or integers. Both sides are reduced to
    one row per key and day and laid on one line, cut into blocks of ``block``
    days: inside a block the last right row is carried on, and what a block passes
    to the next comes from a line of one row per block. So no task sorts a whole
    hot key. Left rows all stay; null keys or days get nulls, as do empty sides.
    """
    num = lambda df, c: F.unix_date(c) if dict(df.dtypes)[c] == "date" else F.col(c).cast("int")
    sign = -1 if forward else 1
    order = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(tie or [F.col(v) for v in values])], *[F.col(v).alias(f"v_{v}") for v in values])
    r = right.filter(F.col(key).isNotNull()).select(F.col(key).alias("__k"), (num(right, right_day) * sign).alias("__d"), order.alias("o")).filter("__d is not null")
    r = r.groupBy("__k", "__d").agg(F.max("o").alias("o"))
    r = r.select("__k", "__d", F.struct(F.col("__d").alias("rd"), *[F.col(f"o.v_{v}").alias(v) for v in values]).alias("r"), F.lit(0).alias("side"))
    none = F.lit(None).cast(r.schema["r"].dataType)
    ask = left.select(F.col(key).alias("__k"), (num(left, left_day) * sign).alias("__d")).filter("__k is not null and __d is not null").distinct()
    line = r.unionByName(ask.select("__k", "__d", none.alias("r"), F.lit(1).alias("side"))).withColumn("b", F.floor(F.col("__d") / block).cast("int"))
    here = F.last("r", ignorenulls=True).over(Window.partitionBy("__k", "b").orderBy("__d", "side").rowsBetween(Window.unboundedPreceding, 0))
    line = line.withColumn("here", here).filter("side = 1")
    blocks = r.withColumn("b", F.floor(F.col("__d") / block).cast("int")).groupBy("__k", "b").agg(F.max("r").alias("last"))
    need = line.select("__k", "b").distinct().withColumn("last", none)
    carry = F.last("last", ignorenulls=True).over(Window.partitionBy("__k").orderBy("b", "asked").rowsBetween(Window.unboundedPreceding, -1))
    passed = blocks.withColumn("asked", F.lit(1)).unionByName(need.withColumn("asked", F.lit(0))).withColumn("from_before", carry).filter("asked = 0").select("__k", "b", "from_before")
    got = line.join(passed, ["__k", "b"], "left").select("__k", "__d", F.coalesce("here", "from_before").alias("r"))
    if tolerance is not None:
        got = got.filter(F.col("__d") - F.col("r.rd") <= tolerance)
    got = got.select("__k", "__d", *[F.col(f"r.{v}").alias(prefix + v) for v in values])
    keyed = left.withColumn("__k", F.col(key)).withColumn("__d", num(left, left_day) * sign)
    return left_join(keyed, got, ["__k", "__d"]).drop("__k", "__d")


def lookups(asked: DataFrame, right: DataFrame, key: str | None, asked_day: str, right_day: str, value: str, frames: dict[str, tuple[str, int | None, int | None]]) -> DataFrame:
    """(key, day, <name>...) of every different key and day asked, with several look-ups in
    one pass. ``frames`` names each as (pick, from, to): ``first`` or ``last`` value, or
    ``max``, ``min`` or ``count``, among the days [day + from, day + to]; None is no bound.

    Right rows of a day count once, by their greatest value. A window holds one row per
    key and day of either side, so the calendar bounds what a hot key brings to a task;
    no pairs are built. Null keys, days and values take no part; without a key (None)
    there is one line of days."""
    k = [key] if key else []
    r = right.filter(F.col(value).isNotNull() & F.col(right_day).isNotNull()).groupBy(*k, F.unix_date(right_day).alias("__d")).agg(F.max(value).alias("v")).withColumn("ask", F.lit(False))
    q = asked.filter(F.col(asked_day).isNotNull()).select(*k, F.unix_date(asked_day).alias("__d")).distinct().withColumn("v", F.lit(None).cast(r.schema["v"].dataType)).withColumn("ask", F.lit(True))
    line = r.unionByName(q)
    if key:
        line = line.filter(F.col(key).isNotNull())
    w = Window.partitionBy(*k or [F.lit(1)]).orderBy("__d")
    edge = lambda n, none: none if n is None else n
    picks = {"first": lambda: F.first("v", ignorenulls=True), "last": lambda: F.last("v", ignorenulls=True), "max": lambda: F.max("v"), "min": lambda: F.min("v"), "count": lambda: F.count("v")}
    out = [picks[p]().over(w.rangeBetween(edge(a, Window.unboundedPreceding), edge(b, Window.unboundedFollowing))).alias(n) for n, (p, a, b) in frames.items()]
    return line.select(*k, "__d", "ask", *out).filter("ask").select(*k, F.date_from_unix_date("__d").alias(asked_day), *frames)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, before: int, after: int, right_values: list[str], prefix: str = "", width: int | None = None) -> DataFrame:
    """Inner join on the key with right days in [left day - ``before``, left day + ``after``].

    The left interval is cut into the bins it touches, so the join is an equi-join
    on key and bin and a hot key spreads over its bins. Null keys or days never
    match; repeats multiply as in any join."""
    width = width or max(before + after, 1)
    le = left.filter(F.col(key).isNotNull() & F.col(left_day).isNotNull()).withColumn("__l", F.unix_date(left_day))
    le = le.withColumn("__b", F.explode(F.sequence(F.floor((F.col("__l") - before) / width), F.floor((F.col("__l") + after) / width))))
    ri = right.select(F.col(key).alias("__rk"), F.unix_date(right_day).alias("__r"), *[F.col(v).alias(prefix + v) for v in right_values]).filter("__r is not null")
    ri = ri.withColumn("__rb", F.floor(F.col("__r") / width))
    on = (F.col(key) == F.col("__rk")) & (F.col("__b") == F.col("__rb")) & F.col("__r").between(F.col("__l") - before, F.col("__l") + after)
    return le.join(ri, on).drop("__l", "__b", "__rk", "__r", "__rb")
