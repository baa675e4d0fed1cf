"""Ordered analytics on short series, top-k, medians and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def last_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first ``k`` rows of each group by ``order``, with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def half_means(series: Column) -> tuple[Column, Column]:
    """Means of the older and the newer half of an array (the newer has the odd one)."""
    h = F.floor(F.size(series) / 2).cast("int")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return mean(F.slice(series, 1, h)), mean(F.slice(series, h + 1, F.greatest(F.size(series) - h, F.lit(1))))


def ordered(value: str, position: str, k: int) -> Column:
    """Aggregate: the ``value`` of the last ``k`` positions, in order; nulls left out."""
    all_ = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).cast("double").alias("v")))))
    return F.slice(all_, F.greatest(F.size(all_) - k + 1, F.lit(1)), k)


def growth_halves(df: DataFrame, entity: str, position: str, value: str, k: int = 8) -> DataFrame:
    """(entity, tasas, media_antigua, media_reciente): growth between adjacent quarters
    of the last ``k`` positive values, with means of both halves.

    Values that are null, zero or negative are dropped before adjacency is tested.
    Fewer than four values or three rates give null means. Series are one row per
    quarter, so an entity's array is bounded by the calendar."""
    s = df.filter(F.col(value) > 0).groupBy(entity).agg(ordered(value, position, k).alias("s"))
    steps = F.filter(F.transform(F.sequence(F.lit(2), F.greatest(F.size("s"), F.lit(2))), lambda i: F.when(i <= F.size("s"), F.struct(F.element_at("s", i - 1).alias("a"), F.element_at("s", F.least(i, F.size("s"))).alias("b")))), lambda x: x.isNotNull() & (x["b"]["p"] - x["a"]["p"] == 1))
    s = s.filter(F.size("s") >= 4).withColumn("g", F.transform(steps, lambda x: (x["b"]["v"] - x["a"]["v"]) / x["a"]["v"]))
    old, new = half_means(F.col("g"))
    enough = F.size("g") >= 3
    return s.select(entity, F.size("g").alias("tasas"), F.when(enough, old).alias("media_antigua"), F.when(enough, new).alias("media_reciente"))


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, bajo, alto): the elements (n - 1) div 2 and n div 2, from 0, of the
    sorted values of each group; their mean is the median, ``alto`` the upper one.

    Exact, and no task holds a group: values are counted, a histogram of relative
    width 1/64 finds the bin of either element, and only the distinct values of
    that bin are ranked. Nulls and NaN are left out, and so are groups without
    values; null group keys are one group."""
    x = F.col("__v").cast("double")
    size = F.floor(F.log2(F.abs(x)) * 64).cast("long")
    top = 1 << 20
    bin_ = F.when(x > 0, top + size).when(x < 0, -top - size).otherwise(0)
    v = df.select(*by, F.col(value).alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan(F.col("__v").cast("double")))
    v = v.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("c")).withColumn("b", bin_)
    h = v.groupBy(*by, "b").agg(F.sum("c").alias("hc"))
    w = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("before", F.sum("hc").over(w) - F.col("hc")).withColumn("n", F.sum("hc").over(Window.partitionBy(*by)))
    h = h.withColumn("lo", F.expr("(n - 1) div 2")).withColumn("hi", F.expr("n div 2"))
    h = h.filter("(lo >= before and lo < before + hc) or (hi >= before and hi < before + hc)")
    right = h.select(*[F.col(k).alias(f"__{k}") for k in by], F.col("b").alias("__b"), "before", "n", "lo", "hi")
    on = F.col("b") == F.col("__b")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    r = Window.partitionBy(*by, "b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    j = v.join(right, on).withColumn("upto", F.col("before") + F.sum("c").over(r))
    at = lambda k: F.max(F.when((F.col(k) < F.col("upto")) & (F.col(k) >= F.col("upto") - F.col("c")), F.col("__v")))
    return j.groupBy(*by).agg(F.max("n").alias("n"), at("lo").alias("bajo"), at("hi").alias("alto"))


def systematic_sample(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Rows floor(i * size / n), i = 0 .. n-1, in ``order``: a sampling operator.

    Only the order columns are sorted by range and kept, with their place in the
    partition; counts per partition (one row each) give the places overall, and the
    few picked ones meet the table again. ``order`` must be total and free of nulls;
    an empty table gives no rows."""
    spark = df.sparkSession
    names = [f"__o{i}" for i in range(len(order))]
    keys = df.select(*[c.alias(x) for c, x in zip(order, names, strict=True)]).orderBy(*names)
    keys = cut_lineage(keys.select(*names, F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__i")))
    sizes = keys.groupBy("__p").agg(F.count(F.lit(1)).alias("c"))
    line = Window.orderBy("__p")  # one row per partition
    starts = sizes.select("__p", F.coalesce(F.sum("c").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    total = keys.count()
    picks = spark.range(n).select(F.floor(F.col("id") * F.lit(total) / n).cast("long").alias("__pos")).distinct()
    placed = keys.join(starts, "__p").select(*names, (F.col("start") + F.col("__i")).alias("__pos")).join(picks, "__pos").drop("__pos")
    wide = df.select("*", *[c.alias(x) for c, x in zip(order, names, strict=True)])
    return wide.join(placed, names).select(*df.columns)


def missing_since(left: DataFrame, right: DataFrame, key: str, right_key: str, right_day: str, day: Column) -> DataFrame:
    """Rows of ``left`` without a right row on or after ``day``."""
    recent = right.filter(F.col(right_day) >= day).select(F.col(right_key).alias("__k")).distinct()
    return left.join(recent, left[key] == F.col("__k"), "left_anti")


def pending_work(candidates: DataFrame, done: DataFrame, news: list[DataFrame], key: str, kinds: list[str], kind: str, when: str) -> DataFrame:
    """(key, kind) pairs that were never done or have something newer than when they were.

    ``done`` has (key, kind, when), each of ``news`` (key, when). News are reduced
    to their latest time per key first, so the OR over several of them is one
    filter after left joins."""
    last = done.groupBy(key, kind).agg(F.max(when).alias("__done"))
    pairs = candidates.withColumn(kind, F.explode(F.array(*[F.lit(k) for k in kinds]))).join(last, [key, kind], "left")
    fresh = F.col("__done").isNull()
    for i, n in enumerate(news):
        pairs = pairs.join(n.groupBy(key).agg(F.max(when).alias(f"__n{i}")), key, "left")
        fresh = fresh | F.coalesce(F.col(f"__n{i}") > F.col("__done"), F.lit(False))
    return pairs.filter(fresh).drop("__done", *[f"__n{i}" for i in range(len(news))])
