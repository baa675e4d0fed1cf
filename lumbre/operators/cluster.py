"""Clusters: many different members of one entity acting within a few days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_clusters(acts: DataFrame, entity: str, member: str, day: str, window: int = 60, least: int = 3) -> DataFrame:
    """(entity, found, members_max, anchor, detected) of every entity with acts.

    For each day with an act (the anchor) the different members of the days
    [anchor, anchor + ``window``] are counted, a null member as one more. The
    first anchor with ``least`` of them is the cluster: ``members_max`` is its
    count and ``detected`` the day on which the ``least``-th joined. Without one,
    ``members_max`` is the highest count, or 0 if the entity has fewer acts than
    ``least``.

    A member who acts on day t counts for the anchors from the day after its
    previous act (or t - ``window``) to t, so the counts are running sums of
    starts and ends and no pair of acts is ever built; windows hold one row per
    entity and day. Acts without entity or day are left out; repeated acts count
    once as members, but each as an act.
    """
    a = acts.filter(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(F.col(entity).alias("e"), F.coalesce(F.concat(F.lit("="), F.col(member).cast("string")), F.lit("")).alias("m"), F.unix_date(F.col(day).cast("date")).alias("d"))
    days = a.groupBy("e", "m", "d").agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("d").over(Window.partitionBy("e", "m").orderBy("d"))
    spans = days.withColumn("lo", F.greatest(F.coalesce(before + 1, F.col("d") - window), F.col("d") - window))
    ends = spans.select("e", F.explode(F.array(F.struct(F.col("lo").alias("d"), F.lit(1).alias("v"), F.lit(0).alias("n"), F.lit(0).alias("act")), F.struct((F.col("d") + 1).alias("d"), F.lit(-1).alias("v"), F.lit(0).alias("n"), F.lit(0).alias("act")), F.struct(F.col("d"), F.lit(0).alias("v"), F.col("n").cast("int").alias("n"), F.lit(1).alias("act")))).alias("x"))
    line = ends.groupBy("e", F.col("x.d").alias("d")).agg(F.sum("x.v").alias("v"), F.sum("x.n").alias("n"), F.max("x.act").alias("act"))
    line = line.withColumn("members", F.sum("v").over(Window.partitionBy("e").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))).filter("act = 1")
    hit = F.when(F.col("members") >= least, F.struct("d", "members"))
    best = line.groupBy("e").agg(F.min(hit).alias("hit"), F.max("members").alias("top"), F.sum("n").alias("acts"))
    found = best.filter("hit is not null").select("e", F.col("hit.d").alias("anchor"))
    inside = days.join(found, "e").filter((F.col("d") >= F.col("anchor")) & (F.col("d") <= F.col("anchor") + window))
    joined = inside.groupBy("e", "m").agg(F.min("d").alias("d"))
    nth = joined.withColumn("r", F.row_number().over(Window.partitionBy("e").orderBy("d", "m"))).filter(F.col("r") == least).select("e", F.col("d").alias("detected"))
    enough = F.col("acts") >= least
    return best.join(nth, "e", "left").select(
        F.col("e").alias(entity),
        (F.col("hit").isNotNull() & enough).alias("found"),
        F.when(enough, F.coalesce("hit.members", "top")).otherwise(0).cast("int").alias("members_max"),
        F.when(enough, F.date_from_unix_date("hit.d")).alias("anchor"),
        F.when(enough, F.date_from_unix_date("detected")).alias("detected"),
    )


def within_window(acts: DataFrame, clusters: DataFrame, entity: str, day: str, window: int) -> DataFrame:
    """Acts of the ``window`` days up to the detection of their entity's cluster; all
    acts of an entity without one."""
    c = clusters.select(entity, F.col("detected").alias("__det"))
    j = acts.join(c, entity)
    inside = (F.col(day) >= F.date_sub("__det", window)) & (F.col(day) <= F.col("__det"))
    return j.filter(F.col("__det").isNull() | inside).drop("__det")


def any_in_window(acts: DataFrame, clusters: DataFrame, entity: str, day: str, window: int, hit: Column, name: str) -> DataFrame:
    """(entity, ``name``) of every entity with acts: whether ``hit`` holds for an act of
    the ``window`` days up to the detection of its cluster; false without a cluster."""
    j = acts.join(clusters.select(entity, F.col("detected").alias("__det")), entity)
    inside = F.col(day).between(F.date_sub("__det", window), F.col("__det"))
    return j.groupBy(entity).agg(F.bool_or(F.coalesce(inside & hit, F.lit(False))).alias(name))


def mentions(title: str | Column, words: tuple[str, ...], without: tuple[str, ...] = (), without_pattern: str = "") -> Column:
    """Whether a title holds one of ``words`` once the phrases ``without`` are taken out."""
    t = F.upper(F.col(title) if isinstance(title, str) else title)
    for w in without:
        t = F.replace(t, F.lit(w), F.lit(""))
    if without_pattern:
        t = F.regexp_replace(t, without_pattern, "")
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(t, F.lit(w))
    return F.coalesce(hit, F.lit(False))
