"""Attributes as they were known at the time of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, left_join


def _dated(df: DataFrame, col: str) -> None:
    if not isinstance(df.schema[col].dataType, T.DateType):
        raise TypeError(f"{col} must be a date: the size of a task is bounded by the days of the calendar")


def known_versions(attrs: DataFrame, entity: str, known_from: str, rank: list[Column], row_id: str) -> DataFrame:
    """Narrow rows (entity, known_from, r): the best row per entity and day, where
    ``rank`` orders the rows an entity has shown so far and ``row_id`` breaks ties
    in favour of the lowest."""
    r = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], (-F.col(row_id)).alias("neg_id"))
    return (
        attrs.filter(F.col(entity).isNotNull() & F.col(known_from).isNotNull())
        .groupBy(F.col(entity).alias("__e"), F.col(known_from).alias("__d"))
        .agg(F.max(r).alias("r"))
    )


def as_known(
    events: DataFrame,
    attrs: DataFrame,
    event_entity: str,
    event_date: str,
    attr_entity: str,
    known_from: str,
    rank: list[Column],
    row_id: str,
    keep: list[str],
    prefix: str = "attr_",
) -> DataFrame:
    """Every event with the attributes valid at its date.

    Of the attribute rows that were known on or before the event's date the one
    with the greatest ``rank``, then the lowest ``row_id``, is valid. The timeline
    of an entity holds only narrow rows: one per day on which something became
    known and one per day with events. A running maximum over it changes when a
    better row becomes known; the cumulative count of changes is the version
    number, and events and wide attributes meet in an equi-join on entity and
    version. Pre-aggregation by day bounds the window of a hot entity by the
    calendar, so both dates must be of type date.

    Events keep all their columns and rows; ``keep`` comes from the attributes
    as ``prefix``-named columns, so equal names do not clash. Events without
    entity or date, or before anything was known, get nulls; attribute rows
    without entity or ``known_from`` are never valid. Repeated events each get
    their row, repeated attribute rows count once (the lowest id).
    """
    _dated(events, event_date)
    _dated(attrs, known_from)
    known = known_versions(attrs, attr_entity, known_from, rank, row_id)
    none = F.lit(None).cast(known.schema["r"].dataType)
    asked = (
        events.filter(F.col(event_entity).isNotNull() & F.col(event_date).isNotNull())
        .select(F.col(event_entity).alias("__e"), F.col(event_date).alias("__d"))
        .distinct()
        .select("__e", "__d", none.alias("r"), F.lit(1).alias("kind"))
    )
    line = known.select("__e", "__d", "r", F.lit(0).alias("kind")).unionByName(asked)
    w = Window.partitionBy("__e").orderBy("__d", "kind")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumn("best", F.max("r").over(run))
    line = line.withColumn("changed", (F.col("kind") == 0) & ~F.lag("best").over(w).eqNullSafe(F.col("best")))
    line = line.withColumn("version", F.sum(F.col("changed").cast("int")).over(run))
    line = cut_lineage(line.filter("kind = 1 or changed").select("__e", "__d", "kind", "changed", "version", "best"))  # read for the events and for the versions
    timed = line.filter("kind = 1").select("__e", "__d", F.col("version").alias("__v"))
    versions = line.filter("changed").select("__e", F.col("version").alias("__v"), (-F.col("best.neg_id")).alias("__id"))
    wide = attrs.select(F.col(row_id).alias("__id"), F.col(attr_entity).alias("__e"), *[F.col(k).alias(prefix + k) for k in keep])
    wide = versions.join(wide, ["__e", "__id"]).drop("__id")
    ev = events.withColumn("__e", F.col(event_entity)).withColumn("__d", F.col(event_date))
    return left_join(left_join(ev, timed, ["__e", "__d"]), wide, ["__e", "__v"]).drop("__e", "__d", "__v")


def with_entity(cases: DataFrame, entities: DataFrame, entity: str = "empresa_id", ticker: str = "ticker", entity_id: str = "id", entity_ticker: str = "ticker") -> DataFrame:
    """Cases with the entity of their ticker where the entity is null.

    Only the rows that need it are joined, on the lower id if a ticker is not
    unique; a ticker that is null or unknown leaves the entity null."""
    names = entities.filter(F.col(entity_ticker).isNotNull()).groupBy(F.col(entity_ticker).alias("__t")).agg(F.min(entity_id).alias("__by_ticker"))
    needs = F.when(F.col(entity).isNull(), F.col(ticker))
    return (
        cases.withColumn("__t", needs)
        .join(names, "__t", "left")
        .withColumn(entity, F.coalesce(F.col(entity), F.col("__by_ticker")))
        .drop("__t", "__by_ticker")
    )
