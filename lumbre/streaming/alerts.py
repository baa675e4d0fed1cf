"""Streaming counterparts: first clusters and late-tolerant windowed totals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def cluster_alerts(acts: DataFrame, entity: str, member: str, day: str, window: int = 60, least: int = 3) -> DataFrame:
    """Stream of (entity, detected, members): one row whenever the days up to an act
    first hold ``least`` different members within ``window`` days.

    The state of an entity is the last day of each member seen in the window, so it
    is bounded by the members of ``window`` days. After an alert an entity is silent
    until its count falls below ``least``. Acts older than the newest by more than
    ``window`` days are ignored; null members count as one more, acts without
    entity or day are left out."""
    kind = acts.schema[entity].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, newest, loud = {}, -(10**9), False
        if state.exists:
            names, days, newest, loud = state.get
            seen = dict(zip(names, days, strict=True))
        out = []
        rows = pd.concat(list(frames)).sort_values(["d", "m"], kind="stable")
        for m, d in zip(rows["m"], rows["d"], strict=True):
            d = int(d)
            if d < newest - window:
                continue
            newest = max(newest, d)
            seen[m] = max(seen.get(m, d), d)
            seen = {k: v for k, v in seen.items() if v >= newest - window}
            if len(seen) >= least and not loud:
                out.append((key[0], newest, len(seen)))
            loud = len(seen) >= least
        state.update((list(seen), list(seen.values()), newest, loud))
        yield pd.DataFrame(out, columns=["e", "d", "members"])

    flat = acts.filter(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(
        F.col(entity).alias("e"), F.coalesce(F.concat(F.lit("="), F.col(member).cast("string")), F.lit("")).alias("m"), F.unix_date(F.col(day).cast("date")).alias("d")
    )
    got = flat.groupBy("e").applyInPandasWithState(step, f"e {kind}, d int, members int", "names array<string>, days array<int>, newest int, loud boolean", "append", GroupStateTimeout.NoTimeout)
    return got.select(F.col("e").alias(entity), F.date_from_unix_date("d").alias("detected"), "members")


def windowed_totals(events: DataFrame, ts: str, keys: list[str], value: str, length: str, slide: str, late: str) -> DataFrame:
    """Totals per sliding event-time window; rows later than ``late`` are dropped by the watermark."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, length, slide), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select("window.start", "window.end", *keys, "n", "total")
