"""Filling of fixed-capacity containers: hierarchical residual packing.

Groups of items are packed apart from each other by best fit; bins that are
nearly full are final, the others travel on as items of their own and are packed
again with those of neighbouring groups, until one group is left.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, fill of each bin) by best fit in falling order of size.

    Open bins are kept by remaining room, so an item finds the tightest one by
    bisection; equal sizes are taken in the order given."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    fill: list[int] = []
    rooms: list[int] = []  # distinct remaining rooms, ascending
    by_room: dict[int, list[int]] = {}
    for i in order:
        s = int(sizes[i])
        k = bisect_left(rooms, s)
        if k < len(rooms):
            room = rooms[k]
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                del by_room[room], rooms[k]
        else:
            b, room = len(fill), capacity
            fill.append(0)
        fill[b] += s
        out[i] = b
        left = room - s
        if left:
            if left in by_room:
                by_room[left].append(b)
            else:
                by_room[left] = [b]
                insort(rooms, left)
    return out, np.array(fill, np.int64)


def safe_mean(most: int) -> float:
    """Mean of a hashed group whose size stays within ``most`` (five standard deviations)."""
    return max((math.sqrt(6.25 + most) - 2.5) ** 2, 1.0)


def pack(
    items: DataFrame,
    item_id: str,
    size: str,
    capacities: dict[str, int],
    group_items: int = 40_000,
    full: float = 0.995,
    fan_in: int = 8,
    all_open: bool = False,
) -> DataFrame:
    """(contenedor, capacidad, caja, <item_id>, pieza, inicio, tamano, llenado): the
    box of every item, for each named capacity, with the fill of that box.

    Items larger than the capacity are cut into full pieces and a rest; pieces
    count from 0 and ``inicio`` is the place of the first unit. All other items
    stay whole. A full piece is a box of its own from the start. Everything else,
    one row per item and capacity, is hashed by its place in the input, so repeats
    and the kinds of a hot source spread over all groups; a group holds at most
    ``group_items`` rows (their mean is five standard deviations below). Boxes
    filled to ``full`` or more are closed after their round, the others are merged
    ``fan_in`` groups at a time.

    Best fit leaves a group at most one box that is half full or less, and two boxes
    can only merge if one of them is. With G groups left no more than G boxes can
    therefore be taken up by others, and whatever box takes one up may as well be one
    of the G + 1 emptiest of its group: only those travel on, which loses no merge.
    ``all_open`` lets every open box travel on instead.

    Items without id, or with a null, zero or negative size, take no room and get
    no row; repeated ids are items of their own; an empty table gives no rows; a
    capacity must be positive.
    """
    if any(c <= 0 for c in capacities.values()):
        raise ValueError("capacities must be positive")
    kind = items.schema[item_id].dataType.simpleString()
    base = items.filter(F.col(item_id).isNotNull() & (F.col(size) > 0)).select(F.col(item_id).alias("id"), F.col(size).cast("long").alias("size"), F.monotonically_increasing_id().alias("u"))
    base = cut_lineage(base)  # sizes are dear to compute and needed for the number of groups; fixes u
    count = base.count()
    groups = max(1, math.ceil(count / safe_mean(group_items))) if count > group_items else 1
    caps = F.array(*[F.struct(F.lit(n).alias("contenedor"), F.lit(int(c)).cast("long").alias("cap")) for n, c in sorted(capacities.items())])
    each = base.select("id", "u", "size", F.explode(caps).alias("c")).select("id", "u", "size", "c.contenedor", "c.cap").withColumn("whole", F.floor(F.col("size") / F.col("cap")))
    # full pieces: a box each, named apart from all others
    fulls = each.filter("whole > 0").select("contenedor", "cap", "id", F.col("cap").alias("tamano"), "u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("pieza"))
    fulls = fulls.select("contenedor", "cap", F.concat_ws("-", F.lit("p"), "u", "pieza").alias("caja"), "id", "pieza", (F.col("pieza") * F.col("cap")).alias("inicio"), "tamano", F.col("tamano").alias("llenado"))
    rest = each.withColumn("inicio", F.col("whole") * F.col("cap")).withColumn("tamano", F.col("size") - F.col("inicio")).filter("tamano > 0")
    pieces = rest.select("id", F.pmod(F.xxhash64("u"), F.lit(groups)).cast("int").alias("g"), "contenedor", "cap", F.col("whole").alias("pieza"), "inicio", "tamano", "u")

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u", kind="stable").drop(columns="u").reset_index(drop=True)
        cap = int(pdf["cap"].iloc[0])
        bins, fill = best_fit(pdf["tamano"].to_numpy(), cap)
        pdf["bin"] = (np.int64(pdf["g"].iloc[0]) << 32) | bins
        pdf["fill"] = fill[bins]
        return pdf

    placed = pieces.groupBy("contenedor", "g").applyInPandas(local, f"id {kind}, g int, contenedor string, cap long, pieza long, inicio long, tamano long, bin long, fill long")
    placed = cut_lineage(placed)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable").reset_index(drop=True)
        bins, fill = best_fit(pdf["fill"].to_numpy(), int(pdf["cap"].iloc[0]))
        heads = pdf.groupby(bins)["bin"].min()
        pdf["to"] = heads.loc[bins].to_numpy()
        pdf["to_fill"] = fill[bins]
        return pdf

    emptiest = Window.partitionBy("contenedor", "g").orderBy("fill", "bin")

    def still_open(boxes: DataFrame) -> DataFrame:
        boxes = boxes.filter(F.col("fill") < F.col("cap") * full).distinct()
        if all_open:
            return boxes
        most = groups + 1
        return boxes.withColumn("r", F.row_number().over(emptiest)).filter(F.col("r") <= most).drop("r")

    open_ = still_open(placed.select("contenedor", "cap", "g", "bin", "fill"))
    moved = open_.select("contenedor", "bin", F.col("bin").alias("to"), F.col("fill").alias("to_fill"))
    while groups > 1:
        groups = math.ceil(groups / fan_in)
        step = open_.withColumn("g", F.floor(F.col("g") / fan_in).cast("int")).groupBy("contenedor", "g").applyInPandas(merge, "contenedor string, cap long, g int, bin long, fill long, to long, to_fill long")
        step = cut_lineage(step)
        jump = step.select("contenedor", F.col("bin").alias("to"), F.col("to").alias("to2"), F.col("to_fill").alias("fill2"))
        moved = moved.join(jump, ["contenedor", "to"], "left").select("contenedor", "bin", F.coalesce("to2", "to").alias("to"), F.coalesce("fill2", "to_fill").alias("to_fill"))
        open_ = still_open(step.select("contenedor", "cap", "g", F.col("to").alias("bin"), F.col("to_fill").alias("fill")))
    out = placed.join(moved, ["contenedor", "bin"], "left").select(
        "contenedor", "cap", F.concat(F.lit("c-"), F.coalesce("to", "bin").cast("string")).alias("caja"), "id", "pieza", "inicio", "tamano", F.coalesce("to_fill", "fill").alias("llenado")
    )
    out = out.unionByName(fulls)
    return out.select("contenedor", F.col("cap").alias("capacidad"), "caja", F.col("id").alias(item_id), "pieza", "inicio", "tamano", "llenado")


def fills(packed: DataFrame) -> DataFrame:
    """(contenedor, capacidad, cajas, minimo, tokens, llenado): boxes used, the fewest
    that could hold the total, and the share of room used."""
    boxes = packed.groupBy("contenedor", "capacidad", "caja").agg(F.sum("tamano").alias("t"))
    s = boxes.groupBy("contenedor", "capacidad").agg(F.count(F.lit(1)).alias("cajas"), F.sum("t").alias("tokens"))
    return s.select("contenedor", "capacidad", "cajas", F.ceil(F.col("tokens") / F.col("capacidad")).alias("minimo"), "tokens", F.round(F.col("tokens") / (F.col("cajas") * F.col("capacidad")), 4).alias("llenado"))
