"""Mixing of sources to target weights by balanced sampling (cube method)."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .packing import safe_mean

_EPS = 1e-9
#: Units of a group that the flight leaves open, so that the landing has a choice.
HOLD = 12
#: Parts into which every source is cut where it meets the plan, so a hot one fills no single task.
SALT = 64


def flight(prob: np.ndarray, size: np.ndarray, seed: int, hold: int = 0) -> np.ndarray:
    """Probabilities after the flight phase, balanced on count and total size.

    Three open units at a time move along the one direction that keeps both the
    sum of probabilities and the expected size, up to the first that reaches 0 or
    1, forward or back with the odds that leave every probability unbiased. At
    most two units stay open, and the last ``hold`` are not touched."""
    p = prob.astype(float).copy()
    rng = random.Random(seed)
    act: list[int] = []
    todo = np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist()
    for i in todo[: max(0, len(todo) - hold)]:
        act.append(i)
        while len(act) == 3:
            a, b, c = act
            ta, tb, tc = float(size[a]), float(size[b]), float(size[c])
            u = (tc - tb, ta - tc, tb - ta)
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = down = math.inf
            for x, v in zip(act, u, strict=True):
                if v > 0:
                    up, down = min(up, (1 - p[x]) / v), min(down, p[x] / v)
                elif v < 0:
                    up, down = min(up, p[x] / -v), min(down, (1 - p[x]) / -v)
            move = up if rng.random() * (up + down) < down else -down
            for x, v in zip(act, u, strict=True):
                p[x] = min(1.0, max(0.0, p[x] + move * v))
            act = [x for x in act if _EPS < p[x] < 1 - _EPS]
    p[p <= _EPS] = 0.0
    p[p >= 1 - _EPS] = 1.0
    return p


def landing(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """0 or 1 for the few units still open, nearest to their expected size."""
    k = np.flatnonzero((prob > 0) & (prob < 1))
    out = prob.copy()
    if len(k):
        pick = (np.arange(1 << len(k))[:, None] >> np.arange(len(k))) & 1
        off = np.abs(pick @ size[k].astype(float) - prob[k] @ size[k])
        n_off = np.abs(pick.sum(axis=1) - prob[k].sum())
        out[k] = pick[np.lexsort((n_off, off))[0]]  # the size first, then the number of items
    return out


def mix(
    items: DataFrame,
    item_id: str,
    source: str,
    size: str,
    targets: DataFrame,
    mix_name: str = "mezcla",
    weight: str = "peso_objetivo",
    repeats: str = "max_repeticiones",
    group_items: int = 40_000,
    fan_in: int = 8,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares) for every mix in ``targets`` (mix, source, weight, repeats).

    drawn: (mix, <item_id>, source, size, repeticiones), the items of each mix and
    how often. shares: (mix, source, peso_objetivo, peso_ajustado, peso_real,
    items, size), where the adjusted weights share out what sources without items
    would have had.

    The total of a mix is the largest at which no source needs more than its
    repeats; each source then needs every item a whole number of times and a
    share of once more. That share is drawn by the cube method: the flight phase
    runs in groups of at most ``group_items`` of a source, hashed by place in the
    input, its few open units go to
    the next, wider round, and only the last of a source, ``HOLD`` and two at
    most, are rounded to the selection nearest in size, then in number.

    Items without id or source, or with a null, zero or negative size are never
    drawn; repeated ids are items of their own; sources outside a mix are left
    out; a mix without any items gives no rows in ``drawn`` and zero shares;
    weights and repeats must be positive, others count as absent.
    """
    ikind, skind = items.schema[item_id].dataType.simpleString(), items.schema[source].dataType.simpleString()
    base = items.filter(F.col(item_id).isNotNull() & F.col(source).isNotNull() & (F.col(size) > 0))
    base = cut_lineage(base.select(F.col(item_id).alias("id"), F.col(source).alias("s"), F.col(size).cast("long").alias("z"), F.monotonically_increasing_id().alias("u")))
    have = base.groupBy("s").agg(F.sum("z").alias("total"), F.count(F.lit(1)).alias("docs"))
    goal = targets.filter((F.col(weight) > 0) & (F.col(repeats) > 0)).select(F.col(mix_name).alias("m"), F.col("source").alias("s"), F.col(weight).cast("double").alias("w"), F.col(repeats).cast("int").alias("r"))
    plan = goal.join(have, "s", "left")
    by = Window.partitionBy("m")
    plan = plan.withColumn("aw", F.when(F.col("total").isNotNull(), F.col("w")) / F.sum(F.when(F.col("total").isNotNull(), F.col("w"))).over(by))
    plan = plan.withColumn("tot", F.min(F.col("total") * F.col("r") / F.col("aw")).over(by))
    plan = plan.withColumn("mult", F.col("tot") * F.col("aw") / F.col("total"))
    plan = plan.withColumn("whole", F.floor(F.col("mult") + 1e-9).cast("int")).withColumn("frac", F.greatest(F.col("mult") - F.col("whole"), F.lit(0.0)))
    plan = plan.withColumn("groups", F.when(F.col("docs") > group_items, F.ceil(F.col("docs") / safe_mean(group_items))).otherwise(1).cast("int"))
    plan = cut_lineage(plan)  # one row per mix and source
    cells_plan = plan.filter("total is not null").select("m", "s", "whole", "frac", "groups", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    cells = base.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALT)).cast("int")).join(cells_plan, ["s", "salt"])
    g = F.pmod(F.xxhash64("u", "m"), F.col("groups")).cast("int")
    cells = cells.select("m", "s", "id", "z", "u", "whole", F.col("frac").alias("p"), g.alias("g"))
    sure = cells.filter("p <= 1e-9").select("m", "s", "id", "z", F.col("whole").alias("rep"))
    schema = f"m string, s {skind}, id {ikind}, z long, u long, whole int, p double, g int"

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u", kind="stable").reset_index(drop=True)
        key = sum(ord(c) * (i + 1) for i, c in enumerate(f"{pdf['m'].iloc[0]}|{pdf['s'].iloc[0]}|{pdf['g'].iloc[0]}"))
        order = np.random.default_rng([seed, key]).permutation(len(pdf))
        p = np.empty(len(pdf))
        p[order] = flight(pdf["p"].to_numpy()[order], pdf["z"].to_numpy()[order], seed + key, HOLD)
        pdf["p"] = p
        return pdf

    def land(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = fly(pdf)
        pdf["p"] = landing(pdf["p"].to_numpy(), pdf["z"].to_numpy())
        return pdf

    groups = int(plan.agg(F.max("groups")).first()[0] or 1)
    flown = cut_lineage(cells.filter("p > 1e-9").groupBy("m", "s", "g").applyInPandas(fly, schema))
    settled = [flown.filter("p = 0 or p = 1")]
    open_ = flown.filter("p > 0 and p < 1")
    while True:
        last = groups <= fan_in
        groups = math.ceil(groups / fan_in)
        step = open_.withColumn("g", F.floor(F.col("g") / fan_in).cast("int")).groupBy("m", "s", "g").applyInPandas(land if last else fly, schema)
        step = cut_lineage(step)
        settled.append(step.filter("p = 0 or p = 1"))
        open_ = step.filter("p > 0 and p < 1")
        if last:
            break
    drawn = sure
    for x in settled:
        drawn = drawn.unionByName(x.select("m", "s", "id", "z", (F.col("whole") + F.col("p").cast("int")).alias("rep")))
    drawn = drawn.filter("rep > 0")
    out = drawn.select(F.col("m").alias(mix_name), F.col("id").alias(item_id), F.col("s").alias(source), F.col("z").alias(size), F.col("rep").alias("repeticiones"))
    got = drawn.groupBy("m", "s").agg(F.sum(F.col("rep")).cast("long").alias("items"), F.sum(F.col("z") * F.col("rep")).cast("long").alias("size"))
    shares = plan.select("m", "s", "w", "aw", "tot").join(got, ["m", "s"], "left")
    shares = shares.withColumn("all", F.sum("size").over(by))
    shares = shares.select(
        F.col("m").alias(mix_name),
        F.col("s").alias(source),
        F.col("w").alias("peso_objetivo"),
        F.coalesce("aw", F.lit(0.0)).alias("peso_ajustado"),
        F.coalesce(F.col("size") / F.col("all"), F.lit(0.0)).alias("peso_real"),
        F.coalesce("items", F.lit(0).cast("long")).alias("items"),
        F.coalesce("size", F.lit(0).cast("long")).alias("size"),
    )
    return out, shares
