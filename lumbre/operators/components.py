"""Connected components of a graph of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of all ids in ``edges`` (a long, b long); a component is named
    by its smallest id.

    Large-star and small-star rounds: every node points to the smallest
    neighbour it knows, so a chain of n nodes needs about log n rounds. A round
    is two grouped minima and equi-joins; neighbours are never gathered in one
    row, so a hub is only many rows of one key. Edges with a null and loops are
    ignored; no edges give no rows. Rounds are cut by checkpoints in the shared
    folder.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut_lineage(e)
    before = None
    for _ in range(max_rounds):
        # large star: the neighbours above a node point to the smallest around it
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if before == (now["n"], now["s"]):
            break
        before = (now["n"], now["s"])
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
