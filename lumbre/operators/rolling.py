"""Totals over trailing periods from segment trees.

A tree covers one time shard of one entity; its nodes hold the sums of the days
below them. A range query adds the few canonical nodes that make up the range,
and a correction adds its difference to the ancestors of its day, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Levels of a tree; a shard has 2**LEVELS days.
LEVELS = 9
SHARD = 1 << LEVELS
#: Query days answered at once.
CHUNK = 1 << 20


class Forest:
    """The segment trees of many shards, as sorted sparse nodes per level.

    ``pos`` are ascending leaf positions (number of the tree in its batch times the
    space of a tree, a multiple of SHARD, plus the place in it), ``val`` one row of
    sums per leaf. Trees are numbered in the batch, so no date can reach into the
    tree of a neighbour."""

    def __init__(self, pos: np.ndarray, val: np.ndarray):
        self.keys, self.vals = [pos], [val]
        for _ in range(LEVELS):
            k = self.keys[-1] >> 1
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
            self.keys.append(k[at])
            self.vals.append(np.add.reduceat(self.vals[-1], at, axis=0) if len(k) else self.vals[-1])
        self.roots = np.concatenate([np.zeros((1, val.shape[1]), val.dtype), np.cumsum(self.vals[LEVELS], axis=0)])

    def _add(self, out: np.ndarray, level: int, rows: np.ndarray, node: np.ndarray) -> None:
        keys = self.keys[level]
        if not len(keys) or not len(rows):
            return
        i = np.searchsorted(keys, node).clip(max=len(keys) - 1)
        hit = keys[i] == node
        out[rows[hit]] += self.vals[level][i[hit]]

    def range_sum(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Sums over the half-open ranges [lo, hi) of positions."""
        out = np.zeros((len(lo), self.vals[0].shape[1]), self.vals[0].dtype)
        lo, hi = lo.copy(), hi.copy()
        for level in range(LEVELS):
            r = np.flatnonzero((lo < hi) & (lo & 1 == 1))
            self._add(out, level, r, lo[r])
            lo[r] += 1
            r = np.flatnonzero((lo < hi) & (hi & 1 == 1))
            hi[r] -= 1
            self._add(out, level, r, hi[r])
            lo >>= 1
            hi >>= 1
        r = np.flatnonzero(lo < hi)  # whole shards
        if len(r):
            keys = self.keys[LEVELS]
            out[r] += self.roots[np.searchsorted(keys, hi[r])] - self.roots[np.searchsorted(keys, lo[r])]
        return out


def _tree_batches(batches: Iterator[pa.RecordBatch], least: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole trees (columns 0 and 1), in the order of the sorted partition."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        e, s = t.column(0).to_numpy(), t.column(1).to_numpy()
        cut = len(e) - int(np.argmax(((e != e[-1]) | (s != s[-1]))[::-1])) if (e[0], s[0]) != (e[-1], s[-1]) else 0
        if cut:
            yield t.slice(0, cut)
            held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _trees(t: pa.Table) -> np.ndarray:
    """Number of the tree of each row."""
    e, s = t.column(0).to_numpy(), t.column(1).to_numpy()
    return np.cumsum(np.r_[False, (e[1:] != e[:-1]) | (s[1:] != s[:-1])])


def _shard(day: str) -> F.Column:
    return F.shiftright(F.col(day).cast("long"), LEVELS)


def trailing_totals(
    leaves: DataFrame,
    entity: str,
    day: str,
    values: list[str],
    windows: tuple[int, ...] = (7, 30),
    last_day: int | None = None,
    running: tuple[str, ...] = (),
) -> DataFrame:
    """For each entity and calendar day the sums of ``values`` over the trailing windows.

    ``leaves`` has one row per entity and day (an integer, days since 1970) with
    integer ``values``; the result has (entity, day, <value>_<window>...) for
    every day from the first of an entity to ``last_day`` (its own last day
    where None), days without activity included. Columns in ``running`` are summed
    from the entity's first day on instead, as presence changes are.

    A task holds trees of one entity and time shard each: the leaves of the shard,
    those of the days before it that its windows reach, and the running sums that
    earlier shards pass on (one row per shard). Rows without entity or day are left
    out; no leaves give no rows; null values count as zero; days may be any.
    """
    names = [f"{v}_{w}" for w in windows for v in values] + list(running)
    cols = [*values, *running]
    clean = leaves.filter(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(
        F.col(entity).cast("long").alias("e"), F.col(day).cast("long").alias("d"), *[F.coalesce(F.col(v).cast("long"), F.lit(0)).alias(v) for v in cols]
    )
    reach = max(windows, default=1) - 1
    space = SHARD * (1 + -(-reach // SHARD))
    ends = clean.groupBy("e").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    if last_day is not None:
        ends = ends.withColumn("hi", F.greatest("hi", F.lit(last_day)))
    heads = ends.select("e", "lo", "hi", F.explode(F.sequence(_shard("lo"), _shard("hi"))).alias("shard"))
    if running:
        sums = clean.groupBy("e", _shard("d").alias("shard")).agg(*[F.sum(v).alias(v) for v in running])
        earlier = Window.partitionBy("e").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        heads = heads.join(sums, ["e", "shard"], "left").select("e", "shard", "lo", "hi", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(v) for v in running])
    start = F.shiftleft("shard", LEVELS)
    heads = heads.select("e", "shard", F.greatest("lo", start).alias("d"), F.least("hi", start + (SHARD - 1)).alias("stop"), *[F.lit(0).cast("long").alias(v) for v in values], *running)
    held = clean.select("e", F.explode(F.sequence(_shard("d"), F.shiftright(F.col("d") + reach, LEVELS))).alias("shard"), "d", F.lit(None).cast("long").alias("stop"), *values, *[F.col(v).alias(v) for v in running])
    held = held.select("e", "shard", "d", "stop", *values, *[F.when(F.col("shard") == _shard("d"), F.col(v)).otherwise(0).alias(v) for v in running])
    schema = pa.schema([("e", pa.int64()), ("d", pa.int32()), *[(n, pa.int64()) for n in names]])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tree_batches(batches):
            tree, base = _trees(t), t.column("shard").to_numpy() * SHARD
            day_ = t.column("d").to_numpy()
            stop = t.column("stop").to_numpy(zero_copy_only=False)
            val = np.stack([t.column(v).to_numpy() for v in cols], axis=1)
            head = ~np.isnan(stop) if stop.dtype.kind == "f" else np.ones(len(stop), bool)
            at = np.flatnonzero(head)
            leaf = np.flatnonzero(~head)
            forest = Forest(tree[leaf] * space + day_[leaf] - base[leaf] + (space - SHARD), val[leaf])
            n = (stop[at] - day_[at]).astype(np.int64) + 1
            upto = np.cumsum(n)
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CHUNK, side="right")))
                k = np.repeat(at[a:b], n[a:b])
                off = np.arange(len(k)) - np.repeat(upto[a:b] - n[a:b] - (upto[a - 1] if a else 0), n[a:b])
                d = day_[k] + off
                origin = tree[k] * space + (space - SHARD)
                pos = origin + d - base[k]
                out = [pa.array(t.column("e").to_numpy()[k]), pa.array(d.astype(np.int32))]
                for w in windows:
                    s = forest.range_sum(pos - (w - 1), pos + 1)
                    out += [pa.array(np.ascontiguousarray(s[:, i])) for i in range(len(values))]
                if running:
                    s = forest.range_sum(origin, pos + 1) + val[k]  # a head carries what earlier shards pass on
                    out += [pa.array(np.ascontiguousarray(s[:, len(values) + i])) for i in range(len(running))]
                yield pa.RecordBatch.from_arrays(out, schema=schema)
                a = b

    ddl = "e long, d int, " + ", ".join(f"`{n}` long" for n in names)
    rows = heads.unionByName(held).repartition("e", "shard").sortWithinPartitions("e", "shard", F.col("stop").isNull(), "d")
    return rows.mapInArrow(answer, ddl).select(F.col("e").alias(entity), F.col("d").alias(day), *names)


def presence_deltas(acts: DataFrame, entity: str, member: str, day: str, windows: tuple[int, ...]) -> DataFrame:
    """Leaves (entity, window, day, delta) whose prefix sums count the different
    members active in the trailing window.

    A member is present for ``window`` days after each act, cut short by its next
    act; presence starts with +1 and ends with -1, so the sum up to a day is the
    number of different members. ``member`` must not be null."""
    days = acts.filter(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(F.col(entity).alias("e"), F.col(member).alias("m"), F.col(day).cast("long").alias("d"))
    days = days.distinct()  # combined before the exchange, so one row per member and day is all a task meets
    after = F.lead("d").over(Window.partitionBy("e", "m").orderBy("d"))
    spans = days.withColumn("after", after).select("e", "d", "after", F.explode(F.array(*[F.lit(w) for w in windows])).alias("w"))
    stop = F.least(F.col("d") + F.col("w"), F.coalesce("after", F.col("d") + F.col("w")))
    ends = spans.select("e", "w", F.explode(F.array(F.struct(F.col("d").alias("d"), F.lit(1).alias("delta")), F.struct(stop.alias("d"), F.lit(-1).alias("delta")))).alias("x"))
    return ends.groupBy("e", "w", F.col("x.d").alias("d")).agg(F.sum("x.delta").alias("delta")).filter("delta <> 0")


def days_with_members(acts: DataFrame, entity: str, member: str, day: str, windows: tuple[int, ...] = (7, 30), least: int = 3) -> DataFrame:
    """(entity, window, day) of all days whose trailing window has at least
    ``least`` different members, silent days included.

    The leaves of the trees, one tree per entity, window and time shard, are the
    changes of presence; a range query from the start of the shard and the sum that
    earlier shards pass on (one row per shard) give the count at each change, which
    holds until the next. Days may be any, however far from others. Nulls and repeats as in ``presence_deltas``.
    """
    # entity and window share one key: the window is its low digit
    deltas = presence_deltas(acts, entity, member, day, windows)
    index = F.element_at(F.create_map(*[F.lit(x) for k, w in enumerate(windows) for x in (w, k)]), F.col("w"))
    n = len(windows)
    leaves = deltas.select((F.col("e").cast("long") * n + index).alias("k"), _shard("d").alias("shard"), "d", F.col("delta").cast("long").alias("delta"))
    line = Window.partitionBy("k").orderBy("shard")
    heads = leaves.groupBy("k", "shard").agg(F.sum("delta").alias("sum"), F.min("d").alias("first"))
    heads = heads.select("k", "shard", F.lead("first").over(line).alias("next"), F.coalesce(F.sum("sum").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("delta"))
    rows = heads.select("k", "shard", F.lit(None).cast("long").alias("d"), "delta", "next").unionByName(leaves.withColumn("next", F.lit(None).cast("long")))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tree_batches(batches):
            tree, k = _trees(t), t.column("k").to_numpy()
            head = t.column("d").is_null().to_numpy()  # the first row of each tree
            at = np.flatnonzero(~head)
            delta, d = t.column("delta").to_numpy(), t.column("d").fill_null(0).to_numpy()
            carry, after = delta[head][tree], t.column("next").fill_null(-(1 << 40)).to_numpy()[head][tree]
            pos = tree[at] * SHARD + d[at] - t.column("shard").to_numpy()[at] * SHARD
            count = Forest(pos, delta[at][:, None]).range_sum(tree[at] * SHARD, pos + 1)[:, 0] + carry[at]
            last = np.r_[tree[at][1:] != tree[at][:-1], True]
            until = np.where(last, after[at], np.r_[d[at][1:], 0]) - 1  # a shard's last change holds until the next shard's first
            hit = np.flatnonzero((count >= least) & (until >= d[at]))
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(k[at][hit]), pa.array(d[at][hit].astype(np.int32)), pa.array(until[hit].astype(np.int32)), pa.array(count[hit])], names=["k", "a", "b", "members"])

    runs = rows.repartition("k", "shard").sortWithinPartitions("k", "shard", F.col("d").isNotNull(), "d").mapInArrow(answer, "k long, a int, b int, members long")
    kind = acts.schema[entity].dataType
    return runs.select(
        F.floor(F.col("k") / n).cast(kind).alias(entity),
        F.element_at(F.array(*[F.lit(w) for w in windows]), (F.pmod("k", F.lit(n)) + 1).cast("int")).alias("window"),
        F.explode(F.sequence("a", "b")).alias(day),
        "members",
    )


# Persistent trees -----------------------------------------------------------


def tree_nodes(leaves: DataFrame, entity: str, day: str, values: list[str]) -> DataFrame:
    """Node table (entity, shard, level, node, values...) of the leaves: every leaf
    adds to its LEVELS + 1 ancestors; empty nodes have no row. Several leaves of a
    day add up. Rows without entity or day are left out."""
    pos = F.col(day).cast("long")
    return (
        leaves.filter(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity), pos.alias("__p"))
        .agg(*[F.sum(F.coalesce(F.col(v), F.lit(0))).alias(v) for v in values])
        .select(entity, F.shiftright("__p", LEVELS).alias("shard"), "__p", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"), *values)
        .withColumn("node", F.expr("shiftright(__p, level)"))
        .groupBy(entity, "shard", "level", "node")
        .agg(*[F.sum(v).alias(v) for v in values])
    )


def correct_nodes(nodes: DataFrame, corrections: DataFrame, entity: str, day: str, values: list[str]) -> DataFrame:
    """Node table after late rows (differences to the sums of their days): only the
    ancestors of corrected days change, all other nodes pass unchanged."""
    keys = [entity, "shard", "level", "node"]
    diff = tree_nodes(corrections, entity, day, values).select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    changed = nodes.join(diff, keys, "left").select(*keys, *[(F.col(v) + F.coalesce(F.col(f"__{v}"), F.lit(0))).alias(v) for v in values])
    new = diff.join(nodes.select(*keys), keys, "left_anti").select(*keys, *[F.col(f"__{v}").alias(v) for v in values])
    return changed.unionByName(new)


def query_nodes(nodes: DataFrame, queries: DataFrame, entity: str, first: str, last: str, values: list[str]) -> DataFrame:
    """Queries (entity, first day, last day; both inclusive) with the sums of their
    ranges, from canonical nodes by one equi-join. Ranges may span any number of
    shards. A range without activity, or with a null, has sums of zero; repeated
    queries each get their row."""
    q = queries.withColumn("__lo", F.col(first).cast("long")).withColumn("__hi", F.col(last).cast("long") + 1)
    keys = [entity, "__lo", "__hi"]
    asked = q.select(*keys).dropna().distinct()
    lo, hi = "(shiftright(__lo + shiftleft(1L, l) - 1, l))", "(shiftright(__hi, l))"
    # at level l the range covers whole nodes [ceil(lo/2^l), floor(hi/2^l)); it uses those whose parent it doesn't cover
    take = (
        f"filter(array(CASE WHEN {lo} < {hi} AND ({lo} & 1) = 1 AND l < {LEVELS} THEN {lo} END,"
        f" CASE WHEN {lo} < {hi} AND ({hi} & 1) = 1 AND l < {LEVELS} AND NOT (({lo} & 1) = 1 AND {lo} = {hi} - 1) THEN {hi} - 1 END), x -> x is not null)"
    )
    whole = f"CASE WHEN l = {LEVELS} AND {lo} < {hi} THEN sequence({lo}, {hi} - 1) ELSE {take} END"
    parts = asked.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).select(*keys, F.col("l").alias("level"), F.explode(F.expr(whole)).alias("node"))
    sums = parts.join(nodes.drop("shard"), [entity, "level", "node"]).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    out = q.join(sums, keys, "left")
    return out.select(*queries.columns, *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])
