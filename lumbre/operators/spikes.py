"""Implausible readings in per-source series.

Peaks over threshold: every series is reduced to seasonal residuals, a
generalised Pareto tail is fitted per series above its own high quantile, and
the cutoff is the level exceeded with a fixed risk. Rules for frozen values
and for values that cannot exist complete the flags.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, left_join
from .series import medians

#: Share of the readings of a series above its threshold.
TAIL = 0.2
#: Restated quarters from which their usual difference is known.
VERSIONS = 20
#: Readings that level, trend and season of a series use up.
SPENT = 3.0
#: Risk of a normal reading to be taken for a spike.
RISK = 3e-3
#: 80 % quantile over the median of an absolute normal deviate.
NORMAL_80 = 1.9


def _median(rows: np.ndarray) -> np.ndarray:
    """Median of the last axis without NaN; NaN where there is nothing."""
    s = np.sort(rows, axis=-1)  # NaN goes last
    k = (~np.isnan(s)).sum(axis=-1)
    take = lambda i: np.take_along_axis(s, np.clip(i, 0, s.shape[-1] - 1)[..., None], axis=-1)[..., 0]
    return np.where(k > 0, (take((k - 1) // 2) + take(k // 2)) / 2, np.nan)


def _quantile(rows: np.ndarray, q: float) -> np.ndarray:
    s = np.sort(rows, axis=-1)
    k = (~np.isnan(s)).sum(axis=-1)
    at = np.maximum(k - 1, 0) * q
    lo = np.floor(at).astype(int)
    take = lambda i: np.take_along_axis(s, np.clip(i, 0, s.shape[-1] - 1)[..., None], axis=-1)[..., 0]
    low = take(lo)
    return np.where(k > 0, low + (take(np.minimum(lo + 1, np.maximum(k - 1, 0))) - low) * (at - lo), np.nan)


def _sides(y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the up to ``width`` values before it and after it."""
    n = y.shape[1]
    pad = np.full((len(y), width), np.nan)
    win = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, y, pad], axis=1), width, axis=1)
    return win[:, :n], win[:, width + 1 : width + 1 + n]


def _local(y: np.ndarray, use: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(residual, one_sided) of each value against the nearer of its neighbourhoods.

    A lasting change of level agrees with one neighbourhood, so only values that
    leave both sides keep a large residual. Neighbourhoods hold values in ``use``;
    a side with fewer than two has no say."""
    at = np.broadcast_to(np.arange(y.shape[1]), y.shape)
    seen = np.maximum.accumulate(np.where(use, at, -1), axis=1)
    prev = np.concatenate([np.full((len(y), 1), -1), seen[:, :-1]], axis=1)
    ok = use & (prev >= 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        d = np.where(ok, (y - np.take_along_axis(y, np.maximum(prev, 0), axis=1)) / (at - prev), np.nan)
    slope = np.where(ok.sum(axis=1) >= 4, _median(d), 0.0)[:, None]
    flat = y - slope * at
    before, after = _sides(np.where(use, flat, np.nan), width)
    nb, na = (~np.isnan(before)).sum(axis=2), (~np.isnan(after)).sum(axis=2)
    b, a = _median(before), _median(after)
    rb, ra = np.where(nb >= 2, flat - b, np.nan), np.where(na >= 2, flat - a, np.nan)
    one = np.isnan(rb) | np.isnan(ra)
    near = np.where(np.isnan(rb), ra, np.where(np.isnan(ra), rb, np.where(np.abs(rb) <= np.abs(ra), rb, ra)))
    mean = flat - (b + a) / 2
    # between two agreeing sides the middle is the better forecast
    return np.where(~one & (np.abs(mean) < np.abs(near)), mean, near), one


def _season(r: np.ndarray, phase: np.ndarray, use: np.ndarray, period: int) -> np.ndarray:
    """Effect of each phase: the median where it was seen three times; of two
    sightings the smaller one if both have the same sign, so that a peak must
    recur before it is taken for a season."""
    out = np.zeros((len(r), period))
    for p in range(period):
        v = np.where((phase == p) & use, r, np.nan)
        k = (~np.isnan(v)).sum(axis=1)
        lo, hi = np.where(np.isnan(v), np.inf, v).min(axis=1), np.where(np.isnan(v), -np.inf, v).max(axis=1)
        with np.errstate(invalid="ignore"):
            two = np.where(lo * hi > 0, np.where(np.abs(lo) < np.abs(hi), lo, hi), 0.0)
        out[:, p] = np.where(k >= 3, _median(v), np.where(k == 2, two, 0.0))
    return out - np.median(out, axis=1, keepdims=True)


def seasonal_residuals(phase: np.ndarray, y: np.ndarray, period: int = 4, width: int = 3, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(residuals, their 80 % quantile, one_sided) of many series, one per row.

    ``y`` holds logarithms from the left in order of time, NaN behind a series'
    end. Level, trend and season come from the series itself. Readings far outside
    are left out of the next round's fit, unless every sighting of their phase
    lies outside on the same side: then it is a season. Series of fewer than five
    readings get NaN."""
    valid = ~np.isnan(y)
    enough = valid.sum(axis=1) >= 5
    use = valid.copy()
    for k in range(rounds):
        season = np.zeros((len(y), period))
        for _ in range(3):
            calm = y - np.take_along_axis(season, phase, axis=1)
            b, a = (_median(x) for x in _sides(np.where(use, calm, np.nan), width + 1))
            mid = np.where(np.isnan(b), a, np.where(np.isnan(a), b, (b + a) / 2))
            season += _season(calm - mid, phase, use, period)
        r, one = _local(y - np.take_along_axis(season, phase, axis=1), use, width)
        scale = np.maximum(_quantile(np.where(use, np.abs(r), np.nan), 0.8), 1e-3)
        far = np.abs(r) > np.maximum(3.5 * scale, 0.3)[:, None]
        for p in range(period):
            at = (phase == p) & valid
            up, down, n = (at & far & (r > 0)).sum(axis=1), (at & far & (r < 0)).sum(axis=1), at.sum(axis=1)
            far &= ~(at & ((n >= 2) & ((up == n) | (down == n)))[:, None])
        keep = valid & ~far
        keep = np.where((keep.sum(axis=1) >= 5)[:, None], keep, use)
        if k == rounds - 1 or (keep == use).all():
            break
        use = keep
    r = np.where(enough[:, None], r, np.nan)
    return r, np.where(enough, scale, np.nan), one


def _short(y: np.ndarray) -> tuple[np.ndarray, float]:
    """Residuals of three or four readings: the distance to the nearest other one."""
    d = y[:, None] - y[None, :]
    np.fill_diagonal(d, np.inf)
    r = d[np.arange(len(y)), np.abs(d).argmin(axis=1)]
    return r, max(float(np.median(np.abs(r))), 0.1)


#: What the model says of one reading: expected log level; of its series the threshold,
#: the number of readings, of exceedances and their two moments; rules, one-sidedness.
MODEL = {"esperado": "double", "u0": "double", "n": "int", "k": "int", "m2": "double", "m3": "double", "positivo": "boolean", "congelado": "double", "lado": "boolean"}
#: Exceedances, in thresholds, beyond which a fit takes no notice of how far they are.
BOUND = 1.0


def _moments(e: np.ndarray, bound: float = BOUND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, mean least of two, mean least of three) of the exceedances in each row.

    These probability-weighted moments exist for any shape below 2 and one far value
    hardly moves them."""
    s = np.sort(np.where(e > 0, np.minimum(e, bound), np.nan), axis=1)
    k = (~np.isnan(s)).sum(axis=1)
    i = np.arange(1, s.shape[1] + 1)
    left = np.maximum(k[:, None] - i, 0)
    v = np.nan_to_num(s)
    m2 = np.where(k >= 2, (v * left).sum(axis=1) * 2 / np.maximum(k * (k - 1), 1), np.nan)
    m3 = np.where(k >= 3, (v * left * np.maximum(left - 1, 0)).sum(axis=1) * 3 / np.maximum(k * (k - 1) * (k - 2), 1), np.nan)
    return k, m2, m3


def _model(ent: np.ndarray, q: np.ndarray, v: np.ndarray, min_run: int, bound: float = BOUND) -> dict[str, np.ndarray]:
    """Expected log level, tail threshold and rules for readings sorted by entity and
    quarter, all series of one field at a time."""
    start = np.flatnonzero(np.r_[True, ent[1:] != ent[:-1]])
    size = np.diff(np.r_[start, len(ent)])
    series = np.repeat(np.arange(len(start)), size)
    # rules on all readings
    neg, pos = np.add.reduceat((v < 0).astype(int), start), np.add.reduceat((v > 0).astype(int), start)
    always = (size >= 4) & (neg <= np.maximum(1, size // 10)) & (pos >= 3)
    run = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (series[1:] != series[:-1])])
    length = np.repeat(np.diff(np.r_[run, len(v)]), np.diff(np.r_[run, len(v)]))
    first = np.zeros(len(v), bool)
    first[run] = True
    frozen = np.where((length >= min_run) & ~first & (v != 0), v, np.nan)
    # residuals of the non-zero ones, one row per series
    nz = np.flatnonzero(v != 0)
    esperado, lado = np.full(len(v), np.nan), np.ones(len(v), bool)
    u0, m2, m3, over = np.full(len(start), np.nan), np.full(len(start), np.nan), np.full(len(start), np.nan), np.zeros(len(start), int)
    if len(nz):
        row = series[nz]
        head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        k = np.diff(np.r_[head, len(row)])
        line = np.repeat(np.arange(len(head)), k)
        col = np.arange(len(row)) - np.repeat(head, k)
        shape = (len(head), int(k.max()))
        y, phase = np.full(shape, np.nan), np.zeros(shape, int)
        y[line, col], phase[line, col] = np.log(np.abs(v[nz])), q[nz] % 4
        r, scale, one = seasonal_residuals(phase, y)
        for i in np.flatnonzero((k >= 3) & (k < 5)):
            r[i, : k[i]], scale[i] = _short(y[i, : k[i]])
        esperado[nz], lado[nz] = (y - r)[line, col], one[line, col]
        u0[row[head]] = scale
        over[row[head]], m2[row[head]], m3[row[head]] = _moments(np.abs(r) / scale[:, None] - 1, bound)
    return {"esperado": esperado, "u0": u0[series], "n": size[series], "k": over[series], "m2": m2[series], "m3": m3[series], "positivo": always[series], "congelado": frozen, "lado": lado}


def _modeller(fields: list[str], min_run: int, bound: float, batch: int = 2_000):
    def model(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            out = {"__e": pdf["__e"].to_numpy(), "q": pdf["q"].to_numpy(int)} | {f"d_{i}": pdf[f"d_{i}"].to_numpy(float) for i in range(len(fields))}
            for i, f in enumerate(fields):
                has = pdf[f].notna().to_numpy()
                got = _model(out["__e"][has], out["q"][has], pdf[f].to_numpy(float)[has], min_run, bound) if has.any() else {}
                for k, kind in MODEL.items():
                    col = np.full(len(pdf), np.nan) if kind == "double" else np.zeros(len(pdf), int if kind == "int" else bool)
                    if got:
                        col[has] = got[k]
                    out[f"{k}_{i}"] = col
            return pd.DataFrame(out)

        held: list[pd.DataFrame] = []
        for pdf in frames:  # sorted by entity; an entity may go on in the next frame
            held.append(pdf)
            if sum(map(len, held)) < batch * 20:
                continue
            all_ = pd.concat(held)
            last = (all_["__e"] == all_["__e"].iloc[-1]).to_numpy()
            if not last.all():
                yield fit(all_[~last])
                held = [all_[last]]
        if held and sum(map(len, held)):
            yield fit(pd.concat(held))

    return model


def _cutoffs(model: DataFrame, fields: list[str], risk: float, prior: float, edge: float) -> list[Column]:
    """Cutoff on |residual| in thresholds for each field: a generalised Pareto tail fitted to
    each series' own exceedances.

    The moments of a series count as many times as it has exceedances, those of its field
    ``prior`` times; shape and scale follow from the mixed moments. Three sums per field
    come to the driver."""
    own = lambda i, c: F.when(F.col(f"k_{i}") >= 3, F.col(f"{c}_{i}"))
    share = lambda i: F.when(F.col(f"k_{i}") >= 3, F.col(f"k_{i}") / F.col(f"n_{i}"))  # noqa: E731  # of a series its readings together
    q = model.agg(*[x for i in range(len(fields)) for x in (F.sum(own(i, "m2") * share(i)).alias(f"a{i}"), F.sum(own(i, "m3") * share(i)).alias(f"b{i}"), F.sum(share(i)).alias(f"c{i}"))]).first()
    out = []
    for i in range(len(fields)):
        many = q[f"c{i}"] or 0.0
        f2, f3 = (q[f"a{i}"] / many, q[f"b{i}"] / many) if many else (0.5, 1 / 3)  # no series of the field has a tail: an exponential one
        k = F.when(F.col(f"k_{i}") >= 3, F.col(f"k_{i}")).otherwise(0)
        mix = lambda c, f: (F.coalesce(own(i, c), F.lit(0.0)) * k + F.lit(f * prior)) / (k + prior)  # noqa: B023, E731
        m2, m3 = mix("m2", f2), mix("m3", f3)
        ratio = F.least(F.greatest(m2 / m3, F.lit(1.5003)), F.lit(2.0))  # shapes from 0 to 1
        xi = (2 * ratio - 3) / (ratio - 1)
        scale = m2 * (2 - xi)
        few = F.sqrt(F.col(f"n_{i}") / F.greatest(F.col(f"n_{i}") - SPENT, F.lit(1.0)))
        out.append(few * (1 + scale * (F.pow(F.lit(risk / TAIL), -xi) - 1) / xi) * F.when(F.col(f"lado_{i}"), edge).otherwise(1.0))
    return out


def _position(df: DataFrame, published: str, row_id: str) -> Column:
    """Order of publication, the id deciding, as one number that a hash aggregate can hold;
    as a struct where the types don't allow it."""
    kinds = df.schema[published].dataType.simpleString(), df.schema[row_id].dataType.simpleString()
    if kinds[0] != "date" or kinds[1] not in ("int", "bigint"):
        return F.struct(F.col(published).isNull(), F.col(published), F.col(row_id))
    day = F.coalesce(F.unix_date(published).cast("long"), F.lit(80_000_000)) + 10_000_000
    return day.cast("decimal(9,0)") * F.lit("1" + "0" * 20).cast("decimal(21,0)") + F.col(row_id).cast("decimal(20,0)")


def flag_implausible(
    df: DataFrame,
    entity: str = "empresa_id",
    row_id: str = "id",
    year: str = "anio_fiscal",
    quarter: str = "trimestre",
    published: str = "fecha_filing",
    fields: tuple[str, ...] = ("revenue", "gross_profit", "shares_outstanding"),
    positive: tuple[str, ...] = ("revenue",),
    strictly_positive: tuple[str, ...] = ("shares_outstanding",),
    bounded: tuple[tuple[str, str], ...] = (("gross_profit", "revenue"),),
    risk: float = RISK,
    min_change: float = 0.0,
    min_run: int = 4,
    prior: float = 20.0,
    edge: float = 1.8,
) -> DataFrame:
    """One row (row_id, campo, motivo) per reading that cannot be right.

    motivo is the first that holds of: ``imposible`` (negative where ``positive``,
    zero or less where ``strictly_positive``, above a sound bound of its row),
    ``congelado`` (the second and later of ``min_run`` equal non-zero readings),
    ``signo`` (negative in a series that is otherwise positive) and ``pico``
    (residual beyond the cutoff, and a change of at least ``min_change`` in
    logarithms). The cutoff is the level that a normal reading exceeds with ``risk``
    under the tail fitted to the series' own exceedances; it is ``edge`` times as high
    where readings stand on one side only, as at the ends of a series. The usual
    difference between versions of a quarter, the precision a field is reported with,
    adds to the scatter of every series of that field.

    A series is modelled on the first published reading of each quarter, so
    repeated rows and restatements neither widen nor hide it; every row is then
    judged by its own value. That also bounds what one task holds: one row per
    entity and quarter, however many rows share the entity.

    Null readings are never flagged and skipped in runs; rows without entity,
    year or quarter are judged only by the rules of impossibility; rows without
    a publication date count as published last, equal ones by the lowest id. A
    series of fewer than three readings has no residuals. Other columns of the
    table are ignored, and an empty table gives no rows.
    """
    fs = list(fields)
    rows = df.select(
        F.col(row_id).alias("__id"),
        F.col(entity).alias("__e"),
        (F.col(year) * 4 + F.col(quarter) - 1).cast("int").alias("q"),
        F.col(published).alias("__p"),
        *[F.col(f).cast("double").alias(f) for f in dict.fromkeys([*fs, *(b for _, b in bounded)])],
    )
    place = _position(rows, "__p", "__id")
    spread = lambda f: F.log(F.max(F.when(F.col(f) > 0, F.col(f))) / F.min(F.when(F.col(f) > 0, F.col(f))))
    first = (
        rows.filter(F.col("__e").isNotNull() & F.col("q").isNotNull())
        .withColumn("place", place)
        .groupBy("__e", "q")
        .agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("place"))).alias(f) for f in fs], *[F.nullif(spread(f), F.lit(0.0)).alias(f"d_{i}") for i, f in enumerate(fs)])
    )
    kind = df.schema[entity].dataType.simpleString()
    cols = [(f"{k}_{i}", t) for i in range(len(fs)) for k, t in MODEL.items()]
    kept = [(f"d_{i}", "double") for i in range(len(fs))]
    ddl = f"__e {kind}, q int, " + ", ".join(f"{c} {t}" for c, t in [*kept, *cols])
    model = first.repartition("__e").sortWithinPartitions("__e", "q").mapInPandas(_modeller(fs, min_run, BOUND), ddl)
    model = model.select("__e", "q", *[F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in [*kept, *cols]])
    model = cut_lineage(model)  # used for the pooled tail and then for the rows; one row per entity and quarter
    cuts = _cutoffs(model, fs, risk, prior, edge)
    apart = model.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"d_{i}").alias("d")) for i in range(len(fs))])).alias("x")).select("x.i", "x.d")
    usual = {r["i"]: NORMAL_80 * (r["bajo"] + r["alto"]) / 2 for r in medians(apart, ["i"], "d").collect() if r["n"] >= VERSIONS}  # one per field
    wide = model.select("__e", "q", *[F.struct(F.col(f"esperado_{i}").alias("esperado"), F.col(f"u0_{i}").alias("u0"), cuts[i].alias("corte"), F.col(f"positivo_{i}").alias("positivo"), F.col(f"congelado_{i}").alias("congelado")).alias(f"m_{f}") for i, f in enumerate(fs)])
    j = left_join(rows, wide, ["__e", "q"])

    def own(f: str) -> Column:
        v, m = F.col(f), F.col(f"m_{f}")
        resid = F.abs(F.log(F.abs(v)) - m["esperado"])
        cut = F.sqrt(m["u0"] * m["u0"] + F.lit(usual.get(fs.index(f), 0.0) ** 2)) * m["corte"]
        rule = F.when(v.isNull(), None)
        if f in positive:
            rule = rule.when(v < 0, "imposible")
        if f in strictly_positive:
            rule = rule.when(v <= 0, "imposible")
        return rule.when(v == m["congelado"], "congelado").when((v < 0) & m["positivo"], "signo").when((v != 0) & (resid > cut) & (resid >= min_change), "pico")

    reasons = {f: own(f) for f in fs}
    for f, b in bounded:  # a bound counts only where the bounding reading is itself sound
        above = (F.col(f) > F.col(b)) & reasons[b].isNull()
        reasons[f] = F.when(above, "imposible").otherwise(reasons[f])
    out = F.array(*[F.struct(F.lit(f).alias("campo"), reasons[f].alias("motivo")) for f in fs])
    flagged = j.select("__id", F.explode(F.filter(out, lambda x: x["motivo"].isNotNull())).alias("x"))
    return flagged.select(F.col("__id").alias(row_id), F.col("x.campo").alias("campo"), F.col("x.motivo").alias("motivo"))
