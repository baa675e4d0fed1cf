import itertools
import math
import random

import datetime as dt

import numpy as np
import pytest

from lumbre.operators import spikes

SCHEMA = "id long, empresa_id int, anio_fiscal int, trimestre int, fecha_filing date, revenue long, gross_profit long, shares_outstanding long, motivo string, campo int"


def rows(e, revenue, gp=None, shares=None, first=1):
    out = []
    for i, r in enumerate(revenue):
        g = gp[i] if gp else (None if r is None else int(r * 0.4))
        s = shares[i] if shares else 1_000_000 + 1000 * i
        out.append((first + i, e, 2015 + i // 4, i % 4 + 1, dt.date(2015, 1, 1) + dt.timedelta(days=91 * i), r, g, s, "x", 1))
    return out


def found(spark, data, **kw):
    df = spark.createDataFrame(data, SCHEMA)
    return {(r["id"], r["campo"], r["motivo"]) for r in spikes.flag_implausible(df, **kw).collect()}


def calm(n, seed=0, season=1.0):
    g = np.random.default_rng(seed)
    return [int(1e7 * 1.01**i * (season if i % 4 == 3 else 1) * np.exp(g.normal(0, 0.03))) for i in range(n)]


def test_single_spike_is_flagged_and_its_neighbours_are_not(spark):
    r = calm(20)
    r[9] *= 4
    assert found(spark, rows(1, r, gp=[int(x * 0.4) for x in calm(20)])) == {(10, "revenue", "pico")}


def test_recurring_peak_lasting_step_and_split_are_not_flagged(spark):
    peak = calm(20, season=1.8)
    step = [x * (3 if i >= 9 else 1) for i, x in enumerate(calm(20))]
    split = [1_000_000 * (10 if i >= 8 else 1) for i in range(20)]
    split = [x + i * 997 for i, x in enumerate(split)]
    assert found(spark, rows(1, peak) + rows(2, step, first=100, shares=split)) == set()


def test_frozen_run_counts_from_its_second_quarter_and_skips_nulls(spark):
    r = calm(16)
    r[5], r[6], r[7], r[8], r[9] = r[5], r[5], None, r[5], r[5]
    gp = [int(x * 0.4) for x in calm(16)]
    got = found(spark, rows(1, r, gp=gp))
    assert {x for x in got if x[2] == "congelado"} == {(7, "revenue", "congelado"), (9, "revenue", "congelado"), (10, "revenue", "congelado")}
    r = calm(16)
    r[6] = r[7] = r[5]  # three are too few
    assert not [x for x in found(spark, rows(1, r, gp=gp)) if x[2] == "congelado"]


def test_impossible_values(spark):
    r, sh = calm(16), [1_000_000 + 1000 * i for i in range(16)]
    gp = [int(x * 0.4) for x in r]
    r[4] = -r[4]
    sh[7] = 0
    gp[10] = int(r[10] * 1.2)
    got = found(spark, rows(1, r, gp=gp, shares=sh))
    assert {(5, "revenue", "imposible"), (8, "shares_outstanding", "imposible"), (11, "gross_profit", "imposible")} <= got
    assert not any(x[0] == 5 and x[1] == "gross_profit" for x in got)


def test_gross_profit_is_not_blamed_for_a_wrong_revenue(spark):
    r = calm(16)
    gp = [int(x * 0.4) for x in r]
    r[8] //= 1000
    assert found(spark, rows(1, r, gp=gp)) == {(9, "revenue", "pico")}


def test_opposite_sign_of_a_positive_series(spark):
    r = calm(16)
    gp = [int(x * 0.4) for x in r]
    gp[6] = -gp[6]
    assert found(spark, rows(1, r, gp=gp)) == {(7, "gross_profit", "signo")}
    assert found(spark, rows(1, r, gp=[-x // 3 for x in r])) == set()


def test_repeats_and_restatements_are_judged_by_their_own_values(spark):
    r = calm(16)
    data = rows(1, r)
    bad = list(data[8])
    bad[5] *= 1000
    bad[6] = None
    data[8] = tuple(bad)
    again = (50, *bad[1:])
    fixed = (51, 1, bad[2], bad[3], bad[4] + dt.timedelta(days=300), r[8], None, bad[7], "x", 1)
    assert found(spark, [*data, again, fixed]) == {(9, "revenue", "pico"), (50, "revenue", "pico")}


def test_zero_nulls_short_and_empty(spark):
    assert found(spark, []) == set()
    zero = [0] * 12
    assert found(spark, rows(1, zero, gp=zero)) == set()
    assert found(spark, rows(1, [None] * 8)) == set()
    assert found(spark, rows(1, [100, 105], gp=[None, None])) == set()
    loose = [(1, None, 2015, 1, None, -5, None, 0, None, None), (2, 7, None, 1, None, None, None, None, None, None)]
    assert found(spark, loose) == {(1, "revenue", "imposible"), (1, "shares_outstanding", "imposible")}


def test_hot_entity_with_many_repeats(spark):
    r = calm(16)
    r[9] *= 5
    base = rows(1, r, gp=[int(x * 0.4) for x in calm(16)])
    data = [(1000 * k + x[0], *x[1:]) for k in range(40) for x in base]
    assert found(spark, data) == {(1000 * k + 10, "revenue", "pico") for k in range(40)}


@pytest.mark.parametrize("xi", [0.01, 0.3, 0.7])
def test_moments_give_back_shape_and_scale(xi):
    g = np.random.default_rng(4)
    e = 0.8 * (g.random((1, 200_000)) ** -xi - 1) / xi
    k, m2, m3 = spikes._moments(e, bound=np.inf)
    ratio = m2[0] / m3[0]
    got = (2 * ratio - 3) / (ratio - 1)
    assert k[0] == e.size and abs(got - xi) < 0.05 and abs(m2[0] * (2 - got) - 0.8) < 0.03


def test_moments_against_all_pairs_and_triples():
    e = np.array([0.4, np.nan, -1.0, 0.9, 0.1, 7.0, 0.3])
    v = [min(x, 1.0) for x in (0.4, 0.9, 0.1, 7.0, 0.3)]
    k, m2, m3 = spikes._moments(e[None, :], bound=1.0)
    assert k[0] == 5 and np.isclose(m2[0], np.mean([min(p) for p in itertools.combinations(v, 2)])) and np.isclose(m3[0], np.mean([min(p) for p in itertools.combinations(v, 3)]))


def test_each_source_has_its_own_tail(spark):
    """The same jump is a spike in a calm series and none in a series with long tails."""
    r = random.Random(9)
    calm_, wild = [], []
    for i in range(40):
        calm_.append(1000 * (1 + 0.02 * r.uniform(-1, 1)))
        wild.append(1000 * math.exp(r.gauss(0, 0.12) * (3 if i % 5 == 0 else 1)))
    calm_[20] = wild[20] = 1550
    data = rows(1, [round(x) for x in calm_])
    data += [(100 + t[0], 2, *t[2:]) for t in rows(2, [round(x) for x in wild])]
    got = {(i, f) for i, f, m in found(spark, data) if m == "pico" and f == "revenue"}
    assert (21, "revenue") in got and not any(i > 100 for i, _ in got)
