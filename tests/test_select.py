"""Selection against plain numpy: cross products, coordinate descent, plug-in penalties, logits and exact areas."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.functions.recode import pairwise
from surveyspark.operators import econ as E
from surveyspark.operators import select as L


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(7)
    n = 240
    x = rnd.standard_normal((n, 30)) + rnd.standard_normal((n, 1)) * 0.3
    x[:, 29] = 4.0  # no variation
    unit, wave = np.arange(n) % 40, np.arange(n) % 4
    d = x[:, 0] + 0.8 * x[:, 3] + rnd.standard_normal(n) + wave
    y = 0.5 * d + 2 * x[:, 3] - 1.5 * x[:, 7] + rnd.standard_normal(n) + 2 * wave
    b = (x[:, 3] - x[:, 5] + rnd.standard_normal(n) > 0).astype(int)
    w = rnd.integers(1, 4, n).astype(float)
    rows = [(int(i), int(u), int(t), float(dd), float(yy), int(bb), float(ww), v.tolist()) for i, (u, t, dd, yy, bb, ww, v) in enumerate(zip(unit, wave, d, y, b, w, x, strict=True))]
    rows += [(900, 1, 1, None, 1.0, 1, 1.0, x[0].tolist()), (901, 1, 1, 1.0, 1.0, None, 1.0, [None, *x[0, 1:].tolist()])]
    return spark.createDataFrame(rows, "id int, unit int, wave int, d double, y double, b int, w double, x array<double>").repartition(4), rows[:n]


def columns(rows):
    return np.array([r[7] for r in rows]), *(np.array([r[k] for r in rows], float) for k in (3, 4, 5, 6)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


@pytest.mark.parametrize("tile", [7, 256])
def test_tiles(data, tile):
    df, rows = data
    x, _, _, _, w, unit, _ = columns(rows)
    got = L.gram_tiles(df.filter("id < 900").withColumn("fold", F.col("unit") % 3), w="w", fold="fold", tile=tile)
    for f in range(3):
        m = x[unit % 3 == f]
        assert got[f] == pytest.approx(m.T @ (m * w[unit % 3 == f, None]))


def test_descent_meets_the_conditions():
    rnd = np.random.default_rng(1)
    for k in (1, 5, 40):
        x = rnd.standard_normal((60, k)) @ (np.eye(k) + 0.3)
        g, c, penalty = x.T @ x, x.T @ rnd.standard_normal(60) * 5, rnd.random(k) * 8
        b = L.descend(g, c, penalty)
        slope = c - g @ b
        assert np.all(np.abs(slope) <= penalty + 1e-6) and np.allclose(slope[b != 0], (penalty * np.sign(b))[b != 0], atol=1e-6)
        assert np.allclose(b, L.descend(g, c, penalty, start=rnd.standard_normal(k)), atol=1e-6)


def slow_plug_in(x, target, unit):
    n, p = x.shape
    groups = np.unique(unit)
    level = 2.2 * math.sqrt(n) * E._normal_quantile(1 - 0.1 / math.log(len(groups)) / (2 * p))
    b, kept = np.zeros(p), None
    for _ in range(15):
        e = target - x @ b
        load = np.sqrt(np.maximum(sum((x[unit == u] * e[unit == u, None]).sum(axis=0) ** 2 for u in groups) / n, 1e-20))
        for _ in range(3000):
            for j in range(p):
                s = x[:, j] @ x[:, j]
                if s > 1e-9:
                    z = x[:, j] @ (target - x @ b) + s * b[j]
                    b[j] = math.copysign(max(abs(z) - level / 2 * load[j], 0), z) / s
            if _ > 60:
                break
        now = np.flatnonzero(b).tolist()
        if now == kept:
            break
        kept = now
    return kept


def test_double_selection(data):
    df, rows = data
    x, d, y, _, _, unit, wave = columns(rows)
    off = lambda m: m - np.stack([m[wave == t].mean(axis=0) for t in range(4)])[wave]
    want = sorted(set(slow_plug_in(off(x), off(y), unit)) | set(slow_plug_in(off(x), off(d), unit)))
    fit, kept = L.double_selection(df, "y", "d", "x", "wave", "unit")
    assert kept == [str(i) for i in want] and {"3", "7", "0"} <= set(kept)
    z = off(np.column_stack([d, x[:, want]]))
    b = np.linalg.lstsq(z, off(y), rcond=None)[0]
    got = {r.term: r.coef for r in fit.collect()}
    assert got["d"] == pytest.approx(b[0]) and set(got) == {"d", *kept}


def test_post_selection(data):
    df, rows = data
    x, _, y, _, _, unit, _ = columns(rows)
    want = slow_plug_in(x - x.mean(axis=0), y - y.mean(), unit)
    assert L.post_selection(df.filter("id <> 900"), "y", "x", "unit", [f"c{i}" for i in range(30)])[1] == [f"c{i}" for i in want]


def test_logit_path(data):
    df, rows = data
    table, coef = L.logit_path(df.filter("id <> 900"), "b", "x", "unit", (0.02, 0.2), folds=3, w="w", forced=2)
    table, coef = {r.penalty: r for r in table.collect()}, [r.coef for r in coef.collect()]
    x, _, _, b, w, unit, _ = columns(rows)
    w = w / w.mean()
    mean = (x * w[:, None]).sum(axis=0) / w.sum()
    sd = np.sqrt((w[:, None] * (x - mean) ** 2).sum(axis=0) / w.sum())
    z = (x - mean) / np.where(sd > 1e-9, sd, np.inf)
    best = max(table.values(), key=lambda r: r.log_likelihood)
    assert best.chosen and sum(r.chosen for r in table.values()) == 1 and 0.5 < best.auc <= 1 and coef[29] == 0.0
    # The conditions of the penalised maximum, at the intercept that balances.
    beta = np.array(coef)
    low, high = -20.0, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (w * (b - 1 / (1 + np.exp(-(mid + z @ beta))))).sum() > 0 else (low, mid)
    slope = z.T @ (w * (b - 1 / (1 + np.exp(-(mid + z @ beta))))) / w.sum()
    penalty = np.where(np.arange(30) < 28, best.penalty, 0.0)
    assert np.all(np.abs(slope) <= penalty + 2e-4) and np.allclose(slope[beta != 0], (penalty * np.sign(beta))[beta != 0], atol=2e-4)


def test_areas(spark):
    rnd = np.random.default_rng(2)
    rows = [(int(rnd.random() < 0.4), float(rnd.integers(0, 12)), float(rnd.integers(1, 4))) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, s double, w double")
    auc, ap = L.areas(df, "y", "s", "w")
    on, off = [r for r in rows if r[0]], [r for r in rows if not r[0]]
    wins = sum(a[2] * b[2] * (1.0 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0.0) for a in on for b in off)
    assert auc == pytest.approx(wins / (sum(a[2] for a in on) * sum(b[2] for b in off)))
    up = lambda rows_, s: sum(r[2] for r in rows_ if r[1] >= s)
    steps = sorted({r[1] for r in rows}, reverse=True)
    assert ap == pytest.approx(sum(sum(r[2] for r in on if r[1] == s) * up(on, s) / up(rows, s) for s in steps) / up(on, -1))
    assert math.isnan(L.areas(df.filter("y = 1"), "y", "s")[0])


def test_pairwise(spark):
    assert spark.createDataFrame([([1.0, 2.0, 5.0],)], "x array<double>").select(pairwise(F.col("x"))).first()[0] == [1.0, 2.0, 5.0, 4.0, 10.0, 25.0]
