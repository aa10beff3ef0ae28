"""Absorbed effects against least squares on dummies, on the driver and as tables."""

from __future__ import annotations

import random

import numpy as np
import pytest

from surveyspark.operators import econ as E


@pytest.mark.parametrize("levels", [2000, 0])
@pytest.mark.parametrize("fes,weight", [(["u", "t"], None), (["u", "t", "g"], "w")])
def test_absorb(spark, levels, fes, weight, monkeypatch):
    monkeypatch.setattr(E, "LEVELS", levels)
    rnd = random.Random(len(fes))
    rows = [(u, f"p{t}", (u * 7 + t) % 5, rnd.gauss(10, 3) + u + t, rnd.gauss(0, 1e3), rnd.randint(1, 4) / 2) for u in range(12) for t in range(6) for _ in range(rnd.choice((0, 1, 1, 3))) if (u < 6) == (t < 3) or fes[-1] == "g"]
    df = spark.createDataFrame([*rows, (None, "p1", 1, 1.0, 1.0, 1.0)], "u int, t string, g int, y double, x double, w double").repartition(4)
    got = E.absorb(df, ["y", "x"], fes, weight)
    assert got.columns == df.columns
    at = {"u": 0, "t": 1, "g": 2}
    z = np.array([[float(r[at[fe]] == v) for fe in fes for v in sorted({q[at[fe]] for q in rows})] for r in rows])
    root = np.sqrt([r[5] if weight else 1.0 for r in rows])[:, None]
    m = np.array([[r[3], r[4]] for r in rows])
    left = m - z @ np.linalg.lstsq(z * root, m * root, rcond=None)[0]
    want = sorted((r[0], r[1], r[2], round(a, 6), round(b, 4)) for r, (a, b) in zip(rows, left, strict=True))
    assert [(a, b, c, pytest.approx(d, abs=2e-6), pytest.approx(e, abs=2e-4)) for a, b, c, d, e in want] == sorted((r.u, r.t, r.g, round(r.y, 6), round(r.x, 4)) for r in got.collect())
    assert E.absorb(df.limit(0), ["y"], fes, weight).count() == 0


@pytest.mark.parametrize("fes", [[], ["g"], ["g", "t"]])
def test_regressors_of_very_different_size(spark, fes):
    rnd = random.Random(5)
    rows = [(g, t, rnd.gauss(0, 1e6), rnd.gauss(0, 1e-4)) for g in range(6) for t in range(5)]
    rows = [(g, t, x, z, 1e-6 * x + 2e4 * z + g + rnd.gauss(0, 1), 0.1 * g) for g, t, x, z in rows]
    df = spark.createDataFrame(rows, "g int, t int, x double, z double, y double, flat double")
    at = {"g": 0, "t": 1}
    dummies = np.array([[1.0, *(float(r[at[fe]] == v) for fe in fes for v in range(6))] for r in rows])
    scaled = np.array([[r[2] / 1e6, r[3] * 1e4] for r in rows])
    want = np.linalg.lstsq(np.hstack([scaled, dummies]), np.array([r[4] for r in rows]), rcond=None)[0][:2] * [1e-6, 1e4]
    got = {r.term: r for r in E.fe_ols(df, "y", ["x", "z"], fes, "g").collect()}
    assert (got["x"].coef, got["z"].coef) == (pytest.approx(want[0], rel=1e-7), pytest.approx(want[1], rel=1e-7))
    if fes:  # what the effects explain has no variation left, however large the others are
        for xs in (["flat"], ["z", "flat"], ["x", "flat"]):
            with pytest.raises(ValueError, match="variation"):
                E.fe_ols(df, "y", xs, fes, "g")
