"""Randomisation tests against slow versions: blobs grown one by one, refits with dummies, permutations written out."""

from __future__ import annotations

import random

import numpy as np
import pytest

from surveyspark.operators import econ as E
from surveyspark.operators import spatial as G


def slow_blobs(near, units, sizes, draw, seed, tries):
    """One draw, blob by blob and round by round; None if a blob runs out of tries."""
    blobs, attempt = [[] for _ in sizes], [0] * len(sizes)
    h = lambda b, u: (int(E.hashlib.md5(f"{seed}|{draw}|{b}|{attempt[b]}|{u}".encode()).hexdigest()[:8], 16), u)
    while any(len(b) < k for b, k in zip(blobs, sizes, strict=True)):
        taken = {u for b in blobs for u in b}
        asked, asks = {}, set()
        for b, k in enumerate(sizes):
            if len(blobs[b]) >= k:
                continue
            free = {v for u in blobs[b] for v in near[u]} - taken if blobs[b] else set(units)
            if free:
                if blobs[b]:
                    asks.add(b)
                u = min(h(b, v) for v in free)[1]
                if u not in taken:
                    asked.setdefault(u, b)  # the first is the largest
        for u, b in asked.items():
            blobs[b].append(u)
        for b, k in enumerate(sizes):
            if b not in asked.values() and b not in asks and len(blobs[b]) < k:
                attempt[b] += 1
                blobs[b] = []
                if attempt[b] >= tries:
                    return None
    return [u for b in blobs for u in b]


@pytest.mark.parametrize("tries", [80, 2])
def test_blobs_have_the_treatments_shape(spark, tries):
    rnd = random.Random(3)
    side = 6
    units = list(range(side * side + 3))  # the last three touch nothing
    links = [(i, i + 1) for i in range(side * side) if i % side < side - 1] + [(i, i + side) for i in range(side * side - side)]
    near = {u: {b for a, b in links if a == u} | {a for a, b in links if b == u} for u in units}
    treated, sizes = {0, 1, 2, 6, 7, 20, 21, 26, 35, 37}, [5, 3, 1, 1]
    y = {u: rnd.gauss(0, 1) for u in units}
    df = spark.createDataFrame([(u, y[u], int(u in treated)) for u in units], "u int, y double, d int")
    got = E.ri_block_p(df, "y", "u", "d", spark.createDataFrame([*links, (5, 5), (4, 99)], "src int, dst int"), 9, seed=4, tries=tries).first()
    drawn = [slow_blobs(near, units, sizes, d, 4, tries) for d in range(9)]
    gap = lambda s: np.mean([y[u] for u in s]) - np.mean([y[u] for u in units if u not in s])
    whole = [gap(set(b)) for b in drawn if b]
    assert all(len(set(b)) == len(treated) for b in drawn if b)
    assert got.pieces == 4 and got.draws == len(whole) and got.failed == 9 - len(whole) and got.statistic == pytest.approx(gap(treated))
    assert got.p == pytest.approx((1 + sum(abs(g) >= abs(gap(treated)) for g in whole)) / (1 + len(whole)))


def panel(rnd):
    rows = []
    for u in range(24):
        level, d = rnd.gauss(0, 1), u % 3
        for p in range(6):
            for _ in range(rnd.choice((0, 1, 1, 2))):  # units are not complete, cells hold several rows
                rows.append((u, p, level + 0.2 * p * d + rnd.gauss(0, 1), d, int(u < 8), int(8 <= u < 11)))
    return rows


def slow_wald(rows, label, periods, ref, before):
    """Least squares with a dummy for every unit and group by period."""
    use = [p for p in periods if p != ref]
    units, cells = sorted({r[0] for r in rows}), sorted({(r[3], r[1]) for r in rows})
    x = np.array([[float(r[0] in label and r[1] == p) for p in use] for r in rows])
    z = np.array([[float(r[0] == u) for u in units] + [float((r[3], r[1]) == c) for c in cells] for r in rows])
    y = np.array([r[2] for r in rows])
    off = lambda m: m - z @ np.linalg.lstsq(z, m, rcond=None)[0]
    x, y = off(x), off(y)
    inverse = np.linalg.inv(x.T @ x)
    b = inverse @ x.T @ y
    score = np.array([sum((x[i] * (y[i] - x[i] @ b) for i, r in enumerate(rows) if r[0] == u), np.zeros(len(use))) for u in units])
    v = inverse @ score.T @ score @ inverse * len(units) / (len(units) - 1)
    pre = [i for i, p in enumerate(use) if p < before]
    return b[pre] @ np.linalg.pinv(v[np.ix_(pre, pre)]) @ b[pre]


@pytest.mark.parametrize("cells,draws", [(10**6, 25), (0, 2)])
def test_pretrend_is_refitted_in_every_draw(spark, cells, draws, monkeypatch):
    monkeypatch.setattr(E, "CELLS", cells)
    rows = panel(random.Random(5))
    df = spark.createDataFrame([*rows, (None, 1, 1.0, 0, 0, 0), (3, 2, None, 0, 1, 0)], "u int, t int, y double, g int, d int, other int").repartition(3)
    got = E.pretrend_ri(df, "y", "d", "u", "t", 3, 3, draws, seed=2, group="g", held="other").first()
    fit = lambda label: slow_wald(rows, label, range(6), 3, 3)
    observed = fit(set(range(8)))
    pool = [str(u) for u in range(24) if not 8 <= u < 11]
    drawn = [fit({int(u) for u in sorted(pool, key=lambda u: (E.hash_draw(2, d, u), u))[:8]}) for d in range(draws)]
    assert got.chi2 == pytest.approx(observed, rel=1e-6) and got.df == 3 and got.draws == draws and got.p_chi2 == pytest.approx(E.chi2_tail(observed, 3))
    assert got.p == pytest.approx((1 + sum(w >= observed for w in drawn)) / (1 + draws)) and got.median == pytest.approx(np.median(drawn), rel=1e-6)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 25, 40, 101])
def test_every_deal_is_a_permutation(spark, n):
    ids = spark.range(n).withColumnRenamed("id", "r")
    found = G.deals(ids, "r", n, 5, 3).collect()
    for d in range(5):
        assert sorted(r.to for r in found if r.draw == d) == list(range(n))
    assert n < 25 or len({tuple(r.to for r in sorted(found, key=lambda r: r.r) if r.draw == d) for d in range(5)}) == 5
