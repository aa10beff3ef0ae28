"""Panel econometrics: absorbed fixed effects, cluster moments, bootstraps, randomisation, event studies, selection.

Bulk work is one aggregation to per-cluster cross moments (X'X, X'y, y'y, n); coefficients need their sum, and the middle of a
cluster covariance is a second small aggregation over clusters, so that only k by k numbers reach the driver. Random draws
are hashes of (seed, draw, unit) and do not depend on partitions.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyspark.sources.scratch import drop_scratch, materialize

TERMS = "term string, coef double, se double, t double, p double, n long, clusters long"


# ---- tails of distributions -------------------------------------------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else (0.0 if df > 0 else math.nan)


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, k: int) -> float:
    """Upper tail for ``k`` degrees, by recursion on k."""
    if x <= 0:
        return 1.0
    q, term = (math.exp(-x / 2), math.exp(-x / 2)) if k % 2 == 0 else (math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2))
    for i in range(2 if k % 2 == 0 else 1, k, 2):
        if k % 2 == 0:
            term *= x / i
            q += term
        else:
            q += term
            term *= x / (i + 2)
    return min(1.0, q)


# ---- fixed effects ----------------------------------------------------------------------------------------------------


def _sweep(df: DataFrame, cols: list[str], fe: str, w: str | None) -> DataFrame:
    """``cols`` less their means by ``fe``. What is left under 1e-10 of a level's largest value is the error of arithmetic and becomes 0."""
    mean = (lambda c: F.sum(F.col(c) * F.col(w)) / F.sum(w)) if w else F.avg
    means = df.groupBy(fe).agg(*[x for i, c in enumerate(cols) for x in (mean(c).alias(f"__m{i}"), (1e-10 * F.max(F.abs(c))).alias(f"__t{i}"))])
    left = {c: (F.col(c) - F.col(f"__m{i}"), F.col(f"__t{i}")) for i, c in enumerate(cols)}
    out = df.join(means, fe).withColumns({c: F.when(v.isNull() | (F.abs(v) > t) | (t == math.inf), v).otherwise(0.0) for c, (v, t) in left.items()})
    return out.drop(*[f"__{n}{i}" for n in "mt" for i in range(len(cols))])


#: Levels of all effects together up to which their cross counts are solved on the driver.
LEVELS = 2_000


def absorb(df: DataFrame, cols: list[str], fes: list[str], w: str | None = None, tol: float = 1e-13, most: int = 2000) -> DataFrame:
    """``cols`` less all fixed effects. One effect is exact in one pass; rows without a level of an effect are left out.

    With several effects rows are first collapsed to cells, one for each combination of levels. The effects that fit the cells solve
    a linear system on the graph of levels (two levels are linked by the weight of their common rows), by conjugate gradients
    scaled by each level's weight; rows are read again only once, to take the effects off. The cross counts of up to LEVELS levels
    are solved on the driver; of more, the vectors are tables in the shared folder and a step is one pass over the cells.
    """
    if len(fes) < 2:
        return _sweep(df, cols, fes[0], w) if fes else df
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    known = df.filter(reduce(lambda p, q: p & q, [F.col(fe).isNotNull() for fe in fes]))
    names = [f"__f{i}" for i in range(len(fes))]
    cells = known.groupBy(*[F.col(fe).cast("string").alias(n) for fe, n in zip(fes, names, strict=True)]).agg(F.sum(weight).alias("__n"), *[x for i, c in enumerate(cols) for x in (F.sum(weight * F.col(c)).alias(f"__c{i}"), F.max(F.abs(c)).cast("double").alias(f"__m{i}"))])
    cells = materialize(cells, "cells")
    counts = cells.agg(*[F.count_distinct(n).alias(n) for n in names], *[F.max(f"__m{i}").alias(f"__m{i}") for i in range(len(cols))]).first()
    few = sum(counts[n] for n in names) <= LEVELS
    effects = _effects_of_few(cells, names, len(cols), tol, most) if few else _effects_of_many(cells, names, len(cols), tol, most)
    out = known
    for i, fe in enumerate(fes):
        mine = effects.filter(F.col("fe") == i).select(F.col("level").alias(f"__l{i}"), *[F.col(f"x{j}").alias(f"__e{i}_{j}") for j in range(len(cols))])
        out = out.join(F.broadcast(mine) if few else mine, F.col(fe).cast("string") == F.col(f"__l{i}"))
    least = [1e-10 * m if (m := counts[f"__m{j}"] or 0.0) < math.inf else 0.0 for j in range(len(cols))]  # not a number is not below
    left = {c: F.col(c) - reduce(lambda p, q: p + q, [F.col(f"__e{i}_{j}") for i in range(len(fes))]) for j, c in enumerate(cols)}
    # What is left under 1e-10 of the largest value is the error of arithmetic: a column that the effects explain becomes 0.
    out = out.withColumns({c: F.when(F.abs(v) > least[j], v).when(F.col(c).isNotNull(), 0.0) for j, (c, v) in enumerate(left.items())})
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def _sums_by_level(cells: DataFrame, names: list[str], sums: dict[str, Column]) -> DataFrame:
    """(fe, level, sums) over the cells of each level of each effect, in one pass."""
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("fe"), F.col(n).alias("level")) for i, n in enumerate(names)]))
    return cells.select(rows, *[v.alias(k) for k, v in sums.items()]).groupBy("fe", "level").agg(*[F.sum(k).alias(k) for k in sums])


def _effects_of_few(cells: DataFrame, names: list[str], k: int, tol: float, most: int) -> DataFrame:
    """(fe, level, x0 ..): the effects, from cross counts of at most LEVELS levels."""
    own = _sums_by_level(cells, names, {"n": F.col("__n"), **{f"c{j}": F.col(f"__c{j}") for j in range(k)}}).orderBy("fe", "level").toPandas()
    place = {key: i for i, key in enumerate(zip(own["fe"], own["level"], strict=True))}
    a = np.diag(own["n"].to_numpy(float))
    for i in range(len(names)):
        for j in range(i):
            for r in cells.groupBy(names[i], names[j]).agg(F.sum("__n").alias("n")).collect():  # pairs of levels
                a[place[i, r[0]], place[j, r[1]]] = a[place[j, r[1]], place[i, r[0]]] = r["n"]
    x = np.zeros((len(own), k))
    scale = np.where(np.diag(a) > 0, np.diag(a), 1.0)
    for j in range(k):
        r = own[f"c{j}"].to_numpy(float)
        z = r / scale
        p, rz, first = z.copy(), float(r @ z), float(r @ z)
        for _ in range(most):
            if rz <= tol * tol * first:
                break
            ap = a @ p
            step = rz / float(p @ ap)
            x[:, j] += step * p
            r = r - step * ap
            z = r / scale
            rz, before = float(r @ z), rz
            p = z + rz / before * p
        if rz > 1e-18 * first:
            raise RuntimeError(f"fixed effects did not settle in {most} steps")
    rows = [(int(f), str(v), *map(float, e)) for f, v, e in zip(own["fe"], own["level"], x, strict=True)]
    return cells.sparkSession.createDataFrame(rows, "fe int, level string, " + ", ".join(f"x{j} double" for j in range(k)))


def _effects_of_many(cells: DataFrame, names: list[str], k: int, tol: float, most: int) -> DataFrame:
    """The same for any number of levels: solution, residual and direction of all columns are one table, a row a level."""
    key, ks = ["fe", "level"], range(k)
    scaled = lambda j: F.coalesce(F.col(f"r{j}") / F.nullif(F.col("n"), F.lit(0.0)), F.lit(0.0))
    now = _sums_by_level(cells, names, {"n": F.col("__n"), **{f"r{j}": F.col(f"__c{j}") for j in ks}})
    now = materialize(now.select(*key, "n", *[x for j in ks for x in (F.lit(0.0).alias(f"x{j}"), F.col(f"r{j}"), scaled(j).alias(f"p{j}"))]), "levels")
    dot = lambda df: [v or 0.0 for v in df.agg(*[F.sum(F.col(f"r{j}") * scaled(j)) for j in ks]).first()]
    rz = first = dot(now)
    for _ in range(most):
        if all(rz[j] <= tol * tol * first[j] for j in ks):
            return now.select(*key, *[f"x{j}" for j in ks])
        rows = cells
        for i, name in enumerate(names):
            mine = now.filter(F.col("fe") == i).select(F.col("level").alias(name), *[F.col(f"p{j}").alias(f"__p{i}_{j}") for j in ks])
            rows = rows.join(mine, name)
        ap = _sums_by_level(rows, names, {f"a{j}": F.col("__n") * reduce(lambda p, q: p + q, [F.col(f"__p{i}_{j}") for i in range(len(names))]) for j in ks})
        both = materialize(now.join(ap, key), "levels")
        pap = both.agg(*[F.sum(F.col(f"p{j}") * F.col(f"a{j}")) for j in ks]).first()
        step = [rz[j] / pap[j] if rz[j] > tol * tol * first[j] and pap[j] else 0.0 for j in ks]
        moved = both.select(*key, "n", *[x for j in ks for x in ((F.col(f"x{j}") + step[j] * F.col(f"p{j}")).alias(f"x{j}"), (F.col(f"r{j}") - step[j] * F.col(f"a{j}")).alias(f"r{j}"), F.col(f"p{j}"))])
        after = dot(moved)
        turn = [after[j] / rz[j] if step[j] else 0.0 for j in ks]
        following = materialize(moved.select(*key, "n", *[x for j in ks for x in (F.col(f"x{j}"), F.col(f"r{j}"), (scaled(j) + turn[j] * F.col(f"p{j}")).alias(f"p{j}"))]), "levels")
        drop_scratch(now, both)
        now, rz = following, [after[j] if step[j] else rz[j] for j in ks]
    raise RuntimeError(f"fixed effects did not settle in {most} steps")


def within2(df: DataFrame, unit: str, t: str, cols: list[str]) -> DataFrame:
    """Two-way within transform of a balanced panel, in closed form."""
    over = lambda c, *k: F.avg(c).over(Window.partitionBy(*k))
    grand = df.agg(*[F.avg(c).alias(f"__g_{c}") for c in cols])
    joined = df.crossJoin(F.broadcast(grand))  # one row
    return joined.withColumns({c: F.col(c) - over(c, unit) - over(c, t) + F.col(f"__g_{c}") for c in cols}).drop(*[f"__g_{c}" for c in cols])


def absorb_weighted2(df: DataFrame, cols: list[str], unit: str, cell: list[str], w: str) -> DataFrame:
    """Unit means taken off, then weighted means of cells (group by period)."""
    one = df.withColumns({c: F.col(c) - F.avg(c).over(Window.partitionBy(unit)) for c in cols})
    by = Window.partitionBy(*cell)
    return one.withColumns({c: F.col(c) - F.sum(F.col(c) * F.col(w)).over(by) / F.sum(w).over(by) for c in cols})


def components(edges: DataFrame, src: str, dst: str, most: int = 100) -> DataFrame:
    """(node, component) by handing on the smallest label and following labels of labels, until none moves."""
    both = edges.select(F.col(src).alias("node"), F.col(dst).alias("other")).union(edges.select(dst, src)).filter("node IS NOT NULL AND other IS NOT NULL").distinct()
    both = materialize(both, "graph")
    labels = materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("c"))
        after = materialize(step.join(jump, "component", "left").select("node", "old", F.least("component", "c").alias("component")), "labels")
        moved = after.filter("old <> component").limit(1).count()
        drop_scratch(labels)
        labels = after.drop("old")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def dummy_rank(df: DataFrame, fes: list[str]) -> int:
    """Rank of the dummies: levels, less one for each connected part of the two effects' graph (more effects: one each). Pairs of up to LEVELS levels are joined on the driver."""
    levels = df.agg(*[F.count_distinct(c).alias(f"__{i}") for i, c in enumerate(fes)]).first() if fes else []
    if len(fes) < 2:
        return sum(levels)
    edge = df.select(F.concat(F.lit("a"), F.col(fes[0]).cast("string")).alias("a"), F.concat(F.lit("b"), F.col(fes[1]).cast("string")).alias("b")).distinct()
    if sum(levels[:2]) <= LEVELS:
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for r in edge.na.drop().collect():  # pairs of levels
            parent[root(r.a)] = root(r.b)
        parts = sum(root(x) == x for x in list(parent))
    else:
        parts = components(edge, "a", "b").agg(F.count_distinct("component")).first()[0]
    return sum(levels) - parts - max(0, len(fes) - 2)


# ---- moments and fits -------------------------------------------------------------------------------------------------


def moments(df: DataFrame, y: str, xs: list[str], cluster: str, w: str | None = None) -> DataFrame:
    """One row a cluster: a_i_j = X'X, c_i = X'y, yy, n. One aggregation with a partial sum before the shuffle."""
    weight = F.col(w) if w else F.lit(1.0)
    k = range(len(xs))
    x = [F.col(c).cast("double") for c in xs]
    cells = [F.sum(weight * x[i] * x[j]).alias(f"a_{i}_{j}") for i in k for j in k if i <= j]
    return df.groupBy(F.col(cluster).alias("cluster")).agg(*cells, *[F.sum(weight * x[i] * F.col(y)).alias(f"c_{i}") for i in k], F.sum(weight * F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n"))


def _square(row, k: int, name: str = "a") -> np.ndarray:
    return np.array([[row[f"{name}_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)


def solve(m: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(X'X inverse, coefficients, n, clusters) from summed moments; a regressor without variation raises."""
    row = m.agg(*[F.sum(c).alias(c) for c in m.columns if c != "cluster"], F.count("*").alias("g")).first()
    a, c = _square(row, k), np.array([row[f"c_{i}"] for i in range(k)], float)
    # Each regressor is measured by its own size, so that the unit of one does not hide another.
    size = np.sqrt(np.maximum(np.diag(a), 0.0))
    if not (size > 0).all() or np.linalg.matrix_rank(unit := a / np.outer(size, size), tol=1e-10) < k:
        raise ValueError("a regressor has no variation left")
    inverse = np.linalg.inv(unit) / np.outer(size, size)
    return inverse, inverse @ c, int(row["n"]), int(row["g"])


def cluster_vcov(m: DataFrame, inverse: np.ndarray, b: np.ndarray, kind: str = "CR1", n: int = 0, g: int = 0, rank: int = 0) -> np.ndarray:
    """Cluster covariance; the middle is summed over clusters in Spark. CR1 has the n - k factor, CR1S has only G/(G-1), CR0 none."""
    k = len(b)
    score = [F.col(f"c_{i}") - reduce(lambda p, q: p + q, [F.col(f"a_{min(i, j)}_{max(i, j)}") * float(b[j]) for j in range(k)]) for i in range(k)]
    row = m.select(*[s.alias(f"s_{i}") for i, s in enumerate(score)]).agg(*[F.sum(F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"m_{i}_{j}") for i in range(k) for j in range(k) if i <= j]).first()
    factor = {"CR0": 1.0, "CR1S": g / (g - 1)}.get(kind, g / (g - 1) * (n - 1) / max(1, n - rank - k)) if g > 1 else math.nan
    return factor * inverse @ _square(row, k, "m") @ inverse


def table(df: DataFrame, names: list[str], b: np.ndarray, v: np.ndarray, n: int, g: int) -> DataFrame:
    rows = []
    for i, name in enumerate(names):
        se = math.sqrt(max(v[i, i], 0.0)) if math.isfinite(v[i, i]) else math.nan
        t = float(b[i]) / se if se else math.nan
        rows.append((name, float(b[i]), se, t, t_tail(t, g - 1), n, g))
    return df.sparkSession.createDataFrame(rows, TERMS)


def fe_ols(df: DataFrame, y: str, xs: list[str], fes: list[str], cluster: str, w: str | None = None, kind: str = "CR1", extra: bool = False):
    """Least squares with absorbed effects and clustered errors: the table of terms (with ``extra`` also moments, coefficients, covariance).

    Rows with a null in any column used are left out. Without ``fes`` a constant is taken off. The columns used are written once,
    since rows are read several times, so that what makes ``df`` runs once.
    """
    held = list(dict.fromkeys([*fes, cluster, *([w] if w else [])]))
    keep = df.select(*dict.fromkeys([y, *xs, *held])).na.drop().select(*held, *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate([y, *xs])])
    keep = rows = materialize(keep, "fit")
    effects = fes or ["__all"]
    if not fes:
        keep = keep.withColumn("__all", F.lit(1))
    cols = [f"__v{i}" for i in range(len(xs) + 1)]
    m = materialize(moments(absorb(keep, cols, effects, w), cols[0], cols[1:], cluster, w), "moments")
    rank = dummy_rank(keep, fes) if fes else 1
    drop_scratch(rows)
    inverse, b, n, g = solve(m, len(xs))
    v = cluster_vcov(m, inverse, b, kind, n, g, rank)
    out = table(df, xs, b, v, n, g)
    return (out, m, b, v) if extra else out


def wls(df: DataFrame, y: str, xs: list[str], w: str, cluster: str) -> DataFrame:
    return fe_ols(df, y, xs, [], cluster, w)


# ---- designs ----------------------------------------------------------------------------------------------------------


def did(df: DataFrame, y: str, treat: str, unit: str, t: str, t0, cluster: str, w: str | None = None) -> DataFrame:
    """Difference in differences, binary or continuous treatment from period ``t0``."""
    return fe_ols(df.withColumn("treat_post", F.col(treat).cast("double") * (F.col(t) >= t0).cast("double")), y, ["treat_post"], [unit, t], cluster, w)


def event_study(df: DataFrame, y: str, treat: str, unit: str, t: str, periods: list, ref, cluster: str, extra: bool = False):
    """A coefficient for each period against ``ref``."""
    terms = {f"treat_{p}": F.col(treat).cast("double") * (F.col(t) == p).cast("double") for p in periods if p != ref}
    return fe_ols(df.withColumns(terms), y, list(terms), [unit, t], cluster, extra=extra)


def event_groups(df: DataFrame, y: str, groups: list[str], unit: str, t: str, periods: list, ref, cluster: str) -> DataFrame:
    terms = {f"{g}_{p}": F.col(g).cast("double") * (F.col(t) == p).cast("double") for g in groups for p in periods if p != ref}
    return fe_ols(df.withColumns(terms), y, list(terms), [unit, t], cluster)


def rings_did(df: DataFrame, y: str, distance: str, edges: list[float], unit: str, t: str, t0, cluster: str) -> DataFrame:
    """Distance rings against the farthest."""
    post = (F.col(t) >= t0).cast("double")
    inside = lambda a, b: ((F.col(distance) >= a) & (F.col(distance) < b)).cast("double")
    terms = {f"ring_{i}": inside(a, b) * post for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))}
    return fe_ols(df.withColumns(terms), y, list(terms), [unit, t], cluster)


def twfe(df: DataFrame, y: str, treats: list[str], unit: str, t: str, cluster: str, block: str | None = None) -> DataFrame:
    """Staggered on/off treatment, pooled and, with ``block``, for each block alone."""
    df = materialize(df.select(*dict.fromkeys([y, *treats, unit, t, cluster, *([block] if block else [])])), "panel")
    out = fe_ols(df, y, treats, [unit, t], cluster).withColumn("block", F.lit("pooled"))
    for r in df.select(block).distinct().orderBy(block).collect() if block else []:  # a few named blocks
        out = out.unionAll(fe_ols(df.filter(F.col(block) == r[0]), y, treats, [unit, t], cluster).withColumn("block", F.lit(str(r[0]))))
    return out


def seasonal(df: DataFrame, y: str, month: str, ref: int, fes: list[str], cluster: str, controls: list[str] = ()) -> DataFrame:
    """Calendar-month contrasts against ``ref``."""
    terms = {f"month_{m}": (F.col(month) == m).cast("double") for m in range(1, 13) if m != ref}
    return fe_ols(df.withColumns(terms), y, [*terms, *controls], fes, cluster)


def ancova(df: DataFrame, y: str, unit: str, t: str, base, treat: str, fe: str, cluster: str) -> DataFrame:
    """Later periods with the baseline outcome as a control and group effects."""
    first = F.max(F.when(F.col(t) == base, F.col(y))).over(Window.partitionBy(unit))
    return fe_ols(df.withColumn("baseline", first).filter(F.col(t) > base).withColumn("treated", F.col(treat).cast("double")), y, ["treated", "baseline"], [fe], cluster)


def long_diff_reg(df: DataFrame, unit: str, t: str, a, b, y: str, x: str, fe: str, cluster: str) -> DataFrame:
    """Change of ``y`` on change of ``x`` between two periods, with group effects."""
    at = lambda c, p: F.max(F.when(F.col(t) == p, F.col(c)))
    wide = df.groupBy(unit, fe, *([cluster] if cluster not in (unit, fe) else [])).agg((at(y, b) - at(y, a)).alias("d_y"), (at(x, b) - at(x, a)).alias("d_x"))
    return fe_ols(wide, "d_y", ["d_x"], [fe], cluster)


def shift_share_reg(df: DataFrame, unit: str, t: str, y: str, exposure: str, controls: list[str], cluster: str) -> DataFrame:
    """Stacked first differences on the change of exposure, controls by period."""
    rows = Window.partitionBy(unit).orderBy(t)
    d = df.withColumns({"d_y": F.col(y) - F.lag(y).over(rows), "d_exposure": F.col(exposure) - F.lag(exposure).over(rows)})
    return fe_ols(d, "d_y", ["d_exposure", *controls], [t], cluster)


def cohort_design(df: DataFrame, y: str, cohort: str, last_unexposed: int, years: int, treat: str, fes: list[str], cluster: str, w: str | None = None) -> DataFrame:
    from surveyspark.functions.recode import exposure

    return fe_ols(df.withColumn("exposed", exposure(F.col(cohort), last_unexposed, years) * F.col(treat).cast("double")), y, ["exposed"], fes, cluster, w)


def cohort_event_study(df: DataFrame, y: str, cohort: str, edges: list, ref: int, treat: str, fes: list[str], cluster: str, controls: list[str] = (), w: str | None = None) -> DataFrame:
    """Effect of treatment in each bin of cohorts (from edge to edge, the first ``ref``-th bin omitted); ``controls`` interact with every bin too."""
    inside = lambda i: ((F.col(cohort) >= edges[i]) & (F.col(cohort) < edges[i + 1])).cast("double")
    bins = [i for i in range(len(edges) - 1) if i != ref]
    rows = df.filter((F.col(cohort) >= edges[0]) & (F.col(cohort) < edges[-1]))
    terms = {f"bin_{edges[i]}": inside(i) * F.col(treat).cast("double") for i in bins}
    terms |= {f"{c}_{edges[i]}": inside(i) * F.col(c).cast("double") for c in controls for i in bins}
    return fe_ols(rows.withColumns(terms), y, list(terms), fes, cluster, w)


def wage_gaps(df: DataFrame, wage: str, group: str, base, cell: list[str], cluster: str, w: str | None = None) -> DataFrame:
    """Log wage gaps of groups against ``base`` with effects for cells."""
    values = [r[0] for r in df.select(group).distinct().orderBy(group).collect() if r[0] not in (None, base)]  # groups are few
    terms = {f"{group}_{v}": (F.col(group) == v).cast("double") for v in values}
    rows = df.filter(F.col(wage) > 0).withColumns({**terms, "log_wage": F.log(wage), "cell": F.concat_ws("_", *cell)})
    return fe_ols(rows, "log_wage", list(terms), ["cell"], cluster, w)


def balance(df: DataFrame, treat: str, cols: list[str], cluster: str) -> DataFrame:
    """Treated and control means, difference and clustered error of each column, all from one pass over long rows."""
    long = df.select(F.col(cluster).alias("cluster"), F.col(treat).cast("double").alias("d"), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(["cluster", "d"], cols, "column", "v").na.drop()
    g = long.groupBy("column", "cluster").agg(F.count("*").alias("n"), F.sum("d").alias("d"), F.sum("v").alias("v"), F.sum(F.col("d") * F.col("v")).alias("dv"))
    tot = g.groupBy("column").agg(F.sum("n").alias("all_n"), F.sum("d").alias("all_d"), F.sum("v").alias("all_v"), F.sum("dv").alias("all_dv"), F.count("*").alias("all_g"))
    tot = tot.select("column", "all_n", "all_g", (F.col("all_dv") / F.col("all_d")).alias("treated"), ((F.col("all_v") - F.col("all_dv")) / (F.col("all_n") - F.col("all_d"))).alias("control"), (F.col("all_d") / F.col("all_n")).alias("dbar"))
    j = g.join(tot, "column")
    # score of a cluster: sum of (d - dbar) * (v - control - difference * d)
    diff = F.col("treated") - F.col("control")
    s = F.col("dv") - F.col("control") * F.col("d") - diff * F.col("d") - F.col("dbar") * (F.col("v") - F.col("control") * F.col("n") - diff * F.col("d"))
    meat = j.withColumn("s", s).groupBy("column", "all_n", "all_g", "treated", "control", "dbar").agg(F.sum(F.col("s") * F.col("s")).alias("meat"))
    sxx = F.col("all_n") * F.col("dbar") * (1 - F.col("dbar"))
    factor = F.col("all_g") / (F.col("all_g") - 1) * (F.col("all_n") - 1) / (F.col("all_n") - 2)
    return meat.select("column", "treated", "control", diff.alias("difference"), (F.sqrt(factor * F.col("meat")) / sxx).alias("se"))


# ---- draws ------------------------------------------------------------------------------------------------------------


def draw(seed: int, number: Column, *key: Column) -> Column:
    """A uniform integer below 2**32 from the draw's number and a key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), number.cast("string"), *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("long")


def hash_draw(seed: int, number: int, key) -> int:
    return int(hashlib.md5(f"{seed}|{number}|{key}".encode()).hexdigest()[:8], 16)


WEBB = np.array([-math.sqrt(1.5), -1.0, -math.sqrt(0.5), math.sqrt(0.5), 1.0, math.sqrt(1.5)])
#: Clusters up to which all sign vectors are taken.
ENUMERATE = 12


def wild_p(m: DataFrame, names: list[str], terms: list[str], draws: int = 9999, weights: str = "webb", seed: int = 1, rank: int = 0) -> DataFrame:
    """(term, t, p, draws): wild cluster bootstrap with the null imposed, from cluster moments alone.

    Clusters stay distributed, each in one task with all draws. For a term let h be its row of (X'X)^-1; a cluster has the null
    score r, q = h'r, u = X'X_g h and a draw's weight w. The draw moves the coefficients by d = (X'X)^-1 sum(w r), and the middle
    of the term's variance is sum(w^2 q^2) - 2 d'sum(w q u) + d'sum(u u')d. So 2k + 1 sums a draw and term are all that tasks
    hold, add up and shuffle. With Rademacher weights and few clusters every sign vector is taken once.
    """
    k, spark = len(names), m.sparkSession
    inverse, b, n, g = solve(m, k)
    factor = g / (g - 1) * (n - 1) / max(1, n - rank - k)
    full = weights == "rademacher" and g <= ENUMERATE
    place = {str(r[0]): i for i, r in enumerate(m.select(F.col("cluster").cast("string")).collect())} if full else {}  # at most ENUMERATE rows
    number = 2**g if full else draws
    spread = cluster_vcov(m, inverse, b, "CR1", n, g, rank)
    observed, null, cross = [], [], []
    for x in terms:
        j = names.index(x)
        observed.append(b[j] / math.sqrt(spread[j, j]) if spread[j, j] > 0 else math.inf)
        null.append(b - inverse[:, j] / inverse[j, j] * b[j])  # least squares without the term
        u = [reduce(lambda p, q: p + q, [F.col(f"a_{min(i, o)}_{max(i, o)}") * float(inverse[j, o]) for o in range(k)]) for i in range(k)]
        row = m.select(*[c.alias(f"u_{i}") for i, c in enumerate(u)]).agg(*[F.sum(F.col(f"u_{i}") * F.col(f"u_{o}")).alias(f"a_{i}_{o}") for i in range(k) for o in range(i, k)]).first()
        cross.append(_square(row, k))

    def signs(ids) -> np.ndarray:
        """draws x clusters"""
        if full:
            return 1.0 - 2.0 * (np.arange(number)[:, None] >> np.array([place[x] for x in ids]) & 1)
        drawn = np.array([[hash_draw(seed, d, x) for x in ids] for d in range(number)])
        return 2.0 * (drawn & 1) - 1.0 if weights == "rademacher" else WEBB[drawn % 6]

    def add(batches):
        sums = np.zeros((len(terms), number, 2 * k + 1))
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.iloc[start : start + 64]
                a = np.stack([np.stack([part[f"a_{min(i, o)}_{max(i, o)}"] for o in range(k)], 1) for i in range(k)], 1)
                c, wt = np.stack([part[f"c_{i}"] for i in range(k)], 1), signs([str(x) for x in part["cluster"]])
                for i, x in enumerate(terms):
                    h = inverse[names.index(x)]
                    r, u = c - a @ null[i], a @ h
                    q = r @ h
                    sums[i] += np.concatenate([wt @ r, (wt * wt) @ (q * q)[:, None], wt @ (q[:, None] * u)], 1)
        for i in range(len(terms)):
            yield pd.DataFrame({"i": i, "draw": np.arange(number), **{f"s_{o}": sums[i, :, o] for o in range(2 * k + 1)}})

    def exceeds(batches):
        for batch in batches:
            s = batch[cells].to_numpy()
            for i in np.unique(batch["i"]):
                j, at = names.index(terms[i]), s[(batch["i"] == i).to_numpy()]
                d = at[:, :k] @ inverse
                v = factor * (at[:, k] - 2 * (d * at[:, k + 1 :]).sum(1) + ((d @ cross[i]) * d).sum(1))
                t = np.where(v > 0, np.abs(d[:, j]) / np.sqrt(np.where(v > 0, v, 1.0)), math.inf)
                yield pd.DataFrame({"i": i, "exceeds": (t >= abs(observed[i]) * (1 - 1e-9)).astype(float)})

    cells = [f"s_{o}" for o in range(2 * k + 1)]
    tasks = max(1, min(g, spark.sparkContext.defaultParallelism))
    dealt = m.withColumn("cluster", F.col("cluster").cast("string")).repartition(tasks, "cluster")
    summed = dealt.mapInPandas(add, "i int, draw long, " + ", ".join(f"{c} double" for c in cells)).groupBy("i", "draw").agg(*[F.sum(c).alias(c) for c in cells])
    hits = summed.mapInPandas(exceeds, "i int, exceeds double").groupBy("i").agg(F.avg("exceeds").alias("p"), F.count("*").alias("draws"))
    return hits.join(spark.createDataFrame([(i, x, float(t)) for i, (x, t) in enumerate(zip(terms, observed))], "i int, term string, t double"), "i").select("term", "t", "p", "draws")


def relabelled(units: DataFrame, unit: str, draws: int, k: int, seed: int) -> DataFrame:
    """The ``k`` units of least hash of each draw, with the ``draw``. Only hashes small enough to be among them are sorted; if a draw has too few of these, all are."""
    n = units.count()
    every = units.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("__h", draw(seed, F.col("draw"), F.col(unit)))
    near = every.filter(F.col("__h") < int(min(1.0, (k + 6 * math.sqrt(k) + 20) / max(n, 1)) * 2**32))
    enough = near.groupBy("draw").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") >= k)).first()[0]
    order = Window.partitionBy("draw").orderBy("__h", unit)
    rows = near if enough == draws else every
    return rows.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k).drop("__r", "__h")


def ri_p(df: DataFrame, y: str, unit: str, treat: str, draws: int, seed: int = 1) -> DataFrame:
    """(statistic, p, draws): difference of means of unit averages, treated units relabelled at random.

    Units are ranked within each draw by their hash; the first as many as are treated take the label, and the others' sums are what is left of all. p = (1 + hits) / (1 + draws).
    """
    units = materialize(df.groupBy(unit).agg(F.avg(y).alias("__y"), F.max(F.col(treat).cast("int")).alias("__d")), "units")
    k = units.agg(F.sum("__d")).first()[0] or 0
    on = F.col("__d") == 1
    observed = units.agg((F.avg(F.when(on, F.col("__y"))) - F.avg(F.when(~on, F.col("__y")))).alias("statistic"), F.sum("__y").alias("__sum"), F.count("__y").alias("__n"))  # one row
    picked = relabelled(units, unit, draws, int(k), seed).groupBy("draw").agg(F.sum("__y").alias("s1"), F.count("__y").alias("n1"))
    stats = picked.crossJoin(F.broadcast(observed)).withColumn("s", F.col("s1") / F.col("n1") - (F.col("__sum") - F.col("s1")) / (F.col("__n") - F.col("n1")))
    hits = stats.agg(F.first("statistic").alias("statistic"), F.count_if(F.abs("s") >= F.abs("statistic") - 1e-12).alias("hits"), F.count("*").alias("draws"))
    return hits.select("statistic", ((1 + F.col("hits")) / (1 + F.col("draws"))).alias("p"), "draws")


def ri_block_p(df: DataFrame, y: str, unit: str, treat: str, adjacency: DataFrame, draws: int, seed: int = 1, tries: int = 80) -> DataFrame:
    """(statistic, p, draws, failed, pieces): randomisation over placebos of the treatment's own shape.

    The treated units fall into connected pieces of ``adjacency`` (src, dst). A draw grows as many connected blobs of the same sizes,
    none over another: each blob starts at the unit of least hash and in every round takes the neighbour of least hash that no
    blob of the draw has; of blobs that want the same unit the larger piece gets it. A blob that starts on a taken unit or has no
    free neighbour left starts again with other hashes; a draw whose blob has started ``tries`` times is left out and counted in
    ``failed``. All draws grow at once, a unit a blob and round; each round is written.
    """
    units = materialize(df.groupBy(unit).agg(F.avg(y).alias("__y"), F.max(F.col(treat).cast("int")).alias("__d")), "units")
    names = units.select(F.col(unit).alias("dst"))
    near = adjacency.select("src", "dst").union(adjacency.select("dst", "src")).filter("src <> dst").distinct().join(names, "dst", "left_semi")
    near = materialize(near.join(names.withColumnRenamed("dst", "src"), "src", "left_semi"), "near")
    on = units.filter("__d = 1").select(F.col(unit).alias("node"))
    inner = near.join(on.withColumnRenamed("node", "src"), "src", "left_semi").join(on.withColumnRenamed("node", "dst"), "dst", "left_semi")
    piece = on.join(components(inner, "src", "dst"), "node", "left").groupBy(F.coalesce("component", "node").alias("piece")).count()
    sizes = sorted((r["count"] for r in piece.collect()), reverse=True)  # a row a piece of the treatment
    key = ["draw", "blob"]
    shape = df.sparkSession.createDataFrame([(i, int(k)) for i, k in enumerate(sizes)], "blob int, size long")
    wanted = materialize(shape.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("attempt", F.lit(0)), "wanted")
    placed = materialize(wanted.select(*key, F.lit(None).cast(names.schema["dst"].dataType).alias(unit)).limit(0), "placed")
    least = lambda rows: rows.groupBy(*key, "attempt").agg(F.min(F.struct(draw(seed, F.col("draw"), F.col("blob"), F.col("attempt"), F.col(unit)).alias("h"), F.col(unit).alias("u")))["u"].alias(unit))
    while True:
        state = materialize(wanted.join(placed.groupBy(*key).count(), key, "left").fillna(0, ["count"]).filter("count < size"), "state")
        if not state.limit(1).count():
            break
        waiting = state.filter("count = 0").agg(F.collect_list(F.struct(*key, "attempt")).alias("all"))  # a row a draw and blob
        starts = units.select(unit).crossJoin(F.broadcast(waiting)).select(unit, F.inline("all"))  # one row
        around = state.filter("count > 0").select(*key, "attempt").join(placed, key).select(*key, "attempt", F.col(unit).alias("src")).join(near, "src").select(*key, "attempt", F.col("dst").alias(unit)).distinct()
        free = around.join(placed.select("draw", unit), ["draw", unit], "left_anti")
        asked = least(starts).unionByName(least(free)).join(placed.select("draw", unit), ["draw", unit], "left_anti")
        got = materialize(asked.groupBy("draw", unit).agg(F.min("blob").alias("blob")).select(*key, unit), "got")
        # Who asked for nothing that is free starts again; who only lost a neighbour to a larger piece asks again.
        has = got.select(*key, F.lit(True).alias("__got"))
        asks = free.select(*key).distinct().withColumn("__asks", F.lit(True))
        again = state.join(has, key, "left").join(asks, key, "left").filter("__got IS NULL AND __asks IS NULL").select(*key, F.lit(1).alias("__more"))
        again = materialize(again, "again")
        lost = wanted.join(again, key).filter(F.col("attempt") + 1 >= tries).select("draw").distinct()
        following = materialize(wanted.join(again, key, "left").withColumn("attempt", F.col("attempt") + F.coalesce("__more", F.lit(0))).drop("__more").join(lost, "draw", "left_anti"), "wanted")
        grown = materialize(placed.unionByName(got).join(again, key, "left_anti").join(lost, "draw", "left_anti"), "placed")
        drop_scratch(wanted, placed, state, got, again)
        wanted, placed = following, grown
    sums = placed.join(units, unit).groupBy("draw").agg(F.sum("__y").alias("s"), F.count("*").alias("n"))
    all_ = units.agg(F.sum("__y").alias("all_y"), F.count("*").alias("all_n"), (F.avg(F.when(F.col("__d") == 1, F.col("__y"))) - F.avg(F.when(F.col("__d") == 0, F.col("__y")))).alias("statistic"))
    stats = sums.crossJoin(F.broadcast(all_)).withColumn("g", F.col("s") / F.col("n") - (F.col("all_y") - F.col("s")) / (F.col("all_n") - F.col("n")))
    hits = stats.agg(F.first("statistic").alias("statistic"), F.count_if(F.abs("g") >= F.abs("statistic") - 1e-12).alias("hits"), F.count("*").alias("draws"))
    return hits.select("statistic", ((1 + F.col("hits")) / (1 + F.col("draws"))).alias("p"), "draws", (F.lit(draws) - F.col("draws")).alias("failed"), F.lit(len(sizes)).alias("pieces"))


def pretrend(df: DataFrame, y: str, treat: str, unit: str, t: str, periods: list, ref, before, cluster: str) -> DataFrame:
    """Joint test that coefficients before ``before`` are 0, from the full covariance: (chi2, df, p)."""
    _, _, b, v = event_study(df, y, treat, unit, t, periods, ref, cluster, extra=True)
    at = [i for i, p in enumerate(q for q in periods if q != ref) if p < before]
    stat = float(b[at] @ np.linalg.pinv(v[np.ix_(at, at)]) @ b[at])
    return df.sparkSession.createDataFrame([(stat, len(at), chi2_tail(stat, len(at)))], "chi2 double, df int, p double")


class EffectCells:
    """Cells of units and periods, on which any column of treated-by-period dummies is known: projections run on cells, not on rows.

    ``unit`` and ``cell`` (group by period) number the two absorbed effects of each cell, ``period`` its period; ``n`` rows have the mean ``y``.
    """

    def __init__(self, unit: np.ndarray, cell: np.ndarray, period: np.ndarray, n: np.ndarray, y: np.ndarray, use: list[int], pre: list[int]) -> None:
        self.unit, self.cell, self.period, self.n, self.use, self.pre = unit, cell, period, n.astype(float), use, pre
        self.y = self.absorb(y[:, None])[:, 0]

    def _sums(self, of: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(of, m[:, j]) for j in range(m.shape[1])], axis=1)

    def absorb(self, m: np.ndarray, tol: float = 1e-11, most: int = 5000) -> np.ndarray:
        m, weights = m.astype(float), [np.bincount(of, self.n) for of in (self.unit, self.cell)]
        limit = tol * max(1.0, float(np.abs(m).max(initial=0.0)))
        for _ in range(most):
            moved = 0.0
            for of, w in zip((self.unit, self.cell), weights, strict=True):
                mean = self._sums(of, m * self.n[:, None]) / w[:, None]
                moved = max(moved, float(np.abs(mean).max(initial=0.0)))
                m = m - mean[of]
            if moved < limit:
                return m
        raise RuntimeError("effects did not settle")

    def wald(self, label: np.ndarray) -> float:
        """The statistic of the periods before, with ``label`` the treated units; not a number if a column has no variation left."""
        x = self.absorb(label[self.unit][:, None] * (self.period[:, None] == np.array(self.use)))
        a = x.T @ (x * self.n[:, None])
        if np.linalg.matrix_rank(a, tol=1e-9 * max(1e-300, np.abs(a).max())) < len(self.use):
            return math.nan
        inverse = np.linalg.inv(a)
        b = inverse @ (x.T @ (self.n * self.y))
        score = self._sums(self.unit, x * (self.n * (self.y - x @ b))[:, None])
        g = len(np.unique(self.unit))
        v = inverse @ (score.T @ score) @ inverse * (g / max(g - 1.0, 1.0))
        return float(b[self.pre] @ np.linalg.pinv(v[np.ix_(self.pre, self.pre)]) @ b[self.pre])


#: Cells of units and periods that a task may hold, about 100 bytes each with one draw's columns.
CELLS = 2_000_000


def pretrend_ri(df: DataFrame, y: str, treat: str, unit: str, t: str, ref, before, draws: int, seed: int = 1, group: str | None = None, held: str | None = None) -> DataFrame:
    """(chi2, df, p_chi2, p, draws, median): the joint pre-trend statistic against its distribution under relabelled units.

    The event study absorbs unit and (``group`` by) period effects and clusters by unit; every draw refits it with as many units
    labelled at random, out of the treated and the controls. Units of ``held`` (another treated group) are never relabelled but stay
    in the sample. Only rows without an outcome, a unit or a period are left out; units need not be complete. Draws whose columns have no variation
    left do not count.

    Rows are first collapsed to cells of unit and period: the treated-by-period columns enter through these alone. Tasks take
    batches of draws and hold the cells, whose number is checked; more than CELLS are refitted draw by draw on the rows.
    """
    at = lambda c: F.col(c).cast("string") if c else F.lit("")
    flag = lambda c: F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))) if c else F.lit(0)
    rows = df.filter(F.col(y).isNotNull() & F.col(unit).isNotNull() & F.col(t).isNotNull())
    cells = rows.groupBy(F.col(unit).cast("string").alias("u"), F.col(t).alias("t"), at(group).alias("g")).agg(F.avg(y).cast("double").alias("y"), F.count("*").alias("n"), flag(treat).alias("d"), flag(held).alias("h"))
    cells = materialize(cells, "cells")
    if cells.count() > CELLS:
        return _pretrend_by_rows(rows, cells, y, unit, t, ref, before, draws, seed, group)
    held_cells = cells.toPandas()  # at most CELLS rows
    held_cells = held_cells.sort_values(["u", "t", "g"], ignore_index=True)
    code = lambda *c: pd.factorize(pd.MultiIndex.from_frame(held_cells[list(c)]) if len(c) > 1 else held_cells[c[0]])[0]
    periods = sorted(held_cells["t"].unique())
    use = [i for i, p in enumerate(periods) if p != ref]
    pre = [k for k, i in enumerate(use) if periods[i] < before]
    number = code("u")
    per_unit = held_cells.groupby(number)[["d", "h"]].max()
    names = held_cells.groupby(number)["u"].first().to_numpy()
    label = (per_unit["d"] == 1).to_numpy()
    pool = np.flatnonzero(label | ((per_unit["d"] == 0) & (per_unit["h"] == 0)).to_numpy())
    fit = EffectCells(number, code("g", "t"), np.searchsorted(periods, held_cells["t"]), held_cells["n"].to_numpy(), held_cells["y"].to_numpy(float), use, pre)
    observed, k = fit.wald(label.astype(float)), int(label.sum())

    def refit(batches):
        for batch in batches:
            found = []
            for d in batch["id"]:
                drawn = sorted(pool, key=lambda i: (hash_draw(seed, d, names[i]), names[i]))[:k]
                one = np.zeros(len(names))
                one[drawn] = 1.0
                found.append(fit.wald(one))
            yield pd.DataFrame({"w": found})

    stats = df.sparkSession.range(draws).repartition(max(1, min(draws, df.sparkSession.sparkContext.defaultParallelism))).mapInPandas(refit, "w double").filter(~F.isnan("w"))
    return _pretrend_table(stats, observed, len(pre))


def _pretrend_table(stats: DataFrame, observed: float, df: int) -> DataFrame:
    hits = stats.agg(F.count_if(F.col("w") >= observed * (1 - 1e-9)).alias("hits"), F.count("*").alias("draws"), F.median("w").alias("median"))  # a number a draw
    return hits.select(F.lit(observed).alias("chi2"), F.lit(df).alias("df"), F.lit(chi2_tail(observed, df)).alias("p_chi2"), ((1 + F.col("hits")) / (1 + F.col("draws"))).alias("p"), "draws", "median")


def _pretrend_by_rows(rows: DataFrame, cells: DataFrame, y: str, unit: str, t: str, ref, before, draws: int, seed: int, group: str | None) -> DataFrame:
    """The same statistics for any number of cells: a distributed fit for every draw."""
    spark = rows.sparkSession
    periods = [r[0] for r in rows.select(t).distinct().orderBy(t).collect()]  # a row a period
    use = [p for p in periods if p != ref]
    pre = [i for i, p in enumerate(use) if p < before]
    per_unit = materialize(cells.groupBy("u").agg(F.max("d").alias("d"), F.max("h").alias("h")), "units")
    k = per_unit.agg(F.sum("d")).first()[0] or 0
    drawn = materialize(relabelled(per_unit.filter("d = 1 OR h = 0").select("u"), "u", draws, int(k), seed), "drawn")
    effect = F.concat_ws("|", F.col(group).cast("string"), F.col(t).cast("string")) if group else F.col(t).cast("string")
    base = rows.select(F.col(unit).cast("string").alias("u"), F.col(t).alias("t"), effect.alias("__cell"), F.col(y).cast("double").alias("y"))

    def wald(label: DataFrame) -> float:
        marked = base.join(label.select("u", F.lit(1.0).alias("__l")), "u", "left").fillna(0.0, ["__l"])
        terms = {f"t{i}": F.col("__l") * (F.col("t") == p).cast("double") for i, p in enumerate(use)}
        try:
            _, _, b, v = fe_ols(marked.withColumns(terms), "y", list(terms), ["u", "__cell"], "u", kind="CR1S", extra=True)
        except ValueError:  # no variation left
            return math.nan
        return float(b[pre] @ np.linalg.pinv(v[np.ix_(pre, pre)]) @ b[pre])

    observed = wald(per_unit.filter("d = 1"))
    found = [wald(drawn.filter(F.col("draw") == d)) for d in range(draws)]
    return _pretrend_table(spark.createDataFrame([(w,) for w in found if not math.isnan(w)], "w double"), observed, len(pre))


def conley(df: DataFrame, y: str, xs: list[str], px: str, py: str, cutoffs: float | list[float], fes: list[str] = ()) -> DataFrame:
    """Spatial covariance with a Bartlett kernel at one or several cut-offs, with absorbed effects: pairs within the largest cut-off meet through a grid of that size."""
    k, cutoffs = len(xs), [float(c) for c in (cutoffs if isinstance(cutoffs, (list, tuple)) else [cutoffs])]
    most = max(cutoffs)
    rows = df.select(*[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate([y, *xs])], F.col(px).alias("px"), F.col(py).alias("py"), *fes).withColumn("__all", F.lit(1)).na.drop()
    cols = [f"__v{i}" for i in range(k + 1)]
    flat = absorb(rows, cols, list(fes) or ["__all"])
    m = moments(flat.withColumn("one", F.lit(1)), cols[0], cols[1:], "one")
    inverse, b, n, _ = solve(m, k)
    e = F.col(cols[0]) - reduce(lambda p, q: p + q, [F.col(c) * float(v) for c, v in zip(cols[1:], b, strict=True)])
    s = flat.select("px", "py", *[(F.col(c) * e).alias(f"u_{i}") for i, c in enumerate(cols[1:])])
    # Rows at one place meet others as one: scores add up, for the kernel depends on places alone.
    s = s.groupBy("px", "py").agg(*[F.sum(f"u_{i}").alias(f"u_{i}") for i in range(k)])
    s = materialize(s.withColumns({"gx": F.floor(F.col("px") / most), "gy": F.floor(F.col("py") / most)}), "scores")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = s.select("*", around.alias("d")).select(*[F.col(c).alias(f"l_{c}") for c in ("px", "py", *[f"u_{i}" for i in range(k)])], (F.col("gx") + F.col("d.i")).alias("gx"), (F.col("gy") + F.col("d.j")).alias("gy"))
    pairs = left.join(s, ["gx", "gy"]).withColumn("far", F.hypot(F.col("px") - F.col("l_px"), F.col("py") - F.col("l_py"))).filter(F.col("far") < most)
    w = lambda c: F.greatest(1 - F.col("far") / c, F.lit(0.0))
    row = pairs.agg(*[F.sum(w(c) * F.col(f"l_u_{i}") * F.col(f"u_{j}")).alias(f"m{at}_{i}_{j}") for at, c in enumerate(cutoffs) for i in range(k) for j in range(k) if i <= j]).first()
    out = [table(df, xs, b, inverse @ _square(row, k, f"m{at}") @ inverse, n, n) for at in range(len(cutoffs))]
    return out[0] if len(cutoffs) == 1 else reduce(DataFrame.unionAll, [o.withColumn("cutoff", F.lit(c)) for o, c in zip(out, cutoffs, strict=True)])


# ---- weighting and selection ------------------------------------------------------------------------------------------


def logit_irls(df: DataFrame, y: str, xs: list[str], ridge: float = 1e-6, steps: int = 25) -> np.ndarray:
    """Coefficients (constant first) of a ridge logit; every step is one aggregation to k by k numbers."""
    k = len(xs) + 1
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    b = np.zeros(k)
    for _ in range(steps):
        eta = reduce(lambda p, q: p + q, [c * float(v) for c, v in zip(x, b, strict=True)])
        p = 1 / (1 + F.exp(-eta))
        cells = [F.sum(p * (1 - p) * x[i] * x[j]).alias(f"a_{i}_{j}") for i in range(k) for j in range(k) if i <= j]
        row = df.agg(*cells, *[F.sum((F.col(y) - p) * x[i]).alias(f"c_{i}") for i in range(k)]).first()
        pen = ridge * np.diag([0.0] + [1.0] * (k - 1))
        step = np.linalg.solve(_square(row, k) + pen, np.array([row[f"c_{i}"] for i in range(k)]) - pen @ b)
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    return b


def overlap_weights(df: DataFrame, features: list[str], treat: str, out: str = "overlap_weight", group: str | None = None, ridge: float = 1e-6) -> DataFrame:
    """1 - propensity for treated rows, propensity for others; features are standardised inside, each value of ``group`` but the first has its own level."""
    from surveyspark.functions.recode import zscore

    df = materialize(df, "weighted")
    rows = zscore(df.withColumn("__d", F.col(treat).cast("double")), features)
    levels = [r[0] for r in df.select(group).na.drop().distinct().orderBy(group).collect()][1:] if group else []  # a coefficient each
    rows = rows.withColumns({f"__g{i}": F.coalesce((F.col(group) == v).cast("double"), F.lit(0.0)) for i, v in enumerate(levels)}) if levels else rows
    xs = [f"{c}_z" for c in features] + [f"__g{i}" for i in range(len(levels))]
    b = logit_irls(rows, "__d", xs, ridge)
    eta = reduce(lambda p, q: p + q, [F.lit(float(b[0])), *[F.col(c) * float(v) for c, v in zip(xs, b[1:], strict=True)]])
    p = 1 / (1 + F.exp(-eta))
    return rows.withColumn(out, F.when(F.col("__d") == 1, 1 - p).otherwise(p)).drop("__d", *xs)


def overlap_report(df: DataFrame, features: list[str], treat: str, w: str = "overlap_weight") -> DataFrame:
    """(feature, raw_gap, weighted_gap, ess_treated, ess_control): gaps of means in standard deviations of all rows, and Kish's effective sizes."""
    on = lambda d: F.col(treat).cast("int") == d
    part = lambda c, d, v: F.sum(F.when(on(d), F.col(c) * v)) / F.sum(F.when(on(d), v))
    ess = lambda d: F.pow(F.sum(F.when(on(d), F.col(w))), 2) / F.sum(F.when(on(d), F.col(w) * F.col(w)))
    gap = lambda c, v: (part(c, 1, v) - part(c, 0, v)) / F.stddev_samp(c)
    row = df.agg(*[F.struct(F.lit(c).alias("feature"), gap(c, F.lit(1.0)).alias("raw_gap"), gap(c, F.col(w)).alias("weighted_gap")).alias(f"f{i}") for i, c in enumerate(features)], ess(1).alias("ess_treated"), ess(0).alias("ess_control"))
    return row.select(F.inline(F.array(*[f"f{i}" for i in range(len(features))])), "ess_treated", "ess_control")


def gram(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, int]:
    """X'X of many columns: each batch adds its product, each task ships one matrix in pieces, pieces are summed by row."""
    k = len(cols)

    def partial(batches):
        total, n = np.zeros((k, k)), 0
        for batch in batches:
            x = batch[cols].to_numpy(float)
            total += x.T @ x
            n += len(x)
        yield pd.DataFrame({"i": np.arange(k + 1), "row": [*total.tolist(), [float(n)] * k]})

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).na.drop().mapInPandas(partial, "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # k * k numbers
    out, n = np.zeros((k, k)), 0
    for r in sums:
        if r.i < k:
            out[r.i, r.j] = r.v
        elif r.j == 0:
            n = int(r.v)
    return out, n


def lasso(g: np.ndarray, c: np.ndarray, penalty: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Coordinate descent from cross moments: minimises b'Gb/2 - c'b + sum of penalty * |b|."""
    b = np.zeros(len(c))
    for _ in range(steps):
        before = b.copy()
        for j in range(len(c)):
            if g[j, j] > 0:
                z = c[j] - g[j] @ b + g[j, j] * b[j]
                b[j] = np.sign(z) * max(abs(z) - penalty[j], 0.0) / g[j, j]
        if np.abs(b - before).max() < 1e-10 * max(1.0, np.abs(b).max()):
            break
    return b


def _select(flat: DataFrame, cols: list[str], g: np.ndarray, n: int, target: int, candidates: list[int], cluster: str) -> set[int]:
    """Candidates with a coefficient under the plug-in penalty.

    A candidate's loading is the root of the mean square of its clusters' scores, refined with the residuals; the level goes by the number of clusters.
    """
    q = len(candidates)
    gg, c = g[np.ix_(candidates, candidates)], g[candidates, target]
    b = np.zeros(q)
    for _ in range(5):
        e = reduce(lambda p, r: p + r, [F.col(cols[target]), *[F.col(cols[i]) * float(-v) for i, v in zip(candidates, b, strict=True) if v]])
        scores = flat.groupBy(cluster).agg(*[F.sum(F.col(cols[i]) * e).alias(f"s{i}") for i in candidates])
        row = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{i}")).alias(f"s{i}") for i in candidates], F.count("*").alias("g")).first()  # a number a candidate
        level = 2.2 * math.sqrt(n) * _normal_quantile(1 - 0.1 / math.log(max(row["g"], 3)) / (2 * max(q, 1)))
        after = lasso(gg, c, level / 2 * np.sqrt(np.maximum([row[f"s{i}"] for i in candidates], 1e-300) / n))
        settled = ((after != 0) == (b != 0)).all() and np.abs(after - b).max() < 1e-6 * max(1.0, np.abs(after).max())
        b = after
        if settled:
            break
    return {candidates[i] for i in range(q) if b[i] != 0}


def _normal_quantile(p: float) -> float:
    lo, hi = -10.0, 10.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def pds_lasso(df: DataFrame, y: str, d: str, candidates: list[str], fe: str, cluster: str) -> DataFrame:
    """Post-double-selection: candidates picked for the outcome or for the treatment, then least squares with both."""
    cols = [y, d, *candidates]
    df = materialize(df.select(*dict.fromkeys([fe, cluster, *cols])), "candidates")
    used = df.select(*dict.fromkeys([fe, cluster]), *cols).na.drop().withColumns({c: F.col(c).cast("double") for c in cols})
    flat = materialize(absorb(used, cols, [fe]), "flat")
    g, n = gram(flat, cols)
    every = list(range(2, len(cols)))
    picked = sorted(_select(flat, cols, g, n, 0, every, cluster) | _select(flat, cols, g, n, 1, every, cluster))
    return fe_ols(df, y, [d, *[cols[i] for i in picked]], [fe], cluster).withColumn("selected", F.lit(len(picked)))


#: Scale of columns that are not to be penalised.
FORCE = 1000.0


def l1_logit_cv(df: DataFrame, y: str, xs: list[str], group: str, penalties: tuple = (0.001, 0.01, 0.1), folds: int = 5, w: str | None = None, forced: list[str] = ()) -> DataFrame:
    """(penalty, auc, pr_auc): L1 logit by grouped cross-validation, both areas out of fold; folds are hashes of ``group``.

    Columns are standardised before the fit. Those of ``forced`` are then scaled up by FORCE, which takes the penalty off their coefficients.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    known = df.withColumn("__y", F.col(y).cast("double")).na.drop(subset=[y, *xs, *forced])
    each = [*xs, *forced]
    m = known.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(each)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(each)]).first()
    known = known.withColumns({f"__x{i}": (F.col(c) - float(m[f"m{i}"] or 0)) / float(m[f"s{i}"] or 1) * (FORCE if i >= len(xs) else 1.0) for i, c in enumerate(each)})
    rows = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(each))], outputCol="__x").transform(known)
    rows = materialize(rows.select("__x", "__y", *([w] if w else []), F.pmod(F.xxhash64(group), F.lit(folds)).alias("__fold")), "folds")
    score = BinaryClassificationEvaluator(labelCol="__y", rawPredictionCol="rawPrediction", numBins=0)
    out = []
    for penalty in penalties:
        model = LogisticRegression(featuresCol="__x", labelCol="__y", elasticNetParam=1.0, regParam=penalty, standardization=False, **({"weightCol": w} if w else {}))
        held = [model.fit(rows.filter(F.col("__fold") != f)).transform(rows.filter(F.col("__fold") == f)) for f in range(folds)]
        both = materialize(reduce(lambda a, b: a.unionAll(b), held).select("__y", "rawPrediction"), "held")
        out.append((penalty, float(score.evaluate(both)), float(score.evaluate(both, {score.metricName: "areaUnderPR"}))))
        drop_scratch(both)
    return df.sparkSession.createDataFrame(out, "penalty double, auc double, pr_auc double")


def post_lasso(df: DataFrame, y: str, candidates: list[str], cluster: str) -> DataFrame:
    """Linear model on the columns that lasso keeps."""
    cols = [y, *candidates]
    df = materialize(df.select(*dict.fromkeys([cluster, *cols])), "candidates")
    used = df.select(cluster, *cols).na.drop().withColumn("__all", F.lit(1)).withColumns({c: F.col(c).cast("double") for c in cols})
    flat = materialize(absorb(used, cols, ["__all"]), "flat")
    g, n = gram(flat, cols)
    picked = sorted(_select(flat, cols, g, n, 0, list(range(1, len(cols))), cluster)) or [1]
    return fe_ols(df, y, [cols[i] for i in picked], [], cluster)


def average_effects(df: DataFrame, y: str, d: str, by: str, cluster: str) -> DataFrame:
    """Average effect of ``d`` when it differs with ``by``, at the mean of ``by``, with its delta-method error."""
    df = materialize(df.select(*dict.fromkeys([y, d, by, cluster])), "panel")
    mean = df.agg(F.avg(by)).first()[0]
    rows = df.withColumn("d_by", F.col(d).cast("double") * (F.col(by) - mean))
    return fe_ols(rows, y, [d, by, "d_by"], [], cluster).filter(F.col("term") == d)


def poisson_count(seed: int, number: Column, key: Column) -> Column:
    """How often a key is taken in a draw: Poisson(1) from its hash."""
    cuts = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(8)]) * 2**32
    u = draw(seed, number, key)
    return reduce(lambda acc, i: F.when(u < float(cuts[i]), i).otherwise(acc), range(6, -1, -1), F.lit(7))


def boot_did(df: DataFrame, key: str, before: str, after: str, treat: str, draws: int, seed: int = 1, w: str | None = None) -> DataFrame:
    """(what, change, low, high, p): weighted mean change of treated and control units and the difference of both, with percentile intervals.

    Units (``key``) are taken Poisson(1) times from their hash; p is twice the smaller share of draws on either side of 0.
    """
    weight = F.col(w) if w else F.lit(1.0)
    units = df.select(F.col(key).alias("__k"), (F.col(after) - F.col(before)).cast("double").alias("__c"), F.col(treat).cast("int").alias("__d"), weight.cast("double").alias("__w")).na.drop()
    mean = lambda d, c: F.sum(F.when(F.col("__d") == d, F.col("__c") * F.col("__w") * c)) / F.nullif(F.sum(F.when(F.col("__d") == d, F.col("__w") * c)), F.lit(0.0))
    parts = lambda c: [mean(1, c).alias("treated"), mean(0, c).alias("control"), (mean(1, c) - mean(0, c)).alias("difference")]
    names = ["treated", "control", "difference"]
    observed = units.agg(*parts(F.lit(1.0))).unpivot([], names, "what", "change")
    drawn = units.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("__n", poisson_count(seed, F.col("draw"), F.col("__k")).cast("double"))
    long = drawn.groupBy("draw").agg(*parts(F.col("__n"))).unpivot([], names, "what", "m").filter("m IS NOT NULL")
    ends = long.groupBy("what").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("m") <= 0).cast("double")), F.avg((F.col("m") >= 0).cast("double")))).alias("p"))
    return observed.join(ends, "what")


def boot_mean(df: DataFrame, key: str, x: str, draws: int, seed: int = 1) -> DataFrame:
    """(mean, low, high): percentile interval; in each draw a row's count is Poisson(1) from its hash, so that rows never move."""
    count = poisson_count(seed, F.col("draw"), F.col(key))
    rows = df.select(key, x).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("c", count)
    means = rows.groupBy("draw").agg((F.sum(F.col("c") * F.col(x)) / F.sum("c")).alias("m"))
    ends = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return df.agg(F.avg(x).alias("mean")).crossJoin(ends)


def holm(df: DataFrame, p: str, by: list[str] = ()) -> DataFrame:
    """Holm's adjusted p within ``by``."""
    order = Window.partitionBy(*by).orderBy(p)
    m = F.count("*").over(Window.partitionBy(*by))
    raw = df.withColumn("__a", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p)))
    return raw.withColumn("p_holm", F.max("__a").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__a")


def romano_wolf(draws: DataFrame, observed: DataFrame) -> DataFrame:
    """Step-down p: ``draws`` (draw, outcome, t) share their draws, ``observed`` (outcome, t). p = (1 + hits) / (1 + draws), never falling."""
    ranked = observed.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("t")), "outcome"))).withColumnRenamed("t", "t_obs")
    joined = draws.join(F.broadcast(ranked), "outcome")  # a row an outcome
    tail = Window.partitionBy("draw").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    most = joined.withColumn("most", F.max(F.abs("t")).over(tail))
    ps = most.groupBy("outcome", "rank", "t_obs").agg(((1 + F.count_if(F.col("most") >= F.abs("t_obs"))) / (1 + F.count("*"))).alias("p"))
    up = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ps.select("outcome", F.col("t_obs").alias("t"), F.max("p").over(up).alias("p_rw"))
