"""Data-quality checks. Each gives rows (section, name, ours, reference, result); result is ok, FAIL, warn or info."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order
from .agg import corr_matrix

ROW = "section string, name string, ours double, reference double, result string"


def check_rows(stats: DataFrame, section: str, checks: dict[str, tuple[Column, Column, Column]], soft: bool = False) -> DataFrame:
    """One row a check from a one-row frame: name -> (ours, reference, passed)."""
    lines = [
        F.struct(F.lit(section).alias("section"), F.lit(n).alias("name"), o.cast("double").alias("ours"), ref.cast("double").alias("reference"), F.when(ok, "ok").otherwise("warn" if soft else "FAIL").alias("result"))
        for n, (o, ref, ok) in checks.items()
    ]
    return stats.select(F.inline(F.array(*lines)))


def require(report: DataFrame) -> DataFrame:
    """Raise if a hard check failed."""
    bad = [r.name for r in report.filter("result = 'FAIL'").limit(20).collect()]
    if bad:
        raise ValueError(f"failed checks: {', '.join(bad)}")
    return report


def check_preserved(before: DataFrame, after: DataFrame, wt: str, tol: float = 1e-9) -> DataFrame:
    one = lambda df, s: df.agg(F.count("*").alias(f"n_{s}"), F.sum(wt).alias(f"w_{s}"))
    both = one(before, "b").crossJoin(one(after, "a"))
    close = F.abs(F.col("w_a") - F.col("w_b")) <= tol * F.greatest(F.abs("w_b"), F.lit(1.0))
    return check_rows(both, "preserved", {"rows": (F.col("n_a"), F.col("n_b"), F.col("n_a") == F.col("n_b")), "weight": (F.col("w_a"), F.col("w_b"), close)})


def check_keys(df: DataFrame, key: list[str], domains: dict[str, list]) -> DataFrame:
    """Uniqueness and completeness of the key and membership of domains, from one aggregate over keys and one over rows."""
    keys = df.groupBy(*key).agg(F.count("*").alias("__n")).agg(F.count_if(F.col("__n") > 1).alias("dup"))
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    rows = df.agg(F.count_if(missing).alias("null"), *[F.count_if(~F.col(c).isin(*v) & F.col(c).isNotNull()).alias(f"d_{c}") for c, v in domains.items()])
    zero = lambda c: (F.col(c), F.lit(0), F.col(c) == 0)
    return check_rows(keys.crossJoin(rows), "keys", {"unique": zero("dup"), "complete": zero("null"), **{f"domain {c}": zero(f"d_{c}") for c in domains}})


def check_nesting(df: DataFrame, child: str, parent: str, div: int) -> DataFrame:
    bad = df.agg(F.count_if(F.floor(F.col(child) / div) != F.col(parent)).alias("bad"))
    return check_rows(bad, "nesting", {f"{child} in {parent}": (F.col("bad"), F.lit(0), F.col("bad") == 0)})


def check_constant(df: DataFrame, by: list[str], cols: list[str], head: Column | None = None) -> DataFrame:
    """Groups in which a column varies (nulls count) and, with ``head``, groups that have not exactly one head."""
    groups = df.groupBy(*by).agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in cols], F.count_if(head if head is not None else F.lit(True)).alias("__heads"))
    stats = groups.agg(*[F.count_if(F.col(c) > 1).alias(c) for c in cols], F.count_if(F.col("__heads") != 1).alias("__heads"))
    zero = lambda c: (F.col(c), F.lit(0), F.col(c) == 0)
    return check_rows(stats, "constant", {**{c: zero(c) for c in cols}, **({"one head": zero("__heads")} if head is not None else {})})


def check_published(df: DataFrame, by: str, value: Column, ref: DataFrame, tol: float) -> DataFrame:
    """Weighted totals by group against ``ref`` (by, reference); groups without a figure are information."""
    joined = df.groupBy(by).agg(value.alias("ours")).join(ref, by, "left")
    close = F.abs(F.col("ours") / F.col("reference") - 1) <= tol
    result = F.when(F.col("reference").isNull(), "info").when(close, "ok").otherwise("FAIL")
    return joined.select(F.lit("published").alias("section"), F.col(by).cast("string").alias("name"), F.col("ours").cast("double").alias("ours"), F.col("reference").cast("double").alias("reference"), result.alias("result"))


def check_plausible(df: DataFrame, by: str, value: str, low: float, high: float, part: Column, whole: Column, slack: float = 0.05) -> DataFrame:
    """Median of ``value`` in its band and the share of rows whose part is at most the whole (plus slack), by group."""
    shares = df.groupBy(by).agg(F.avg((part <= (1 + slack) * whole).cast("double")).alias("share"))
    stats = order.join_groups(shares, order.quantiles(df, [by], value, [0.5]).select(by, F.col("quantiles")[0].alias("median")), [by], "left")
    median_ok, share_ok = F.col("median").between(low, high), F.col("share") >= 0.95
    lines = F.array(
        F.struct(F.lit("plausible").alias("section"), F.concat(F.lit("median "), F.col(by).cast("string")).alias("name"), F.col("median").alias("ours"), F.lit(float(high)).alias("reference"), F.when(median_ok, "ok").otherwise("warn").alias("result")),
        F.struct(F.lit("plausible").alias("section"), F.concat(F.lit("part "), F.col(by).cast("string")).alias("name"), F.col("share").alias("ours"), F.lit(0.95).alias("reference"), F.when(share_ok, "ok").otherwise("warn").alias("result")),
    )
    return stats.select(F.inline(lines))


def check_grid(df: DataFrame, unit: str, period: str, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """All units in all periods once, and values in their ranges."""
    stats = df.agg(F.count("*").alias("n"), F.count_distinct(unit).alias("u"), F.count_distinct(period).alias("p"), *[F.count_if(~F.col(c).between(*r)).alias(f"r_{c}") for c, r in ranges.items()])
    size = F.col("u") * F.col("p")
    return check_rows(stats, "grid", {"complete": (F.col("n"), size, F.col("n") == size), **{f"range {c}": (F.col(f"r_{c}"), F.lit(0), F.col(f"r_{c}") == 0) for c in ranges}})


def period_gaps(df: DataFrame, layer: str, period: str) -> DataFrame:
    """(layer, period) missing between a layer's first and last period."""
    span = df.groupBy(layer).agg(F.min(period).alias("a"), F.max(period).alias("b"))
    every = span.select(layer, F.explode(F.sequence("a", "b")).alias(period))
    return every.join(df.select(layer, period).distinct(), [layer, period], "left_anti")


def check_rank_agreement(df: DataFrame, a: str, b: str, by: str, least: float = 0.5) -> DataFrame:
    """Lowest rank correlation over the groups."""
    low = corr_matrix(df, [a, b], [by], "spearman").agg(F.min("r").alias("low"))
    return check_rows(low, "rank agreement", {f"{a} {b}": (F.col("low"), F.lit(least), F.col("low") > least)}, soft=True)


def check_censoring(df: DataFrame, a: str, b: str, by: str, dark: float = 0.0) -> DataFrame:
    """Share dark in layer ``a`` and mean of ``b`` where ``a`` is dark and where it is not."""
    cut = F.col(a) <= dark
    return df.groupBy(by).agg(F.avg(cut.cast("double")).alias("share_dark"), F.avg(F.when(cut, F.col(b))).alias("mean_dark"), F.avg(F.when(~cut, F.col(b))).alias("mean_lit"))


def check_panel(df: DataFrame, value: str, usable: str, joined: str, least: float = 0.95) -> DataFrame:
    """Finite where usable, null where not, never negative, share joined."""
    v, u = F.col(value), F.col(usable)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    stats = df.agg(F.count_if(u & ~finite).alias("holes"), F.count_if(~u & v.isNotNull()).alias("extra"), F.count_if(v < 0).alias("neg"), F.avg(F.col(joined).isNotNull().cast("double")).alias("hit"))
    zero = lambda c: (F.col(c), F.lit(0), F.col(c) == 0)
    return check_rows(stats, "panel", {"finite": zero("holes"), "null": zero("extra"), "sign": zero("neg"), "joined": (F.col("hit"), F.lit(least), F.col("hit") > least)})


def check_second_route(df: DataFrame, routes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows in which a column and its second route differ; nulls equal nulls."""
    stats = df.agg(*[F.count_if(~a.eqNullSafe(b)).alias(n) for n, (a, b) in routes.items()])
    return check_rows(stats, "second route", {n: (F.col(n), F.lit(0), F.col(n) == 0) for n in routes})
