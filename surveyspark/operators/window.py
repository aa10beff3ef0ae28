"""Window operators on panels: stocks, differences, anomalies, interpolation, imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyspark.sources.scratch import materialize

from . import order
from .agg import average_rank
from .joins import bracket_join


def depleting_stock(df: DataFrame, unit: str, t: str, flow: str, stock0: str, out: str = "stock") -> DataFrame:
    """Stock at the start of each period: the base less all earlier flows, never under 0."""
    before = Window.partitionBy(unit).orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.greatest(F.col(stock0) - F.coalesce(F.sum(flow).over(before), F.lit(0.0)), F.lit(0.0)))


def diff(df: DataFrame, unit: str, t: str, cols: list[str]) -> DataFrame:
    """Change from the row before (not the year before)."""
    rows = Window.partitionBy(unit).orderBy(t)
    return df.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(rows) for c in cols})


def anomaly(df: DataFrame, unit: list[str], x: str, dry: float = 0.2) -> DataFrame:
    """z within the unit, percentile rank (ties averaged, over n) and a flag for ranks of ``dry`` and under."""
    whole = Window.partitionBy(*unit)
    z = (F.col(x) - F.avg(x).over(whole)) / F.nullif(F.stddev_samp(x).over(whole), F.lit(0.0))
    ranked = average_rank(df.withColumn("z", z), x, unit, "__rank")
    rank = F.col("__rank") / F.count(x).over(whole)
    return ranked.withColumn("pct_rank", rank).withColumn("drought", F.col("pct_rank") <= dry).drop("__rank")


def complete_periods(df: DataFrame, by: list[str], part: str, n: int = 12) -> DataFrame:
    """Only groups with all ``n`` parts, such as years with twelve months."""
    full = df.groupBy(*by).agg(F.count_distinct(part).alias("__n")).filter(F.col("__n") == n).select(*by)
    return df.join(full, by, "left_semi")


def number_in(df: DataFrame, by: list[str], order: list[Column], out: str = "number") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def interview_index(df: DataFrame, hh: str, wt: str, pos: str, out: str = "interview") -> DataFrame:
    """Number of a household's interview: the (household, weight) groups in the order of their first row."""
    first = df.withColumn("__first", F.min(pos).over(Window.partitionBy(hh, wt)))
    return first.withColumn(out, F.dense_rank().over(Window.partitionBy(hh).orderBy("__first"))).drop("__first")


def blocks(df: DataFrame, by: list[str], order: str, key: str, out: str = "block") -> DataFrame:
    """A key smaller than that of the row before starts a new block; blocks are numbered within ``by``."""
    rows = Window.partitionBy(*by).orderBy(order)
    starts = df.withColumn("__new", F.when(F.col(key) < F.lag(key).over(rows), 1).otherwise(0))
    return starts.withColumn(out, F.sum("__new").over(rows.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def arg_best(df: DataFrame, by: list[str], pick: str, value: str, largest: bool = True) -> DataFrame:
    """``pick`` where ``value`` is largest (smallest); ties by the smallest pick."""
    key = F.struct((-F.col(value) if largest else F.col(value)).alias("v"), F.col(pick).alias("p"))
    return df.groupBy(*by).agg(F.min(key)["p"].alias(pick), (F.max(value) if largest else F.min(value)).alias(value))


def interp_log(df: DataFrame, knots: DataFrame, on: list[str], t: str, value: str) -> DataFrame:
    """Log-linear between knots, forward at the last rate, null before the first knot.

    The last rate is that between the last two knots.
    """
    ends = Window.partitionBy(*on).orderBy(F.desc(t))
    last = knots.withColumn("__r", F.row_number().over(ends)).filter("__r <= 2").groupBy(*on).agg(
        F.max(t).alias("__t"), F.max_by(value, t).alias("__v"), ((F.log(F.max_by(value, t)) - F.log(F.min_by(value, t))) / F.nullif(F.max(t) - F.min(t), F.lit(0))).alias("__g")
    )
    rows = bracket_join(df, knots, on, t, value).join(last, on, "left")
    span = F.nullif(F.col("t1") - F.col("t0"), F.lit(0))
    inside = F.exp(F.log("v0") + (F.log("v1") - F.log("v0")) * F.coalesce((F.col(t) - F.col("t0")) / span, F.lit(0.0)))
    after = F.col("__v") * F.exp(F.coalesce("__g", F.lit(0.0)) * (F.col(t) - F.col("__t")))
    return rows.withColumn(value, F.when(F.col("t0").isNull(), None).when(F.col("t1").isNull(), after).otherwise(inside)).select(*on, t, value)


def tails(df: DataFrame, x: str, by: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """(by, __q): the two exact quantiles of each group, for ``winsorise`` and ``trim``."""
    return materialize(order.quantiles(df, by, x, [lo, hi], "__q"), "tails")


def winsorise(df: DataFrame, x: str, by: list[str], lo: float = 0.01, hi: float = 0.99, limits: DataFrame | None = None) -> DataFrame:
    q = order.join_groups(df, tails(df, x, by, lo, hi) if limits is None else limits, by, "left")
    return q.withColumn(x, F.least(F.greatest(F.col(x), F.col("__q")[0]), F.col("__q")[1])).drop("__q")


def trim(df: DataFrame, x: str, by: list[str], lo: float = 0.01, hi: float = 0.99, limits: DataFrame | None = None) -> DataFrame:
    q = order.join_groups(df, tails(df, x, by, lo, hi) if limits is None else limits, by, "left")
    return q.filter(F.col(x).between(F.col("__q")[0], F.col("__q")[1])).drop("__q")


def fill_group_mean(df: DataFrame, x: str, by: str, t: str) -> DataFrame:
    """Missing values become the group's mean in the period, then the period's mean."""
    near, wide = F.avg(x).over(Window.partitionBy(t, by)), F.avg(x).over(Window.partitionBy(t))
    return df.withColumn(x, F.coalesce(F.col(x), near, wide))


def demean(df: DataFrame, x: str, by: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.col(x) - F.avg(x).over(Window.partitionBy(*by)))


def quadrants(df: DataFrame, x: str, y: str) -> DataFrame:
    """high/low quadrant by the medians of two variables."""
    middle = lambda c, name: order.quantiles(df, [], c, [0.5]).select(F.col("quantiles")[0].alias(name))
    mid = middle(x, "__mx").crossJoin(middle(y, "__my"))  # one row
    side = lambda c, m: F.when(F.col(c) >= F.col(m), "high").otherwise("low")
    return df.crossJoin(F.broadcast(mid)).withColumn("quadrant", F.concat_ws("-", side(x, "__mx"), side(y, "__my"))).drop("__mx", "__my")


def baseline(df: DataFrame, unit: str, wave: str, base, col: str, out: str) -> DataFrame:
    return df.withColumn(out, F.max(F.when(F.col(wave) == base, F.col(col))).over(Window.partitionBy(unit)))


def pre_trend(df: DataFrame, unit: str, t: str, y: str, cutoff) -> DataFrame:
    """Mean and slope of each unit before ``cutoff``."""
    return df.filter(F.col(t) < cutoff).groupBy(unit).agg(F.avg(y).alias("pre_mean"), F.regr_slope(y, t).alias("pre_slope"))
