"""Sensor time series: averaging instruments, quantile maps between them, coverage, test and retest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyspark.sources.scratch import materialize

from . import order
from .agg import first_period
from .joins import overlap_pairs
from .window import demean


def average_satellites(df: DataFrame, stats: list[str]) -> DataFrame:
    """(unit, layer, period): means over satellites and how many there were."""
    return df.groupBy("unit", "layer", "period").agg(*[F.avg(s).alias(s) for s in stats], F.count_distinct("sat").alias("n_sat"))


def layers_wide(df: DataFrame, layers: list[str], stats: list[str]) -> DataFrame:
    """A column for each layer and statistic."""
    cols = [F.max(F.when(F.col("layer") == name, F.col(s))).alias(f"{name}_{s}") for name in layers for s in stats]
    return df.groupBy("unit", "period").agg(*cols)


def derive_series(df: DataFrame, total: str, pop: str, floor: float) -> DataFrame:
    """asinh of the total, total per 1,000 people and the first period above ``floor``."""
    out = df.withColumns({"asinh_total": F.asinh(F.greatest(F.col(total), F.lit(0.0))), "per_1000": 1000 * F.col(total) / F.nullif(F.col(pop), F.lit(0.0))})
    return first_period(out, "unit", "period", F.col(total) > floor, "first_lit")


def quantile_map(joint: DataFrame, src: str, dst: str, n: int = 1001) -> DataFrame:
    """(k, x, y): ``n`` quantiles of both instruments over pixels that both see; y never falls. n rows."""
    both = joint.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(src, dst)
    both = materialize(both, "both")
    rows = order.quantile_grid(both, src, n).withColumnRenamed("value", "x").join(order.quantile_grid(both, dst, n).withColumnRenamed("value", "y"), "k")
    up = Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return materialize(rows.withColumn("y", F.max("y").over(up)), "map")


def apply_map(df: DataFrame, lut: DataFrame, value: str, out: str) -> DataFrame:
    """Values through the map by linear interpolation; ends are held. The map's knots travel as one small array."""
    knots = lut.groupBy("x").agg(F.max("y").alias("y")).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("__k"))
    v, k = F.col(value), F.col("__k")
    at = F.size(F.filter(k, lambda e: e["x"] <= v))
    lo, hi = F.get(k, F.greatest(at - 1, F.lit(0))), F.get(k, F.least(at, F.size(k) - 1))
    span = hi["x"] - lo["x"]
    t = F.when(span > 0, F.least(F.greatest((v - lo["x"]) / span, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return df.crossJoin(F.broadcast(knots)).withColumn(out, F.when(v.isNotNull(), lo["y"] + t * (hi["y"] - lo["y"]))).drop("__k")


def compose_maps(chain: list[DataFrame]) -> DataFrame:
    """One map from the first instrument to the last instrument's scale."""
    out = chain[0]
    for lut in chain[1:]:
        out = apply_map(out, lut, "y", "__y").select("k", "x", F.col("__y").alias("y"))
    return out


def retest(df: DataFrame, unit: str, period: str, month: str, source: str, value: str, treated: str) -> DataFrame:
    """Agreement of two instruments' treated less control gaps: correlation raw, deseasonalised and by year, and the deviation of their difference."""
    gap = df.groupBy(source, period, month).agg((F.avg(F.when(F.col(treated), F.col(value))) - F.avg(F.when(~F.col(treated), F.col(value)))).alias("gap"))
    plain = demean(gap, "gap", [source, month], "season")
    pairs = overlap_pairs(plain, [period, month], source, "gap").join(overlap_pairs(plain, [period, month], source, "season").select(period, month, "source_a", "source_b", F.col("value_a").alias("sa"), F.col("value_b").alias("sb")), [period, month, "source_a", "source_b"])
    year = pairs.groupBy("source_a", "source_b", F.floor(F.col(period) / 100).alias("y")).agg(F.avg("value_a").alias("ya"), F.avg("value_b").alias("yb")).groupBy("source_a", "source_b").agg(F.corr("ya", "yb").alias("annual"))
    out = pairs.groupBy("source_a", "source_b").agg(F.corr("value_a", "value_b").alias("raw"), F.corr("sa", "sb").alias("deseasonalised"), F.stddev_samp(F.col("value_a") - F.col("value_b")).alias("sd_diff"), F.count("*").alias("n"))
    return out.join(year, ["source_a", "source_b"])


def coverage_scale(df: DataFrame, total: str, observed: str, least: float) -> DataFrame:
    """Totals over the observed share; unit-months whose least share over satellites is under ``least`` go."""
    low = F.min(observed).over(Window.partitionBy("unit", "period"))
    return df.withColumn("__low", low).filter(F.col("__low") >= least).withColumn(total, F.col(total) / F.nullif(F.col(observed), F.lit(0.0))).drop("__low")


def drop_blank(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Without composites that are constant over their whole extent."""
    blank = df.groupBy(*by).agg(F.min(value).alias("a"), F.max(value).alias("b")).filter("a = b").select(*by)
    return df.join(blank, by, "left_anti")


def lit_share_series(df: DataFrame, value: str, observed: str, floor: float, least: float = 0.9) -> DataFrame:
    """Share of observed pixels above ``floor`` by unit and period; blank where under ``least`` is observed."""
    seen = F.avg(F.col(observed).cast("double"))
    share = F.avg(F.when(F.col(observed), (F.col(value) > floor).cast("double")))
    return df.groupBy("unit", "period").agg(F.when(seen >= least, share).alias("lit_share"), seen.alias("observed"))
