"""Exact ranks and quantiles of groups of any size: distributed selection over distinct values.

Values are counted by group and distinct value and dealt to range partitions by (group, value) with Spark's sampled splitters.
Rows are added up in order within (group, partition); the sums of these are few and are added up in a second, small level. A
position in a group is the sum of earlier partitions plus that of earlier rows in its own, so no task ever holds a group: a
group of any number of values spreads over as many partitions as its rows fill, and a value is picked by its exact position.

The dealt table is written to the shared folder once, because splitters of a second evaluation could differ.

Defined cases: missing values have no position; a missing group is a group; values that are equal stand together; groups
without any value have no row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyspark.sources.scratch import materialize


def join_groups(df: DataFrame, groups: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``groups``, one row a group; missing keys meet."""
    if not by:
        return df.crossJoin(F.broadcast(groups))  # one row
    right = groups.withColumnsRenamed({c: f"__by_{c}" for c in by})
    return df.join(right, reduce(and_, [df[c].eqNullSafe(right[f"__by_{c}"]) for c in by]), how).drop(*[f"__by_{c}" for c in by])


def deal(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` in range partitions by group and ``order``, written once, with the partition's number."""
    return materialize(rows.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "order")


def running(dealt: DataFrame, by: list[str], order: list[str], amounts: list[str]) -> DataFrame:
    """Rows of ``deal`` with, for each of ``amounts``, ``before_`` (its sum over earlier rows of the group, in ``order``) and ``all_`` (over the group)."""
    # Second level: a row for each group and partition.
    parts = dealt.groupBy(*by, "__part").agg(*[F.sum(a).alias(f"__own_{a}") for a in amounts])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "__part", *[x for a in amounts for x in (F.coalesce(F.sum(f"__own_{a}").over(earlier), F.lit(0)).alias(f"__shift_{a}"), F.sum(f"__own_{a}").over(group).alias(f"all_{a}"))])
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumns({f"__sum_{a}": F.coalesce(F.sum(a).over(inside), F.lit(0)) for a in amounts})
    out = join_groups(dealt, parts, [*by, "__part"])
    return out.select(*[c for c in dealt.columns if not c.startswith("__sum_") and c != "__part"], *[x for a in amounts for x in ((F.col(f"__sum_{a}") + F.col(f"__shift_{a}")).alias(f"before_{a}"), F.col(f"all_{a}"))])


def positions(df: DataFrame, by: list[str], x: str, w: str | None = None, missing: bool = False) -> DataFrame:
    """(by, x, n, before_n, all_n): distinct values with how many rows have them, come before them, and are in the group; with ``w`` the same of weights.

    With ``missing``, a group's missing values are a row with n = 0, so that no group goes.
    """
    return running(counted(df, by, x, w, missing), by, [x], ["n", "w"] if w else ["n"])


def counted(df: DataFrame, by: list[str], x: str, w: str | None = None, missing: bool = False) -> DataFrame:
    """The dealt (by, x, n) of ``positions``."""
    kept = df if missing else df.filter(F.col(x).isNotNull() & (F.col(w).isNotNull() if w else F.lit(True)))
    sums = [F.count(x).alias("n"), *([F.sum(F.col(w).cast("double")).alias("w")] if w else [])]
    return deal(kept.groupBy(*by, x).agg(*sums), by, [x])


def picked(p: float, x: str = "__x") -> Column:
    """The quantile among ``positions`` of a group, on the straight line between two neighbours."""
    at = F.lit(float(p)) * (F.col("all_n") - 1)
    holds = lambda k: F.max(F.when((F.col("before_n") <= k) & (k < F.col("before_n") + F.col("n")), F.col(x)))
    part, low, high = F.max(at - F.floor(at)), holds(F.floor(at)), holds(F.ceil(at))
    return F.when(part == 0, low).otherwise((1 - part) * low + part * high)


def quantiles(df: DataFrame, by: list[str], x: str, probs: list[float], out: str = "quantiles") -> DataFrame:
    """(by, ``out``): exact quantiles as an array; missing in groups without a value."""
    values = positions(df.select(*by, F.col(x).cast("double").alias("__x")), by, "__x", missing=True)
    return values.groupBy(*by).agg(F.array(*[picked(p) for p in probs]).alias(out))


def describe(df: DataFrame, by: list[str], x: str, probs: list[float]) -> DataFrame:
    """(by, mean, sd, quantiles) of one pass over ``df``: all are taken from the counted values."""
    values = counted(df.select(*by, F.col(x).cast("double").alias("__x")), by, "__x", missing=True)
    means = values.groupBy(*by).agg(F.sum("n").alias("__n"), (F.sum(F.col("n") * F.col("__x")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))
    spread = F.sum(F.col("n") * F.pow(F.col("__x") - F.col("mean"), F.lit(2.0)))
    moments = join_groups(values, means, by).groupBy(*by).agg(F.max("mean").alias("mean"), F.sqrt(spread / F.nullif(F.max("__n") - 1, F.lit(0))).alias("sd"))
    picks = running(values, by, ["__x"], ["n"]).groupBy(*by).agg(F.array(*[picked(p) for p in probs]).alias("quantiles"))
    return join_groups(moments, picks, by)


def quantile_grid(df: DataFrame, x: str, n: int) -> DataFrame:
    """(k, value): ``n`` quantiles from the least value to the greatest, evenly spaced; each value finds its own places by arithmetic."""
    values = positions(df.select(F.col(x).cast("double").alias("__x")), [], "__x")
    first, past, span = F.col("before_n"), F.col("before_n") + F.col("n"), F.col("all_n") - 1
    up = lambda a: F.floor((a * (n - 1) + span - 1) / span)
    down = lambda a: F.floor(a * (n - 1) / span)
    last = F.lit(n - 1).cast("long")
    at_or_under = F.when(span == 0, F.array(F.lit(0).cast("long"), last)).otherwise(F.array(up(first), F.least(up(past) - 1, last)))
    at_or_over = F.when(span == 0, F.array(F.lit(0).cast("long"), last)).otherwise(F.array(F.when(first == 0, F.lit(0).cast("long")).otherwise(down(first - 1) + 1), down(past - 1)))
    pick = lambda ends, side: values.select("__x", span.alias("span"), ends.alias("e")).filter("e[0] <= e[1]").select(F.explode(F.sequence(F.col("e")[0], F.col("e")[1])).alias("k"), F.lit(side).alias("side"), "__x", "span")
    both = pick(at_or_under, 0).unionAll(pick(at_or_over, 1)).groupBy("k").agg(F.max(F.when(F.col("side") == 0, F.col("__x"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("__x"))).alias("high"), F.max("span").alias("span"))
    part = F.pmod(F.col("k") * F.col("span"), F.lit(n - 1)) / F.lit(float(n - 1))
    return both.select("k", (F.col("low") + part * (F.col("high") - F.col("low"))).alias("value"))


def weighted_quantile(df: DataFrame, by: list[str], x: str, w: str, q: float) -> DataFrame:
    """(by, wquantile): the smallest value whose cumulative weight reaches ``q`` of the group's."""
    values = positions(df, by, x, w)
    return values.groupBy(*by).agg(F.min(F.when(F.col("before_w") + F.col("w") >= q * F.col("all_w"), F.col(x))).alias("wquantile"))


def average_ranks(df: DataFrame, by: list[str], x: str, out: str) -> DataFrame:
    """(by, x, ``out``): the rank of each distinct value, ties with their average rank."""
    return positions(df, by, x).select(*by, x, (F.col("before_n") + (F.col("n") + 1) / 2).alias(out))


def row_numbers(df: DataFrame, by: list[str], order: list[str], out: str = "__r", of: str = "__n") -> DataFrame:
    """``df`` with the number of each row in its group, in ``order``, and the group's number of rows."""
    rows = running(deal(df.withColumn("__one", F.lit(1).cast("long")), by, order), by, order, ["__one"])
    return rows.select(*df.columns, (F.col("before___one") + 1).alias(out), F.col("all___one").alias(of))
