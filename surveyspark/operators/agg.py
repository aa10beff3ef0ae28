"""Weighted aggregations, distributions, transitions and reconstructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyspark.sources.scratch import materialize

from . import order


def weighted_pivot(df: DataFrame, by: list[str], on: str, values: list, w: str) -> DataFrame:
    """Weighted counts by group, a column for each of ``values``, zero where there is none."""
    return df.groupBy(*by).pivot(on, values).agg(F.sum(w)).fillna(0, subset=[str(v) for v in values])


def wsum(x: Column, w: Column) -> Column:
    return F.sum(x * w)


def wmean(x: Column, w: Column) -> Column:
    """Weighted mean over rows where value and weight are there; null if their weights sum to 0."""
    return F.sum(x * w) / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0))


def wratio(num: Column, den: Column, w: Column) -> Column:
    """Ratio of weighted sums."""
    return F.sum(num * w) / F.nullif(F.sum(den * w), F.lit(0.0))


def wquantile(df: DataFrame, by: list[str], x: str, w: str, q: float = 0.5) -> DataFrame:
    """Smallest value whose cumulative weight reaches ``q`` of the total: one row a group, groups of any size."""
    return order.weighted_quantile(df, by, x, w, q)


def wshare(flag: Column, w: Column) -> Column:
    """Weighted share of rows where ``flag`` holds, among those where it is known."""
    return F.sum(F.when(flag, w).when(~flag, 0.0)) / F.nullif(F.sum(F.when(flag.isNotNull(), w)), F.lit(0.0))


def share_of(df: DataFrame, value: str, by: list[str], out: str = "share") -> DataFrame:
    return df.withColumn(out, F.col(value) / F.sum(value).over(Window.partitionBy(*by)))


def describe_by(df: DataFrame, by: list[str], col: str, probs: tuple = (0.1, 0.5, 0.9)) -> DataFrame:
    """Mean, deviation and exact quantiles of finite values by group."""
    finite = F.when(~F.isnan(col) & (F.abs(col) != float("inf")), F.col(col))
    out = order.describe(df.select(*by, finite.alias("__value")), by, "__value", list(probs))
    return out.select(*by, "mean", "sd", *[F.col("quantiles")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(probs)])


def collapse_constant(df: DataFrame, by: list[str], head: Column, head_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row a group: columns that never vary within a group, size, the head's fields; and the number of groups in which each other column varies.

    ``head`` orders the members; the first is the head. Nulls count as a value of their own.
    """
    others = [c for c in df.columns if c not in by]
    # A column is constant where its least and greatest values agree and it is null in all rows or in none: one pass of partial sums.
    sums = [f(c).alias(f"__{name}_{i}") for i, c in enumerate(others) for name, f in (("low", F.min), ("high", F.max), ("n", F.count))]
    # The head's fields stand after the order in one struct, which is compared from its start.
    first = F.min(F.struct(head.alias("__order"), *[F.col(c).alias(f"head_{c}") for c in head_cols])).alias("__head")
    groups = materialize(df.groupBy(*by).agg(F.count("*").alias("__size"), first, *sums), "groups")
    varies = [~F.col(f"__low_{i}").eqNullSafe(F.col(f"__high_{i}")) | ((F.col(f"__n_{i}") > 0) & (F.col(f"__n_{i}") < F.col("__size"))) for i in range(len(others))]
    row = groups.agg(*[F.count_if(v).alias(f"n_{i}") for i, v in enumerate(varies)], F.count("*").alias("all")).first()  # a number a column decides which columns stay
    fields = [F.col(f"__low_{i}").alias(c) for i, c in enumerate(others) if not row[f"n_{i}"]]
    report = df.sparkSession.createDataFrame([(c, row[f"n_{i}"]) for i, c in enumerate(others) if row[f"n_{i}"]], "column string, n_varying long")
    return groups.select(*by, *fields, F.col("__size").alias("size"), *[F.col(f"__head.head_{c}") for c in head_cols]), report


def member_counts(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Members of the own group for which each flag holds, on every member's row."""
    group = Window.partitionBy(*by)
    return df.withColumns({name: F.sum(flag.cast("long")).over(group) for name, flag in flags.items()})


def flows(df: DataFrame, by: list[str], origin: str, dest: str, w: str) -> DataFrame:
    return df.groupBy(*by, origin, dest).agg(F.sum(w).alias("flow"))


def fixed_price_value(df: DataFrame, item: str, price: Column, quantity: Column, w: Column, window: Column, by: list[str]) -> DataFrame:
    """Value at each item's median price over the rows ``window``, and the share of rows that have such a price."""
    prices = order.quantiles(df.filter(window).select(item, price.alias("__p")), [item], "__p", [0.5]).select(item, F.col("quantiles")[0].alias("__price"))
    joined = df.join(prices, item, "left")
    return joined.groupBy(*by).agg(F.sum(quantity * w * F.col("__price")).alias("value"), F.avg(F.col("__price").isNotNull().cast("double")).alias("covered"))


def sum_min_count(x: Column, n: int = 1) -> Column:
    return F.when(F.count(x) >= n, F.sum(x))


def sum_if_covered(x: Column, least: float = 0.8) -> Column:
    return F.when(F.count(x) >= least * F.count(F.lit(1)), F.sum(x))


def top_n(df: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """The ``n`` largest groups by total; ties by the group."""
    return df.groupBy(by).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), by).limit(n)


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, column, n): values that are there."""
    cols = [c for c in df.columns if c not in by]
    counts = df.groupBy(*by).agg(*[F.count(c).alias(c) for c in cols])
    return counts.unpivot(by, cols, "column", "n")


def stale_codes(df: DataFrame, wave: str, cols: list[str], labels: DataFrame) -> DataFrame:
    """(wave, variable, code) that occur but are not in the wave's own ``labels`` (wave, variable, code)."""
    seen = df.select(F.col(wave).alias("wave"), *[F.col(c).cast("long").alias(c) for c in cols]).unpivot(["wave"], cols, "variable", "code").filter("code IS NOT NULL").distinct()
    return seen.join(labels.select("wave", "variable", F.col("code").cast("long").alias("code")), ["wave", "variable", "code"], "left_anti")


def transitions(before: DataFrame, after: DataFrame, on: list[str], by: str, cls: str, ha: str) -> DataFrame:
    """(by, from, to, ha, row_share): area by class in two layers of the same pixels."""
    pairs = before.select(*on, by, F.col(cls).alias("from"), ha).join(after.select(*on, F.col(cls).alias("to")), on)
    return share_of(pairs.groupBy(by, "from", "to").agg(F.sum(ha).alias("ha")), "ha", [by, "from"], "row_share")


def gross_flows(moves: DataFrame, by: str) -> DataFrame:
    """(by, class, loss, gain, net) from transitions; what stays in its class is neither."""
    moved = moves.filter(F.col("from") != F.col("to"))
    rows = moved.select(by, F.col("from").alias("class"), F.col("ha").alias("loss"), F.lit(0.0).alias("gain")).unionAll(moved.select(by, F.col("to").alias("class"), F.lit(0.0).alias("loss"), F.col("ha").alias("gain")))
    return rows.groupBy(by, "class").agg(F.sum("loss").alias("loss"), F.sum("gain").alias("gain"), (F.sum("gain") - F.sum("loss")).alias("net"))


def long_diff(df: DataFrame, unit: str, wave: str, a, b, cols: list[str]) -> DataFrame:
    """Change and growth of ``cols`` from wave ``a`` to ``b``."""
    at = lambda c, w: F.max(F.when(F.col(wave) == w, F.col(c)))
    wide = df.filter(F.col(wave).isin(a, b)).groupBy(unit).agg(*[at(c, w).alias(f"__{c}_{i}") for c in cols for i, w in enumerate((a, b))])
    return wide.select(unit, *[x for c in cols for x in ((F.col(f"__{c}_1") - F.col(f"__{c}_0")).alias(f"d_{c}"), (F.col(f"__{c}_1") / F.nullif(F.col(f"__{c}_0"), F.lit(0.0)) - 1).alias(f"g_{c}"))])


def with_total(df: DataFrame, by: str, aggs: list[Column], total: str = "total") -> DataFrame:
    """Groups and, in the same table, the row over all of them."""
    rolled = df.rollup(by).agg(F.grouping(by).alias("__g"), *aggs)
    return rolled.withColumn(by, F.when(F.col("__g") == 1, total).otherwise(F.col(by).cast("string"))).drop("__g")


def first_period(df: DataFrame, unit: str, period: str, cond: Column, out: str = "first_period") -> DataFrame:
    return df.withColumn(out, F.min(F.when(cond, F.col(period))).over(Window.partitionBy(unit)))


def addback(recorded: Column, candidates: Column, adults: Column, rate: float) -> tuple[Column, Column]:
    """Recorded plus candidates above the usual rate among adults, and the upper bound."""
    return recorded + F.greatest(candidates - rate * adults, F.lit(0.0)), recorded + candidates


def workforce(df: DataFrame, by: list[str], year: str, rules: dict, w: str) -> DataFrame:
    """Weighted workers under the year's own definition: ``{year: condition}``; years without one are left out."""
    cond = F.lit(False)
    for y, c in rules.items():
        cond = cond | ((F.col(year) == y) & c)
    return df.filter(F.col(year).isin(*rules)).groupBy(*by, year).agg(F.sum(F.when(cond, F.col(w)).otherwise(0.0)).alias("workers"), F.sum(w).alias("people"))


def average_rank(df: DataFrame, col: str, by: list[str], out: str) -> DataFrame:
    """Rank of values, ties with their average rank. Ranks are counted over distinct values."""
    return order.join_groups(df, order.average_ranks(df, by, col, out), [*by, col], "left")


def rank_columns(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """(by, cols): every value replaced by its average rank in its column, all columns ranked at once."""
    rows = materialize(df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).withColumn("__row", F.monotonically_increasing_id()), "ranked")
    long = rows.unpivot([*by, "__row"], cols, "__column", "__value").filter("__value IS NOT NULL")
    ranked = order.join_groups(long, order.average_ranks(long, [*by, "__column"], "__value", "__rank"), [*by, "__column", "__value"])
    return ranked.groupBy(*by, "__row").agg(*[F.max(F.when(F.col("__column") == c, F.col("__rank"))).alias(c) for c in cols]).drop("__row")


def corr_matrix(df: DataFrame, cols: list[str], by: list[str] = (), method: str = "pearson") -> DataFrame:
    """(by, a, b, r) for all pairs of columns."""
    by = list(by)
    if method == "spearman":
        df = rank_columns(df, cols, by)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    wide = df.groupBy(*by).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot(by, [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return long.select(*by, F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "r")


def trend(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def binscatter(df: DataFrame, x: str, ys: list[str], n: int, by: list[str], tie: list[str]) -> DataFrame:
    """Means in ``n`` bins of equal count on the rank of ``x`` within ``by``; ties by ``tie``."""
    rows = order.row_numbers(df.select(*dict.fromkeys([*by, x, *tie, *ys])), by, [x, *tie])
    rows = rows.withColumn("bin", F.greatest(F.lit(1), F.ceil((F.col("__r") - 1) * n / (F.col("__n") - 1))).cast("int"))
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in (x, *ys)])


def anova(df: DataFrame, value: str, by: str) -> DataFrame:
    """F statistic of a one-way analysis of variance, from group counts, means and variances."""
    groups = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).filter("n > 0")
    total = groups.agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("raw"))
    between = F.col("raw") - F.col("n") * F.col("grand") * F.col("grand")
    return total.select((F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"), (between / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"))


def remaining_index(df: DataFrame, by: list[str], loss_year: str, ha: str, years: list[int]) -> DataFrame:
    """Stock left after each year as an index, 100 before the first; ``loss_year`` is 0 or null where nothing was lost."""
    lost = [F.sum(F.when((F.col(loss_year) > 0) & (F.col(loss_year) <= y), F.col(ha)).otherwise(0.0)) for y in years]
    wide = df.groupBy(*by).agg(F.sum(ha).alias("__all"), *[x.alias(str(y)) for x, y in zip(lost, years, strict=True)])
    long = wide.unpivot([*by, "__all"], [str(y) for y in years], "year", "lost")
    return long.select(*by, F.col("year").cast("int").alias("year"), (100 * (1 - F.col("lost") / F.nullif(F.col("__all"), F.lit(0.0)))).alias("index"))


def climatology(df: DataFrame, by: list[str], month: str, value: str, dry: float) -> DataFrame:
    return df.groupBy(*by, month).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.avg(value)).alias("cv"), F.avg((F.col(value) < dry).cast("double")).alias("drought_rate"))


def rate(num: DataFrame, den: DataFrame, on: list[str], scale: float) -> DataFrame:
    """``num.value`` per ``scale`` of ``den.base``."""
    return num.join(den, on, "left").select(*on, (scale * F.col("value") / F.nullif(F.col("base"), F.lit(0.0))).alias("rate"))


def mean_se(df: DataFrame, by: list[str], x: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"))


def signature_groups(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Groups of rows that answer alike (nulls too): ``by``, signature, size and the smallest ``id`` in it. A lost cluster id comes back where sizes agree."""
    return df.groupBy(by, F.xxhash64(*cols).alias("signature")).agg(F.count("*").alias("size"), F.min("id").alias("first_id"))


def composition(df: DataFrame, unit: str, by: list[str], classes: list[str], area: str) -> DataFrame:
    """Area-weighted shares of classes by ``unit`` and ``by``, as parts of their row total."""
    sums = df.groupBy(unit, *by).agg(*[F.sum(F.col(c) * F.col(area)).alias(c) for c in classes])
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return sums.select(unit, *by, *[(F.col(c) / F.nullif(total, F.lit(0.0))).alias(c) for c in classes])


def stack_sources(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in frames.items():
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
