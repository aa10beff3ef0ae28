"""Named pipelines: compositions of the operators into the tables that users ask for. Tables that are read several times are written once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyspark.functions import recode as R
from surveyspark.operators import agg as A
from surveyspark.operators import econ as E
from surveyspark.operators import joins as J
from surveyspark.operators import sensor as N
from surveyspark.operators import spatial as G
from surveyspark.operators import window as W
from surveyspark.sources.scratch import materialize

C = F.col


def land_panel(flows: DataFrame, stock0: float, rain: DataFrame, least: float) -> DataFrame:
    """Unit by year: stock at the start, yearly change, guarded hazard, rain and its anomaly."""
    stock = W.diff(W.depleting_stock(flows.withColumn("__base", F.lit(stock0)), "unit", "year", "loss", "__base"), "unit", "year", ["loss"])
    hazard, usable = R.guarded_ratio(C("loss"), C("stock"), least)
    return J.join_panels([stock.withColumns({"hazard": hazard, "hazard_usable": usable}).drop("__base"), W.anomaly(rain, ["unit"], "rain").select("unit", "year", "rain", "z")], ["unit", "year"], "left")


def cell_master(cells: DataFrame, points: DataFrame, inside: DataFrame, losses: DataFrame) -> DataFrame:
    """Cross-section of units: buildings, their area, density and loss rate."""
    built = G.unit_stats(points, inside, "id", "unit", "v").select("unit", C("n").alias("n_buildings"), C("sum").alias("building_area"))
    loss = losses.groupBy("unit").agg(F.sum("loss_ha").alias("loss_ha"))
    rate, usable = R.guarded_ratio(C("loss_ha"), C("km2"), 1.0)
    out = J.join_panels([cells, built, loss], ["unit"], "left").fillna(0)
    return out.withColumns({"density": C("n_buildings") / C("km2"), "loss_rate": rate, "usable": usable})


def jobs_panel(people: DataFrame, classes: list, unit: str, period: str, cls: str, wt: str, cuts: tuple, names: tuple, per: float = 1000.0) -> DataFrame:
    """Weighted workers by unit, period and class, shares, and the unit's band by workers / ``per`` (``cuts`` between ``names``). One shuffle on (unit, period)."""
    wide = A.weighted_pivot(people, [unit, period], cls, classes, wt)
    total = sum((C(c) for c in classes[1:]), C(classes[0]))
    shares = {f"share_{c}": R.guarded_ratio(C(c), total)[0] for c in classes}
    return wide.withColumns({**shares, "workers": total, "band": R.band(total / per, [0.0, *cuts, 1e12], list(names))})


def output_by_district(crops: DataFrame, firms: DataFrame, district: str, item: str, price: Column, quantity: Column, weight: Column, price_window: Column, turnover: Column, least_share: float = 0.8) -> DataFrame:
    """Fixed-price output of ``crops`` and the turnover of ``firms``, blank where under ``least_share`` of a district's firms report it."""
    prices = A.fixed_price_value(crops, item, price, quantity, weight, price_window, [district])
    services = firms.groupBy(district).agg(A.sum_if_covered(turnover, least_share).alias("turnover"))
    return J.join_panels([prices, services], [district], "left")


def sector_panel(panel: DataFrame, mapping: dict, unit: str, period: str, workers: str, land: str, farm_share: str, people: str) -> DataFrame:
    """Unified panel with model objects: employment share (lam), land per worker, capital of farms and services, crowding, elasticity (eps)."""
    timed = J.match_period(panel, period, mapping, "follows")
    share = A.share_of(timed, workers, [period], "lam")
    trend = A.trend(panel.withColumns({"__y": F.log(workers), "__x": F.log(land)}), [unit], "__y", "__x").select(unit, C("slope").alias("eps"))
    objects = share.select(unit, period, "follows", "lam", (C(land) / C(workers)).alias("land"), (C(farm_share) * C(land)).alias("k_a"), ((1 - C(farm_share)) * C(land)).alias("k_s"), (C(workers) / C(people)).alias("crowd"))
    return J.join_panels([objects, trend], [unit])


def district_rent(plots: DataFrame, index: DataFrame, base: int, district: str, period: str, rent: list[Column], area: Column, area_unit: Column, hectares: dict, wt: str, sentinels: tuple = (), tails: tuple = (0.01, 0.99)) -> DataFrame:
    """Weighted median of real rent a hectare by district and period.

    Rent is the first of ``rent`` that is there and no sentinel; areas are converted by ``hectares`` (unit: hectares), units that it does not
    list are missing. Values are winsorised within the period, then deflated by ``index`` (year, price) to ``base``.
    """
    paid = F.coalesce(*[F.when(~c.isin(*sentinels), c) if sentinels else c for c in rent])
    size = area * F.coalesce(*[F.when(area_unit == F.lit(u), F.lit(float(h))) for u, h in hectares.items()])
    rate = R.guarded_ratio(paid, size, 0.0)[0]
    known = plots.withColumn("rent", rate).filter("rent IS NOT NULL")
    real = R.deflate(W.winsorise(known, "rent", [period], *tails), "rent", period, index, base, "real")
    return A.wquantile(real.withColumn("real", F.round("real", 2)), [district, period], "real", wt)


def density(people: DataFrame, area: DataFrame, unit: str, period: str, wt: str, urban: Column) -> DataFrame:
    """Population density and urban share by unit and period; ``area`` (unit, km2)."""
    pop = people.groupBy(unit, period).agg(F.sum(wt).alias("value"), A.wshare(urban, C(wt)).alias("urban"))
    base = pop.select(unit, period).join(area, unit).select(unit, period, C("km2").alias("base"))
    per = A.rate(pop.select(unit, period, "value"), base, [unit, period], 1.0)
    return per.join(pop.select(unit, period, "urban"), [unit, period])


def controls(people: DataFrame, unit: str, wt: str, shares: dict[str, Column], means: dict[str, Column], ratios: dict[str, tuple[Column, Column]], blocks: list[DataFrame]) -> DataFrame:
    """Baseline control block by unit in one pass over persons: weighted shares, means and ratios of sums; ``blocks`` (unit, ...) stand beside them."""
    w = C(wt)
    sums = [A.wshare(c, w).alias(n) for n, c in shares.items()] + [A.wmean(c, w).alias(n) for n, c in means.items()] + [A.wratio(a, b, w).alias(n) for n, (a, b) in ratios.items()]
    return J.join_panels([people.groupBy(C(unit).alias("unit")).agg(*sums), *blocks], ["unit"], "left")


def housing_panel(people: DataFrame, unit: str, period: str, wt: str, outcomes: dict[str, Column]) -> DataFrame:
    """Weighted means of housing, education, cohort and marriage outcomes by unit and period; an outcome may differ by wave (``by_wave``)."""
    rows = people.withColumns(outcomes)
    return rows.groupBy(unit, period).agg(*[A.wmean(C(c), C(wt)).alias(c) for c in outcomes])


def three_sectors(people: DataFrame, unit: str, period: str, wt: str, farm: Column, candidate: Column, adult: Column, industry: Column, services: Column, rate: float) -> DataFrame:
    """Jobs of three sectors, with farm candidates beyond ``rate`` of the adults added back, and the upper bound of farm jobs."""
    w = lambda c: F.coalesce(F.sum(F.when(c, C(wt))), F.lit(0.0))
    added, upper = A.addback(w(farm), w(candidate), w(adult), rate)
    return people.groupBy(unit, period).agg(added.alias("farm"), upper.alias("farm_upper"), w(industry).alias("industry"), w(services).alias("services"))


def labour_tables(people: DataFrame, district: str, section: str, wt: str, tourism: Column) -> DataFrame:
    """District by section counts and shares, and each district's tourism share."""
    counts = people.groupBy(district, C(section).alias("section")).agg(F.sum(wt).alias("workers"))
    of_all = people.groupBy(district).agg(A.wshare(tourism, C(wt)).alias("tourism"))
    return A.share_of(counts, "workers", [district]).join(of_all, district)


def tourism(people: DataFrame, district: str, wt: str, definitions: dict[str, Column]) -> DataFrame:
    """Tourism employment under each definition, by district and in total."""
    w = lambda c: F.round(F.sum(F.when(c, C(wt)).otherwise(0.0)), 4)
    return A.with_total(people, district, [w(c).alias(name) for name, c in definitions.items()])


def nightlights(long: DataFrame, pop: DataFrame, layers: list[str]) -> DataFrame:
    """Complete unit by period grid of averaged layers with population between knots and derived series."""
    wide = N.layers_wide(N.average_satellites(long, ["total"]), layers, ["total"])
    grid = J.complete_grid(wide.select("unit").distinct(), wide.select("period").distinct())
    people = W.interp_log(wide.select("unit").distinct().join(F.broadcast(wide.select("period").distinct())), pop, ["unit"], "period", "people")
    joined = J.join_panels([grid, wide, people], ["unit", "period"], "left")
    return N.derive_series(joined, f"{layers[0]}_total", "people", 100.0)


def rainfall(monthly: DataFrame, unit: str, year: str, month: str, rain: str) -> DataFrame:
    """District rainfall: complete years only, anomalies, and the nation's mean beside them."""
    whole = W.complete_periods(monthly, [unit, year], month)
    years = W.anomaly(whole.groupBy(unit, year).agg(F.sum(rain).alias(rain)), [unit], rain)
    nation = years.groupBy(year).agg(F.avg(rain).alias("nation"), F.avg(C("drought").cast("double")).alias("drought_share"))
    return years.join(nation, year)


def park_gap(people: DataFrame, unit: str, period: str, wt: str, outcome: Column, treated: Column, event: int, span: tuple) -> DataFrame:
    """Treated less control share of the outcome by period, with the effect of treatment on it from ``event`` on within ``span``."""
    panel = people.groupBy(unit, period).agg(A.wshare(outcome, C(wt)).alias("share")).withColumn("treat", treated.cast("double"))
    panel = materialize(panel, "panel")
    gap = panel.groupBy(period).agg((F.avg(F.when(C("treat") == 1, C("share"))) - F.avg(F.when(C("treat") == 0, C("share")))).alias("gap"))
    effect = E.did(panel.filter(C(period).between(*span)), "share", "treat", unit, period, event, unit).select(C("coef").alias("did"), "p")
    return gap.crossJoin(F.broadcast(effect))  # one row


def survey_wave(people: DataFrame, households: DataFrame, key: list[str], order: list[str], flags: dict[str, Column], head: list[str]) -> DataFrame:
    """Wave assembly: household keys attached, members counted by ``flags``, households collapsed with their head's fields; the first member by ``order`` is the head."""
    counted = A.member_counts(J.attach_keys(people, households, key), key, flags)
    homes, _ = A.collapse_constant(counted, key, F.struct(*order), head)
    return homes


def gate_gradient(panel: DataFrame, outcome: str, unit: str, period: str, km: Column, event: int, cuts: list, names: list) -> DataFrame:
    """Outcome by distance band and the gradient of its growth from ``event`` on in log distance."""
    rows = panel.withColumns({"__km": km, "__ly": F.log(outcome)}).withColumn("band", R.band(C("__km"), cuts, names))
    rows = materialize(rows.select(*dict.fromkeys([outcome, unit, period, "__km", "__ly", "band"])), "bands")
    slope = E.fe_ols(rows.withColumn("__lk", F.log("__km") * (C(period) >= event).cast("double")), "__ly", ["__lk"], [unit, period], unit).select(C("coef").alias("gradient"), "p")
    return rows.groupBy("band", period).agg(F.avg(outcome).alias("y")).crossJoin(F.broadcast(slope))  # one row


def forest_event_study(panel: DataFrame, outcome: str, unit: str, period: str, treated: Column, covariates: list[str], baseline: int, omitted: int, periods: list[int]) -> DataFrame:
    """Event study with overlap weights from the covariates of the ``baseline`` period, on a grid's cells."""
    rows = materialize(panel.withColumn("treat", treated.cast("int")).select(*dict.fromkeys([outcome, unit, period, *covariates, "treat"])), "grid")
    weights = E.overlap_weights(rows.filter(C(period) == baseline).select(unit, *covariates, "treat"), covariates, "treat").select(unit, "overlap_weight")
    terms = {f"treat_{p}": C("treat").cast("double") * (C(period) == p).cast("double") for p in periods if p != omitted}
    return E.fe_ols(rows.join(weights, unit).withColumns(terms), outcome, list(terms), [unit, period], unit, "overlap_weight")


def land_summaries(moves: DataFrame, panel: DataFrame, district: str, period: str, unit: str, along: str, outcome: str, bins: int) -> DataFrame:
    """Net flows by class and binned means along one outcome, in one long table."""
    net = A.gross_flows(moves, district).select(F.concat_ws(" ", F.lit("net"), "class", C(district).cast("string")).alias("name"), C("net").alias("value"))
    binned = A.binscatter(panel, along, [outcome], bins, [period], [unit]).select(F.concat_ws(" ", F.lit("bin"), C(period).cast("string"), C("bin").cast("string")).alias("name"), C(outcome).alias("value"))
    return net.unionAll(binned)


def recode_file(df: DataFrame, kind: str) -> DataFrame:
    """Unit, weight and cluster columns by the file's kind; weights over a million; (0, 0) places are no places."""
    unit, weight, cluster = {"household": ("hhid", "hv005", "hv001"), "woman": ("caseid", "v005", "v001")}[kind]
    x, y = C("x"), C("y")
    place = (x != 0) | (y != 0)
    return df.select(C(unit).cast("string").alias("unit"), (C(weight) / 1e6).alias("wt"), C(cluster).alias("cluster"), F.when(place, x).alias("x"), F.when(place, y).alias("y"))


def district_models(panel: DataFrame, district: str, period: str, outcome: tuple[Column, Column], sums: list[str], means: list[str], models: dict[str, tuple[list, list]], logs: tuple = ()) -> DataFrame:
    """District by period frame (``rate`` is the ratio of the outcome's sums; logs of ``logs`` beside it) and its clustered ``models`` {name: (regressors, fixed effects)}."""
    d = panel.groupBy(district, period).agg(A.wratio(*outcome, F.lit(1.0)).alias("rate"), *[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means])
    d = materialize(d.withColumns({f"log_{c}": F.log(c) for c in logs}) if logs else d, "districts")
    return reduce(DataFrame.unionAll, [E.fe_ols(d, "rate", xs, fes, district).withColumn("model", F.lit(name)) for name, (xs, fes) in models.items()])


def gap_by_waves(panel: DataFrame, outcomes: list[str], unit: str, wave: str, treated: Column, base, waves: list, cluster: str) -> DataFrame:
    """(outcome, wave, coef, se, p, park_base, other_base, park, other): how the gap of treated units has moved since ``base``, one regression with unit and wave
    effects an outcome, beside both groups' means."""
    rows = panel.withColumn("__d", treated.cast("double")).withColumns({f"d_{w}": (C(wave) == w).cast("double") * treated.cast("double") for w in waves})
    rows = materialize(rows.select(*dict.fromkeys([*outcomes, unit, wave, cluster, "__d", *[f"d_{w}" for w in waves]])), "gaps")
    mean = lambda c, w, d: F.avg(F.when((C(wave) == w) & (C("__d") == d), C(c)))
    out = []
    for c in outcomes:
        fit = E.fe_ols(rows, c, [f"d_{w}" for w in waves], [unit, wave], cluster).withColumn("wave", F.substring("term", 3, 20).cast("int"))
        means = rows.agg(mean(c, base, 1).alias("park_base"), mean(c, base, 0).alias("other_base"), F.array(*[F.struct(F.lit(w).alias("wave"), mean(c, w, 1).alias("park"), mean(c, w, 0).alias("other")) for w in waves]).alias("m"))
        means = means.select("park_base", "other_base", F.inline("m"))
        out.append(fit.join(means, "wave").select(F.lit(c).alias("outcome"), "wave", "coef", "se", "p", "park_base", "other_base", "park", "other"))
    return reduce(DataFrame.unionAll, out)


def validate_sources(a: DataFrame, b: DataFrame, district: str, wave: str, part: str, base: str, per: float = 100.0) -> DataFrame:
    """(what, n, correlation, mean_a, mean_b): two surveys' rates by district, wave by wave and as changes between following waves; rates are ratios of sums."""
    rate = lambda df, name: df.groupBy(district, wave).agg((per * F.sum(part) / F.nullif(F.sum(base), F.lit(0.0))).alias(name))
    both = rate(a, "a").join(rate(b, "b"), [district, wave])
    before = Window.partitionBy(district).orderBy(wave)
    both = both.withColumns({"from": F.lag(wave).over(before), "da": C("a") - F.lag("a").over(before), "db": C("b") - F.lag("b").over(before)})
    levels = both.groupBy(C(wave).cast("string").alias("what")).agg(F.count("*").alias("n"), F.corr("a", "b").alias("correlation"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    moved = both.filter(C("from").isNotNull()).groupBy(F.concat_ws("-", C("from").cast("string"), C(wave).cast("string")).alias("what"))
    return levels.unionAll(moved.agg(F.count("*").alias("n"), F.corr("da", "db").alias("correlation"), F.avg("da").alias("mean_a"), F.avg("db").alias("mean_b")))


def outcome_regressions(panel: DataFrame, outcomes: dict[str, Column], share: str, people: str, unit: str, district: str, wave: str, base) -> DataFrame:
    """(outcome, term, coef, se, p, n, clusters, base_mean): each outcome on the services' share and the logarithm of people, with unit and
    district by wave effects, clustered by district; an outcome's column is null in rows that do not count for it."""
    rows = panel.withColumns({"share": C(share).cast("double"), "ln_people": F.log(people), "__cell": F.concat_ws("_", district, wave), **{f"__y{i}": c for i, c in enumerate(outcomes.values())}})
    rows = materialize(rows.select(*dict.fromkeys([unit, district, wave, "share", "ln_people", "__cell", *[f"__y{i}" for i in range(len(outcomes))]])), "outcomes")
    out = []
    for i, name in enumerate(outcomes):
        one = rows.withColumn("__y", C(f"__y{i}")).filter(C("__y").isNotNull())
        fit = E.fe_ols(one, "__y", ["share", "ln_people"], [unit, "__cell"], district)
        mean = one.agg(F.avg(F.when(C(wave) == base, C("__y"))).alias("base_mean"))  # one row
        out.append(fit.crossJoin(F.broadcast(mean)).select(F.lit(name).alias("outcome"), "term", "coef", "se", "p", "n", "clusters", "base_mean"))
    return reduce(DataFrame.unionAll, out)


def forest_grid(pixels: DataFrame, factor: int, covariates: dict[str, Column], loss_year: str, periods: list) -> DataFrame:
    """(cell, period, loss_share, covariates): pixels in cells of factor by factor, complete over ``periods``; the loss in a period as a share of the cell's area."""
    cells = pixels.groupBy(F.floor(C("row") / factor).alias("gy"), F.floor(C("col") / factor).alias("gx")).agg(
        F.sum("ha").alias("ha"), *[c.alias(n) for n, c in covariates.items()], F.array(*[F.struct(F.lit(p).alias("period"), F.sum(F.when(C(loss_year) == p, C("ha")).otherwise(0.0)).alias("lost")) for p in periods]).alias("__p")
    )
    return cells.select(F.concat_ws("_", "gy", "gx").alias("cell"), "gx", "gy", *covariates, "ha", F.inline("__p")).withColumn("loss_share", C("lost") / C("ha")).drop("lost")


def cell_infrastructure(cells: DataFrame, points: DataFrame, edges: DataFrame, lines: DataFrame, planted: DataFrame, size: float) -> DataFrame:
    """``cells`` (unit, km2) with buildings and line kilometres a square kilometre and the planted share of the land, all exact."""
    built = points.join(G.points_in(points, edges, "id", "unit", size), "id").groupBy("unit").agg(F.count("*").alias("n"))
    wires = G.length_by_unit(lines, edges, "id", "unit", size)
    trees = G.overlap_area(edges, planted, "unit", "stand", size).groupBy("unit").agg(F.sum("area").alias("planted"))
    out = J.join_panels([cells, built, wires, trees], ["unit"], "left").fillna(0)
    return out.select("unit", (C("n") / C("km2")).alias("building_density"), (C("length") / C("km2")).alias("line_density"), (C("planted") / C("km2")).alias("planted_share"))
