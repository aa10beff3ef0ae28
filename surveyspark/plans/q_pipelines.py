"""Queries of the named pipelines."""

from pyspark.sql import functions as F

from surveyspark.functions import recode as R
from surveyspark.operators import assembly as Y
from surveyspark.operators import controls as K
from surveyspark.operators import spatial as G

from . import pipelines as P
from . import q_spatial as S
from .base import query
from .q_agg import _LAYERS, monthly, moves, r, rounded

C = F.col


@query("pip_01_land_panel", """WITH @panel, s AS (SELECT sector AS unit, wave AS year, y AS loss, n AS rain, greatest(40 - coalesce(sum(y) OVER (PARTITION BY sector ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS stock FROM panel)
SELECT unit, year, round(stock, 5) AS stock, round(loss - lag(loss) OVER w, 5) AS d_loss, CASE WHEN stock >= 1 THEN round(loss / stock, 6) END AS hazard, round((rain - avg(rain) OVER u) / nullif(stddev_samp(rain) OVER u, 0), 6) AS z FROM s WINDOW w AS (PARTITION BY unit ORDER BY year), u AS (PARTITION BY unit)""")
def _(t):
    flows = t.panel.select(C("sector").alias("unit"), C("wave").alias("year"), C("y").alias("loss"))
    rain = t.panel.select(C("sector").alias("unit"), C("wave").alias("year"), C("n").alias("rain"))
    df = P.land_panel(flows, 40.0, rain, 1.0)
    return df.select("unit", "year", r("stock", 5).alias("stock"), r("d_loss", 5).alias("d_loss"), r("hazard").alias("hazard"), r("z").alias("z"))


@query("pip_02_cell_master", f"""WITH {S._PIX}, {S._PTS}, p AS (SELECT (floor(x / 20) + 5 * floor(y / 20))::INTEGER AS unit, count(*) AS n FROM pts GROUP BY 1), l AS (SELECT unit, sum(ha) AS l FROM lab WHERE cover >= 30 AND loss > 0 GROUP BY 1)
SELECT n_nationkey AS unit, round(coalesce(n, 0) / 400.0, 6) AS density, round(coalesce(l, 0) / 400.0, 6) AS loss_rate FROM nation LEFT JOIN p ON p.unit = n_nationkey LEFT JOIN l ON l.unit = n_nationkey""")
def _(t):
    pts = S.points(t)
    losses = G.annual_loss(S.pixels(t), S.labels(t), "unit", "loss", "cover", 30)
    df = P.cell_master(S.units(t).select("unit", F.lit(400.0).alias("km2")), pts, G.points_in(pts, S.edges(t), "id", "unit", 10.0), losses)
    return df.select("unit", r("density").alias("density"), r("loss_rate").alias("loss_rate"))


@query("pip_03_jobs_panel", """WITH @person, g AS (SELECT sector, wave, coalesce(sum(wt) FILTER (cls = 'A'), 0) AS a, coalesce(sum(wt) FILTER (cls = 'N'), 0) AS n, coalesce(sum(wt) FILTER (cls = 'R'), 0) AS r FROM person GROUP BY 1, 2)
SELECT sector, wave, round(a, 4) AS "A", round(n, 4) AS "N", round(r, 4) AS "R", round(a / (a + n + r), 8) AS "share_A", round(n / (a + n + r), 8) AS "share_N", round(r / (a + n + r), 8) AS "share_R", round(a + n + r, 4) AS workers, CASE WHEN a + n + r <= 10000 THEN 'small' WHEN a + n + r <= 20000 THEN 'medium' ELSE 'large' END AS band FROM g""")
def _(t):
    df = P.jobs_panel(t.person, ["A", "N", "R"], "sector", "wave", "cls", "wt", (10.0, 20.0), ("small", "medium", "large"))
    return rounded(rounded(df, 4, "A", "N", "R", "workers"), 8, "share_A", "share_N", "share_R")


@query("pip_04_output", """WITH @person, p AS (SELECT type, quantile_cont(value / wt, 0.5) AS price FROM person WHERE wave BETWEEN 1996 AND 1998 GROUP BY type), v AS (SELECT dist, sum(wt * price) AS value, avg((price IS NOT NULL)::INT) AS covered FROM person LEFT JOIN p USING (type) GROUP BY dist),
s AS (SELECT dist, CASE WHEN count(CASE WHEN size < 48 THEN 1 END) >= 0.8 * count(*) THEN sum(value) FILTER (size < 48) END AS turnover FROM person WHERE segment <> 'BUILDING' GROUP BY dist) SELECT dist, round(value, 1) AS value, round(covered, 6) AS covered, round(turnover, 0) AS turnover FROM v LEFT JOIN s USING (dist)""")
def _(t):
    firms = t.person.filter("segment <> 'BUILDING'")
    df = P.output_by_district(t.person, firms, "dist", "type", C("value") / C("wt"), C("wt"), F.lit(1.0), C("wave").between(1996, 1998), F.when(C("size") < 48, C("value")))
    return df.select("dist", r("value", 1).alias("value"), r("covered").alias("covered"), r("turnover", 0).alias("turnover"))


@query("pip_05_sector_panel", """WITH @panel, e AS (SELECT sector, regr_slope(ln(y), ln(x)) AS eps FROM panel GROUP BY sector), s AS (SELECT *, y / sum(y) OVER (PARTITION BY wave) AS lam FROM panel WHERE wave > 1995)
SELECT sector, wave, CASE WHEN wave < 1998 THEN 1995 ELSE 1998 END AS follows, round(lam, 8) AS lam, round(x / y, 6) AS land, round(z * x, 6) AS k_a, round((1 - z) * x, 6) AS k_s, round(y / n, 8) AS crowd, round(eps, 5) AS eps FROM s JOIN e USING (sector)""")
def _(t):
    df = P.sector_panel(t.panel, {1996: 1995, 1997: 1995, 1998: 1998, 1999: 1998, 2000: 1998}, "sector", "wave", "y", "x", "z", "n")
    return rounded(rounded(rounded(df, 8, "lam", "crowd"), 6, "land", "k_a", "k_s"), 5, "eps")


@query("pip_06_district_rent", """WITH @person, p AS (SELECT dist, wave, wt, value / (wt * CASE cls WHEN 'A' THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END) AS rent FROM person WHERE cls IN ('A', 'N') AND value NOT IN (98, 99) AND wt > 0),
q AS (SELECT wave, quantile_cont(rent, 0.01) AS lo, quantile_cont(rent, 0.99) AS hi FROM p GROUP BY wave), i AS (SELECT year(o_orderdate)::INTEGER AS year, round(avg(o_totalprice) / 1000, 2) AS price FROM orders GROUP BY 1),
v AS (SELECT dist, wave, round(least(greatest(rent, lo), hi) * (SELECT price FROM i WHERE year = 1997) / price, 2) AS real, wt FROM p JOIN q USING (wave) JOIN i ON year = wave), g AS (SELECT dist, wave, real, sum(wt) AS w FROM v GROUP BY 1, 2, 3),
c AS (SELECT *, sum(w) OVER (PARTITION BY dist, wave ORDER BY real) AS cum, sum(w) OVER (PARTITION BY dist, wave) AS whole FROM g) SELECT dist, wave, min(real) AS wquantile FROM c WHERE cum >= 0.5 * whole GROUP BY 1, 2""")
def _(t):
    index = t["orders"].groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.avg("o_totalprice") / 1000, 2).alias("price"))
    # Areas of the first flag are in tenths of a hectare; a rent of 98 or 99 and the last flag's units are not known.
    rent = [F.when(C("wave") < 1997, C("value")), C("value")]
    return P.district_rent(t.person, index, 1997, "dist", "wave", rent, C("wt"), C("cls"), {"A": 0.1, "N": 1.0}, "wt", (98, 99))


@query("pip_07_density", """WITH @person SELECT sector, wave, round(sum(wt) / (400.0 + sector), 6) AS rate, round(sum(wt) FILTER (cls = 'R') / sum(wt), 8) AS urban FROM person GROUP BY 1, 2""")
def _(t):
    area = t["nation"].select(C("n_nationkey").alias("sector"), (400.0 + C("n_nationkey")).alias("km2"))
    df = P.density(t.person, area, "sector", "wave", "wt", C("cls") == "R")
    return df.select("sector", "wave", r("rate").alias("rate"), r("urban", 8).alias("urban"))


@query("pip_08_controls", """WITH @person SELECT sector AS unit, round(sum(wt) FILTER (age < 15) / sum(wt), 8) AS young, round(sum(wt) FILTER (age >= 45) / sum(wt), 8) AS old, round(sum(wt) FILTER (sex = 'F') / sum(wt), 8) AS female, round(sum(wt * (size <= 3)::INT) FILTER (size < 48) / sum(wt) FILTER (size < 48), 8) AS small, round(sum(value * disc * wt) / sum(value * wt), 8) AS rate, round(sum(tax * wt) / sum(wt), 8) AS tax,
 round(sum(wt) FILTER (cls = 'R') / sum(wt), 8) AS returned, round(sum(wt) FILTER (segment = 'BUILDING') / sum(wt), 8) AS building, 400.0::DOUBLE AS area FROM person GROUP BY sector""")
def _(t):
    climate = G.rain_climate(monthly(t), "sector", "wave", "month", "rain", 150, 0.95).select(C("sector").alias("unit"), C("cv").alias("rain_cv"))
    shares = {"young": C("age") < 15, "old": C("age") >= 45, "female": C("sex") == "F", "returned": C("cls") == "R", "building": C("segment") == "BUILDING"}
    means = {"small": R.share(C("size"), [1, 2, 3], [48, 49, 50]), "tax": C("tax")}
    df = P.controls(t.person, "sector", "wt", shares, means, {"rate": (C("value") * C("disc"), C("value"))}, [G.shape_stats(S.edges(t), "unit").select("unit", "area"), climate]).drop("rain_cv")
    return rounded(df, 8, "young", "old", "female", "small", "rate", "tax", "returned", "building")


@query("pip_09_housing", """WITH @person, p AS (SELECT sector, wave, wt, (CASE wave WHEN 1996 THEN (cls = 'R') WHEN 1998 THEN (sex = 'F') ELSE size <= 4 END)::INT AS good, CASE least(pid, 4) WHEN 1 THEN least(size, 6) WHEN 2 THEN 6 + least(size, 3) WHEN 3 THEN 9 + least(size, 3) ELSE 12 + least(size, 4) END AS years, (disc > 0.05 OR tax > 0.04)::INT AS owns, least(greatest(age - 10, 0), 12) / 12.0 AS ramp FROM person WHERE wave IN (1996, 1998, 2000))
SELECT sector, wave, round(sum(good * wt) / sum(wt), 8) AS good, round(sum(years * wt) / sum(wt), 8) AS years, round(sum(owns * wt) / sum(wt), 8) AS owns, round(sum(ramp * wt) / sum(wt), 8) AS ramp FROM p GROUP BY 1, 2""")
def _(t):
    good = R.by_wave(C("wave"), {1996: R.share(C("cls"), ["R"]), 1998: R.share(C("sex"), ["F"]), 2000: R.share(C("size"), [1, 2, 3, 4])})
    years = R.schooling_years(F.least(C("pid"), F.lit(4)), C("size"), {1: 0, 2: 6, 3: 9, 4: 12}, {1: 6, 2: 3, 3: 3, 4: 4})
    outcomes = {"good": good, "years": years, "owns": R.any_of([C("disc") > 0.05, C("tax") > 0.04]).cast("double"), "ramp": R.exposure(C("age"), 10, 12)}
    return rounded(P.housing_panel(t.person.filter(C("wave").isin(1996, 1998, 2000)), "sector", "wave", "wt", outcomes), 8, *outcomes)


@query("pip_10_three_sectors", """WITH @person, g AS (SELECT sector, wave, coalesce(sum(wt) FILTER (cls = 'A'), 0) AS rec, coalesce(sum(wt) FILTER (cls = 'R' AND size > 25), 0) AS cand, coalesce(sum(wt) FILTER (age BETWEEN 15 AND 45), 0) AS ad, coalesce(sum(wt) FILTER (segment IN ('BUILDING', 'MACHINERY')), 0) AS i, coalesce(sum(wt) FILTER (segment NOT IN ('BUILDING', 'MACHINERY')), 0) AS s FROM person GROUP BY 1, 2)
SELECT sector, wave, round(rec + greatest(cand - 0.2 * ad, 0), 4) AS farm, round(rec + cand, 4) AS farm_upper, round(i, 4) AS industry, round(s, 4) AS services FROM g""")
def _(t):
    industry = C("segment").isin("BUILDING", "MACHINERY")
    return rounded(P.three_sectors(t.person, "sector", "wave", "wt", C("cls") == "A", (C("cls") == "R") & (C("size") > 25), C("age").between(15, 45), industry, ~industry, 0.2), 4, "farm", "farm_upper", "industry", "services")


@query("pip_11_labour_tables", """WITH @person, c AS (SELECT dist, segment AS section, sum(wt) AS workers FROM person GROUP BY 1, 2), t AS (SELECT dist, sum(wt) FILTER (brand LIKE '%#1%') / sum(wt) AS tourism FROM person GROUP BY 1) SELECT dist, section, round(workers, 4) AS workers, round(workers / sum(workers) OVER (PARTITION BY dist), 8) AS share, round(tourism, 8) AS tourism FROM c JOIN t USING (dist)""")
def _(t):
    return rounded(rounded(P.labour_tables(t.person, "dist", "segment", "wt", C("brand").contains("#1")), 4, "workers"), 8, "share", "tourism")


@query("pip_12_tourism", """WITH @person SELECT coalesce(dist::VARCHAR, 'total') AS dist, round(sum(CASE WHEN brand LIKE '%#1%' AND size <= 10 THEN wt ELSE 0 END), 4) AS narrow, round(sum(CASE WHEN brand LIKE '%#1%' THEN wt ELSE 0 END), 4) AS medium, round(sum(CASE WHEN brand LIKE '%#1%' OR segment = 'FURNITURE' THEN wt ELSE 0 END), 4) AS wide FROM person GROUP BY ROLLUP (dist)""")
def _(t):
    hotel = C("brand").contains("#1")
    return P.tourism(t.person, "dist", "wt", {"narrow": hotel & (C("size") <= 10), "medium": hotel, "wide": hotel | (C("segment") == "FURNITURE")})


@query("pip_13_nightlights")
def _(t):
    pop = t["customer"].groupBy(C("c_nationkey").alias("unit")).agg(F.count("*").cast("double").alias("n")).select("unit", F.inline(F.array(F.struct(F.lit(199501).alias("period"), C("n").alias("people")), F.struct(F.lit(199901).alias("period"), (1.2 * C("n")).alias("people")))))
    return P.nightlights(S.long(t), pop, ["A", "R"])


@query("pip_14_rainfall", """WITH @person, m AS (SELECT sector, wave, month, round(sum(wt), 4) AS rain FROM person WHERE wave BETWEEN 1995 AND 2000 GROUP BY 1, 2, 3), y AS (SELECT sector, wave, sum(rain) AS rain FROM m GROUP BY 1, 2 HAVING count(DISTINCT month) = 12),
k AS (SELECT *, (rain - avg(rain) OVER u) / nullif(stddev_samp(rain) OVER u, 0) AS z, (rank() OVER (PARTITION BY sector ORDER BY rain) + (count(*) OVER (PARTITION BY sector, rain) - 1) / 2.0) / count(*) OVER u <= 0.2 AS drought FROM y WINDOW u AS (PARTITION BY sector)), n AS (SELECT wave, avg(rain) AS nation, avg(drought::INT) AS ds FROM k GROUP BY wave)
SELECT sector, wave, round(rain, 4) AS rain, round(z, 6) AS z, drought, round(nation, 4) AS nation, round(ds, 6) AS drought_share FROM k JOIN n USING (wave)""")
def _(t):
    df = P.rainfall(monthly(t), "sector", "wave", "month", "rain")
    return df.select("sector", "wave", r("rain", 4).alias("rain"), r("z").alias("z"), "drought", r("nation", 4).alias("nation"), r("drought_share").alias("drought_share"))


@query("pip_15_park_gap", """WITH @person, p AS (SELECT sector, wave, sum(CASE WHEN cls = 'R' THEN wt ELSE 0 END) / sum(wt) AS s FROM person GROUP BY 1, 2), g AS (SELECT wave, avg(s) FILTER (sector < 8) - avg(s) FILTER (sector >= 8) AS gap FROM p GROUP BY wave) SELECT wave, round(gap, 8) AS gap, round((SELECT avg(gap) FILTER (wave >= 1998) - avg(gap) FILTER (wave < 1998) FROM g WHERE wave BETWEEN 1995 AND 2000), 6) AS did FROM g""")
def _(t):
    return P.park_gap(t.person, "sector", "wave", "wt", C("cls") == "R", C("sector") < 8, 1998, (1995, 2000)).select("wave", r("gap", 8).alias("gap"), r("did").alias("did"))


@query("pip_16_survey_wave", """SELECT l_orderkey AS hhid, count(*)::BIGINT AS size FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_suppkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t):
    households = t["orders"].select(C("o_orderkey").alias("hhid"), C("o_custkey").alias("custkey"))
    people = t.person.select("hhid", "wave", "sector", "pid", "partkey", "value", "suppkey", "wt", "age", "cls").distinct()
    return P.survey_wave(people, households, ["hhid"], ["pid", "partkey", "value"], {"young": C("age") < 15}, ["age", "cls"]).select("hhid", "size")


@query("pip_17_gate_gradient")
def _(t):
    return P.gate_gradient(t.panel, "y", "sector", "wave", 1.0 + C("sector"), 1998, [0, 5, 12, 100], ["near", "mid", "far"])


@query("pip_17_gate_bands", """WITH @panel, q AS (SELECT sector, wave, y, CASE WHEN sector + 1 <= 5 THEN 'near' WHEN sector + 1 <= 12 THEN 'mid' ELSE 'far' END AS band, ln(y) AS v, CASE WHEN wave >= 1998 THEN ln(1.0 + sector) ELSE 0 END AS x FROM panel),
w AS (SELECT v - avg(v) OVER s - avg(v) OVER t + avg(v) OVER () AS v, x - avg(x) OVER s - avg(x) OVER t + avg(x) OVER () AS x FROM q WINDOW s AS (PARTITION BY sector), t AS (PARTITION BY wave)), g AS (SELECT sum(x * v) / sum(x * x) AS g FROM w) SELECT band, wave, round(avg(y), 5) AS y, round(max(g), 6) AS gradient FROM q, g GROUP BY band, wave""")
def _(t):
    df = P.gate_gradient(t.panel, "y", "sector", "wave", 1.0 + C("sector"), 1998, [0, 5, 12, 100], ["near", "mid", "far"])
    return df.select("band", "wave", r("y", 5).alias("y"), r("gradient").alias("gradient"))


@query("pip_18_forest_event_study")
def _(t):
    return P.forest_event_study(t.panel, "y", "sector", "wave", C("sector") % 3 == 0, ["x", "z"], 1995, 1997, list(range(1995, 2001)))


@query("pip_19_land_summaries", f"""WITH @person{_LAYERS}, moved AS (SELECT dist, f AS class, ha AS loss, 0 AS gain FROM tr WHERE f <> t UNION ALL SELECT dist, t, 0, ha FROM tr WHERE f <> t), panel AS (SELECT sector, wave, round(sum(wt), 4) / 1000 AS y, round(sum(value), 2) / 1e6 AS x FROM person WHERE wave BETWEEN 1995 AND 2000 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY wave ORDER BY x, sector) AS r, count(*) OVER (PARTITION BY wave) AS m FROM panel), binned AS (SELECT *, greatest(1, ceil((r - 1) * 4 / (m - 1)))::INTEGER AS bin FROM ranked)
SELECT concat_ws(' ', 'net', class, dist) AS name, round(sum(gain) - sum(loss), 4) AS value FROM moved GROUP BY class, dist UNION ALL SELECT concat_ws(' ', 'bin', wave, bin), round(avg(y), 4) FROM binned GROUP BY wave, bin""")
def _(t):
    return rounded(P.land_summaries(moves(t), t.panel, "dist", "wave", "sector", "x", "y", 4), 4, "value")


@query("pip_20_recode_file", """SELECT o_orderkey::VARCHAR AS unit, o_custkey * 100 / 1e6 AS wt, (o_custkey % 50)::BIGINT AS cluster, CASE WHEN o_orderkey % 4 > 0 OR o_custkey % 3 > 0 THEN (o_orderkey % 4)::DOUBLE END AS x, CASE WHEN o_orderkey % 4 > 0 OR o_custkey % 3 > 0 THEN (o_custkey % 3)::DOUBLE END AS y FROM orders""")
def _(t):
    df = t["orders"].select(C("o_orderkey").alias("hhid"), (C("o_custkey") * 100).alias("hv005"), (C("o_custkey") % 50).alias("hv001"), (C("o_orderkey") % 4).cast("double").alias("x"), (C("o_custkey") % 3).cast("double").alias("y"))
    return P.recode_file(df, "household")


@query("pip_21_district_models")
def _(t):
    models = {"pooled": (["x"], []), "district": (["x"], ["dist"]), "two-way": (["x"], ["dist", "wave"]), "controls": (["x", "z", "log_n"], ["dist"])}
    return P.district_models(t.panel, "dist", "wave", (C("y"), C("n")), ["x", "n"], ["z"], models, ("n",))


@query("pip_21_model_terms", """WITH @panel, d AS (SELECT dist, wave, sum(y) / sum(n) AS y, sum(x) AS x FROM panel GROUP BY 1, 2), v AS (SELECT 'pooled' AS model, y - avg(y) OVER () AS y, x - avg(x) OVER () AS x FROM d UNION ALL SELECT 'district', y - avg(y) OVER (PARTITION BY dist), x - avg(x) OVER (PARTITION BY dist) FROM d
UNION ALL SELECT 'two-way', y - avg(y) OVER (PARTITION BY dist) - avg(y) OVER (PARTITION BY wave) + avg(y) OVER (), x - avg(x) OVER (PARTITION BY dist) - avg(x) OVER (PARTITION BY wave) + avg(x) OVER () FROM d) SELECT model, round(1e6 * sum(x * y) / sum(x * x), 4) AS micro FROM v GROUP BY model""")
def _(t):
    models = {"pooled": (["x"], []), "district": (["x"], ["dist"]), "two-way": (["x"], ["dist", "wave"])}
    df = P.district_models(t.panel, "dist", "wave", (C("y"), C("n")), ["x", "n"], ["z"], models, ("n",))
    return df.select("model", F.round(1e6 * C("coef"), 4).alias("micro"))


#: Modules of one wave: a base and a dwelling file a household, a roster and a work file a person, plots with several rows, parts without a household.
_WAVE = """base AS (SELECT o_orderkey AS hhid, c_nationkey AS dist, 1 + o_orderkey % 5 AS wt, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS roof FROM orders JOIN customer ON o_custkey = c_custkey),
dwelling AS (SELECT 7 * o_orderkey + 1 AS hhid, o_orderpriority AS roof, o_totalprice AS rent FROM orders WHERE o_orderkey % 4 < 3),
link AS (SELECT o_orderkey AS hhid, 7 * o_orderkey + 1 AS oldkey FROM orders),
roster AS (SELECT l_orderkey AS hhid, l_linenumber AS pid, min(l_partkey) AS age, max(l_returnflag) AS sex FROM lineitem GROUP BY 1, 2),
work AS (SELECT l_orderkey AS hhid, l_linenumber AS pid, max(l_suppkey) AS job, max(l_returnflag || '.') AS sex FROM lineitem WHERE l_linenumber < 4 GROUP BY 1, 2)"""


def wave_modules(t):
    first = lambda *cols: t["lineitem"].groupBy(C("l_orderkey").alias("hhid"), C("l_linenumber").alias("pid")).agg(*cols)
    orders = t["orders"]
    return {
        "base": orders.join(t["customer"], C("o_custkey") == C("c_custkey")).select(C("o_orderkey").alias("hhid"), C("c_nationkey").alias("dist"), (1 + C("o_orderkey") % 5).alias("wt"), F.when(C("o_orderkey") % 3 > 0, C("o_orderpriority")).alias("roof")),
        "dwelling": orders.filter("o_orderkey % 4 < 3").select((7 * C("o_orderkey") + 1).alias("hhid"), C("o_orderpriority").alias("roof"), C("o_totalprice").alias("rent")),
        "link": orders.select(C("o_orderkey").alias("hhid"), (7 * C("o_orderkey") + 1).alias("oldkey")),
        "roster": first(F.min("l_partkey").alias("age"), F.max("l_returnflag").alias("sex")),
        "work": first(F.max(F.when(C("l_linenumber") < 4, C("l_suppkey"))).alias("job"), F.max(F.concat("l_returnflag", F.lit("."))).alias("sex")).filter("pid < 4"),
        "plots": t["lineitem"].select(C("l_orderkey").alias("hhid"), C("l_linenumber").alias("pid"), C("l_quantity").alias("area")),
        "parts": t["part"].select(C("p_partkey").alias("item"), C("p_size").alias("size")),
    }


def assembled(t):
    return Y.assemble_wave(wave_modules(t), "hhid", "pid", ["base"], "roster", ["dist", "wt"], crosswalk=("link", "oldkey"), head=(C("pid") == 1, ["age", "sex"]))


@query("pip_16_household_file", f"""WITH {_WAVE}, m AS (SELECT hhid, count(*) AS hhsize, max(age) FILTER (pid = 1) AS head_age, max(sex) FILTER (pid = 1) AS head_sex FROM roster GROUP BY hhid)
SELECT b.hhid, dist, wt, coalesce(b.roof, d.roof) AS roof, rent, oldkey, hhsize::BIGINT AS hhsize, head_age, head_sex FROM base b LEFT JOIN dwelling d ON d.hhid = 7 * b.hhid + 1 LEFT JOIN link l ON l.hhid = b.hhid LEFT JOIN m ON m.hhid = b.hhid""")
def _(t):
    return assembled(t).household.select("hhid", "dist", "wt", "roof", "rent", "oldkey", "hhsize", "head_age", "head_sex")


@query("pip_16_person_file", f"""WITH {_WAVE} SELECT hhid, pid, age, r.sex, dist, wt, job, w.sex AS sex_work FROM roster r JOIN base USING (hhid) LEFT JOIN work w USING (hhid, pid)""")
def _(t):
    return assembled(t).person.select("hhid", "pid", "age", "sex", "dist", "wt", "job", "sex_work")


@query("pip_16_modules", f"""WITH {_WAVE}, p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT 'base' AS module, 'household' AS level, (SELECT count(*) FROM base)::BIGINT AS n, 'hhid' AS "key", 1.0::DOUBLE AS match_rate UNION ALL SELECT 'dwelling', 'household', (SELECT count(*) FROM dwelling), 'hhid', 1.0 UNION ALL SELECT 'link', 'household', (SELECT count(*) FROM link), 'hhid', 1.0
UNION ALL SELECT 'roster', 'person', (SELECT count(*) FROM roster), 'hhid+pid', 1.0 UNION ALL SELECT 'work', 'person', (SELECT count(*) FROM work), 'hhid+pid', 1.0 UNION ALL SELECT 'plots', 'multi', (SELECT count(*) FROM lineitem), NULL, 1.0 UNION ALL SELECT 'parts', 'other', (SELECT count(*) FROM part), NULL, NULL""")
def _(t):
    return assembled(t).report()


@query("pip_16_checks", f"""WITH {_WAVE}, h AS (SELECT count(*)::DOUBLE AS n FROM base), p AS (SELECT count(*)::DOUBLE AS n FROM roster) SELECT 'wave' AS section, unnest(['households', 'persons', 'sizes', 'household weights', 'person weights']) AS name, unnest([h.n, p.n, p.n, 0, 0])::DOUBLE AS ours, unnest([h.n, p.n, p.n, 0, 0])::DOUBLE AS reference, 'ok' AS result FROM h, p""")
def _(t):
    return Y.check_wave(assembled(t), "hhid", "pid", "wt")


@query("pip_16_dependencies", """WITH g AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS a, count(DISTINCT l_returnflag) AS b, 1 AS c FROM lineitem GROUP BY 1)
SELECT unnest(['pid', 'flag', 'parity']) AS "column", count(*)::BIGINT AS n_groups, unnest([count(*) FILTER (a > 1), count(*) FILTER (b > 1), 0])::BIGINT AS n_varying, unnest([count(*) FILTER (a > 1) = 0, count(*) FILTER (b > 1) = 0, true]) AS depends FROM g""")
def _(t):
    rows = t["lineitem"].select(C("l_orderkey").alias("hhid"), C("l_linenumber").alias("pid"), C("l_returnflag").alias("flag"), (C("l_orderkey") % 2).alias("parity"))
    return Y.dependencies(rows, ["hhid"])


# Baseline items with their number of codes, the last of which often means "not stated"; missing in one row of 13.
_HOME_ITEMS = "household_size 9, head_sex 3, head_age 80, absent 3, residents 7, visitors 2, male 4, female 4, urban 3, settlement 10, dwelling_type 10, tenure 10, lighting_source 10, cooking_energy 10, living_rooms 100, radio_television 10, telephone 10, bicycles 100"
_PERSON_ITEMS = "age 90, relation_head 11, marital_grouped 10, handicap_type 10, handicap_cause 8, parents_survival 10, residence_duration 100, birth_place 10000, previous_residence 10000, nationality 1000, languages_spoken 100, marital_status 9, religion 8"


def _items(text, key):
    pairs = [x.split() for x in text.split(", ")]
    return {name: f"CASE WHEN ({key} + {i}) % 13 <> 0 THEN ({key} * {2 * i + 1} + {key} % {i + 5}) % {n} END" for i, (name, n) in enumerate(pairs)}


def baseline(t):
    home = t["orders"].join(t["customer"], C("o_custkey") == C("c_custkey")).select(C("c_nationkey").alias("unit"), (1 + C("o_orderkey") % 5).alias("w"), C("o_orderkey").alias("k"))
    people = t.person.select(C("sector").alias("unit"), C("wt").alias("w"), (C("hhid") * 5 + C("pid")).alias("k"))
    with_items = lambda df, text: df.select("unit", "w", *[F.expr(sql).alias(name) for name, sql in _items(text, "k").items()])
    middle = S.units(t).select("unit", (C("x0") + 10).alias("x"), (C("y0") + 10).alias("y"))
    near = lambda *spots: F.least(*[F.hypot(C("x") - a, C("y") - b) for a, b in spots]) if len(spots) > 1 else F.hypot(C("x") - spots[0][0], C("y") - spots[0][1])
    access = middle.select("unit", near((47, 55)).alias("capital"), F.least("x", "y", 100 - C("x"), 100 - C("y")).alias("border"), near((12, 83), (71, 26), (88, 91)).alias("town"))
    climate = G.rain_climate(monthly(t), "sector", "wave", "month", "rain", 150, 0.95).withColumnRenamed("sector", "unit")
    given = {"terrain": G.terrain(S.pixels(t), S.labels(t).drop("share"), "unit", 30.0), "access": access, "shape": G.shape_stats(S.edges(t), "unit"), "climate": climate}
    return K.control_block({"household": with_items(home, _HOME_ITEMS), "person": with_items(people, _PERSON_ITEMS)}, "unit", "w", given)


def _share(c, yes, no=None):
    return f"sum(w * ({yes})::INTEGER) FILTER ({c} IS NOT NULL{f' AND {c} NOT IN ({no})' if no else ''}) / sum(w) FILTER ({c} IS NOT NULL{f' AND {c} NOT IN ({no})' if no else ''})"


_HOME = {
    "hh_size": "sum(household_size * w) / sum(w) FILTER (household_size IS NOT NULL)", "female_head": "sum(w * coalesce(head_sex = 2, false)::INTEGER) / sum(w)", "head_age": "sum(head_age * w) / sum(w) FILTER (head_age IS NOT NULL)",
    "absent_share": "sum(absent * w) / nullif(sum(residents * w), 0)", "visitor_share": "sum(visitors * w) / nullif(sum(residents * w) + sum(visitors * w), 0)", "sex_ratio": "sum(male * w) / nullif(sum(female * w), 0)",
    "urban": "sum(w * coalesce(urban = 1, false)::INTEGER) / sum(w)", "planned": _share("settlement", "settlement = 1 OR settlement = 4", "9"), "onehh_house": _share("dwelling_type", "dwelling_type = 1", "9"), "owner": _share("tenure", "tenure = 1", "9"),
    "electric": _share("lighting_source", "lighting_source IN (1, 2)", "9"), "firewood": _share("cooking_energy", "cooking_energy = 4", "9"), "rooms": "sum(living_rooms * w) FILTER (living_rooms < 90) / sum(w) FILTER (living_rooms < 90)",
    "radiotv": _share("radio_television", "radio_television IN (1, 2, 3)", "9"), "phone": _share("telephone", "telephone BETWEEN 1 AND 3", "9"), "bicycle": _share("bicycles", "bicycles > 0", "99"),
}
_PEOPLE = {
    "share_u15": "sum(w * coalesce(age < 15, false)::INTEGER) / sum(w)", "share_65p": "sum(w * coalesce(age >= 65, false)::INTEGER) / sum(w)", "extended": _share("relation_head", "relation_head IN (7, 8)", "99"), "nonrelative": _share("relation_head", "relation_head = 9", "99"),
    "child_head": "sum(w * coalesce(age < 18, false)::INTEGER) FILTER (relation_head = 1) / sum(w) FILTER (relation_head = 1)", "never_married": _share("marital_grouped", "marital_grouped = 1", "99"), "divorced": _share("marital_grouped", "marital_grouped = 8", "99"), "widowed": _share("marital_grouped", "marital_grouped = 9", "99"),
    "handicap": _share("handicap_type", "handicap_type >= 2 AND handicap_type <= 8", "9"), "war_disab": "sum(w * coalesce(handicap_cause IN (4, 5, 6), false)::INTEGER) / sum(w)", "orphan_double": _share("parents_survival", "parents_survival = 4", "5, 9"), "orphan_any": _share("parents_survival", "parents_survival IN (2, 3, 4)", "5, 9"),
    "newcomer5": _share("residence_duration", "residence_duration < 5", "98"), "foreign_born": _share("birth_place", "birth_place >= 2000", "9999"), "prev_abroad": _share("previous_residence", "previous_residence >= 2000", "9999"), "foreign_national": _share("nationality", "nationality <> 100", "999"),
    "english": _share("languages_spoken", "languages_spoken < 32 AND languages_spoken // 8 % 2 = 1", "99"), "french": _share("languages_spoken", "languages_spoken < 32 AND languages_spoken // 2 % 2 = 1", "99"), "swahili": _share("languages_spoken", "languages_spoken < 32 AND languages_spoken // 4 % 2 = 1", "99"),
    "cohabiting": _share("marital_status", "marital_status = 2", "99"), "polygamous": _share("marital_status", "marital_status BETWEEN 4 AND 7", "99"), "catholic": _share("religion", "religion = 1", "99"), "protestant": _share("religion", "religion = 2", "99"), "muslim": _share("religion", "religion = 6", "99"), "log_pop": "ln(sum(w))",
}
_GIVEN = {
    "elev_mean": "mean", "elev_sd": "sd", "slope_mean": "slope", "log_dist_capital": "ln(sqrt(pow(x - 47, 2) + pow(y - 55, 2)))", "log_area": "ln(400.0)", "compactness": "4 * pi() * 400 / 6400", "log_dist_border": "ln(least(x, y, 100 - x, 100 - y))",
    "log_dist_town": "ln(least(sqrt(pow(x - 12, 2) + pow(y - 83, 2)), sqrt(pow(x - 71, 2) + pow(y - 26, 2)), sqrt(pow(x - 88, 2) + pow(y - 91, 2))))", "rain_mean": "rmean", "rain_cv": "cv", "dry_months": "dry_months", "drought_freq": "drought_share",
}
_BLOCK_SQL = f"""WITH @person, h AS (SELECT c_nationkey AS unit, (1 + o_orderkey % 5)::DOUBLE AS w, {", ".join(f"{q} AS {n}" for n, q in _items(_HOME_ITEMS, "o_orderkey").items())} FROM orders JOIN customer ON o_custkey = c_custkey),
z AS (SELECT sector AS unit, wt::DOUBLE AS w, hhid * 5 + pid AS k FROM person), p AS (SELECT unit, w, {", ".join(f"{q} AS {n}" for n, q in _items(_PERSON_ITEMS, "k").items())} FROM z),
hs AS (SELECT unit, {", ".join(f"{q} AS {n}" for n, q in _HOME.items())} FROM h GROUP BY unit), ps AS (SELECT unit, {", ".join(f"{q} AS {n}" for n, q in _PEOPLE.items())} FROM p GROUP BY unit),
{S._PIX}, sl AS (SELECT l.unit, l.value, degrees(atan(sqrt(pow((e.value - w.value) / 60, 2) + pow((n.value - s.value) / 60, 2)))) AS slope FROM lab l LEFT JOIN px e ON e.row = l.row AND e.col = l.col + 1 LEFT JOIN px w ON w.row = l.row AND w.col = l.col - 1 LEFT JOIN px n ON n.row = l.row - 1 AND n.col = l.col LEFT JOIN px s ON s.row = l.row + 1 AND s.col = l.col),
te AS (SELECT unit, avg(value) AS mean, stddev_samp(value) AS sd, avg(slope) AS slope FROM sl GROUP BY unit),
mo AS (SELECT sector, wave, month, round(sum(wt), 4) AS rain FROM person WHERE wave BETWEEN 1995 AND 2000 GROUP BY 1, 2, 3), ye AS (SELECT sector, wave, sum(rain) AS y, count(*) FILTER (rain < 150) AS dry FROM mo GROUP BY 1, 2), me AS (SELECT *, avg(y) OVER (PARTITION BY sector) AS m FROM ye),
cl AS (SELECT sector AS unit, avg(y) AS rmean, stddev_samp(y) / avg(y) AS cv, avg(dry) AS dry_months, avg((y < 0.95 * m)::INT) AS drought_share FROM me GROUP BY sector),
ac AS (SELECT n_nationkey AS unit, 20.0 * (n_nationkey % 5) + 10 AS x, 20.0 * (n_nationkey // 5) + 10 AS y FROM nation)
SELECT unit, {", ".join(f"round({n}, 6) AS {n}" for n in [*_HOME, *_PEOPLE])}, {", ".join(f"round({q}, 6) AS {n}" for n, q in _GIVEN.items())} FROM hs LEFT JOIN ps USING (unit) LEFT JOIN te USING (unit) LEFT JOIN cl USING (unit) LEFT JOIN ac USING (unit)"""


@query("pip_08_control_block", _BLOCK_SQL)
def _(t):
    df = baseline(t)
    return rounded(df, 6, *[c for c in df.columns if c != "unit"])


@query("pip_02_infrastructure", f"""WITH {S._LINES}, n AS (SELECT (floor(x / 20) + 5 * floor(y / 20))::INTEGER AS unit, count(*) AS n FROM pts GROUP BY 1), l AS (SELECT unit, sum(greatest(b - a, 0) * len) AS length FROM k GROUP BY unit),
st AS (SELECT (c_custkey * 29 % 970) / 10.0 AS x0, (c_custkey * 61 % 970) / 10.0 AS y0, 1.0 + c_custkey % 3 AS s FROM customer),
u AS (SELECT n_nationkey AS unit, 20.0 * (n_nationkey % 5) AS x0, 20.0 * (n_nationkey // 5) AS y0 FROM nation), p AS (SELECT unit, sum(greatest(least(u.x0 + 20, st.x0 + s) - greatest(u.x0, st.x0), 0) * greatest(least(u.y0 + 20, st.y0 + s) - greatest(u.y0, st.y0), 0)) AS planted FROM u, st GROUP BY unit)
SELECT unit, round(coalesce(n, 0) / 400.0, 6) AS building_density, round(coalesce(length, 0) / 400.0, 6) AS line_density, round(coalesce(planted, 0) / 400.0, 6) AS planted_share FROM u LEFT JOIN n USING (unit) LEFT JOIN l USING (unit) LEFT JOIN p USING (unit)""")
def _(t):
    pts = S.points(t)
    lines = pts.select("id", C("x").alias("x1"), C("y").alias("y1"), (C("x") * 0.9).alias("x2"), (C("y") * 0.9).alias("y2"))
    stands = S.squares(t).withColumnRenamed("customer", "stand")
    df = P.cell_infrastructure(S.units(t).select("unit", F.lit(400.0).alias("km2")), pts, S.edges(t), lines, stands, 10.0)
    return rounded(df, 6, "building_density", "line_density", "planted_share")


_RATES = "s AS (SELECT sector, dist, wave, sum(wt) AS adults, coalesce(sum(wt) FILTER (cls = 'R'), 0) AS service, coalesce(sum(wt) FILTER (sex = 'F'), 0) AS nonfarm FROM person WHERE wave IN (1996, 1998, 2000) GROUP BY 1, 2, 3), q AS (SELECT *, 100 * service / adults AS service_rate, 100 * nonfarm / adults AS nonfarm_rate FROM s)"


def rates(t):
    cells = t.person.filter(C("wave").isin(1996, 1998, 2000)).groupBy("sector", "dist", "wave").agg(F.sum("wt").alias("adults"), F.coalesce(F.sum(F.when(C("cls") == "R", C("wt"))), F.lit(0)).alias("service"), F.coalesce(F.sum(F.when(C("sex") == "F", C("wt"))), F.lit(0)).alias("nonfarm"))
    return cells.withColumns({"service_rate": 100 * C("service") / C("adults"), "nonfarm_rate": 100 * C("nonfarm") / C("adults")})


@query("pip_15_gap_waves", f"""WITH @person, {_RATES}, l AS (SELECT 'service_rate' AS outcome, sector, wave, service_rate AS v FROM q UNION ALL SELECT 'nonfarm_rate', sector, wave, nonfarm_rate FROM q), m AS (SELECT outcome, wave, avg(v) FILTER (sector < 8) AS park, avg(v) FILTER (sector >= 8) AS other FROM l GROUP BY 1, 2)
SELECT a.outcome, a.wave, round(a.park - a.other - b.park + b.other, 5) AS coef, round(b.park, 5) AS park_base, round(b.other, 5) AS other_base, round(a.park, 5) AS park, round(a.other, 5) AS other FROM m a JOIN m b ON b.outcome = a.outcome AND b.wave = 1996 WHERE a.wave > 1996""")
def _(t):
    df = P.gap_by_waves(rates(t), ["service_rate", "nonfarm_rate"], "sector", "wave", C("sector") < 8, 1996, [1998, 2000], "sector")
    return rounded(df.drop("se", "p"), 5, "coef", "park_base", "other_base", "park", "other")


@query("pip_15_validation", """WITH @person, a AS (SELECT dist, wave, 100 * coalesce(sum(wt) FILTER (cls = 'R'), 0) / sum(wt) AS a, 100 * coalesce(sum(wt) FILTER (cls = 'R' AND pid <= 2), 0) / sum(wt) FILTER (pid <= 2) AS b FROM person WHERE wave IN (1996, 1998, 2000) GROUP BY 1, 2),
d AS (SELECT *, lag(wave) OVER w AS p, a - lag(a) OVER w AS da, b - lag(b) OVER w AS db FROM a WINDOW w AS (PARTITION BY dist ORDER BY wave))
SELECT wave::VARCHAR AS what, count(*)::BIGINT AS n, round(corr(a, b), 6) AS correlation, round(avg(a), 5) AS mean_a, round(avg(b), 5) AS mean_b FROM d GROUP BY wave UNION ALL SELECT p || '-' || wave, count(*), round(corr(da, db), 6), round(avg(da), 5), round(avg(db), 5) FROM d WHERE p IS NOT NULL GROUP BY p, wave""")
def _(t):
    people = t.person.filter(C("wave").isin(1996, 1998, 2000)).withColumn("service", F.when(C("cls") == "R", C("wt")).otherwise(0))
    df = P.validate_sources(people, people.filter("pid <= 2"), "dist", "wave", "service", "wt")
    return rounded(rounded(df, 6, "correlation"), 5, "mean_a", "mean_b")


@query("pip_17_outcomes", f"""WITH @person, {_RATES}, v AS (SELECT sector, dist, wave, nonfarm_rate AS y, service_rate AS x, ln(adults) AS z FROM q), r AS (SELECT sector, wave, y - avg(y) OVER s - avg(y) OVER c + avg(y) OVER d AS y, x - avg(x) OVER s - avg(x) OVER c + avg(x) OVER d AS x, z - avg(z) OVER s - avg(z) OVER c + avg(z) OVER d AS z FROM v WINDOW s AS (PARTITION BY sector), c AS (PARTITION BY dist, wave), d AS (PARTITION BY dist)),
k AS (SELECT sum(x * x) AS a, sum(x * z) AS b, sum(z * z) AS c, sum(x * y) AS u, sum(z * y) AS w, count(*) AS n FROM r), m AS (SELECT avg(y) FILTER (wave = 1996) AS m FROM v)
SELECT 'nonfarm' AS outcome, unnest(['share', 'ln_people']) AS term, round(unnest([(c * u - b * w) / (a * c - b * b), (a * w - b * u) / (a * c - b * b)]), 5) AS coef, n::BIGINT AS n, round(m, 5) AS base_mean FROM k, m""")
def _(t):
    df = P.outcome_regressions(rates(t), {"nonfarm": C("nonfarm_rate")}, "service_rate", "adults", "sector", "dist", "wave", 1996)
    return rounded(df.select("outcome", "term", "coef", "n", "base_mean"), 5, "coef", "base_mean")


def _grid_sql(rounds: int = 12) -> str:
    """Weights by Newton steps on two standardised covariates of the cells; on a complete grid with weights a cell, a coefficient is a difference of weighted mean changes."""
    logit = ["b0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"]
    for k in range(rounds):
        logit.append(f"""h{k} AS MATERIALIZED (SELECT sum(p * (1 - p)) AS a, sum(p * (1 - p) * x) AS b, sum(p * (1 - p) * z) AS c, sum(p * (1 - p) * x * x) AS e, sum(p * (1 - p) * x * z) AS f, sum(p * (1 - p) * z * z) AS i, sum(d - p) AS u, sum((d - p) * x) AS v, sum((d - p) * z) AS w, max(b0) AS b0, max(b1) AS b1, max(b2) AS b2
  FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x + b2 * z))) AS p FROM q, b{k})),
b{k + 1} AS MATERIALIZED (SELECT b0 + (u * (e * i - f * f) - b * (v * i - f * w) + c * (v * f - e * w)) / det AS b0, b1 + (a * (v * i - f * w) - u * (b * i - f * c) + c * (b * w - v * c)) / det AS b1, b2 + (a * (e * w - v * f) - b * (b * w - v * c) + u * (b * f - e * c)) / det AS b2
  FROM (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM h{k}))""")
    return f"""WITH {S._PIX}, g AS (SELECT row // 5 AS gy, col // 5 AS gx, avg(value) / 10000 AS x, avg(cover) / 100 AS z, sum(ha) AS ha, {", ".join(f"sum(CASE WHEN loss = {p} THEN ha ELSE 0 END) / sum(ha) AS y{p}" for p in range(1, 7))} FROM px GROUP BY 1, 2),
q AS (SELECT gy, gx, (gx % 3 = 0)::INTEGER AS d, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS x, (z - avg(z) OVER ()) / stddev_samp(z) OVER () AS z, y1, y2, y3, y4, y5, y6 FROM g), {", ".join(logit)},
o AS (SELECT *, abs(d - 1 / (1 + exp(-(b0 + b1 * x + b2 * z)))) AS wt FROM q, b{rounds}), m AS (SELECT d, {", ".join(f"sum(wt * (y{p} - y3)) / sum(wt) AS m{p}" for p in (1, 2, 4, 5, 6))} FROM o GROUP BY d)
SELECT unnest(['treat_1', 'treat_2', 'treat_4', 'treat_5', 'treat_6']) AS term, round(unnest([{", ".join(f"a.m{p} - b.m{p}" for p in (1, 2, 4, 5, 6))}]), 5) AS coef FROM m a, m b WHERE a.d = 1 AND b.d = 0"""


@query("pip_18_forest_grid", _grid_sql())
def _(t):
    grid = P.forest_grid(S.pixels(t), 5, {"x": F.avg("value") / 10000, "z": F.avg("cover") / 100}, "loss", [1, 2, 3, 4, 5, 6])
    df = P.forest_event_study(grid, "loss_share", "cell", "period", C("gx") % 3 == 0, ["x", "z"], 1, 3, [1, 2, 3, 4, 5, 6])
    return df.select("term", r("coef", 5).alias("coef"))
