"""Queries of aggregations, windows, joins and sets."""

from pyspark.sql import functions as F

from surveyspark.operators import agg as A
from surveyspark.operators import joins as J
from surveyspark.operators import sets as S
from surveyspark.operators import window as W

from .base import query

C = F.col


def r(c, n=6):
    return F.round(c, n)


def rounded(df, n, *cols):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("agg_01_weighted_pivot", """WITH @person SELECT sector, wave, round(coalesce(sum(wt) FILTER (cls = 'A'), 0), 4) AS "A", round(coalesce(sum(wt) FILTER (cls = 'N'), 0), 4) AS "N", round(coalesce(sum(wt) FILTER (cls = 'R'), 0), 4) AS "R" FROM person GROUP BY sector, wave""")
def _(t):
    return rounded(A.weighted_pivot(t.person, ["sector", "wave"], "cls", ["A", "N", "R"], "wt"), 4, "A", "N", "R")


@query("agg_02_wmean", """WITH @person SELECT sector, round(sum(x * wt) / nullif(sum(wt) FILTER (x IS NOT NULL), 0), 8) AS mean, round(sum(x * wt), 4) AS total FROM (SELECT *, CASE WHEN size < 48 THEN size END AS x FROM person) GROUP BY sector""")
def _(t):
    x = F.when(C("size") < 48, C("size"))
    return t.person.groupBy("sector").agg(r(A.wmean(x, C("wt")), 8).alias("mean"), r(A.wsum(x, C("wt")), 4).alias("total"))


@query("agg_03_wratio", """WITH @person SELECT dist, wave, round(sum(value * disc * wt) / nullif(sum(value * wt), 0), 8) AS rate FROM person GROUP BY dist, wave""")
def _(t):
    return t.person.groupBy("dist", "wave").agg(r(A.wratio(C("value") * C("disc"), C("value"), C("wt")), 8).alias("rate"))


@query("agg_04_wquantile", """WITH @person, v AS (SELECT sector, size, sum(wt) AS w FROM person GROUP BY sector, size),
c AS (SELECT *, sum(w) OVER (PARTITION BY sector ORDER BY size) AS cum, sum(w) OVER (PARTITION BY sector) AS tot FROM v) SELECT sector, min(size) FILTER (cum >= 0.5 * tot) AS wquantile FROM c GROUP BY sector""")
def _(t):
    return A.wquantile(t.person, ["sector"], "size", "wt")


@query("agg_05_wshare", """WITH @person SELECT sector, wave, round(sum(CASE WHEN f THEN wt WHEN NOT f THEN 0 END) / nullif(sum(wt) FILTER (f IS NOT NULL), 0), 8) AS share FROM (SELECT *, CASE WHEN size < 48 THEN cls = 'R' END AS f FROM person) GROUP BY sector, wave""")
def _(t):
    return t.person.groupBy("sector", "wave").agg(r(A.wshare(F.when(C("size") < 48, C("cls") == "R"), C("wt")), 8).alias("share"))


@query("agg_06_share_of", """WITH @person SELECT sector, cls, round(sum(wt) / sum(sum(wt)) OVER (PARTITION BY sector), 8) AS share FROM person GROUP BY sector, cls""")
def _(t):
    return rounded(A.share_of(t.person.groupBy("sector", "cls").agg(F.sum("wt").alias("v")), "v", ["sector"]), 8, "share").drop("v")


@query("agg_07_describe", """WITH @person SELECT dist, wave, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90 FROM person GROUP BY dist, wave""")
def _(t):
    return rounded(A.describe_by(t.person, ["dist", "wave"], "value"), 4, "mean", "sd", "p10", "p50", "p90")


@query("agg_08_collapse_constant", """WITH @person, one AS (SELECT hhid, any_value(sector) AS sector, any_value(wave) AS wave, count(*)::BIGINT AS size, min_by(cls, (pid, partkey, value)) AS head_cls FROM person GROUP BY hhid)
SELECT sector, wave, head_cls, count(*)::BIGINT AS households, sum(size)::BIGINT AS persons FROM one GROUP BY 1, 2, 3""")
def _(t):
    homes, _ = A.collapse_constant(t.person.select("hhid", "sector", "wave", "cls", "pid", "partkey", "value"), ["hhid"], F.struct("pid", "partkey", "value"), ["cls"])
    return homes.groupBy("sector", "wave", "head_cls").agg(F.count("*").alias("households"), F.sum("size").alias("persons"))


@query("agg_09_member_counts", """WITH @person, m AS (SELECT *, count(*) FILTER (age < 15) OVER h AS young, count(*) FILTER (cls = 'R') OVER h AS returned FROM person WINDOW h AS (PARTITION BY hhid)) SELECT sector, sum(young)::BIGINT AS young, sum(returned)::BIGINT AS returned FROM m GROUP BY sector""")
def _(t):
    df = A.member_counts(t.person, ["hhid"], {"young": C("age") < 15, "returned": C("cls") == "R"})
    return df.groupBy("sector").agg(F.sum("young").alias("young"), F.sum("returned").alias("returned"))


@query("agg_10_flows", """WITH @person SELECT wave, sector, s_nationkey AS supplier, round(sum(wt), 4) AS flow FROM person JOIN supplier ON suppkey = s_suppkey GROUP BY 1, 2, 3""")
def _(t):
    df = t.person.join(t["supplier"], C("suppkey") == C("s_suppkey")).withColumn("supplier", C("s_nationkey"))
    return rounded(A.flows(df, ["wave"], "sector", "supplier", "wt"), 4, "flow")


@query("agg_11_fixed_price", """WITH @person, p AS (SELECT type, quantile_cont(value / wt, 0.5) AS price FROM person WHERE wave BETWEEN 1996 AND 1998 AND type <> 'ECONOMY' GROUP BY type)
SELECT sector, round(sum(wt * 1.0 * price), 4) AS value, round(avg((price IS NOT NULL)::INT), 8) AS covered FROM person LEFT JOIN p USING (type) GROUP BY sector""")
def _(t):
    df = A.fixed_price_value(t.person, "type", C("value") / C("wt"), C("wt"), F.lit(1.0), C("wave").between(1996, 1998) & (C("type") != "ECONOMY"), ["sector"])
    return df.select("sector", r("value", 4).alias("value"), r("covered", 8).alias("covered"))


@query("agg_12_sum_min_count", """WITH @person SELECT sector, wave, CASE WHEN count(x) >= 60 THEN round(sum(x), 4) END AS some, CASE WHEN count(x) >= 0.94 * count(*) THEN round(sum(x), 4) END AS covered FROM (SELECT *, CASE WHEN size < 48 THEN wt END AS x FROM person) GROUP BY sector, wave""")
def _(t):
    x = F.when(C("size") < 48, C("wt"))
    return t.person.groupBy("sector", "wave").agg(r(A.sum_min_count(x, 60), 4).alias("some"), r(A.sum_if_covered(x, 0.94), 4).alias("covered"))


@query("agg_13_top_n", """WITH @person SELECT brand, round(sum(value), 2) AS total FROM person GROUP BY brand ORDER BY sum(value) DESC, brand LIMIT 10""")
def _(t):
    return rounded(A.top_n(t.person, "brand", "value", 10), 2, "total")


@query("agg_14_coverage", """WITH @person SELECT wave, unnest(['size', 'tax']) AS "column", unnest([count(CASE WHEN size < 48 THEN 1 END), count(nullif(tax, 0))])::BIGINT AS n FROM person GROUP BY wave""")
def _(t):
    return A.coverage(t.person.select("wave", F.when(C("size") < 48, C("size")).alias("size"), F.nullif("tax", F.lit(0.0)).alias("tax")), ["wave"])


@query("agg_15_stale_codes", """WITH @person SELECT DISTINCT wave, 'code' AS variable, substr(priority, 1, 1)::BIGINT AS code FROM person WHERE (wave = 1998 AND priority LIKE '5%') OR (wave = 2000 AND priority LIKE '1%')""")
def _(t):
    from .q_recode import value_labels

    labels = value_labels(t).filter("NOT (wave = 2000 AND code = 1)").select("wave", F.lit("code").alias("variable"), "code")
    return A.stale_codes(t.person.select("wave", F.substring("priority", 1, 1).alias("code")), "wave", ["code"], labels)


_LAYERS = """, a AS (SELECT hhid, pid, partkey, suppkey, dist, cls, wt AS ha FROM person WHERE pid = 1), b AS (SELECT hhid, min(cls) AS after_cls FROM person GROUP BY hhid),
tr AS (SELECT dist, cls AS f, after_cls AS t, sum(ha) AS ha FROM a JOIN b USING (hhid) GROUP BY 1, 2, 3)"""


def moves(t):
    before = t.person.filter("pid = 1").select("hhid", "dist", "cls", C("wt").alias("ha"))
    return A.transitions(before, t.person.groupBy("hhid").agg(F.min("cls").alias("cls")), ["hhid"], "dist", "cls", "ha")


@query("agg_16_transitions", f"""WITH @person{_LAYERS} SELECT dist, f AS "from", t AS "to", round(ha, 4) AS ha, round(ha / sum(ha) OVER (PARTITION BY dist, f), 8) AS row_share FROM tr""")
def _(t):
    return moves(t).select("dist", "from", "to", r("ha", 4).alias("ha"), r("row_share", 8).alias("row_share"))


@query("agg_17_gross_flows", f"""WITH @person{_LAYERS}, m AS (SELECT dist, f AS class, ha AS loss, 0 AS gain FROM tr WHERE f <> t UNION ALL SELECT dist, t, 0, ha FROM tr WHERE f <> t)
SELECT dist, class, round(sum(loss), 4) AS loss, round(sum(gain), 4) AS gain, round(sum(gain) - sum(loss), 4) AS net FROM m GROUP BY dist, class""")
def _(t):
    return rounded(A.gross_flows(moves(t), "dist"), 4, "loss", "gain", "net")


@query("agg_18_long_diff", """WITH @panel SELECT a.sector, round(b.y - a.y, 6) AS d_y, round(b.y / nullif(a.y, 0) - 1, 8) AS g_y FROM panel a JOIN panel b USING (sector) WHERE a.wave = 1995 AND b.wave = 2000""")
def _(t):
    return A.long_diff(t.panel, "sector", "wave", 1995, 2000, ["y"]).select("sector", r("d_y").alias("d_y"), r("g_y", 8).alias("g_y"))


@query("agg_19_with_total", """WITH @person SELECT coalesce(sector::VARCHAR, 'total') AS sector, round(sum(wt), 4) AS workers, count(*)::BIGINT AS n FROM person GROUP BY ROLLUP (sector)""")
def _(t):
    return A.with_total(t.person, "sector", [r(F.sum("wt"), 4).alias("workers"), F.count("*").alias("n")])


@query("agg_20_first_period", """WITH @panel SELECT sector, wave, min(CASE WHEN n > 95 THEN wave END) OVER (PARTITION BY sector) AS first_period FROM panel""")
def _(t):
    return A.first_period(t.panel.select("sector", "wave", "n"), "sector", "wave", C("n") > 95).drop("n")


@query("agg_21_addback", """WITH @person SELECT sector, round(rec + greatest(cand - 0.3 * adults, 0), 4) AS added, round(rec + cand, 4) AS upper FROM (SELECT sector, coalesce(sum(wt) FILTER (cls = 'A'), 0) AS rec, coalesce(sum(wt) FILTER (cls = 'R'), 0) AS cand, sum(wt) FILTER (age BETWEEN 15 AND 45) AS adults FROM person GROUP BY sector)""")
def _(t):
    w = lambda c: F.coalesce(F.sum(F.when(c, C("wt"))), F.lit(0.0))
    added, upper = A.addback(w(C("cls") == "A"), w(C("cls") == "R"), w(C("age").between(15, 45)), 0.3)
    return t.person.groupBy("sector").agg(r(added, 4).alias("added"), r(upper, 4).alias("upper"))


@query("agg_22_workforce", """WITH @person SELECT sector, wave, round(sum(CASE WHEN (wave = 1996 AND age >= 10) OR (wave = 1998 AND age >= 16) OR (wave = 2000 AND age >= 16 AND cls <> 'N') THEN wt ELSE 0 END), 4) AS workers, round(sum(wt), 4) AS people FROM person WHERE wave IN (1996, 1998, 2000) GROUP BY sector, wave""")
def _(t):
    rules = {1996: C("age") >= 10, 1998: C("age") >= 16, 2000: (C("age") >= 16) & (C("cls") != "N")}
    return rounded(A.workforce(t.person, ["sector"], "wave", rules, "wt"), 4, "workers", "people")


_RANK = "(rank() OVER (PARTITION BY wave ORDER BY {0}) + (count(*) OVER (PARTITION BY wave, {0}) - 1) / 2.0)"


@query("agg_23_corr_matrix", f"""WITH @panel, k AS (SELECT wave, {_RANK.format('y')} AS y, {_RANK.format('x')} AS x, {_RANK.format('n')} AS n FROM panel), m AS (SELECT wave, corr(y, x) AS yx, corr(y, n) AS yn, corr(x, n) AS xn FROM k GROUP BY wave)
SELECT wave, unnest(['y', 'y', 'x']) AS a, unnest(['x', 'n', 'n']) AS b, round(unnest([yx, yn, xn]), 6) AS r FROM m""")
def _(t):
    return rounded(A.corr_matrix(t.panel, ["y", "x", "n"], ["wave"], "spearman"), 6, "r")


@query("agg_23_corr_pearson", """WITH @panel SELECT 'y' AS a, 'x' AS b, round(corr(y, x), 6) AS r FROM panel UNION ALL SELECT 'y', 'z', round(corr(y, z), 6) FROM panel UNION ALL SELECT 'x', 'z', round(corr(x, z), 6) FROM panel""")
def _(t):
    return rounded(A.corr_matrix(t.panel, ["y", "x", "z"]), 6, "r")


@query("agg_24_trend", """WITH @panel SELECT sector, round(regr_slope(y, wave), 6) AS slope, round(regr_intercept(y, wave), 4) AS intercept FROM panel GROUP BY sector""")
def _(t):
    return A.trend(t.panel, ["sector"], "y", "wave").select("sector", r("slope").alias("slope"), r("intercept", 4).alias("intercept"))


@query("agg_25_binscatter", """WITH @panel, k AS (SELECT *, row_number() OVER (PARTITION BY wave ORDER BY x, sector) AS r, count(*) OVER (PARTITION BY wave) AS m FROM panel),
b AS (SELECT *, greatest(1, ceil((r - 1) * 5 / (m - 1)))::INTEGER AS bin FROM k) SELECT wave, bin, count(*)::BIGINT AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM b GROUP BY wave, bin""")
def _(t):
    return rounded(A.binscatter(t.panel.drop("n"), "x", ["y"], 5, ["wave"], ["sector"]), 6, "x", "y")


@query("agg_26_anova", """WITH @person, g AS (SELECT cls, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM person GROUP BY cls), s AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS gm, sum((n - 1) * v) AS w, sum(n * m * m) AS raw FROM g)
SELECT (k - 1)::BIGINT AS df_between, (n - k)::BIGINT AS df_within, round((raw - n * gm * gm) / (k - 1) / (w / (n - k)), 4) AS f FROM s""")
def _(t):
    return A.anova(t.person, "value", "cls").withColumn("f", r("f", 4))


@query("agg_27_remaining_index", """WITH @person, p AS (SELECT sector, wt AS ha, CASE WHEN cls = 'R' THEN wave END AS y FROM person) SELECT sector, t.year::INTEGER AS year, round(100 * (1 - coalesce(sum(ha) FILTER (y > 0 AND y <= t.year), 0) / sum(ha)), 6) AS index FROM p, (VALUES (1996), (1998), (2000)) t(year) GROUP BY sector, t.year""")
def _(t):
    df = t.person.select("sector", C("wt").alias("ha"), F.when(C("cls") == "R", C("wave")).alias("loss"))
    return rounded(A.remaining_index(df, ["sector"], "loss", "ha", [1996, 1998, 2000]), 6, "index")


_MONTHLY = """, monthly AS (SELECT sector, dist, wave, month, round(sum(wt), 4) AS rain FROM person WHERE wave BETWEEN 1995 AND 2000 GROUP BY 1, 2, 3, 4)"""


def monthly(t):
    return t.person.filter(C("wave").between(1995, 2000)).groupBy("sector", "dist", "wave", "month").agg(F.round(F.sum("wt"), 4).alias("rain"))


@query("agg_28_climatology", f"""WITH @person{_MONTHLY} SELECT sector, month, round(avg(rain), 6) AS mean, round(stddev_samp(rain) / avg(rain), 8) AS cv, round(avg((rain < 150)::INT), 8) AS drought_rate FROM monthly GROUP BY sector, month""")
def _(t):
    return A.climatology(monthly(t), ["sector"], "month", "rain", 150).select("sector", "month", r("mean").alias("mean"), r("cv", 8).alias("cv"), r("drought_rate", 8).alias("drought_rate"))


@query("agg_29_rate", """WITH @person SELECT sector, wave, round(1000 * sum(wt) FILTER (cls = 'R') / nullif(sum(wt), 0), 6) AS rate FROM person GROUP BY sector, wave HAVING count(*) FILTER (cls = 'R') > 0""")
def _(t):
    key = ["sector", "wave"]
    num = t.person.filter("cls = 'R'").groupBy(*key).agg(F.sum("wt").alias("value"))
    return rounded(A.rate(num, t.person.groupBy(*key).agg(F.sum("wt").alias("base")), key, 1000), 6, "rate")


@query("agg_30_mean_se", """WITH @person SELECT wave, sector < 8 AS treated, count(value)::BIGINT AS n, round(avg(value), 4) AS mean, round(stddev_samp(value) / sqrt(count(value)), 4) AS se FROM person GROUP BY 1, 2""")
def _(t):
    return rounded(A.mean_se(t.person.withColumn("treated", C("sector") < 8), ["wave", "treated"], "value"), 4, "mean", "se")


@query("agg_31_signature_groups", """WITH g AS (SELECT event_type, coalesce(props, '') AS p, coalesce(user_id, -1) AS u, count(*) AS size, min(event_id) AS first_id FROM events GROUP BY 1, 2, 3) SELECT event_type, size::BIGINT AS size, first_id FROM g""")
def _(t):
    return A.signature_groups(t["events"].withColumn("id", C("event_id")), "event_type", ["props", "user_id"]).drop("signature")


@query("agg_32_composition", """WITH @person, s AS (SELECT sector, wave, sum(disc * value) AS disc, sum(tax * value) AS tax FROM person GROUP BY sector, wave) SELECT sector, wave, round(disc / nullif(disc + tax, 0), 8) AS disc, round(tax / nullif(disc + tax, 0), 8) AS tax FROM s""")
def _(t):
    return rounded(A.composition(t.person, "sector", ["wave"], ["disc", "tax"], "value"), 8, "disc", "tax")


@query("agg_33_stack_sources", """WITH @person SELECT dist, round(sum(wt) FILTER (cls = 'R') / sum(wt), 8) AS share, CASE sex WHEN 'F' THEN 'first' ELSE 'second' END AS source FROM person GROUP BY dist, sex""")
def _(t):
    one = lambda s: t.person.filter(C("sex") == s).groupBy("dist").agg(r(A.wshare(C("cls") == "R", C("wt")), 8).alias("share"))
    return A.stack_sources({"first": one("F"), "second": one("O")})


@query("win_01_depleting_stock", """WITH @panel SELECT sector, wave, round(greatest(20 - coalesce(sum(y) OVER (PARTITION BY sector ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), 6) AS stock FROM panel""")
def _(t):
    return W.depleting_stock(t.panel.withColumn("base", F.lit(20.0)), "sector", "wave", "y", "base").select("sector", "wave", r("stock").alias("stock"))


@query("win_02_diff", """WITH @panel SELECT sector, wave, round(y - lag(y) OVER w, 6) AS d_y, round(x - lag(x) OVER w, 6) AS d_x FROM panel WINDOW w AS (PARTITION BY sector ORDER BY wave)""")
def _(t):
    return W.diff(t.panel, "sector", "wave", ["y", "x"]).select("sector", "wave", r("d_y").alias("d_y"), r("d_x").alias("d_x"))


@query("win_03_anomaly", f"""WITH @person{_MONTHLY}, f AS (SELECT * FROM monthly SEMI JOIN (SELECT sector, wave FROM monthly GROUP BY 1, 2 HAVING count(DISTINCT month) = 12) USING (sector, wave)),
z AS (SELECT *, (rain - avg(rain) OVER u) / nullif(stddev_samp(rain) OVER u, 0) AS z, (rank() OVER (PARTITION BY sector ORDER BY rain) + (count(*) OVER (PARTITION BY sector, rain) - 1) / 2.0) / count(rain) OVER u AS p FROM f WINDOW u AS (PARTITION BY sector))
SELECT sector, wave, month, round(z, 6) AS z, round(p, 8) AS pct_rank, p <= 0.2 AS drought FROM z""")
def _(t):
    df = W.anomaly(W.complete_periods(monthly(t), ["sector", "wave"], "month"), ["sector"], "rain")
    return df.select("sector", "wave", "month", r("z").alias("z"), r("pct_rank", 8).alias("pct_rank"), "drought")


@query("win_04_number_in", """WITH @person SELECT number, count(*)::BIGINT AS n, sum(pid)::BIGINT AS pids FROM (SELECT pid, row_number() OVER (PARTITION BY hhid ORDER BY pid, partkey, suppkey, value) AS number FROM person) GROUP BY number""")
def _(t):
    df = W.number_in(t.person, ["hhid"], [C(c) for c in ("pid", "partkey", "suppkey", "value")])
    return df.groupBy(C("number").cast("long").alias("number")).agg(F.count("*").alias("n"), F.sum("pid").alias("pids"))


@query("win_05_interview_index", """WITH e AS (SELECT event_id, user_id, event_type, min(event_id) OVER (PARTITION BY user_id, event_type) AS f FROM events) SELECT event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY f)::INTEGER AS interview FROM e""")
def _(t):
    return W.interview_index(t["events"], "user_id", "event_type", "event_id").select("event_id", "interview")


@query("win_06_blocks", """WITH e AS (SELECT event_id, event_type, CASE WHEN user_id < lag(user_id) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) SELECT event_id, sum(new) OVER (PARTITION BY event_type ORDER BY event_id)::BIGINT AS block FROM e""")
def _(t):
    return W.blocks(t["events"].select("event_id", "event_type", "user_id"), ["event_type"], "event_id", "user_id").select("event_id", "block")


@query("win_07_arg_best", """WITH @panel SELECT wave, arg_min(sector, (-y, sector)) AS sector, max(y) AS y FROM panel GROUP BY wave""")
def _(t):
    return W.arg_best(t.panel, ["wave"], "sector", "y")


@query("win_08_interp_log", """WITH @panel, k AS (SELECT sector, wave, y FROM panel WHERE wave IN (1996, 1998, 1999)), p AS (SELECT a.sector, 1994 + i AS wave FROM (SELECT DISTINCT sector FROM panel) a, range(0, 10) t(i)),
j AS (SELECT p.*, (SELECT max(wave) FROM k WHERE k.sector = p.sector AND k.wave <= p.wave) AS t0, (SELECT min(wave) FROM k WHERE k.sector = p.sector AND k.wave >= p.wave) AS t1 FROM p)
SELECT j.sector, j.wave::INTEGER AS wave, round(CASE WHEN t0 IS NULL THEN NULL WHEN t1 IS NULL THEN c.y * exp((ln(c.y) - ln(b.y)) / 1 * (j.wave - 1999)) ELSE exp(ln(a.y) + (ln(d.y) - ln(a.y)) * coalesce((j.wave - t0)::DOUBLE / nullif(t1 - t0, 0), 0)) END, 6) AS y
FROM j LEFT JOIN k a ON a.sector = j.sector AND a.wave = t0 LEFT JOIN k d ON d.sector = j.sector AND d.wave = t1 JOIN k b ON b.sector = j.sector AND b.wave = 1998 JOIN k c ON c.sector = j.sector AND c.wave = 1999""")
def _(t):
    knots = t.panel.filter(C("wave").isin(1996, 1998, 1999)).select("sector", "wave", "y")
    grid = J.complete_grid(t.panel.select("sector").distinct(), t.spark.range(1994, 2004).select(C("id").cast("int").alias("wave")))
    return rounded(W.interp_log(grid, knots, ["sector"], "wave", "y"), 6, "y")


@query("win_09_winsorise", """WITH @person, q AS (SELECT type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM person GROUP BY type) SELECT type, round(sum(least(greatest(value, lo), hi)), 0) AS total, count(*) FILTER (value BETWEEN lo AND hi)::BIGINT AS n_trimmed FROM person JOIN q USING (type) GROUP BY type""")
def _(t):
    limits = W.tails(t.person, "value", ["type"])
    kept = W.trim(t.person, "value", ["type"], limits=limits).groupBy("type").agg(F.count("*").alias("n_trimmed"))
    return W.winsorise(t.person, "value", ["type"], limits=limits).groupBy("type").agg(r(F.sum("value"), 0).alias("total")).join(kept, "type")


@query("win_10_fill_group_mean", """WITH @panel, g AS (SELECT sector, dist, wave, CASE WHEN n > 78 AND dist <> 2 THEN y END AS y FROM panel) SELECT sector, wave, round(coalesce(y, avg(y) OVER (PARTITION BY wave, dist), avg(y) OVER (PARTITION BY wave)), 6) AS y FROM g""")
def _(t):
    df = t.panel.withColumn("y", F.when((C("n") > 78) & (C("dist") != 2), C("y")))
    return W.fill_group_mean(df, "y", "dist", "wave").select("sector", "wave", r("y").alias("y"))


@query("win_11_demean", f"""WITH @person{_MONTHLY} SELECT sector, wave, month, round(rain - avg(rain) OVER (PARTITION BY sector, month), 6) AS d FROM monthly""")
def _(t):
    return W.demean(monthly(t), "rain", ["sector", "month"], "d").select("sector", "wave", "month", r("d").alias("d"))


@query("win_12_quadrants", """WITH @panel, m AS (SELECT quantile_cont(y, 0.5) AS my, quantile_cont(x, 0.5) AS mx FROM panel) SELECT sector, wave, CASE WHEN y >= my THEN 'high' ELSE 'low' END || '-' || CASE WHEN x >= mx THEN 'high' ELSE 'low' END AS quadrant FROM panel, m""")
def _(t):
    return W.quadrants(t.panel, "y", "x").select("sector", "wave", "quadrant")


@query("win_13_baseline", """WITH @panel SELECT sector, wave, round(max(CASE WHEN wave = 1996 THEN y END) OVER (PARTITION BY sector), 6) AS base FROM panel""")
def _(t):
    return W.baseline(t.panel, "sector", "wave", 1996, "y", "base").select("sector", "wave", r("base").alias("base"))


@query("win_14_pre_trend", """WITH @panel SELECT sector, round(avg(y), 6) AS pre_mean, round(regr_slope(y, wave), 6) AS pre_slope FROM panel WHERE wave < 1998 GROUP BY sector""")
def _(t):
    return rounded(W.pre_trend(t.panel, "sector", "wave", "y", 1998), 6, "pre_mean", "pre_slope")


@query("set_01_pool", """WITH @person SELECT wave, count(*)::BIGINT AS n, count(disc)::BIGINT AS n_disc, count(tax)::BIGINT AS n_tax FROM (SELECT wave, disc, NULL AS tax FROM person WHERE wave = 1996 UNION ALL SELECT wave, NULL, tax FROM person WHERE wave = 1998) GROUP BY wave""")
def _(t):
    df = S.pool([t.person.filter("wave = 1996").select("wave", "disc"), t.person.filter("wave = 1998").select("wave", "tax")])
    return df.groupBy("wave").agg(F.count("*").alias("n"), F.count("disc").alias("n_disc"), F.count("tax").alias("n_tax"))


@query("set_02_exact_duplicates", """WITH @person, g AS (SELECT hhid, pid, wave, sex, sector, count(*) AS n FROM person GROUP BY ALL) SELECT wave, sum(n - 1)::BIGINT AS n_dropped, round(sum((n - 1) * pid), 4)::DOUBLE AS wt_dropped FROM g GROUP BY wave""")
def _(t):
    _, report = S.drop_exact_duplicates(t.person.select("hhid", "pid", "wave", "sex", "sector"), "wave", "pid")
    return report.withColumn("wt_dropped", r(C("wt_dropped").cast("double"), 4))


@query("set_03_first_per_key", """WITH @person SELECT hhid, pid, partkey, n_more FROM (SELECT hhid, pid, partkey, row_number() OVER (PARTITION BY hhid, pid ORDER BY partkey, suppkey, value) AS r, count(*) OVER (PARTITION BY hhid, pid) - 1 AS n_more FROM person) WHERE r = 1""")
def _(t):
    return S.first_per_key(t.person, ["hhid", "pid"], [C("partkey"), C("suppkey"), C("value")]).select("hhid", "pid", "partkey", "n_more")


@query("set_04_duplicate_keys", """WITH @person SELECT wave, count(*)::BIGINT AS n_keys, sum(n)::BIGINT AS n_rows FROM (SELECT wave, hhid, pid, count(*) AS n FROM person GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY wave""")
def _(t):
    return S.duplicate_keys(t.person, ["hhid", "pid"], "wave")


@query("set_05_missing_from", """SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996""")
def _(t):
    return S.missing_from(t["customer"].select("c_custkey"), t["orders"].filter(F.year("o_orderdate") == 1996).select(C("o_custkey").alias("c_custkey")))


@query("set_06_ranking", """WITH @panel SELECT sector, wave, rank() OVER (PARTITION BY wave ORDER BY n DESC)::INTEGER AS rank FROM panel""")
def _(t):
    return S.sorted_panel(S.ranking(t.panel, ["wave"], "n").select("sector", "wave", "rank"), "sector", "wave")


@query("jn_01_join_panels", """WITH @panel, d AS (SELECT dist, wave, round(avg(z), 8) AS dz FROM panel GROUP BY dist, wave) SELECT sector, wave, round(y / n, 8) AS rate, dz, n_name AS name FROM panel JOIN d USING (dist, wave) JOIN nation ON n_nationkey = sector""")
def _(t):
    d = t.panel.groupBy("dist", "wave").agg(r(F.avg("z"), 8).alias("dz"))
    df = J.join_panels([t.panel, d], ["dist", "wave"])
    df = J.join_panels([df, t["nation"].select(C("n_nationkey").alias("sector"), C("n_name").alias("name"))], ["sector"])
    return df.select("sector", "wave", r(C("y") / C("n"), 8).alias("rate"), "dz", "name")


@query("jn_02_coalescing_join", """WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang, source FROM documents), o AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE source END AS source FROM documents SEMI JOIN labels USING (doc_id)),
j AS (SELECT b.lang AS l1, o.lang AS l2, b.source AS s1, o.source AS s2, o.doc_id IS NOT NULL AS hit FROM b LEFT JOIN o USING (doc_id))
SELECT unnest(['lang', 'source']) AS "column", unnest([count(*) FILTER (l1 IS NULL AND l2 IS NOT NULL), count(*) FILTER (s1 IS NULL AND s2 IS NOT NULL)])::BIGINT AS n_filled,
 unnest([count(*) FILTER (l1 <> l2), count(*) FILTER (s1 <> s2)])::BIGINT AS n_conflict, round(avg(hit::INT), 8) AS match_rate FROM j""")
def _(t):
    docs = t["documents"].select("doc_id", "lang", "source")
    other = docs.join(t["labels"], "doc_id", "left_semi").withColumn("source", F.when(C("doc_id") % 5 == 0, "x").otherwise(C("source")))
    _, report = J.coalescing_join(docs.withColumn("lang", F.when(C("doc_id") % 3 > 0, C("lang"))), other, ["doc_id"], "o")
    return rounded(report, 8, "match_rate")


@query("jn_03_attach_keys", """WITH @person SELECT p.wave, in_sample, count(*)::BIGINT AS n, count(sector2)::BIGINT AS n_sector FROM (SELECT p.wave, h.o_orderkey IS NOT NULL AS in_sample, coalesce(CASE WHEN pid = 1 THEN sector END, c) AS sector2 FROM person p LEFT JOIN (SELECT o_orderkey, o_custkey AS c FROM orders WHERE o_orderstatus <> 'F') h ON h.o_orderkey = hhid) p GROUP BY 1, 2""")
def _(t):
    keys = t["orders"].filter("o_orderstatus <> 'F'").select(C("o_orderkey").alias("hhid"), C("o_custkey").cast("int").alias("sector"))
    df = J.attach_keys(t.person.select("hhid", "wave", F.when(C("pid") == 1, C("sector")).alias("sector")), keys, ["hhid"])
    return df.groupBy("wave", "in_sample").agg(F.count("*").alias("n"), F.count("sector").alias("n_sector"))


@query("jn_04_map_keys", """WITH @person SELECT wave, count(*)::BIGINT AS n, sum(hhid)::BIGINT AS total FROM person GROUP BY wave""")
def _(t):
    keys = t["orders"].select(C("o_orderkey").alias("hhid"))
    old = t.person.select((-C("hhid")).alias("hhid"), "wave")
    xwalk = keys.select((-C("hhid")).alias("old"), C("hhid").alias("new"))
    return J.map_keys_if_better(old, "hhid", keys, xwalk).groupBy("wave").agg(F.count("*").alias("n"), F.sum("hhid").alias("total"))


@query("jn_05_fallback_join", """WITH @person, a AS (SELECT sector, cls, avg(wt) AS v FROM person WHERE pid > 4 AND sector < 12 GROUP BY 1, 2), b AS (SELECT sector, avg(wt) AS v FROM person WHERE sector < 18 GROUP BY 1)
SELECT p.sector, p.cls, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 END AS source, round(coalesce(a.v, b.v), 6) AS weight, count(*)::BIGINT AS n FROM person p LEFT JOIN a USING (sector, cls) LEFT JOIN b USING (sector) GROUP BY 1, 2, 3, 4""")
def _(t):
    w = t.person.select("sector", "cls", "pid", C("wt").alias("weight"))
    df = J.fallback_join(t.person.select("sector", "cls"), [(w.filter("pid > 4 AND sector < 12"), ["sector", "cls"]), (w.filter("sector < 18"), ["sector"])], "weight")
    return df.groupBy("sector", "cls", "source", r("weight").alias("weight")).agg(F.count("*").alias("n"))


@query("jn_06_semi_anti", """WITH @person SELECT wave, (dist = 1)::BOOLEAN AS treated, count(*)::BIGINT AS n FROM person WHERE dist <> 3 GROUP BY 1, 2""")
def _(t):
    units = t["nation"].select(C("n_nationkey").alias("sector"), C("n_regionkey").alias("d"))
    p = J.anti(t.person, units.filter("d = 3"), ["sector"])
    one = J.semi(p, units.filter("d = 1"), ["sector"]).withColumn("treated", F.lit(True))
    rest = J.anti(p, units.filter("d = 1"), ["sector"]).withColumn("treated", F.lit(False))
    return one.unionAll(rest).groupBy("wave", "treated").agg(F.count("*").alias("n"))


@query("jn_07_join_on_name", """WITH @panel SELECT sector, n_nationkey AS code, count(*)::BIGINT AS n FROM panel JOIN nation ON n_nationkey = sector GROUP BY 1, 2""")
def _(t):
    named = t.panel.select("sector", F.concat(F.lit("1"), "sector", F.lit(". Nation "), "sector").alias("label"))
    right = t["nation"].select(C("n_nationkey").alias("code"), F.concat(F.lit("NATION-"), "n_nationkey").alias("title"))
    return J.join_on_name(named, right, "label", "title").groupBy("sector", "code").agg(F.count("*").alias("n"))


# Names lack their second letter: all other letters match, and no other name of the parent is as close.
_FUZZY = """SELECT n_regionkey AS block, n_name AS left_name, replace(n_name, 'NATION', 'NTION') AS right_name, round(2.0 * (length(n_name) - 1) / (2 * length(n_name) - 1), 8) AS score FROM nation"""


def _named(t):
    left = t["nation"].select(C("n_regionkey").alias("block"), C("n_name").alias("name"))
    return left, left.select("block", F.replace("name", F.lit("NATION"), F.lit("NTION")).alias("name"))


@query("jn_08_fuzzy_match", _FUZZY)
def _(t):
    return rounded(J.fuzzy_match(*_named(t), "block", 0.8, one_to_one=False), 8, "score")


@query("jn_08_fuzzy_parts")
def _(t):
    """Names of parts within their brand against the same names with two letters changed, one lost or the words turned round."""
    left = t["part"].select(C("p_brand").alias("block"), F.concat("p_name", F.lit(" "), "p_type").alias("name"))
    n, kind = F.length("name"), F.pmod(F.crc32("name"), F.lit(4))
    worn = F.when(kind == 0, F.concat(F.substring("name", 1, 3), F.col("name").substr(F.lit(5), n))).when(kind == 1, F.translate("name", "aeT", "eaD")).when(kind == 2, F.concat_ws(" ", F.reverse(F.split("name", " ")))).otherwise(F.col("name"))
    return J.fuzzy_match(left, left.select("block", worn.alias("name")), "block", 0.8)


@query("jn_08_fuzzy_customers")
def _(t):
    """Names of customers within nation and segment against a list that has lost two digits in three."""
    left = t["customer"].select(F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("block"), C("c_name").alias("name"))
    right = left.select("block", F.when(F.pmod(F.crc32("name"), F.lit(3)) == 0, C("name")).otherwise(F.concat(F.substring("name", 1, 7), F.substring("name", -4, 4))).alias("name"))
    return J.fuzzy_match(left, right, "block", 0.75, one_to_one=False)


@query("jn_08_fuzzy_one_to_one", _FUZZY)
def _(t):
    return rounded(J.fuzzy_match(*_named(t), "block", 0.8), 8, "score")


@query("jn_09_match_period", """WITH @panel SELECT sector, wave, CASE WHEN wave < 1998 THEN 1995 ELSE 1998 END AS follows, round(y, 6) AS y FROM panel WHERE wave > 1995""")
def _(t):
    return J.match_period(t.panel, "wave", {1996: 1995, 1997: 1995, 1998: 1998, 1999: 1998, 2000: 1998}, "follows").select("sector", "wave", "follows", r("y").alias("y"))


@query("jn_10_bracket_join", """WITH @panel, k AS (SELECT sector, wave, n FROM panel WHERE wave IN (1996, 1999)) SELECT p.sector, p.wave, a.wave AS t0, a.n::DOUBLE AS v0, b.wave AS t1, b.n::DOUBLE AS v1 FROM panel p
LEFT JOIN k a ON a.sector = p.sector AND a.wave = (CASE WHEN p.wave >= 1999 THEN 1999 WHEN p.wave >= 1996 THEN 1996 END) LEFT JOIN k b ON b.sector = p.sector AND b.wave = (CASE WHEN p.wave <= 1996 THEN 1996 WHEN p.wave <= 1999 THEN 1999 END)""")
def _(t):
    return J.bracket_join(t.panel.select("sector", "wave"), t.panel.filter(C("wave").isin(1996, 1999)), ["sector"], "wave", "n")


_UNITS = "(SELECT n_nationkey AS k, (n_nationkey * 37 % 100)::DOUBLE AS x, (n_nationkey * 61 % 100)::DOUBLE AS y FROM nation)"


@query("jn_11_pairwise", f"""SELECT a.k AS a, b.k AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM {_UNITS} a JOIN {_UNITS} b ON a.k < b.k""")
def _(t):
    units = t["nation"].select(C("n_nationkey").alias("k"), (C("n_nationkey") * 37 % 100).cast("double").alias("x"), (C("n_nationkey") * 61 % 100).cast("double").alias("y"))
    return rounded(J.pairwise(units, "k", "x", "y"), 6, "distance")


@query("jn_12_overlap_pairs", """WITH @person, i AS (SELECT suppkey, wave, sex, round(sum(wt), 4) AS v FROM person GROUP BY 1, 2, 3) SELECT a.suppkey, a.wave, a.sex AS source_a, a.v AS value_a, b.sex AS source_b, b.v AS value_b FROM i a JOIN i b USING (suppkey, wave) WHERE a.sex < b.sex""")
def _(t):
    i = t.person.groupBy("suppkey", "wave", "sex").agg(r(F.sum("wt"), 4).alias("v"))
    return J.overlap_pairs(i, ["suppkey", "wave"], "sex", "v")


@query("jn_13_agree", """SELECT unnest(['lang', 'source']) AS "column", count(*)::BIGINT AS n, unnest([count(*) FILTER (doc_id % 4 > 0 OR lang IS NULL), count(*)])::BIGINT AS n_equal FROM documents""")
def _(t):
    a = t["documents"].select("doc_id", "lang", "source")
    return J.agree(a, a.withColumn("lang", F.when(C("doc_id") % 4 > 0, C("lang"))), ["doc_id"])


@query("jn_14_main_record", """WITH @person SELECT hhid, pid, wt FROM (SELECT hhid, pid, wt, row_number() OVER (PARTITION BY hhid ORDER BY wt DESC, pid, partkey, suppkey) AS r FROM person) WHERE r = 1""")
def _(t):
    return J.main_record(t.person, ["hhid"], [F.desc("wt"), C("pid"), C("partkey"), C("suppkey")]).select("hhid", "pid", "wt")
