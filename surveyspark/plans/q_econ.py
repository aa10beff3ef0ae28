"""Queries of panel econometrics on the sector by year panel."""

from pyspark.sql import functions as F

from surveyspark.functions.recode import pairwise, zscore
from surveyspark.operators import econ as E
from surveyspark.operators import select as L

from .base import query
from .q_agg import monthly, r, rounded

C = F.col
#: Two-way residuals of y, x and z of the balanced panel.
_W2 = """, w2 AS (SELECT sector, dist, wave, y - avg(y) OVER s - avg(y) OVER t + avg(y) OVER () AS y, x - avg(x) OVER s - avg(x) OVER t + avg(x) OVER () AS x FROM panel WINDOW s AS (PARTITION BY sector), t AS (PARTITION BY wave))"""
#: Coefficient and CR1 error of y on x in `res` (y, x, g) with absorbed rank `k`.
_ONE = """, b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT g) AS gs FROM res),
 m AS (SELECT sum(s * s) AS meat FROM (SELECT g, sum(x * (y - b * x)) AS s FROM res, b GROUP BY g))
SELECT '{0}' AS term, round(b, 5) AS coef, round(sqrt(gs / (gs - 1.0) * (n - 1.0) / (n - {1} - 1) * meat) / sxx, 5) AS se, n::BIGINT AS n, gs::BIGINT AS clusters FROM b, m"""


def terms(df, n=5):
    return df.select("term", r("coef", n).alias("coef"), r("se", n).alias("se"), "n", "clusters")


@query("eco_01_absorb", f"""WITH @panel{_W2} SELECT sector, wave, round(y, 5) AS y, round(x, 5) AS x FROM w2""")
def _(t):
    df = E.absorb(t.panel.select("sector", "wave", "y", "x"), ["y", "x"], ["sector", "wave"])
    return rounded(df, 5, "y", "x").select("sector", "wave", "y", "x")


@query("eco_02_within2", f"""WITH @panel{_W2} SELECT sector, wave, round(y, 5) AS y FROM w2""")
def _(t):
    return E.within2(t.panel, "sector", "wave", ["y"]).select("sector", "wave", r("y", 5).alias("y"))


@query("eco_03_absorb_weighted", """WITH @panel, u AS (SELECT sector, dist, wave, n, y - avg(y) OVER (PARTITION BY sector) AS y FROM panel) SELECT sector, wave, round(y - sum(y * n) OVER (PARTITION BY dist, wave) / sum(n) OVER (PARTITION BY dist, wave), 5) AS y FROM u""")
def _(t):
    return E.absorb_weighted2(t.panel, ["y"], "sector", ["dist", "wave"], "n").select("sector", "wave", r("y", 5).alias("y"))


@query("eco_04_fe_ols", f"WITH @panel{_W2}, res AS (SELECT y, x, sector AS g FROM w2)" + _ONE.format("x", "(25 + 6 - 1)"))
def _(t):
    return terms(E.fe_ols(t.panel, "y", ["x"], ["sector", "wave"], "sector"))


@query("eco_05_cluster_vcov", f"WITH @panel{_W2}, res AS (SELECT y, x, dist AS g FROM w2)" + _ONE.format("x", "(25 + 6 - 1)"))
def _(t):
    return terms(E.fe_ols(t.panel, "y", ["x"], ["sector", "wave"], "dist"))


@query("eco_06_wild_bootstrap")
def _(t):
    _, m, _, _ = E.fe_ols(t.panel, "y", ["x", "z"], ["sector", "wave"], "dist", extra=True)
    return E.wild_p(m, ["x", "z"], ["x"], weights="rademacher", rank=30)


@query("eco_06_wild_webb")
def _(t):
    _, m, _, _ = E.fe_ols(t.panel, "y", ["x", "z"], ["sector", "wave"], "sector", extra=True)
    return E.wild_p(m, ["x", "z"], ["x", "z"], draws=999, rank=30)


def _seasonal_sql() -> str:
    """Normal equations of eleven month dummies and the outcome (column 13) within units, solved pivot by pivot."""
    steps = ["m1 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM dm a JOIN dm b USING (id) GROUP BY a.i, b.i)"]
    for k in range(2, 13):
        m = f"m{k - 1}"
        steps.append(f"m{k} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN a.i = {k} THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END AS v FROM {m} a JOIN {m} r ON r.i = {k} AND r.j = a.j JOIN {m} c ON c.i = a.i AND c.j = {k} JOIN {m} p ON p.i = {k} AND p.j = {k})")
    return f"""WITH @person, monthly AS (SELECT sector, wave, month, round(sum(wt), 4) AS rain FROM person WHERE wave BETWEEN 1995 AND 2000 GROUP BY 1, 2, 3),
r AS (SELECT row_number() OVER () AS id, sector, wave, month, rain FROM monthly), l AS (SELECT id, sector, wave, i, CASE WHEN i = 13 THEN rain ELSE (month = i)::INTEGER END AS v FROM r, range(2, 14) t(i)),
dm AS MATERIALIZED (SELECT id, i, v - avg(v) OVER (PARTITION BY sector, wave, i) AS v FROM l), {", ".join(steps)}
SELECT 'month_' || i AS term, round(v, 4) AS coef FROM m12 WHERE j = 13 AND i < 13"""


@query("eco_07_seasonal", _seasonal_sql())
def _(t):
    df = monthly(t)
    return E.seasonal(df.withColumn("unit", F.concat_ws("_", "sector", "wave")), "rain", "month", 1, ["unit"], "sector").select("term", r("coef", 4).alias("coef"))


@query("eco_07_seasonal_any", _seasonal_sql())
def _(t):
    df = monthly(t)
    return E.seasonal(df.withColumn("unit", F.concat_ws("_", "sector", "wave")), "rain", "month", 1, ["unit"], "sector").select("term", r("coef", 4).alias("coef"))


@query("eco_08_wls", "WITH @panel, res AS (SELECT y, x, n AS w, dist AS g FROM panel), c AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM res), d AS (SELECT y - my AS y, x - mx AS x, w, g FROM res, c), b AS (SELECT sum(w * x * y) / sum(w * x * x) AS b, sum(w * x * x) AS sxx, count(*) AS n, count(DISTINCT g) AS gs FROM d), m AS (SELECT sum(s * s) AS meat FROM (SELECT g, sum(w * x * (y - b * x)) AS s FROM d, b GROUP BY g)) SELECT 'x' AS term, round(b, 5) AS coef, round(sqrt(gs / (gs - 1.0) * (n - 1.0) / (n - 2) * meat) / sxx, 5) AS se, n::BIGINT AS n, gs::BIGINT AS clusters FROM b, m")
def _(t):
    return terms(E.wls(t.panel, "y", ["x"], "n", "dist"))


_DID = """WITH @panel, p AS (SELECT sector, dist, wave, y, CASE WHEN sector < 8 AND wave >= 1998 THEN 1.0 ELSE 0.0 END AS x FROM panel), w2 AS (SELECT sector, y - avg(y) OVER s - avg(y) OVER t + avg(y) OVER () AS y, x - avg(x) OVER s - avg(x) OVER t + avg(x) OVER () AS x FROM p WINDOW s AS (PARTITION BY sector), t AS (PARTITION BY wave)), res AS (SELECT y, x, sector AS g FROM w2)"""


def treated(t):
    return t.panel.withColumn("treat", (C("sector") < 8).cast("double"))


@query("eco_09_did", _DID + _ONE.format("treat_post", "30"))
def _(t):
    return terms(E.did(treated(t), "y", "treat", "sector", "wave", 1998, "sector"))


@query("eco_10_event_study", """WITH @panel, d AS (SELECT wave, avg(y) FILTER (sector < 8) - avg(y) FILTER (sector >= 8) AS g FROM panel GROUP BY wave) SELECT 'treat_' || wave AS term, round(g - (SELECT g FROM d WHERE wave = 1997), 5) AS coef FROM d WHERE wave <> 1997""")
def _(t):
    df = E.event_study(treated(t), "y", "treat", "sector", "wave", list(range(1995, 2001)), 1997, "sector")
    return df.select("term", r("coef", 5).alias("coef"))


@query("eco_11_event_groups", """WITH @panel, d AS (SELECT wave, avg(y) FILTER (sector < 8) - avg(y) FILTER (sector >= 14) AS a, avg(y) FILTER (sector BETWEEN 8 AND 13) - avg(y) FILTER (sector >= 14) AS b FROM panel GROUP BY wave)
SELECT 'near_' || wave AS term, round(a - (SELECT a FROM d WHERE wave = 1997), 5) AS coef FROM d WHERE wave <> 1997 UNION ALL SELECT 'mid_' || wave, round(b - (SELECT b FROM d WHERE wave = 1997), 5) FROM d WHERE wave <> 1997""")
def _(t):
    df = t.panel.withColumns({"near": C("sector") < 8, "mid": C("sector").between(8, 13)})
    return E.event_groups(df, "y", ["near", "mid"], "sector", "wave", list(range(1995, 2001)), 1997, "sector").select("term", r("coef", 5).alias("coef"))


@query("eco_11_rings", """WITH @panel, d AS (SELECT wave >= 1998 AS post, CASE WHEN sector < 8 THEN 0 WHEN sector < 14 THEN 1 ELSE 2 END AS ring, avg(y) AS m FROM panel GROUP BY 1, 2), c AS (SELECT ring, max(m) FILTER (post) - max(m) FILTER (NOT post) AS ch FROM d GROUP BY ring)
SELECT 'ring_' || ring AS term, round(ch - (SELECT ch FROM c WHERE ring = 2), 5) AS coef FROM c WHERE ring < 2""")
def _(t):
    return E.rings_did(t.panel.withColumn("km", C("sector").cast("double")), "y", "km", [0, 8, 14], "sector", "wave", 1998, "sector").select("term", r("coef", 5).alias("coef"))


@query("eco_12_twfe", _DID + _ONE.format("on", "30"))
def _(t):
    df = t.panel.withColumn("on", ((C("sector") < 8) & (C("wave") >= 1998)).cast("double"))
    return terms(E.twfe(df, "y", ["on"], "sector", "wave", "sector"))


@query("eco_12_twfe_blocks")
def _(t):
    df = t.panel.withColumn("on", ((F.floor(C("sector") / 5) < 2) & (C("wave") >= 1997 + F.floor(C("sector") / 5))).cast("double"))
    return E.twfe(df, "y", ["on"], "sector", "wave", "sector", block="dist")


_BLOCKS = """WITH @panel, p AS (SELECT sector, dist, wave, y, CASE WHEN sector // 5 < 2 AND wave >= 1997 + sector // 5 THEN 1.0 ELSE 0.0 END AS o FROM panel), b AS (SELECT 'pooled' AS block, sector, wave, y, o FROM p UNION ALL SELECT dist::VARCHAR, sector, wave, y, o FROM p),
v AS (SELECT block, sector, y - avg(y) OVER s - avg(y) OVER t + avg(y) OVER k AS y, o - avg(o) OVER s - avg(o) OVER t + avg(o) OVER k AS x FROM b WINDOW s AS (PARTITION BY block, sector), t AS (PARTITION BY block, wave), k AS (PARTITION BY block)),
c AS (SELECT block, sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT sector) AS g FROM v GROUP BY block), m AS (SELECT block, sum(s * s) AS meat FROM (SELECT block, sector, sum(x * (y - b * x)) AS s FROM v JOIN c USING (block) GROUP BY block, sector) GROUP BY block)
SELECT block, round(b, 4) AS coef, round(sqrt(g / (g - 1.0) * (n - 1.0) / (n - (g + 5) - 1) * meat) / sxx, 4) AS se, n::BIGINT AS n, g::BIGINT AS clusters FROM c JOIN m USING (block)"""


@query("eco_12_twfe_by_block", _BLOCKS)
def _(t):
    df = t.panel.withColumn("on", ((F.floor(C("sector") / 5) < 2) & (C("wave") >= 1997 + F.floor(C("sector") / 5))).cast("double"))
    return E.twfe(df, "y", ["on"], "sector", "wave", "sector", block="dist").select("block", r("coef", 4).alias("coef"), r("se", 4).alias("se"), "n", "clusters")


@query("eco_13_pretrend")
def _(t):
    return E.pretrend(treated(t), "y", "treat", "sector", "wave", list(range(1995, 2001)), 1997, 1997, "sector")


@query("eco_13_pretrend_ri")
def _(t):
    return E.pretrend_ri(treated(t), "y", "treat", "sector", "wave", 1997, 1997, 199)


@query("eco_13_pretrend_groups")
def _(t):
    """A second treated group is held fixed, periods go by district, and units are not complete."""
    df = t.panel.withColumns({"near": (C("sector") < 8).cast("int"), "far": C("sector").between(8, 11).cast("int")}).filter((C("sector") + C("wave")) % 7 > 0)
    return E.pretrend_ri(df, "y", "near", "sector", "wave", 1998, 1998, 99, group="dist", held="far")


_RI = """WITH @panel, u AS (SELECT sector, avg(y) AS y, (sector < 8)::INT AS d FROM panel GROUP BY sector), o AS (SELECT avg(y) FILTER (d = 1) - avg(y) FILTER (d = 0) AS s FROM u),
r AS (SELECT i, y, row_number() OVER (PARTITION BY i ORDER BY ('0x' || substr(md5(concat_ws('|', 1, i, sector)), 1, 8))::BIGINT, sector) <= (SELECT sum(d) FROM u) AS l FROM u, range(0, 199) t(i)), g AS (SELECT i, avg(y) FILTER (l) - avg(y) FILTER (NOT l) AS g FROM r GROUP BY i)
SELECT round(max(s), 6) AS statistic, round((1 + count(*) FILTER (abs(g) >= abs(s) - 1e-12)) / (1.0 + count(*)), 8)::DOUBLE AS p, count(*)::BIGINT AS draws FROM g, o"""


@query("eco_14_randomisation", _RI)
def _(t):
    return E.ri_p(treated(t), "y", "sector", "treat", 199).select(r("statistic").alias("statistic"), r("p", 8).alias("p"), "draws")


def ring_graph(t):
    """Each sector beside the next two, both ways."""
    n = t["nation"].select(C("n_nationkey").alias("src"), F.explode(F.array(*[F.lit(i) for i in (-2, -1, 1, 2)])).alias("d"))
    return n.select("src", F.pmod(C("src") + C("d"), F.lit(25)).alias("dst"))


@query("eco_15_block_randomisation")
def _(t):
    return E.ri_block_p(t.panel.withColumn("treat", (C("sector") < 4).cast("double")), "y", "sector", "treat", ring_graph(t), 99)


@query("eco_15_pieces")
def _(t):
    """Three pieces of four, two and one sectors."""
    treat = C("sector").isin(0, 1, 2, 3, 10, 11, 18).cast("double")
    return E.ri_block_p(t.panel.withColumn("treat", treat), "y", "sector", "treat", ring_graph(t), 99)


_CON = """WITH @panel, p AS (SELECT y - avg(y) OVER () AS y, x - avg(x) OVER () AS x, (sector * 37 % 100)::DOUBLE AS px, (sector * 61 % 100)::DOUBLE AS py FROM panel), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n FROM p),
u AS (SELECT px, py, x * (y - b * x) AS u FROM p, b), k AS (SELECT a.u * c.u * greatest(1 - sqrt((a.px - c.px) * (a.px - c.px) + (a.py - c.py) * (a.py - c.py)) / 30.0, 0) AS v FROM u a, u c)
SELECT 'x' AS term, round(b, 5) AS coef, round(sqrt(greatest((SELECT sum(v) FROM k), 0)) / sxx, 5) AS se FROM b"""


@query("eco_16_conley", _CON)
def _(t):
    df = t.panel.withColumns({"px": (C("sector") * 37 % 100).cast("double"), "py": (C("sector") * 61 % 100).cast("double")})
    return E.conley(df, "y", ["x"], "px", "py", 30.0).select("term", r("coef", 5).alias("coef"), r("se", 5).alias("se"))


_CON_FE = """WITH @panel, p AS (SELECT y - avg(y) OVER d AS y, x - avg(x) OVER d AS x, (sector * 37 % 100)::DOUBLE AS px, (sector * 61 % 100)::DOUBLE AS py FROM panel WINDOW d AS (PARTITION BY dist)), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx FROM p),
u AS (SELECT px, py, x * (y - b * x) AS u FROM p, b), k AS (SELECT c.cutoff, a.u * e.u * greatest(1 - sqrt((a.px - e.px) * (a.px - e.px) + (a.py - e.py) * (a.py - e.py)) / c.cutoff, 0) AS v FROM u a, u e, (VALUES (20.0::DOUBLE), (40.0::DOUBLE)) AS c(cutoff))
SELECT cutoff, 'x' AS term, round(max(b), 5) AS coef, round(sqrt(greatest(sum(v), 0)) / max(sxx), 5) AS se FROM k, b GROUP BY cutoff"""


@query("eco_16_conley_effects", _CON_FE)
def _(t):
    df = t.panel.withColumns({"px": (C("sector") * 37 % 100).cast("double"), "py": (C("sector") * 61 % 100).cast("double")})
    return E.conley(df, "y", ["x"], "px", "py", [20.0, 40.0], ["dist"]).select("cutoff", "term", r("coef", 5).alias("coef"), r("se", 5).alias("se"))


def _logit_sql(rounds: int = 12) -> str:
    """Newton steps of a logit on two standardised columns, each a three by three system by determinants."""
    steps = ["b0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"]
    for k in range(rounds):
        steps.append(f"""h{k} AS MATERIALIZED (SELECT sum(p * (1 - p)) AS a, sum(p * (1 - p) * x) AS b, sum(p * (1 - p) * z) AS c, sum(p * (1 - p) * x * x) AS e, sum(p * (1 - p) * x * z) AS f, sum(p * (1 - p) * z * z) AS i, sum(d - p) AS u, sum((d - p) * x) AS v, sum((d - p) * z) AS w, max(b0) AS b0, max(b1) AS b1, max(b2) AS b2
  FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x + b2 * z))) AS p FROM q, b{k})),
b{k + 1} AS MATERIALIZED (SELECT b0 + (u * (e * i - f * f) - b * (v * i - f * w) + c * (v * f - e * w)) / det AS b0, b1 + (a * (v * i - f * w) - u * (b * i - f * c) + c * (b * w - v * c)) / det AS b1, b2 + (a * (e * w - v * f) - b * (b * w - v * c) + u * (b * f - e * c)) / det AS b2
  FROM (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM h{k}))""")
    return f"""WITH @panel, q AS (SELECT (sector % 3 = 0)::INTEGER AS d, x AS rx, z AS rz, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS x, (z - avg(z) OVER ()) / stddev_samp(z) OVER () AS z FROM panel), {", ".join(steps)},
o AS (SELECT d, rx, rz, abs(d - 1 / (1 + exp(-(b0 + b1 * x + b2 * z)))) AS w FROM q, b{rounds}),
m AS (SELECT d, sum(w * rx) / sum(w) AS x, sum(w * rz) / sum(w) AS z FROM o GROUP BY d)
SELECT unnest(['x', 'z']) AS feature, round(unnest([t.x, t.z]), 5) AS treated, round(unnest([c.x, c.z]), 5) AS control FROM m t, m c WHERE t.d = 1 AND c.d = 0"""


@query("eco_17_overlap_weights", _logit_sql())
def _(t):
    df = E.overlap_weights(t.panel.withColumn("treat", (C("sector") % 3 == 0).cast("int")), ["x", "z"], "treat")
    mean = lambda c, d: F.sum(F.when(C("treat") == d, C(c) * C("overlap_weight"))) / F.sum(F.when(C("treat") == d, C("overlap_weight")))
    return df.agg(*[F.struct(F.lit(c).alias("feature"), F.round(mean(c, 1), 5).alias("treated"), F.round(mean(c, 0), 5).alias("control")).alias(c) for c in ("x", "z")]).select(F.inline(F.array("x", "z")))


@query("eco_17_overlap_report")
def _(t):
    df = E.overlap_weights(t.panel.withColumn("treat", (C("sector") % 3 == 0).cast("int")), ["x", "z"], "treat", group="wave")
    return E.overlap_report(df, ["x", "z"], "treat")


_ANC = """WITH @panel, q AS (SELECT sector, wave, y, (sector < 8)::INT AS d, max(CASE WHEN wave = 1995 THEN y END) OVER (PARTITION BY sector) AS b FROM panel), r AS (SELECT sector, y - avg(y) OVER w AS y, d - avg(d) OVER w AS d, b - avg(b) OVER w AS b FROM q WHERE wave > 1995 WINDOW w AS (PARTITION BY wave)),
s AS (SELECT sum(d * d) AS dd, sum(d * b) AS db, sum(b * b) AS bb, sum(d * y) AS dy, sum(b * y) AS ky, count(*) AS n, count(DISTINCT sector) AS g, 5 AS k FROM r), c AS (SELECT *, (bb * dy - db * ky) / (dd * bb - db * db) AS c1, (dd * ky - db * dy) / (dd * bb - db * db) AS c2, dd * bb - db * db AS det FROM s),
u AS (SELECT sector, sum(r.d * (y - c1 * r.d - c2 * r.b)) AS u1, sum(r.b * (y - c1 * r.d - c2 * r.b)) AS u2 FROM r, c GROUP BY sector), m AS (SELECT sum(u1 * u1) AS m11, sum(u1 * u2) AS m12, sum(u2 * u2) AS m22 FROM u),
f AS (SELECT *, g / (g - 1.0) * (n - 1.0) / (n - k - 2) AS f FROM c, m)
SELECT 'treated' AS term, round(c1, 5) AS coef, round(sqrt(f * (bb * bb * m11 - 2 * bb * db * m12 + db * db * m22)) / det, 5) AS se, n::BIGINT AS n, g::BIGINT AS clusters FROM f
UNION ALL SELECT 'baseline', round(c2, 5), round(sqrt(f * (db * db * m11 - 2 * db * dd * m12 + dd * dd * m22)) / det, 5), n::BIGINT, g::BIGINT FROM f"""


@query("eco_18_ancova", _ANC)
def _(t):
    return terms(E.ancova(treated(t), "y", "sector", "wave", 1995, "treat", "wave", "sector"))


@query("eco_19_long_diff", """WITH @panel, d AS (SELECT a.sector, a.dist, b.y - a.y AS dy, b.x - a.x AS dx FROM panel a JOIN panel b USING (sector) WHERE a.wave = 1995 AND b.wave = 2000), res AS (SELECT dy - avg(dy) OVER (PARTITION BY dist) AS y, dx - avg(dx) OVER (PARTITION BY dist) AS x, dist AS g FROM d)""" + _ONE.format("d_x", "5"))
def _(t):
    return terms(E.long_diff_reg(t.panel, "sector", "wave", 1995, 2000, "y", "x", "dist", "dist"))


@query("eco_20_cohort", """WITH @person, p AS (SELECT ln(value) AS y, least(greatest(age - 10, 0), 12) / 12.0 * (sector < 8)::INT AS x, sector AS g FROM person), res AS (SELECT y - avg(y) OVER (PARTITION BY g) AS y, x - avg(x) OVER (PARTITION BY g) AS x, g FROM p WHERE y IS NOT NULL)""" + _ONE.format("exposed", "25"))
def _(t):
    df = t.person.withColumns({"lv": F.log("value"), "treat": C("sector") < 8})
    return terms(E.cohort_design(df, "lv", "age", 10, 12, "treat", ["sector"], "sector"))


_COHORTS = """WITH @person, p AS (SELECT ln(value) AS y, CASE WHEN age < 20 THEN 0 WHEN age < 35 THEN 1 ELSE 2 END AS b, sector < 8 AS d FROM person WHERE age < 60), m AS (SELECT b, d, avg(y) AS m FROM p GROUP BY 1, 2), g AS (SELECT b, max(m) FILTER (d) - max(m) FILTER (NOT d) AS g FROM m GROUP BY b)
SELECT 'bin_' || (CASE b WHEN 1 THEN 20 ELSE 35 END) AS term, round(g - (SELECT g FROM g WHERE b = 0), 5) AS coef FROM g WHERE b > 0"""


@query("eco_20_cohort_bins", _COHORTS)
def _(t):
    bin_ = F.when(C("age") < 20, 0).when(C("age") < 35, 1).otherwise(2)
    df = t.person.withColumns({"lv": F.log("value"), "treat": C("sector") < 8, "bin": bin_, "side": C("sector") < 8})
    return E.cohort_event_study(df, "lv", "age", [0, 20, 35, 60], 0, "treat", ["bin", "side"], "sector").select("term", r("coef", 5).alias("coef"))


@query("eco_21_shift_share", """WITH @panel, d AS (SELECT wave, dist, y - lag(y) OVER s AS y, x - lag(x) OVER s AS x FROM panel WINDOW s AS (PARTITION BY sector ORDER BY wave)), res AS (SELECT y - avg(y) OVER (PARTITION BY wave) AS y, x - avg(x) OVER (PARTITION BY wave) AS x, dist AS g FROM d WHERE y IS NOT NULL)""" + _ONE.format("d_exposure", "5"))
def _(t):
    return terms(E.shift_share_reg(t.panel, "sector", "wave", "y", "x", [], "dist"))


def order_components(o):
    edges = o.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("o"), C("o_orderkey") % 5000 + (C("o_orderkey") % 7) * 100000).alias("b"))
    return E.components(edges, "a", "b")


_COMPONENTS = """WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'o' || (o_orderkey % 5000 + (o_orderkey % 7) * 100000) AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM u GROUP BY a UNION (SELECT c.node, min(o.component) FROM recurring.c AS c JOIN u ON u.a = c.node JOIN c AS o ON o.node = u.b WHERE o.component < c.component GROUP BY c.node))
SELECT node, component FROM c"""


@query("eco_22_components", _COMPONENTS)
def _(t):
    return order_components(t["orders"])


@query("eco_22_components_all", _COMPONENTS)
def _(t):
    return order_components(t["orders"])


@query("eco_23_pds_lasso")
def _(t):
    from surveyspark.functions.recode import expand_candidates

    df = zscore(t.panel, ["x", "z", "n"]).withColumn("terms", expand_candidates(["x_z", "z_z", "n_z"]))
    names = [f"c{i}" for i in range(6)]
    df = df.select("sector", "dist", "wave", "y", "z", *[C("terms")[i].alias(c) for i, c in enumerate(names)])
    return E.pds_lasso(df, "y", "z", names, "wave", "sector")


@query("eco_24_l1_logit_cv")
def _(t):
    df = t.person.select("hhid", (C("cls") == "R").cast("int").alias("y"), C("wt"), (C("age") / 50).alias("a"), C("disc"), C("tax"), (C("wave") - 1995).alias("w"))
    return E.l1_logit_cv(df, "y", ["a", "disc", "tax"], "hhid", penalties=(0.001, 0.1), folds=3, forced=["w"])


@query("eco_25_post_lasso")
def _(t):
    df = t.person.select("sector", (C("cls") == "R").cast("int").alias("y"), "age", "disc", "tax", C("wave").cast("double").alias("w"))
    return E.post_lasso(df, "y", ["age", "disc", "tax", "w"], "sector")


def candidates(t):
    """1,539 candidates of every vector: 54 components, their squares and all their products."""
    x = F.transform(F.slice("embedding", 1, 54), lambda v: v.cast("double") * 8)
    rows = t["embeddings"].select("vec_id", C("label").cast("double").alias("y"), F.get("embedding", F.lit(63)).cast("double").alias("d"), (C("vec_id") % 7).alias("wave"), (C("vec_id") % 50).alias("unit"), x.alias("v"))
    return rows.withColumn("x", F.concat("v", pairwise(C("v"))))


@query("eco_23_double_selection")
def _(t):
    fit, kept = L.double_selection(candidates(t), "y", "d", "x", "wave", "unit")
    return fit.withColumn("selected", F.lit(len(kept)))


@query("eco_24_logit_path")
def _(t):
    df = candidates(t).withColumn("high", (C("y") > 4).cast("int"))
    return L.logit_path(df, "high", "x", "unit", (0.1, 0.05))[0]


@query("eco_24_logit_coefficients")
def _(t):
    df = t.person.select("hhid", (C("cls") == "R").cast("int").alias("y"), "wt", "age", "disc", "tax", C("size").cast("double").alias("size"), (C("wave") - 1995).alias("w"))
    return L.logit_path(df, "y", ["age", "disc", "tax", "size", "w"], "hhid", (0.01, 0.001), folds=3, w="wt", forced=1)[1]


@query("eco_25_post_selection")
def _(t):
    fit, kept = L.post_selection(candidates(t).withColumn("high", (C("y") > 4).cast("double")), "high", "x", "unit")
    return fit.withColumn("selected", F.lit(len(kept)))


@query("eco_25_average_effects")
def _(t):
    return E.average_effects(t.panel.withColumn("d", (C("sector") < 8).cast("double")), "y", "d", "z", "sector")


@query("eco_26_boot_mean", """WITH @panel, u AS (SELECT sector, avg(y) AS y FROM panel GROUP BY sector), h AS (SELECT i, y, ('0x' || substr(md5(concat_ws('|', 1, i, sector)), 1, 8))::BIGINT / 4294967296.0 AS q FROM u, range(0, 200) t(i)),
c AS (SELECT i, y, CASE WHEN q < exp(-1) THEN 0 WHEN q < exp(-1) * 2 THEN 1 WHEN q < exp(-1) * 2.5 THEN 2 WHEN q < exp(-1) * (2.5 + 1 / 6.0) THEN 3 WHEN q < exp(-1) * (2.5 + 1 / 6.0 + 1 / 24.0) THEN 4 WHEN q < exp(-1) * (2.5 + 1 / 6.0 + 1 / 24.0 + 1 / 120.0) THEN 5 WHEN q < exp(-1) * (2.5 + 1 / 6.0 + 1 / 24.0 + 1 / 120.0 + 1 / 720.0) THEN 6 ELSE 7 END AS c FROM h), m AS (SELECT i, sum(c * y) / sum(c) AS m FROM c GROUP BY i)
SELECT (SELECT round(avg(y), 6) FROM u) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def _(t):
    units = t.panel.groupBy("sector").agg(F.avg("y").alias("y"))
    return rounded(E.boot_mean(units, "sector", "y", 200), 6, "mean", "low", "high")


_BOOT = """WITH @panel, u AS (SELECT sector, max(CASE WHEN wave = 2000 THEN y END) - max(CASE WHEN wave = 1995 THEN y END) AS c, (sector < 8)::INT AS d FROM panel GROUP BY sector), h AS (SELECT i, c, d, ('0x' || substr(md5(concat_ws('|', 1, i, sector)), 1, 8))::BIGINT / 4294967296.0 AS q FROM u, range(0, 200) t(i)),
k AS (SELECT i, c, d, CASE WHEN q < exp(-1) THEN 0 WHEN q < exp(-1) * 2 THEN 1 WHEN q < exp(-1) * 2.5 THEN 2 WHEN q < exp(-1) * (2.5 + 1 / 6.0) THEN 3 WHEN q < exp(-1) * (2.5 + 1 / 6.0 + 1 / 24.0) THEN 4 WHEN q < exp(-1) * (2.5 + 1 / 6.0 + 1 / 24.0 + 1 / 120.0) THEN 5 WHEN q < exp(-1) * (2.5 + 1 / 6.0 + 1 / 24.0 + 1 / 120.0 + 1 / 720.0) THEN 6 ELSE 7 END AS n FROM h),
m AS (SELECT i, sum(n * c) FILTER (d = 1) / sum(n) FILTER (d = 1) AS treated, sum(n * c) FILTER (d = 0) / sum(n) FILTER (d = 0) AS control FROM k GROUP BY i), l AS (SELECT 'treated' AS what, treated AS m FROM m UNION ALL SELECT 'control', control FROM m UNION ALL SELECT 'difference', treated - control FROM m),
o AS (SELECT avg(c) FILTER (d = 1) AS t, avg(c) FILTER (d = 0) AS k FROM u)
SELECT what, round(max(CASE what WHEN 'treated' THEN t WHEN 'control' THEN k ELSE t - k END), 5) AS change, round(quantile_cont(m, 0.025), 5) AS low, round(quantile_cont(m, 0.975), 5) AS high, round(least(1, 2 * least(avg((m <= 0)::INT), avg((m >= 0)::INT))), 6)::DOUBLE AS p FROM l, o WHERE m IS NOT NULL GROUP BY what"""


@query("eco_26_boot_did", _BOOT)
def _(t):
    at = lambda p: F.max(F.when(C("wave") == p, C("y")))
    units = t.panel.groupBy("sector").agg(at(1995).alias("before"), at(2000).alias("after"), F.max((C("sector") < 8).cast("int")).alias("treat"))
    return rounded(rounded(E.boot_did(units, "sector", "before", "after", "treat", 200), 5, "change", "low", "high"), 6, "p")


@query("eco_27_holm", """WITH @panel, p AS (SELECT wave, sector, (('0x' || substr(md5(concat_ws('|', sector, wave)), 1, 8))::BIGINT / 4294967296.0)::DOUBLE AS p, count(*) OVER (PARTITION BY wave) AS m FROM panel), a AS (SELECT *, least(1, (m - row_number() OVER (PARTITION BY wave ORDER BY p) + 1) * p) AS a FROM p)
SELECT wave, sector, round(max(a) OVER (PARTITION BY wave ORDER BY p ROWS UNBOUNDED PRECEDING), 8) AS p_holm FROM a""")
def _(t):
    p = t.panel.select("wave", "sector", (F.conv(F.substring(F.md5(F.concat_ws("|", "sector", "wave")), 1, 8), 16, 10).cast("double") / 4294967296.0).alias("p"))
    return E.holm(p, "p", ["wave"]).select("wave", "sector", r("p_holm", 8).alias("p_holm"))


@query("eco_27_romano_wolf")
def _(t):
    units = t.panel.groupBy("sector").agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.avg("z").alias("z"))
    long = zscore(units, ["y", "x", "z"]).select("sector", "y_z", "x_z", "z_z").unpivot(["sector"], ["y_z", "x_z", "z_z"], "outcome", "v")
    draws = long.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(98).cast("long")))).groupBy("draw", "outcome").agg(F.avg(C("v") * F.when(E.draw(3, C("draw"), C("sector")) % 2 == 0, 1.0).otherwise(-1.0)).alias("t"))
    observed = long.groupBy("outcome").agg(F.avg(C("v") * F.when(C("sector") < 12, 1.0).otherwise(-1.0)).alias("t"))
    return E.romano_wolf(draws, observed)


@query("eco_28_balance", """WITH @panel, p AS (SELECT y, (sector < 8)::INT AS d, sector AS g FROM panel), k AS (SELECT avg(y) FILTER (d = 1) AS t, avg(y) FILTER (d = 0) AS c, avg(d) AS db, count(*) AS n, count(DISTINCT g) AS gs FROM p), m AS (SELECT sum(s * s) AS meat FROM (SELECT g, sum((d - db) * (y - c - (t - c) * d)) AS s FROM p, k GROUP BY g))
SELECT 'y' AS "column", round(t, 5) AS treated, round(c, 5) AS control, round(t - c, 5) AS difference, round(sqrt(gs / (gs - 1.0) * (n - 1.0) / (n - 2) * meat) / (n * db * (1 - db)), 5) AS se FROM k, m""")
def _(t):
    return rounded(E.balance(treated(t), "treat", ["y"], "sector"), 5, "treated", "control", "difference", "se")


@query("eco_29_wage_gaps", """WITH @person, p AS (SELECT ln(value) AS y, (sex = 'O')::INT::DOUBLE AS x, cls || '_' || wave AS cell, sector AS g FROM person), res AS (SELECT y - avg(y) OVER (PARTITION BY cell) AS y, x - avg(x) OVER (PARTITION BY cell) AS x, g FROM p)""" + _ONE.format("sex_O", "(SELECT count(DISTINCT cell) FROM p)"))
def _(t):
    return terms(E.wage_gaps(t.person, "value", "sex", "F", ["cls", "wave"], "sector"))
