"""Queries of spatial joins, pixel reductions and sensor series. Units are the nations as 25 squares of a 100 by 100 plane."""

from pyspark.sql import functions as F

from surveyspark.operators import sensor as N
from surveyspark.operators import spatial as G
from surveyspark.sources.scratch import materialize

from .base import query
from .q_agg import monthly, r, rounded

C = F.col
_PIX = "px AS (SELECT c_custkey % 100 AS row, (c_custkey // 100) % 100 AS col, round(avg(c_acctbal), 2) AS value, max(1 + (c_custkey % 100) / 100.0)::DOUBLE AS ha, min(c_custkey % 7) AS loss, min(c_custkey % 90) AS cover FROM customer GROUP BY 1, 2), lab AS (SELECT *, (col // 20 + 5 * (row // 20))::INTEGER AS unit FROM px)"
_PTS = "pts AS (SELECT o_orderkey AS id, (o_orderkey * 7 % 1000) / 10.0 AS x, (o_orderkey * 13 % 1000) / 10.0 AS y, round(o_totalprice, 2) AS v FROM orders)"


def units(t):
    return t["nation"].select(C("n_nationkey").alias("unit"), (20.0 * (C("n_nationkey") % 5)).alias("x0"), (20.0 * F.floor(C("n_nationkey") / 5)).alias("y0"))


def edges(t):
    corner = [(0, 0, 20, 0), (20, 0, 20, 20), (20, 20, 0, 20), (0, 20, 0, 0)]
    e = F.array(*[F.struct((C("x0") + a).alias("x1"), (C("y0") + b).alias("y1"), (C("x0") + c).alias("x2"), (C("y0") + d).alias("y2")) for a, b, c, d in corner])
    return units(t).select("unit", F.inline(e))


def pixels(t):
    k = C("c_custkey")
    return t["customer"].groupBy((k % 100).alias("row"), (F.floor(k / 100) % 100).alias("col")).agg(F.round(F.avg("c_acctbal"), 2).alias("value"), F.max(1 + (k % 100) / 100.0).alias("ha"), F.min(k % 7).alias("loss"), F.min(k % 90).alias("cover"))


def labels(t, s=1):
    return G.label_pixels(pixels(t), edges(t), "unit", 10.0, s=s)


def points(t):
    return t["orders"].select(C("o_orderkey").alias("id"), (C("o_orderkey") * 7 % 1000 / 10.0).alias("x"), (C("o_orderkey") * 13 % 1000 / 10.0).alias("y"), F.round("o_totalprice", 2).alias("v"))


@query("geo_01_points_in", f"WITH {_PTS} SELECT (floor(x / 20) + 5 * floor(y / 20))::INTEGER AS unit, count(*)::BIGINT AS n, round(sum(v), 1) AS sum, round(avg(v), 3) AS mean FROM pts GROUP BY 1")
def _(t):
    p = points(t)
    return G.unit_stats(p, G.points_in(p, edges(t), "id", "unit", 10.0), "id", "unit", "v").select("unit", "n", r("sum", 1).alias("sum"), r("mean", 3).alias("mean"))


@query("geo_02_zonal", f"WITH {_PIX} SELECT unit, round(sum(value), 2) AS sum, round(sum(value * ha) / sum(ha), 6) AS mean, max(value) AS max, round(coalesce(sum(ha) FILTER (value > 5000), 0) / sum(ha), 8) AS lit_share, round(max(value) / sum(value), 8) AS top_share FROM lab GROUP BY unit")
def _(t):
    df = G.zonal(pixels(t), labels(t), "unit", 5000.0)
    return df.select("unit", r("sum", 2).alias("sum"), r("mean").alias("mean"), "max", r("lit_share", 8).alias("lit_share"), r("top_share", 8).alias("top_share"))


@query("geo_03_label_pixels", f"WITH {_PIX} SELECT row, col, unit, 1.0::DOUBLE AS share FROM lab")
def _(t):
    return labels(t, s=2)


@query("geo_04_class_area", f"""WITH {_PIX} SELECT unit, cover >= 45 AS inside, round(coalesce(sum(ha) FILTER (value < 2000), 0), 6) AS low, round(coalesce(sum(ha) FILTER (value >= 2000), 0), 6) AS high FROM lab GROUP BY 1, 2""")
def _(t):
    df = G.class_area(pixels(t), labels(t), "unit", F.when(C("value") < 2000, "low").otherwise("high"), ["low", "high"], C("cover") >= 45)
    return rounded(df, 6, "low", "high")


@query("geo_05_annual_loss", f"WITH {_PIX} SELECT unit, loss AS year, round(sum(ha), 6) AS loss_ha FROM lab WHERE cover >= 30 AND loss > 0 GROUP BY 1, 2")
def _(t):
    return rounded(G.annual_loss(pixels(t), labels(t), "unit", "loss", "cover", 30), 6, "loss_ha")


@query("geo_06_regrid", f"WITH {_PIX} SELECT (row // 10)::BIGINT AS row, (col // 10)::BIGINT AS col, round(avg(value), 4) AS value, round(sum(ha), 6) AS ha, count(*)::BIGINT AS n FROM px GROUP BY 1, 2")
def _(t):
    return G.regrid(pixels(t), 10).select("row", "col", r("value", 4).alias("value"), r("ha").alias("ha"), "n")


@query("geo_07_dist_to", f"WITH {_PTS} SELECT id, round(least(sqrt(pow(x - least(greatest(x, 10), 60), 2) + pow(y - 50, 2)), sqrt(pow(x - 80, 2) + pow(y - 20, 2))), 6) AS distance FROM pts")
def _(t):
    gates = t["region"].filter("r_regionkey < 2").select(F.when(C("r_regionkey") == 0, 10.0).otherwise(80.0).alias("x1"), F.when(C("r_regionkey") == 0, 50.0).otherwise(20.0).alias("y1"), F.when(C("r_regionkey") == 0, 60.0).otherwise(80.0).alias("x2"), F.when(C("r_regionkey") == 0, 50.0).otherwise(20.0).alias("y2"))
    return rounded(G.dist_to(points(t), gates, "id"), 6, "distance")


_ADJ = "adj AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey AND abs(a.n_nationkey % 5 - b.n_nationkey % 5) <= 1 AND abs(a.n_nationkey // 5 - b.n_nationkey // 5) <= 1)"


@query("geo_08_adjacency", f"WITH {_ADJ} SELECT src, dst FROM adj")
def _(t):
    return G.adjacency(edges(t), "unit")


@query("geo_08_touches", f"WITH {_ADJ} SELECT DISTINCT src AS unit FROM adj WHERE dst IN (6, 12) AND src NOT IN (6, 12)")
def _(t):
    return G.touches(G.adjacency(edges(t), "unit"), units(t).filter("unit IN (6, 12)").select("unit"))


@query("geo_09_shape_stats", "SELECT n_nationkey AS unit, 400.0::DOUBLE AS area, 80.0::DOUBLE AS perimeter, round(4 * pi() * 400 / 6400, 8) AS compactness, (20.0 * (n_nationkey % 5) + 10)::DOUBLE AS cx, (20.0 * (n_nationkey // 5) + 10)::DOUBLE AS cy FROM nation")
def _(t):
    return rounded(G.shape_stats(edges(t), "unit"), 8, "compactness", "cx", "cy")


@query("geo_10_treatment", """WITH f AS (SELECT n_nationkey AS unit, n_regionkey = 1 AS border, n_nationkey = 7 AS gate, n_nationkey % 6 = 5 AS town, n_nationkey = 0 AS capital, n_nationkey % 4 = 1 AS near_settled, sqrt(pow(20.0 * (n_nationkey % 5) - 40, 2) + pow(20.0 * (n_nationkey // 5) - 20, 2)) AS km FROM nation)
SELECT unit, CASE WHEN capital THEN 'capital' WHEN town THEN 'town' WHEN gate THEN 'gate' WHEN near_settled AND km <= 45 THEN 'near_gate' WHEN border THEN 'border' WHEN near_settled THEN 'spill' ELSE 'control' END AS "group", NOT (capital OR town OR gate OR near_settled OR border) AS clean_control FROM f""")
def _(t):
    k = C("unit")
    u = units(t).join(t["nation"].select(C("n_nationkey").alias("unit"), "n_regionkey"), "unit")
    u = u.withColumns({"border": C("n_regionkey") == 1, "gate": k == 7, "town": k % 6 == 5, "capital": k == 0, "near_settled": k % 4 == 1, "gate_km": F.hypot(C("x0") - 40, C("y0") - 20)})
    return G.treatment_groups(u, 45.0).select("unit", "group", "clean_control")


@query("geo_10_flags", f"""WITH {_PIX}, f AS (SELECT *, coalesce(cover < 15, false) AS park, cover < 5 AS old FROM lab), st AS (SELECT * FROM f WHERE NOT park), b AS (SELECT DISTINCT a.unit FROM f a JOIN f o ON o.old AND abs(a.row - o.row) <= 1 AND abs(a.col - o.col) <= 1),
n AS (SELECT DISTINCT a.unit FROM st a JOIN st g ON g.unit = 7 AND abs(a.row - g.row) <= 1 AND abs(a.col - g.col) <= 1), d AS (SELECT unit, min(sqrt(pow(col + 0.5 - 40, 2) + pow(row + 0.5 - 20, 2))) AS km FROM st GROUP BY unit)
SELECT DISTINCT f.unit, f.unit IN (SELECT unit FROM b) AS border, f.unit = 7 AS gate, f.unit IN (SELECT unit FROM n) AS near_settled, round(km, 6) AS gate_km FROM f LEFT JOIN d USING (unit)""")
def _(t):
    labelled = pixels(t).withColumn("unit", (F.floor(C("col") / 20) + 5 * F.floor(C("row") / 20)).cast("int"))
    gate_units, gates = t["nation"].filter("n_nationkey = 7").select(C("n_nationkey").alias("unit")), t["nation"].filter("n_nationkey = 7").select(F.lit(40.0).alias("x"), F.lit(20.0).alias("y"))
    flags = G.treatment_flags(labelled, "unit", C("cover") < 15, C("cover") < 5, gate_units, gates, 1.0)
    return flags.withColumn("gate_km", F.round("gate_km", 6))


@query("geo_11_block", f"WITH {_PTS}, m AS (SELECT min(x) AS mx, min(y) AS my FROM pts) SELECT floor((x - mx) / 20)::BIGINT || '_' || floor((y - my) / 20)::BIGINT AS block, count(*)::BIGINT AS n FROM pts, m GROUP BY 1")
def _(t):
    return G.spatial_block(points(t), 20.0).groupBy("block").agg(F.count("*").alias("n"))


# A line from (x, y) to (0.9 x, 0.9 y): its length in a square is its length times the part of the way that lies between both pairs of sides.
_LINES = f"""{_PTS}, q AS (SELECT id, x, y, n_nationkey AS unit, 20.0 * (n_nationkey % 5) AS x0, 20.0 * (n_nationkey // 5) AS y0 FROM pts, nation),
k AS (SELECT unit, 0.1 * sqrt(x * x + y * y) AS len, greatest(0, CASE WHEN x = 0 THEN CASE WHEN x0 = 0 THEN 0 ELSE 9 END ELSE (1 - (x0 + 20) / x) / 0.1 END, CASE WHEN y = 0 THEN CASE WHEN y0 = 0 THEN 0 ELSE 9 END ELSE (1 - (y0 + 20) / y) / 0.1 END) AS a,
  least(1, CASE WHEN x = 0 THEN CASE WHEN x0 = 0 THEN 1 ELSE 0 END ELSE (1 - x0 / x) / 0.1 END, CASE WHEN y = 0 THEN CASE WHEN y0 = 0 THEN 1 ELSE 0 END ELSE (1 - y0 / y) / 0.1 END) AS b FROM q)"""


@query("geo_12_length", f"WITH {_LINES} SELECT unit, round(sum(greatest(b - a, 0) * len), 4) AS length FROM k GROUP BY unit")
def _(t):
    lines = points(t).select("id", C("x").alias("x1"), C("y").alias("y1"), (C("x") * 0.9).alias("x2"), (C("y") * 0.9).alias("y2"))
    return rounded(G.length_by_unit(lines, edges(t), "id", "unit", 10.0), 4, "length")


# Right triangles of suppliers over squares of customers: the part under the slope by sums of squares.
_TRI = """a AS (SELECT s_suppkey AS supplier, (s_suppkey * 37 % 950) / 10.0 AS x0, (s_suppkey * 53 % 940) / 10.0 AS y0, 4.0 + s_nationkey % 7 AS s FROM supplier),
b AS (SELECT c_custkey AS customer, (c_custkey * 29 % 970) / 10.0 AS x0, (c_custkey * 61 % 970) / 10.0 AS y0, 1.0 + c_custkey % 3 AS s FROM customer),
m AS (SELECT supplier, customer, a.x0 + a.y0 + a.s AS c, greatest(a.x0, b.x0) AS p, greatest(a.x0, b.x0 + b.s) AS q, greatest(a.y0, b.y0) AS u, greatest(a.y0, b.y0 + b.s) AS v FROM a JOIN b ON b.x0 < a.x0 + a.s AND a.x0 < b.x0 + b.s AND b.y0 < a.y0 + a.s AND a.y0 < b.y0 + b.s),
f AS (SELECT supplier, customer, (pow(greatest(c - p - u, 0), 2) - pow(greatest(c - q - u, 0), 2) - pow(greatest(c - p - v, 0), 2) + pow(greatest(c - q - v, 0), 2)) / 2 AS area FROM m)"""


def polygons(df, key, x0, y0, s, corners):
    """Edge rows of the same shape for every row: ``corners`` in units of ``s`` from (x0, y0), in order."""
    ring = [*corners, corners[0]]
    e = F.array(*[F.struct((x0 + s * p[0]).alias("x1"), (y0 + s * p[1]).alias("y1"), (x0 + s * q[0]).alias("x2"), (y0 + s * q[1]).alias("y2")) for p, q in zip(ring[:-1], ring[1:], strict=True)])
    return df.select(C(key[0]).alias(key[1]), F.inline(e))


def triangles(t):
    k = C("s_suppkey")
    return polygons(t["supplier"], ("s_suppkey", "supplier"), k * 37 % 950 / 10.0, k * 53 % 940 / 10.0, 4.0 + C("s_nationkey") % 7, [(0, 0), (0, 1), (1, 0)])


def squares(t):
    k = C("c_custkey")
    return polygons(t["customer"], ("c_custkey", "customer"), k * 29 % 970 / 10.0, k * 61 % 970 / 10.0, 1.0 + k % 3, [(0, 0), (1, 0), (1, 1), (0, 1)])


@query("geo_12_overlap_area", f"WITH {_TRI} SELECT supplier, customer, round(area, 5) AS area FROM f WHERE round(area, 5) > 0")
def _(t):
    return rounded(G.overlap_area(triangles(t), squares(t), "supplier", "customer", 5.0), 5, "area").filter("area > 0")


@query("geo_12_overlap", f"WITH {_PIX} SELECT unit, (unit // 5)::BIGINT AS band, round(sum(ha), 6) AS ha FROM lab GROUP BY 1, 2")
def _(t):
    a = labels(t)
    bands = a.select("row", "col", F.floor(C("unit") / 5).alias("band"), "share")
    return rounded(G.overlap_by_unit(pixels(t).select("row", "col", "ha"), a, bands, "unit", "band"), 6, "ha")


@query("geo_13_terrain", f"""WITH {_PIX}, s AS (SELECT l.unit, l.value, degrees(atan(sqrt(pow((e.value - w.value) / 60, 2) + pow((n.value - s.value) / 60, 2)))) AS slope FROM lab l LEFT JOIN px e ON e.row = l.row AND e.col = l.col + 1 LEFT JOIN px w ON w.row = l.row AND w.col = l.col - 1 LEFT JOIN px n ON n.row = l.row - 1 AND n.col = l.col LEFT JOIN px s ON s.row = l.row + 1 AND s.col = l.col)
SELECT unit, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(avg(slope), 4) AS slope FROM s GROUP BY unit""")
def _(t):
    return rounded(G.terrain(pixels(t), labels(t).drop("share"), "unit", 30.0), 4, "mean", "sd", "slope")


@query("geo_14_rain_climate", """WITH @person, monthly AS (SELECT sector, wave, month, round(sum(wt), 4) AS rain FROM person WHERE wave BETWEEN 1995 AND 2000 GROUP BY 1, 2, 3), y AS (SELECT sector, wave, sum(rain) AS y, count(*) FILTER (rain < 150) AS dry FROM monthly GROUP BY 1, 2), m AS (SELECT *, avg(y) OVER (PARTITION BY sector) AS m FROM y)
SELECT sector, round(avg(y), 4) AS mean, round(stddev_samp(y) / avg(y), 8) AS cv, round(avg(dry), 6) AS dry_months, round(avg((y < 0.95 * m)::INT), 6) AS drought_share FROM m GROUP BY sector""")
def _(t):
    df = G.rain_climate(monthly(t), "sector", "wave", "month", "rain", 150, 0.95)
    return df.select("sector", r("mean", 4).alias("mean"), r("cv", 8).alias("cv"), r("dry_months").alias("dry_months"), r("drought_share").alias("drought_share"))


@query("geo_15_reduce_regions", f"WITH {_PIX}, d AS (SELECT *, 2000 + 17 + loss AS year, cover / 90.0 AS p FROM lab) SELECT unit, year::INTEGER AS year, round(coalesce(sum(ha) FILTER (p >= 0.5), 0), 6) AS alert_ha, round(avg(p), 8) AS probability FROM d GROUP BY 1, 2")
def _(t):
    px = pixels(t).withColumns({"code": (17 + C("loss")) * 1000 + 100, "p": C("cover") / 90.0})
    df = G.reduce_regions(px, labels(t), "unit", "code", "p", 0.5)
    return df.select("unit", "year", r("alert_ha").alias("alert_ha"), r("probability", 8).alias("probability"))


_Z = f"WITH @panel, {_ADJ}, u AS (SELECT sector AS unit, avg(y) AS y FROM panel GROUP BY sector), z AS (SELECT unit, y - (SELECT avg(y) FROM u) AS z FROM u), l AS (SELECT src AS unit, avg(z) AS lag FROM adj JOIN z ON z.unit = dst GROUP BY src)"


@query("geo_16_moran", _Z + " SELECT round(sum(z * lag) / sum(z * z), 8) AS moran FROM z JOIN l USING (unit)")
def _(t):
    u = t.panel.groupBy(C("sector").alias("unit")).agg(F.avg("y").alias("y"))
    return G.moran(u, G.adjacency(edges(t), "unit"), "unit", "y").select(r("moran", 8).alias("moran"))


def _deal_sql() -> str:
    """The keyed bijection on 25 units, five by five, six rounds, for 99 draws."""
    move = lambda i, x: f"('0x' || substr(md5(concat_ws('|', 1, draw, {i}, {x})), 1, 8))::BIGINT"
    steps = ["k0 AS (SELECT unit, draw, r // 5 AS a, r % 5 AS b FROM n, range(0, 99) t(draw))"]
    for i in range(6):
        steps.append(f"k{i + 1} AS (SELECT unit, draw, {'a, (b + ' + move(i, 'a') + ') % 5 AS b' if i % 2 else '(a + ' + move(i, 'b') + ') % 5 AS a, b'} FROM k{i})")
    return _Z + f""", n AS (SELECT unit, z, row_number() OVER (ORDER BY unit) - 1 AS r FROM z), {", ".join(steps)}, d AS (SELECT k.draw, k.unit, n.z FROM k6 k JOIN n ON n.r = 5 * k.a + k.b),
g AS (SELECT d.draw, src AS unit, avg(z) AS lag FROM adj JOIN d ON d.unit = dst GROUP BY 1, 2), i AS (SELECT draw, sum(z * lag) / sum(z * z) AS i FROM d JOIN g USING (draw, unit) GROUP BY draw), o AS (SELECT sum(z * lag) / sum(z * z) AS m FROM z JOIN l USING (unit))
SELECT round(max(m), 8) AS moran, (1.0::DOUBLE + count(*) FILTER (abs(i) >= abs(m))) / (1 + count(*)) AS p FROM i, o"""


@query("geo_16_moran_p", _deal_sql())
def _(t):
    u = t.panel.groupBy(C("sector").alias("unit")).agg(F.avg("y").alias("y"))
    return G.moran(u, G.adjacency(edges(t), "unit"), "unit", "y", perms=99).select(r("moran", 8).alias("moran"), "p")


@query("geo_16_lisa", _Z + " SELECT unit, round(z * lag / (SELECT avg(z * z) FROM z), 6) AS local, CASE WHEN z >= 0 THEN 'H' ELSE 'L' END || CASE WHEN lag >= 0 THEN 'H' ELSE 'L' END AS quadrant FROM z JOIN l USING (unit)")
def _(t):
    u = t.panel.groupBy(C("sector").alias("unit")).agg(F.avg("y").alias("y"))
    return rounded(G.lisa(u, G.adjacency(edges(t), "unit"), "unit", "y"), 6, "local")


_LONG = "lng AS (SELECT sector AS unit, cls AS layer, sex AS sat, wave * 100 + month AS period, round(avg(wt), 6) AS mean, round(sum(wt), 4) AS total FROM person GROUP BY 1, 2, 3, 4)"


def long(t):
    rows = t.person.groupBy(C("sector").alias("unit"), C("cls").alias("layer"), C("sex").alias("sat"), (C("wave") * 100 + C("month")).alias("period"))
    return rows.agg(F.round(F.avg("wt"), 6).alias("mean"), F.round(F.sum("wt"), 4).alias("total"))


@query("ntl_01_average_satellites", f"WITH @person, {_LONG} SELECT unit, layer, period, round(avg(mean), 7) AS mean, round(avg(total), 5) AS total, count(DISTINCT sat)::BIGINT AS n_sat FROM lng GROUP BY 1, 2, 3")
def _(t):
    return N.average_satellites(long(t), ["mean", "total"]).select("unit", "layer", "period", r("mean", 7).alias("mean"), r("total", 5).alias("total"), "n_sat")


@query("ntl_02_layers_wide", f'WITH @person, {_LONG}, a AS (SELECT unit, layer, period, avg(total) AS total FROM lng GROUP BY 1, 2, 3) SELECT unit, period, round(max(total) FILTER (layer = \'A\'), 3) AS "A_total", round(max(total) FILTER (layer = \'R\'), 3) AS "R_total" FROM a GROUP BY 1, 2')
def _(t):
    return rounded(N.layers_wide(N.average_satellites(long(t), ["total"]), ["A", "R"], ["total"]), 3, "A_total", "R_total")


@query("ntl_03_derive_series", """WITH @panel SELECT sector AS unit, wave AS period, round(asinh(y), 6) AS asinh_total, round(1000 * y / n, 4) AS per_1000, min(wave) FILTER (y > 2) OVER (PARTITION BY sector) AS first_lit FROM panel""")
def _(t):
    df = N.derive_series(t.panel.select(C("sector").alias("unit"), C("wave").alias("period"), "y", "n"), "y", "n", 2.0)
    return df.select("unit", "period", r("asinh_total").alias("asinh_total"), r("per_1000", 4).alias("per_1000"), "first_lit")


def joint(t):
    return t.person.groupBy("suppkey", "wave").agg(F.round(F.sum(F.when(C("sex") == "F", C("wt"))), 2).alias("a"), F.round(F.sum(F.when(C("sex") == "O", C("wt"))), 2).alias("b"))


_Q11 = "j AS (SELECT suppkey, wave, round(sum(wt) FILTER (sex = 'F'), 2) AS a, round(sum(wt) FILTER (sex = 'O'), 2) AS b FROM person GROUP BY 1, 2), k AS (SELECT * FROM j WHERE a IS NOT NULL AND b IS NOT NULL), q AS (SELECT quantile_cont(a, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS qa, quantile_cont(b, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS qb FROM k), lut AS (SELECT unnest(range(0, 11))::INTEGER AS k, unnest(qa) AS x, unnest(qb) AS y FROM q)"


@query("ntl_04_quantile_map", f"WITH @person, {_Q11} SELECT k, round(x, 6) AS x, round(max(y) OVER (ORDER BY k), 6) AS y FROM lut")
def _(t):
    return rounded(N.quantile_map(joint(t), "a", "b", 11), 6, "x", "y")


@query("ntl_05_apply_map", f"""WITH @person, {_Q11}, u AS (SELECT x, max(y) AS y FROM lut GROUP BY x), v AS (SELECT suppkey, wave, a, (SELECT max(x) FROM u WHERE x <= a) AS lo, (SELECT min(x) FROM u WHERE x > a) AS hi FROM j WHERE a IS NOT NULL)
SELECT suppkey, wave, round(CASE WHEN lo IS NULL THEN (SELECT min_by(y, x) FROM u) WHEN hi IS NULL THEN l.y ELSE l.y + (a - lo) / (hi - lo) * (h.y - l.y) END, 5) AS mapped FROM v LEFT JOIN u l ON l.x = lo LEFT JOIN u h ON h.x = hi""")
def _(t):
    df = materialize(joint(t), "joint")
    return N.apply_map(df.filter("a IS NOT NULL"), N.quantile_map(df, "a", "b", 11), "a", "mapped").select("suppkey", "wave", r("mapped", 5).alias("mapped"))


_COMPOSED = """WITH @person, j AS (SELECT suppkey, wave, round(sum(wt) FILTER (sex = 'F'), 2) AS a, round(sum(wt) FILTER (sex = 'O'), 2) AS b FROM person GROUP BY 1, 2), q AS (SELECT quantile_cont(a, [i / 100.0 for i in range(0, 101)]) AS qa, quantile_cont(b, [i / 100.0 for i in range(0, 101)]) AS qb FROM j WHERE a IS NOT NULL AND b IS NOT NULL),
l AS (SELECT unnest(range(0, 101)) AS k, unnest(qa) AS a, unnest(qb) AS b FROM q), f AS (SELECT k, a AS x, max(b) OVER (ORDER BY k) AS y FROM l), g AS (SELECT x, max(y) AS y FROM (SELECT b AS x, max(a) OVER (ORDER BY k) AS y FROM l) GROUP BY x),
v AS (SELECT k, x, y, coalesce((SELECT max(g.x) FROM g WHERE g.x <= f.y), (SELECT min(g.x) FROM g)) AS lo, coalesce((SELECT min(g.x) FROM g WHERE g.x > f.y), (SELECT max(g.x) FROM g)) AS hi FROM f)
SELECT v.k::INTEGER AS k, round(v.x, 4) AS x, round(a.y + CASE WHEN hi > lo THEN least(greatest((v.y - lo) / (hi - lo), 0), 1) ELSE 0 END * (b.y - a.y), 4) AS y FROM v JOIN g a ON a.x = lo JOIN g b ON b.x = hi"""


@query("ntl_05_compose_maps", _COMPOSED)
def _(t):
    df = materialize(joint(t), "joint")
    return rounded(N.compose_maps([N.quantile_map(df, "a", "b", 101), N.quantile_map(df, "b", "a", 101)]), 4, "x", "y").withColumn("k", C("k").cast("int"))


@query("ntl_06_retest", """WITH @person, g AS (SELECT sex AS s, wave * 100 + month AS p, month AS m, avg(wt) FILTER (sector < 8) - avg(wt) FILTER (sector >= 8) AS gap FROM person GROUP BY 1, 2, 3), d AS (SELECT *, gap - avg(gap) OVER (PARTITION BY s, m) AS season FROM g),
q AS (SELECT a.s AS source_a, b.s AS source_b, a.p, a.gap AS ga, b.gap AS gb, a.season AS sa, b.season AS sb FROM d a JOIN d b USING (p, m) WHERE a.s < b.s), y AS (SELECT source_a, source_b, corr(ya, yb) AS annual FROM (SELECT source_a, source_b, p // 100, avg(ga) AS ya, avg(gb) AS yb FROM q GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT source_a, source_b, round(corr(ga, gb), 6) AS raw, round(corr(sa, sb), 6) AS deseasonalised, round(stddev_samp(ga - gb), 6) AS sd_diff, count(*)::BIGINT AS n, round(any_value(annual), 6) AS annual FROM q JOIN y USING (source_a, source_b) GROUP BY 1, 2""")
def _(t):
    df = t.person.select("sector", (C("wave") * 100 + C("month")).alias("period"), "month", "sex", "wt", (C("sector") < 8).alias("treated"))
    return rounded(N.retest(df, "sector", "period", "month", "sex", "wt", "treated"), 6, "raw", "deseasonalised", "sd_diff", "annual")


@query("ntl_07_coverage", f"WITH @person, {_LONG}, c AS (SELECT *, 0.2 + least(mean, 40) / 50 AS obs FROM lng), m AS (SELECT *, min(obs) OVER (PARTITION BY unit, period) AS low FROM c) SELECT unit, layer, sat, period, round(total / obs, 3) AS total FROM m WHERE low >= 0.5")
def _(t):
    df = long(t).withColumn("obs", 0.2 + F.least(C("mean"), F.lit(40.0)) / 50)
    return N.coverage_scale(df, "total", "obs", 0.5).select("unit", "layer", "sat", "period", r("total", 3).alias("total"))


@query("ntl_08_drop_blank", """WITH @person, g AS (SELECT *, CASE WHEN wave = 1997 THEN 1.0 ELSE wt END AS v FROM person) SELECT cls, wave, count(*)::BIGINT AS n FROM g WHERE wave <> 1997 GROUP BY 1, 2""")
def _(t):
    df = t.person.select("cls", "wave", F.when(C("wave") == 1997, 1.0).otherwise(C("wt")).alias("v"))
    return N.drop_blank(df, ["cls", "wave"], "v").groupBy("cls", "wave").agg(F.count("*").alias("n"))


@query("ntl_09_lit_share", """WITH @person SELECT sector AS unit, wave AS period, CASE WHEN avg((size < 46)::INT) >= 0.9 THEN round(avg((wt > 20)::INT) FILTER (size < 46), 8) END AS lit_share, round(avg((size < 46)::INT), 8) AS observed FROM person GROUP BY 1, 2""")
def _(t):
    df = t.person.select(C("sector").alias("unit"), C("wave").alias("period"), "wt", (C("size") < 46).alias("obs"))
    return rounded(N.lit_share_series(df, "wt", "obs", 20.0), 8, "lit_share", "observed")
