"""Queries of sources, quality checks, wave alignment and harmonised concepts."""

from pyspark.sql import functions as F

from surveyspark.operators import align as V
from surveyspark.operators import harmonise as H
from surveyspark.operators import quality as Q
from surveyspark.sources import io as IO
from surveyspark.sources.scratch import scratch_path

from .base import query
from .q_agg import r, rounded

C = F.col
CHECK = "SELECT '{0}' AS section, unnest([{1}]) AS name, unnest([{2}])::DOUBLE AS ours, unnest([{3}])::DOUBLE AS reference, unnest([{4}]) AS result FROM {5}"


@query("src_01_extract", "SELECT l_orderkey AS hhid, l_quantity AS wt, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    out = IO.extract(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"], scratch_path(t.spark, "extract"), {"l_orderkey": "hhid", "l_quantity": "wt"}, redo=True)
    return out.groupBy("hhid", "wt").agg(F.count("*").alias("n"))


@query("src_02_scan_agg", "SELECT l_returnflag AS cls, count(*)::BIGINT AS n, round(sum(l_quantity), 4) AS wt FROM lineitem WHERE year(l_shipdate) IN (1996, 1998) GROUP BY 1")
def _(t):
    return IO.scan_agg(t["lineitem"].withColumnRenamed("l_returnflag", "cls"), F.year("l_shipdate").isin(1996, 1998), ["cls"], [F.count("*").alias("n"), r(F.sum("l_quantity"), 4).alias("wt")])


@query("src_06_catalog", "SELECT 'nation' AS dataset, unnest(['n_nationkey', 'n_regionkey']) AS variable, 'int' AS type, count(*)::BIGINT AS n_rows FROM nation UNION ALL SELECT 'orders', unnest(['o_orderkey', 'o_custkey']), 'bigint', count(*) FROM orders")
def _(t):
    index = IO.catalog_scan(t.spark, {"nation": t["nation"], "orders": t["orders"]})
    return IO.catalog_find(index, "key$", regex=True).select("dataset", "variable", "type", "n_rows")


@query("src_07_by_wave", """WITH @person SELECT wave, count(*)::BIGINT AS n, count(CASE WHEN wave = 1996 THEN disc END)::BIGINT AS n_disc FROM person WHERE wave IN (1996, 1998) GROUP BY wave""")
def _(t):
    path = scratch_path(t.spark, "waves")
    df = t.person.filter("wave IN (1996, 1998)").select("hhid", "wave", F.when(C("wave") == 1996, C("disc")).alias("disc"), "tax")
    IO.write_by_wave(df, path, "wave", ["hhid"])
    back = t.spark.read.option("mergeSchema", True).parquet(path)
    return back.groupBy("wave").agg(F.count("*").alias("n"), F.count("disc").alias("n_disc"))


@query("src_08_poolable", """WITH @person SELECT brand AS module, count(*)::BIGINT AS n_years, sum(n)::BIGINT AS n_rows FROM (SELECT brand, wave, count(*) AS n FROM person GROUP BY 1, 2 HAVING count(*) >= 300) GROUP BY brand HAVING count(*) >= 2""")
def _(t):
    return IO.poolable(t.person.groupBy(C("brand").alias("module"), C("wave").alias("year")).agg(F.count("*").alias("n_rows")), 300)


@query("src_03_panel_csv", """WITH @panel SELECT sector, wave, round(y, 3) AS y FROM panel""")
def _(t):
    path = scratch_path(t.spark, "panel")
    IO.write_panel(t.panel.select("sector", "wave", F.round("y", 3).alias("y")), path)
    return IO.read_panel(t.spark, path, "sector int, wave int, y double")


@query("src_04_labelled", "SELECT n_nationkey AS code, n_name AS text, 'nation key' AS label FROM nation")
def _(t):
    path = scratch_path(t.spark, "labelled")
    names = t.spark.createDataFrame([("n_nationkey", "nation key")], "variable string, label string")
    values = t["nation"].select(F.lit("n_nationkey").alias("variable"), C("n_nationkey").alias("code"), C("n_name").alias("text"))
    IO.LabelledTable(t["nation"], names, values).write(path)
    back = IO.LabelledTable.read(t.spark, path)
    label = back.data.schema["n_nationkey"].metadata["label"]
    return back.data.join(back.value_labels, C("n_nationkey") == C("code")).select("code", "text", F.lit(label).alias("label"))


@query("src_05_discover", "SELECT source AS path, CASE WHEN source LIKE 'src1%' THEN 'one' ELSE 'other' END AS kind, CASE WHEN source LIKE 'src1%' THEN regexp_extract(source, '^src1(.*)$', 1) ELSE regexp_extract(source, '^src([0-9]+)$', 1) END AS number FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def _(t):
    files = t["documents"].filter("source IS NOT NULL").select(C("source").alias("path")).distinct()
    found = IO.discover(files, [(r"^src1(.*)$", ["one"]), (r"^src([0-9]+)$", ["other"])])
    return found.select("path", F.when(C("one").isNotNull(), "one").otherwise("other").alias("kind"), F.coalesce("one", "other").alias("number"))


@query("src_09_pixels", """SELECT c_custkey AS k, round(29.0 + (c_custkey % 100 + 0.5) * 0.01, 6) AS lon, round(-1.0 - (c_custkey // 100 + 0.5) * 0.01, 6) AS lat,
 round(0.01 * 0.01 * (6371008.8::DOUBLE * 3.141592653589793::DOUBLE / 180) * (6371008.8::DOUBLE * 3.141592653589793::DOUBLE / 180) * cos(radians(-1.0 - (c_custkey // 100 + 0.5) * 0.01)) / 10000, 6) AS ha FROM customer""")
def _(t):
    grid = t["customer"].select(C("c_custkey").alias("k"), F.expr("c_custkey div 100").alias("row"), (C("c_custkey") % 100).alias("col"))
    return rounded(IO.pixels(grid, 29.0, -1.0, 0.01, 0.01), 6, "lon", "lat", "ha").select("k", "lon", "lat", "ha")


@query("qc_01_preserved", CHECK.format("preserved", "'rows', 'weight'", "count(*), round(sum(l_quantity), 2)", "count(*), round(sum(l_quantity), 2)", "'ok', 'ok'", "lineitem"))
def _(t):
    lines = t["lineitem"]
    return rounded(Q.require(Q.check_preserved(lines, lines.join(t["orders"], C("l_orderkey") == C("o_orderkey"), "left"), "l_quantity")), 2, "ours", "reference")


@query("qc_02_keys", "WITH k AS (SELECT count(*) AS dup FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)), d AS (SELECT count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS bad FROM lineitem)\n" + CHECK.format("keys", "'unique', 'complete', 'domain l_returnflag'", "dup, 0, bad", "0, 0, 0", "CASE WHEN dup = 0 THEN 'ok' ELSE 'FAIL' END, 'ok', CASE WHEN bad = 0 THEN 'ok' ELSE 'FAIL' END", "k, d"))
def _(t):
    return Q.check_keys(t["lineitem"], ["l_orderkey", "l_linenumber"], {"l_returnflag": ["A", "N"]})


@query("qc_03_nesting", "WITH @person, b AS (SELECT count(*) FILTER (sector // 5 <> dist) AS bad FROM person)\n" + CHECK.format("nesting", "'sector in dist'", "bad", "0", "CASE WHEN bad = 0 THEN 'ok' ELSE 'FAIL' END", "b"))
def _(t):
    return Q.check_nesting(t.person, "sector", "dist", 5)


@query("qc_04_constant", "WITH @person, g AS (SELECT hhid, count(DISTINCT wave) AS w, count(DISTINCT cls) AS c, count(*) FILTER (pid = 1) AS h FROM person GROUP BY hhid), s AS (SELECT count(*) FILTER (w > 1) AS w, count(*) FILTER (c > 1) AS c, count(*) FILTER (h <> 1) AS h FROM g)\n"
       + CHECK.format("constant", "'wave', 'cls', 'one head'", "w, c, h", "0, 0, 0", "CASE WHEN w = 0 THEN 'ok' ELSE 'FAIL' END, CASE WHEN c = 0 THEN 'ok' ELSE 'FAIL' END, CASE WHEN h = 0 THEN 'ok' ELSE 'FAIL' END", "s"))
def _(t):
    return Q.check_constant(t.person, ["hhid"], ["wave", "cls"], C("pid") == 1)


@query("qc_05_published", """WITH @person, o AS (SELECT wave, sum(wt) AS ours FROM person GROUP BY wave), ref AS (SELECT year(o_orderdate)::INTEGER AS wave, count(*) * 100.0 AS reference FROM orders WHERE year(o_orderdate) < 2001 GROUP BY 1)
SELECT 'published' AS section, wave::VARCHAR AS name, round(ours, 2) AS ours, reference::DOUBLE AS reference, CASE WHEN reference IS NULL THEN 'info' WHEN abs(ours / reference - 1) <= 0.02 THEN 'ok' ELSE 'FAIL' END AS result FROM o LEFT JOIN ref USING (wave)""")
def _(t):
    ref = t["orders"].groupBy(F.year("o_orderdate").alias("wave")).agg((F.count("*") * 100.0).alias("reference")).filter("wave < 2001")
    return rounded(Q.check_published(t.person, "wave", F.sum("wt"), ref, 0.02), 2, "ours")


@query("qc_06_plausible", """WITH @person, s AS (SELECT dist, quantile_cont(value / wt, 0.5) AS m, avg((disc <= 1.05 * tax)::INT) AS s FROM person GROUP BY dist)
SELECT 'plausible' AS section, 'median ' || dist AS name, round(m, 4) AS ours, 1500.0::DOUBLE AS reference, CASE WHEN m BETWEEN 100 AND 1500 THEN 'ok' ELSE 'warn' END AS result FROM s UNION ALL SELECT 'plausible', 'part ' || dist, round(s, 4), 0.95, CASE WHEN s >= 0.95 THEN 'ok' ELSE 'warn' END FROM s""")
def _(t):
    return rounded(Q.check_plausible(t.person.withColumn("price", C("value") / C("wt")), "dist", "price", 100, 1500, C("disc"), C("tax")), 4, "ours")


@query("qc_07_grid", "WITH @panel, s AS (SELECT count(*) AS n, count(DISTINCT sector) * count(DISTINCT wave) AS g, count(*) FILTER (z NOT BETWEEN 0 AND 0.05) AS b FROM panel)\n" + CHECK.format("grid", "'complete', 'range z'", "n, b", "g, 0", "CASE WHEN n = g THEN 'ok' ELSE 'FAIL' END, CASE WHEN b = 0 THEN 'ok' ELSE 'FAIL' END", "s"))
def _(t):
    return Q.check_grid(t.panel, "sector", "wave", {"z": (0.0, 0.05)})


@query("qc_07_gaps", """WITH @person, s AS (SELECT custkey, wave FROM person GROUP BY 1, 2) SELECT a.custkey, y AS wave FROM (SELECT custkey, min(wave) AS a, max(wave) AS b FROM s GROUP BY custkey) a, range(1990, 2010) t(y) WHERE y BETWEEN a AND b AND NOT EXISTS (SELECT 1 FROM s WHERE s.custkey = a.custkey AND s.wave = y)""")
def _(t):
    return Q.period_gaps(t.person.select("custkey", "wave"), "custkey", "wave")


@query("qc_08_rank_agreement", """WITH @panel, k AS (SELECT wave, (rank() OVER (PARTITION BY wave ORDER BY y) + (count(*) OVER (PARTITION BY wave, y) - 1) / 2.0) AS a, (rank() OVER (PARTITION BY wave ORDER BY x) + (count(*) OVER (PARTITION BY wave, x) - 1) / 2.0) AS b FROM panel), c AS (SELECT min(q) AS low FROM (SELECT corr(a, b) AS q FROM k GROUP BY wave))
SELECT 'rank agreement' AS section, 'y x' AS name, round(low, 6) AS ours, 0.5::DOUBLE AS reference, CASE WHEN low > 0.5 THEN 'ok' ELSE 'warn' END AS result FROM c""")
def _(t):
    return rounded(Q.check_rank_agreement(t.panel, "y", "x", "wave"), 6, "ours")


@query("qc_09_censoring", """WITH @person SELECT wave, round(avg((tax <= 0.01)::INT), 8) AS share_dark, round(avg(disc) FILTER (tax <= 0.01), 8) AS mean_dark, round(avg(disc) FILTER (tax > 0.01), 8) AS mean_lit FROM person GROUP BY wave""")
def _(t):
    return rounded(Q.check_censoring(t.person, "tax", "disc", "wave", 0.01), 8, "share_dark", "mean_dark", "mean_lit")


@query("qc_10_panel", "WITH @panel, s AS (SELECT avg((sector > 0)::INT) AS hit FROM panel)\n" + CHECK.format("panel", "'finite', 'null', 'sign', 'joined'", "0, 0, 0, round(hit, 8)", "0, 0, 0, 0.95", "'ok', 'ok', 'ok', CASE WHEN hit > 0.95 THEN 'ok' ELSE 'FAIL' END", "s"))
def _(t):
    df = t.panel.withColumn("usable", C("n") >= 80).withColumn("rate", F.when(C("n") >= 80, C("y") / C("n"))).withColumn("other", F.when(C("sector") > 0, 1))
    return rounded(Q.check_panel(df, "rate", "usable", "other"), 8, "ours")


@query("qc_11_second_route", "WITH @person, s AS (SELECT count(*) FILTER ((CASE WHEN size < 10 THEN 'low' ELSE 'high' END) IS DISTINCT FROM (CASE WHEN size >= 11 THEN 'high' WHEN size <= 10 THEN 'low' END)) AS bad FROM person)\n" + CHECK.format("second route", "'size'", "bad", "0", "CASE WHEN bad = 0 THEN 'ok' ELSE 'FAIL' END", "s"))
def _(t):
    return Q.check_second_route(t.person, {"size": (F.when(C("size") < 10, "low").otherwise("high"), F.when(C("size") >= 11, "high").when(C("size") <= 10, "low"))})


def catalogue(t):
    """Value labels by wave of two variables: priority (1998 lacks a code) and a brand number whose texts change in 2000."""
    from .q_recode import value_labels

    one = value_labels(t).select(F.lit("priority").alias("variable"), "wave", "code", "text")
    two = t.person.select(F.lit("brand").alias("variable"), "wave", F.substring("brand", 7, 1).cast("int").alias("code"), F.concat(F.when(C("wave") >= 2000, "zone ").otherwise("kind "), F.substring("brand", 7, 1)).alias("text")).distinct()
    return one.unionAll(two)


def seen(t):
    return V.observed(t.person.select("wave", F.substring("priority", 1, 1).cast("int").alias("priority"), F.substring("brand", 7, 1).cast("int").alias("brand")), "wave", ["priority", "brand"])


@query("ver_01_observed", """WITH @person, l AS (SELECT wave, 'size' AS variable, size::DOUBLE AS v FROM person WHERE size NOT IN (98, 99) UNION ALL SELECT wave, 'pid', pid FROM person) SELECT variable, wave, min(v) AS low, max(v) AS high, count(DISTINCT v)::BIGINT AS n_codes FROM l GROUP BY 1, 2""")
def _(t):
    df = V.observed(t.person, "wave", ["size", "pid"])
    return df.select("variable", "wave", "low", "high", F.size("codes").cast("long").alias("n_codes"))


@query("ver_02_compatible_pairs", """WITH @person, w AS (SELECT DISTINCT wave FROM person), p AS (SELECT a.wave AS wave_a, b.wave AS wave_b FROM w a, w b WHERE a.wave < b.wave) SELECT 'brand' AS variable, wave_a, wave_b, NOT (wave_b >= 2000 AND wave_a < 2000) AS compatible FROM p UNION ALL SELECT 'priority', wave_a, wave_b, true FROM p""")
def _(t):
    return V.compatible_pairs(catalogue(t), seen(t)).select("variable", "wave_a", "wave_b", "compatible")


def decisions(t):
    names = catalogue(t).select("variable", "wave").distinct().withColumn("label", F.when(C("variable") == "priority", "order priority").otherwise("brand number"))
    pairs = V.compatible_pairs(catalogue(t), seen(t)).join(V.similar_pairs(names, 0.25), ["variable", "wave_a", "wave_b"])
    return V.version_groups(pairs, list(range(1990, 2010)))


@query("ver_03_version_groups", """WITH @person, w AS (SELECT DISTINCT wave FROM person) SELECT 'brand' AS variable, wave, CASE WHEN wave >= 2000 THEN 'brand_v2' ELSE 'brand' END AS pooled_column FROM w UNION ALL SELECT 'priority', wave, 'priority' FROM w""")
def _(t):
    return decisions(t)


@query("ver_04_merge_labels", """WITH @person, l AS (SELECT DISTINCT wave, substr(brand, 7, 1)::INTEGER AS code FROM person) SELECT CASE WHEN wave >= 2000 THEN 'brand_v2' ELSE 'brand' END AS pooled_column, code, CASE WHEN wave >= 2000 THEN 'zone ' ELSE 'kind ' END || code AS text, 1::BIGINT AS n_texts FROM l GROUP BY 1, 2, 3
UNION SELECT 'priority', substr(o_orderpriority, 1, 1)::INTEGER, substr(o_orderpriority, 3), 1 FROM orders""")
def _(t):
    return V.merge_labels(catalogue(t), decisions(t))


@query("ver_05_pool_versions", """WITH @person, d AS (SELECT DISTINCT wave, hhid, pid, brand FROM person WHERE wave IN (1998, 2000)) SELECT wave, count(*)::BIGINT AS n, count(CASE WHEN wave = 1998 THEN 1 END)::BIGINT AS n_brand, count(CASE WHEN wave = 2000 THEN 1 END)::BIGINT AS n_v2 FROM d GROUP BY wave""")
def _(t):
    frame = lambda w: t.person.filter(C("wave") == w).select("wave", "hhid", "pid", "brand")
    df = V.pool_versions({1998: frame(1998), 2000: frame(2000)}, [("brand", 2000, "brand_v2")], ["wave", "hhid", "pid"])
    return df.groupBy("wave").agg(F.count("*").alias("n"), F.count("brand").alias("n_brand"), F.count("brand_v2").alias("n_v2"))


@query("ver_06_pool_modules", """WITH @person, d AS (SELECT DISTINCT wave, hhid, pid, cls FROM person WHERE wave IN (1996, 1998)) SELECT wave, cls, count(*)::BIGINT AS n FROM d GROUP BY 1, 2""")
def _(t):
    frame = lambda w: t.person.filter(C("wave") == w).select("wave", "hhid", "pid", "cls")
    return V.pool_modules({(1996, "pers"): frame(1996), (1998, "person"): frame(1998), (1998, "alone"): frame(1998)}, {"pers": "person"}, ["wave", "hhid", "pid"])["person"].groupBy("wave", "cls").agg(F.count("*").alias("n"))


@query("ver_07_classify_level", """WITH k AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS p FROM lineitem GROUP BY 1), s AS (SELECT sum(n)::BIGINT AS n, count(*)::BIGINT AS households, sum(p) AS persons FROM k) SELECT n, households, CASE WHEN n = households THEN 'household' WHEN n = persons THEN 'person' WHEN persons > 0 THEN 'multi' ELSE 'other' END AS level FROM s""")
def _(t):
    return V.classify_level(t["lineitem"], "l_orderkey", "l_linenumber")


@query("ver_08_audit", """WITH @person, w AS (SELECT DISTINCT wave FROM person) SELECT 'brand' AS variable, a.wave AS wave_a, b.wave AS wave_b FROM w a, w b WHERE a.wave < 2000 AND b.wave >= 2000""")
def _(t):
    forced = catalogue(t).select("variable", "wave").distinct().withColumn("pooled_column", C("variable"))  # all waves in one column: what must not be pooled is found
    return V.audit_versions(catalogue(t), seen(t), forced).unionAll(V.audit_versions(catalogue(t), seen(t), decisions(t))).select("variable", "wave_a", "wave_b")


RULES = [
    H.Rule("labour", (1995, 1996, 1997), "marital", ("pid",), codes={1: [1, 2], 2: [3], 3: [4, 5]}),
    H.Rule("labour", (1998, 1999, 2000), "marital", ("pid",), codes={1: [1], 2: [2, 3], 3: [4, 5, 6, 7]}, quality="approximate", note="two codes joined"),
    H.Rule("labour", (1995, 1996, 1997, 1998, 1999, 2000), "educ", ("size",), kind="override", codes={1: list(range(1, 20)), 2: list(range(20, 45))}, when="cls = 'R' AND size > 40", to=3),
    H.Rule("labour", (1996, 1998), "status", ("f1", "f2"), kind="flag", yes=(1, 2)),
    H.Rule("census", (1996, 1998, 2000), "marital", ("pid",), codes={1: [1], 2: [2], 3: [3, 4, 5, 6, 7]}),
    H.Rule("census", (2000,), "status", ("f1",), kind="flag", yes=(1,)),
    H.Rule("living", (1997, 1999), "educ", ("size",), kind="override", codes={1: list(range(1, 26)), 2: list(range(26, 51))}, when="f2 = 1", to=3),
    H.Rule("living", (1997, 1999), "status", ("f1", "f2", "pid"), kind="flag", yes=(3,)),
    H.Rule("farm", (1996, 2000), "marital", ("pid",), codes={1: [1, 2, 3], 2: [4, 5, 6, 7]}),
    H.Rule("farm", (1996, 2000), "status", ("f2",), kind="flag", yes=(2,)),
    H.Rule("food", (1995, 1999), "age", ("size",), kind="range", codes={"low": 15, "high": 49}),
    H.Rule("food", (1995, 1999), "marital", ("pid",), codes={1: [1], 2: [2, 3, 4, 5, 6, 7]}),
]
_F = "f AS (SELECT *, CASE WHEN size < 48 THEN size % 3 END AS f1, CASE WHEN size > 2 THEN pid % 3 END AS f2 FROM person)"


def survey(t):
    return t.person.withColumns({"f1": F.when(C("size") < 48, C("size") % 3), "f2": F.when(C("size") > 2, C("pid") % 3)})


def counted(t, dataset, *concepts):
    df = survey(t).drop("age") if dataset == "food" else survey(t)
    return H.harmonise(df, RULES, dataset).groupBy("wave", *concepts).agg(F.count("*").alias("n"))


_OLD = "CASE WHEN pid <= 2 THEN 1 WHEN pid = 3 THEN 2 WHEN pid <= 5 THEN 3 END"
_NEW = "CASE WHEN pid = 1 THEN 1 WHEN pid <= 3 THEN 2 WHEN pid <= 7 THEN 3 END"


@query("har_01_labour", f"""WITH @person, {_F} SELECT wave, CASE WHEN wave IN (1995, 1996, 1997) THEN {_OLD} WHEN wave IN (1998, 1999, 2000) THEN {_NEW} END AS marital,
 CASE WHEN wave BETWEEN 1995 AND 2000 THEN CASE WHEN cls = 'R' AND size > 40 THEN 3 WHEN size < 20 THEN 1 WHEN size < 45 THEN 2 END END AS educ,
 CASE WHEN wave IN (1996, 1998) AND (f1 IS NOT NULL OR f2 IS NOT NULL) THEN (coalesce(f1 IN (1, 2), false) OR coalesce(f2 IN (1, 2), false))::INT END AS status, count(*)::BIGINT AS n FROM f GROUP BY 1, 2, 3, 4""")
def _(t):
    return counted(t, "labour", "marital", "educ", "status")


@query("har_02_census", f"""WITH @person, {_F} SELECT wave, CASE WHEN wave IN (1996, 1998, 2000) THEN CASE WHEN pid = 1 THEN 1 WHEN pid = 2 THEN 2 ELSE 3 END END AS marital, CASE WHEN wave = 2000 THEN (f1 = 1)::INT END AS status, count(*)::BIGINT AS n FROM f GROUP BY 1, 2, 3""")
def _(t):
    return counted(t, "census", "marital", "status")


@query("har_03_living", f"""WITH @person, {_F} SELECT wave, CASE WHEN wave IN (1997, 1999) THEN CASE WHEN f2 = 1 THEN 3 WHEN size < 26 THEN 1 ELSE 2 END END AS educ, CASE WHEN wave IN (1997, 1999) THEN (pid = 3)::INT END AS status, count(*)::BIGINT AS n FROM f GROUP BY 1, 2, 3""")
def _(t):
    return counted(t, "living", "educ", "status")


@query("har_04_farm", f"""WITH @person, {_F} SELECT wave, CASE WHEN wave IN (1996, 2000) THEN CASE WHEN pid <= 3 THEN 1 ELSE 2 END END AS marital, CASE WHEN wave IN (1996, 2000) THEN (f2 = 2)::INT END AS status, count(*)::BIGINT AS n FROM f GROUP BY 1, 2, 3""")
def _(t):
    return counted(t, "farm", "marital", "status")


@query("har_05_food", f"""WITH @person, {_F} SELECT wave, CASE WHEN wave IN (1995, 1999) AND size BETWEEN 15 AND 49 THEN size END AS age, CASE WHEN wave IN (1995, 1999) THEN CASE WHEN pid = 1 THEN 1 ELSE 2 END END AS marital, count(*)::BIGINT AS n FROM f GROUP BY 1, 2, 3""")
def _(t):
    return counted(t, "food", "age", "marital")


@query("har_06_all", f"""WITH @person, {_F}, u AS (SELECT 'labour' AS dataset, wave, CASE WHEN wave IN (1995, 1996, 1997) THEN {_OLD} WHEN wave IN (1998, 1999, 2000) THEN {_NEW} END AS marital FROM f UNION ALL SELECT 'farm', wave, CASE WHEN wave IN (1996, 2000) THEN CASE WHEN pid <= 3 THEN 1 ELSE 2 END END FROM f)
SELECT dataset, wave, marital, count(*)::BIGINT AS n FROM u GROUP BY 1, 2, 3""")
def _(t):
    df = H.harmonise_all({"labour": survey(t), "farm": survey(t)}, RULES, {"key": F.concat_ws("_", "wave", "hhid")})
    return df.groupBy("dataset", "wave", "marital").agg(F.count("*").alias("n"))


@query("har_07_employment_ratio", f"""WITH @person, {_F} SELECT wave, round(sum(CASE WHEN f1 IN (1, 2) THEN wt WHEN f1 IS NOT NULL THEN 0 END) / sum(wt) FILTER (f1 IS NOT NULL), 8) AS ratio, round(sum(wt) FILTER (f1 IS NOT NULL), 4) AS people FROM f GROUP BY wave""")
def _(t):
    df = H.employment_ratio(survey(t), ["wave"], "f1", (1, 2), "wt")
    return df.select("wave", r("ratio", 8).alias("ratio"), r("people", 4).alias("people"))
