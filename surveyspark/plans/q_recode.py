"""Queries of projections, recodes, features and texts."""

from pyspark.sql import functions as F

from surveyspark.functions import recode as R
from surveyspark.functions import text as X

from .base import query

C = F.col
CLASS = {1: ["A", "N"], 2: ["R"]}


@query("prj_02_destring", """
SELECT count(*)::BIGINT AS n, sum(TRY_CAST(trim(split_part(brand, '#', 2)) AS DOUBLE)) AS total, count(*) FILTER (type IS NOT NULL)::BIGINT AS n_text
FROM (SELECT p_brand AS brand, p_type AS type FROM part)""")
def _(t):
    df = R.destring(t["part"].select(F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand"), C("p_type").alias("type")))
    return df.agg(F.count("*").alias("n"), F.sum("brand").alias("total"), F.count("type").alias("n_text"))


@query("prj_03_compress", """WITH @person SELECT wave::SMALLINT AS wave, max(age)::TINYINT AS age, sum(wt) AS wt FROM person GROUP BY wave""")
def _(t):
    return R.compress(t.person.select("hhid", "pid", "wt", "age", "wave", "disc"), keep_double=("wt",)).groupBy("wave").agg(F.max("age").alias("age"), F.sum("wt").alias("wt"))


@query("prj_05_recode", """WITH @person SELECT wave, target, count(*)::BIGINT AS n FROM (SELECT wave, CASE WHEN cls IN ('A', 'N') THEN 1 WHEN cls = 'R' THEN 2 END AS target FROM person) GROUP BY wave, target""")
def _(t):
    return t.person.select("wave", R.recode(C("cls"), CLASS).alias("target")).groupBy("wave", "target").agg(F.count("*").alias("n"))


@query("prj_06_split_id", """WITH @person SELECT hhid // 1000 AS a, (hhid // 10) % 100 AS b, hhid % 10 AS c, count(*)::BIGINT AS n, min(dist * 100 + sector + 1)::BIGINT AS code FROM person GROUP BY 1, 2, 3""")
def _(t):
    a, b, c = R.split_id(C("hhid"), 1000, 10)
    return t.person.groupBy(a.alias("a"), b.alias("b"), c.alias("c")).agg(F.count("*").alias("n"), F.min(R.rebase(C("sector"), C("dist"))).cast("long").alias("code"))


@query("prj_07_make_key", """WITH @person SELECT CASE WHEN pid > 2 AND sector > 0 THEN concat_ws('_', wave, sector, hhid, pid) END AS key, count(*)::BIGINT AS n FROM person GROUP BY 1""")
def _(t):
    key = R.make_key([C("wave"), C("sector"), C("hhid").cast("double").cast("long"), C("pid")], blank_if=(C("sector") <= 0) | (C("pid") <= 2))
    return t.person.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("prj_08_share", """WITH @person SELECT sector, round(avg(CASE WHEN size >= 48 THEN NULL WHEN size IN (1, 2, 3, 4, 5) THEN 1.0 ELSE 0.0 END), 8) AS share FROM person GROUP BY sector""")
def _(t):
    return t.person.groupBy("sector").agg(F.round(F.avg(R.share(C("size"), [1, 2, 3, 4, 5], na=[48, 49, 50])), 8).alias("share"))


@query("prj_09_crosswalk_wave", """WITH @person SELECT wave, sum(CASE wave WHEN 1996 THEN (CASE WHEN cls = 'R' THEN 1 ELSE 0 END) WHEN 1998 THEN (CASE WHEN sex = 'F' THEN 1 ELSE 0 END)
 WHEN 2000 THEN (CASE WHEN size IN (1, 2) THEN 1 ELSE 0 END) END)::DOUBLE AS yes FROM person GROUP BY wave""")
def _(t):
    flag = R.by_wave(C("wave"), {1996: R.share(C("cls"), ["R"]), 1998: R.share(C("sex"), ["F"]), 2000: R.share(C("size"), [1, 2])})
    return t.person.groupBy("wave").agg(F.sum(flag).alias("yes"))


@query("prj_10_any_of", """WITH @person SELECT sector, sum(CASE WHEN d IS NULL AND x IS NULL THEN NULL WHEN coalesce(d > 0.05, false) OR coalesce(x > 0.04, false) THEN 1 ELSE 0 END)::BIGINT AS owns
FROM (SELECT sector, nullif(disc, 0) AS d, nullif(tax, 0) AS x FROM person) GROUP BY sector""")
def _(t):
    d, x = F.nullif(C("disc"), F.lit(0.0)), F.nullif(C("tax"), F.lit(0.0))
    return t.person.groupBy("sector").agg(F.sum(R.any_of([d > 0.05, x > 0.04])).alias("owns"))


@query("prj_11_any_yes_all_no", """WITH @person SELECT wave, count(*) FILTER (pid = 1 OR size = 1)::BIGINT AS n_any, count(*) FILTER (pid = 2 AND size = 2 AND sex = 'F')::BIGINT AS n_none FROM person GROUP BY wave""")
def _(t):
    return t.person.groupBy("wave").agg(F.count_if(R.any_yes([C("pid"), C("size")])).alias("n_any"), F.count_if(R.all_no([C("pid"), C("size")], extra=[C("sex") == "F"])).alias("n_none"))


@query("prj_12_schooling_years", """WITH @person SELECT sex, round(avg(CASE pid WHEN 1 THEN 0 + least(size, 6) WHEN 2 THEN 6 + least(size, 3) WHEN 3 THEN 9 + least(size, 3) ELSE 12 + least(size, 4) END), 8) AS years FROM person WHERE pid <= 4 GROUP BY sex""")
def _(t):
    years = R.schooling_years(C("pid"), C("size"), {1: 0, 2: 6, 3: 9, 4: 12}, {1: 6, 2: 3, 3: 3, 4: 4})
    return t.person.filter("pid <= 4").groupBy("sex").agg(F.round(F.avg(years), 8).alias("years"))


_CODES = "(SELECT DISTINCT p_brand AS code, CASE WHEN substr(p_brand, 7, 1) <= '2' THEN 'low' WHEN substr(p_brand, 7, 1) <= '4' THEN 'high' END AS target, substr(p_brand, 8, 1) = '5' AS approximate FROM part)"


@query("prj_13_crosswalk_code", f"""WITH @person SELECT target AS section, approximate AS section_approx, count(*)::BIGINT AS n FROM person LEFT JOIN {_CODES} ON code = brand AND target IS NOT NULL GROUP BY 1, 2""")
def _(t):
    first, second = F.substring("p_brand", 7, 1), F.substring("p_brand", 8, 1)
    table = t["part"].select(C("p_brand").alias("code"), F.when(first <= "2", "low").when(first <= "4", "high").alias("target"), (second == "5").alias("approximate")).distinct().filter("target IS NOT NULL")
    return R.crosswalk(t.person, "brand", table, "section").groupBy("section", "section_approx").agg(F.count("*").alias("n"))


@query("prj_14_classify_industry", """WITH @person SELECT wave, industry, round(sum(wt), 4) AS workers FROM (SELECT wave, wt, CASE WHEN wave <= 1996 THEN (CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN 'industry' ELSE 'services' END)
 ELSE (CASE WHEN size <= 10 THEN 'farm' WHEN size <= 30 THEN 'industry' WHEN brand LIKE '%#1%' THEN 'tourism' ELSE 'services' END) END AS industry FROM person) GROUP BY wave, industry""")
def _(t):
    old = F.when(C("segment").isin("BUILDING", "MACHINERY"), "industry").otherwise("services")
    new = R.band(C("size"), [-1, 10, 30], ["farm", "industry"])
    new = F.coalesce(new, F.when(C("brand").contains("#1"), "tourism").otherwise("services"))
    return t.person.groupBy("wave", F.when(C("wave") <= 1996, old).otherwise(new).alias("industry")).agg(F.round(F.sum("wt"), 4).alias("workers"))


@query("prj_15_coalesce_waves", """WITH @person SELECT wave, round(sum(coalesce(CASE WHEN wave <= 1997 THEN disc END, CASE WHEN wave > 1997 THEN nullif(tax, 0) END)), 6) AS total FROM person GROUP BY wave""")
def _(t):
    item = F.coalesce(F.when(C("wave") <= 1997, C("disc")), F.when(C("wave") > 1997, F.nullif(C("tax"), F.lit(0.0))))
    return t.person.groupBy("wave").agg(F.round(F.sum(item), 6).alias("total"))


@query("prj_16_guarded_ratio", """WITH @panel SELECT sector, wave, CASE WHEN n >= 80 THEN round(y / n, 8) END AS rate, n >= 80 AS usable FROM panel""")
def _(t):
    rate, usable = R.guarded_ratio(C("y"), C("n"), 80)
    return t.panel.select("sector", "wave", F.round(rate, 8).alias("rate"), usable.alias("usable"))


@query("prj_17_core_map", """WITH @person SELECT wave, round(sum(CASE WHEN wave < 1997 THEN wt / 10000 WHEN wave < 1999 THEN value ELSE disc * wt / 100 END), 4) AS area FROM person GROUP BY wave""")
def _(t):
    area = F.when(C("wave") < 1997, C("wt") / 10000).when(C("wave") < 1999, C("value")).otherwise(C("disc") * C("wt") / 100)
    return t.person.groupBy("wave").agg(F.round(F.sum(area), 4).alias("area"))


_CPI = "(VALUES (1995, 80.0), (1996, 90.0), (1997, 100.0), (1998, 110.0), (1999, 125.0)) cpi(year, price)"


@query("prj_18_bracket_deflate", f"""WITH @person SELECT wave, round(sum(least(CASE pid WHEN 1 THEN 500 WHEN 2 THEN 1500 WHEN 3 THEN 4000 WHEN 4 THEN 9000 END, 7500)::DOUBLE * 100.0 / price), 4) AS income
FROM person LEFT JOIN {_CPI} ON year = least(wave, 1999) WHERE pid <= 4 GROUP BY wave""")
def _(t):
    cpi = t.spark.createDataFrame([(1995, 80.0), (1996, 90.0), (1997, 100.0), (1998, 110.0), (1999, 125.0)], "year int, price double")
    rows = t.person.filter("pid <= 4").withColumn("income", R.bracket_mid(C("pid"), {1: 500, 2: 1500, 3: 4000, 4: 9000}, 7500).cast("double"))
    return R.deflate(rows, "income", "wave", cpi, 1997, "real").groupBy("wave").agg(F.round(F.sum("real"), 4).alias("income"))


@query("prj_19_band", """WITH @person SELECT CASE WHEN age > 0 AND age <= 14 THEN '0-14' WHEN age > 14 AND age <= 30 THEN '15-30' WHEN age > 30 AND age <= 60 THEN '31-60' END AS age_band,
 CASE WHEN wt >= 1 AND wt < 25 THEN 'low' WHEN wt >= 25 AND wt < 50 THEN 'high' END AS wt_band, count(*)::BIGINT AS n FROM person GROUP BY 1, 2""")
def _(t):
    return t.person.groupBy(R.band(C("age"), [0, 14, 30, 60], ["0-14", "15-30", "31-60"]).alias("age_band"), R.band(C("wt"), [1, 25, 50], ["low", "high"], right=False).alias("wt_band")).agg(F.count("*").alias("n"))


@query("prj_20_design", """WITH @person SELECT wave, sum((cls = 'A')::INT * (sex = 'F')::INT)::DOUBLE AS af, sum((cls = 'R')::INT)::DOUBLE AS cls_R, sum((cls = 'A')::INT)::DOUBLE AS cls_A FROM person GROUP BY wave""")
def _(t):
    df = t.person.select("wave", "sex", *R.one_hot("cls", ["A", "N", "R"], omit="N"), F.lit(1.0).alias("same"))
    df = R.drop_constant(df, ["cls_A", "cls_R", "same"])
    return df.groupBy("wave").agg(F.sum(C("cls_A") * (C("sex") == "F").cast("double")).alias("af"), *[F.sum(c).alias(c) for c in df.columns if c.startswith("cls_")])


@query("prj_21_expand_candidates", """WITH @panel, l AS (SELECT sector, wave, unnest([y * y * n, y * x * n, y * z * n, x * x * n, x * z * n, z * z * n]) AS term, generate_subscripts([1, 2, 3, 4, 5, 6], 1) - 1 AS i FROM panel) SELECT sector, wave, i::INTEGER AS i, round(term, 2) AS term FROM l""")
def _(t):
    return t.panel.select("sector", "wave", F.posexplode(R.expand_candidates(["y", "x", "z"], by="n")).alias("i", "term")).withColumn("term", F.round("term", 2))


@query("prj_22_zscore", """WITH @panel SELECT sector, wave, round((y - m) / s, 6) AS y_z, round((y - mb) / sb, 6) AS y_base FROM panel,
 (SELECT avg(y) AS m, stddev_samp(y) AS s, avg(y) FILTER (wave = 1995 AND dist <> 1) AS mb, stddev_samp(y) FILTER (wave = 1995 AND dist <> 1) AS sb FROM panel)""")
def _(t):
    all_rows = R.zscore(t.panel, ["y"]).withColumnRenamed("y_z", "z_all")
    both = R.zscore(all_rows, ["y"], where=(C("wave") == 1995) & (C("dist") != 1))
    return both.select("sector", "wave", F.round("z_all", 6).alias("y_z"), F.round("y_z", 6).alias("y_base"))


@query("prj_23_asinh", """WITH @panel SELECT sector, wave, round(asinh(greatest(y - 3, 0)), 8) AS a, round(ln(1 + n), 8) AS l FROM panel""")
def _(t):
    return t.panel.select("sector", "wave", F.round(R.asinh_pos(C("y") - 3), 8).alias("a"), F.round(F.log1p("n"), 8).alias("l"))


@query("prj_24_exposure", """WITH @person SELECT age, round(least(greatest(age - 10, 0), 12) / 12.0, 8) AS exposure, count(*)::BIGINT AS n FROM person GROUP BY 1, 2""")
def _(t):
    return t.person.groupBy("age", F.round(R.exposure(C("age"), 10, 12), 8).alias("exposure")).agg(F.count("*").alias("n"))


@query("prj_25_interact", """WITH @panel SELECT concat_ws('_', dist, wave) AS fe, sum(CASE WHEN sector < 8 AND wave = 1998 THEN 1.0 ELSE 0.0 END)::DOUBLE AS t_1998, sum(CASE WHEN sector < 8 AND wave = 1999 THEN 1.0 ELSE 0.0 END)::DOUBLE AS t_1999 FROM panel GROUP BY 1""")
def _(t):
    df = t.panel.select(R.fe_key("dist", "wave").alias("fe"), *R.interact(C("sector") < 8, C("wave"), [1998, 1999], "t"))
    return df.groupBy("fe").agg(F.sum("t_1998").alias("t_1998"), F.sum("t_1999").alias("t_1999"))


_PT = "(SELECT c_custkey AS k, (c_custkey * 7 % 1000) / 500.0 - 1.0 AS lat, 29.0 + (c_custkey % 1000) / 500.0 AS lon FROM customer)"


@query("prj_26_haversine", f"""SELECT k, round(a, 6) AS km_a, round(least(a, b), 6) AS km, CASE WHEN a <= b THEN 'a' ELSE 'b' END AS gate FROM (SELECT k,
 2 * 6371.0 * asin(sqrt(pow(sin((radians(0.5) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(0.5)) * pow(sin(radians(30.0 - lon) / 2), 2))) AS a,
 2 * 6371.0 * asin(sqrt(pow(sin((radians(-0.5) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(-0.5)) * pow(sin(radians(29.2 - lon) / 2), 2))) AS b FROM {_PT})""")
def _(t):
    p = t["customer"].select(C("c_custkey").alias("k"), (C("c_custkey") * 7 % 1000 / 500.0 - 1.0).alias("lat"), (29.0 + C("c_custkey") % 1000 / 500.0).alias("lon"))
    p = p.select("k", R.haversine(C("lat"), C("lon"), F.lit(0.5), F.lit(30.0)).alias("a"), R.haversine(C("lat"), C("lon"), F.lit(-0.5), F.lit(29.2)).alias("b"))
    least, name = R.nearest_of({"a": C("a"), "b": C("b")})
    return p.select("k", F.round("a", 6).alias("km_a"), F.round(least, 6).alias("km"), name.alias("gate"))


@query("prj_27_shift_share", """WITH @panel, s AS (SELECT sector AS unit, cls AS part, sum(wt) / sum(sum(wt)) OVER (PARTITION BY sector) AS share FROM person GROUP BY sector, cls),
g AS (SELECT cls AS part, wave AS period, ln(1 + sum(wt)) * exp(-5.0 / 10) AS shock FROM person GROUP BY cls, wave)
SELECT unit, period, round(sum(share * shock), 6) AS exposure, round(sum(share), 6) AS sum_shares FROM s JOIN g USING (part) GROUP BY unit, period""")
def _(t):
    from surveyspark.operators.agg import share_of

    shares = share_of(t.person.groupBy(C("sector").alias("unit"), C("cls").alias("part")).agg(F.sum("wt").alias("v")), "v", ["unit"])
    shocks = t.person.groupBy(C("cls").alias("part"), C("wave").alias("period")).agg(R.decay(F.sum("wt"), F.lit(5.0)).alias("shock"))
    out = R.shift_share(shares, shocks, "unit", "part", "period")
    return out.select("unit", "period", F.round("exposure", 6).alias("exposure"), F.round("sum_shares", 6).alias("sum_shares"))


@query("prj_28_derive_parent", """WITH @person SELECT parent, filled, count(*)::BIGINT AS n FROM (SELECT coalesce(CASE WHEN pid > 2 THEN dist END, sector // 5) AS parent, pid <= 2 AS filled FROM person) GROUP BY 1, 2""")
def _(t):
    parent, filled = R.derive_parent(C("sector"), F.when(C("pid") > 2, C("dist")), 5)
    return t.person.groupBy(parent.alias("parent"), filled.alias("filled")).agg(F.count("*").alias("n"))


_LABELS = "(SELECT DISTINCT year(o_orderdate)::INTEGER AS w, substr(o_orderpriority, 1, 1)::INTEGER AS code, substr(o_orderpriority, 3) AS text FROM orders WHERE NOT (year(o_orderdate) = 1998 AND o_orderpriority LIKE '5%'))"


def value_labels(t):
    """Wave's labels of the priority code; 1998 lacks code 5."""
    rows = t["orders"].select(F.year("o_orderdate").alias("wave"), F.substring("o_orderpriority", 1, 1).cast("int").alias("code"), F.expr("substring(o_orderpriority, 3)").alias("text"))
    return rows.filter("NOT (wave = 1998 AND code = 5)").distinct()


@query("prj_29_decode", f"""WITH @person SELECT wave, coalesce(text, p::VARCHAR) AS label, count(*)::BIGINT AS n FROM (SELECT wave, substr(priority, 1, 1)::INTEGER AS p FROM person) LEFT JOIN {_LABELS} ON w = wave AND code = p GROUP BY 1, 2""")
def _(t):
    df = R.decode(t.person.select("wave", F.substring("priority", 1, 1).cast("int").alias("p")), "p", value_labels(t), "label", wave="wave")
    return df.groupBy("wave", "label").agg(F.count("*").alias("n"))


@query("prj_31_label_fixes", f"""SELECT 'priority' AS variable, w AS wave, code, CASE WHEN code = 1 AND w BETWEEN 1996 AND 1997 THEN 'top' WHEN code = 5 THEN 'bottom' ELSE text END AS text, coalesce((code = 1 AND w BETWEEN 1996 AND 1997) OR code = 5, false) AS fixed FROM {_LABELS}""")
def _(t):
    fixes = t.spark.createDataFrame([(1, "^prio", 1996, 1997, 1, "top"), (2, "^priority$", 1900, 2100, 5, "bottom"), (3, "^prio", 1900, 2100, 5, "never")], "priority int, pattern string, wave_from int, wave_to int, code int, text string")
    return R.label_fixes(value_labels(t).withColumn("variable", F.lit("priority")), fixes)


@query("prj_01_lower_names", "SELECT n_nationkey::BIGINT AS name, n_name AS name_2, n_regionkey FROM nation")
def _(t):
    return R.lower_names(t["nation"].select(C("n_nationkey").cast("long").alias("Name"), F.lit(None).cast("string").alias("NAME"), C("n_name").alias("name"), C("n_regionkey").alias("N_regionkey")))


@query("prj_04_resolve_types", """WITH @person SELECT 'DOU' AS kind, sum(hhid)::DOUBLE AS total, count(*)::BIGINT AS n FROM (SELECT CAST(hhid AS DOUBLE) AS hhid FROM person UNION ALL SELECT CAST(hhid AS DOUBLE) FROM person)""")
def _(t):
    rows = t.person.select("hhid", "cls")
    a, b = R.resolve_types([rows, rows.withColumn("hhid", C("hhid").cast("string"))])
    both = a.unionByName(b)
    return both.groupBy(F.upper(F.substring(F.typeof("hhid"), 1, 3)).alias("kind")).agg(F.sum("hhid").alias("total"), F.count("*").alias("n"))


@query("prj_30_strip_prefix", """WITH @person SELECT wave, cls, count(*)::BIGINT AS n FROM person GROUP BY wave, cls""")
def _(t):
    df = t.person.select("wave", C("cls").alias("w1996_cls"), C("sex").alias("w1998_sex"))
    return R.strip_wave_prefix(df, "w1996", ["w1996", "w1998"]).groupBy("wave", "cls").agg(F.count("*").alias("n"))


@query("prj_32_stamp", """WITH @person SELECT 'survey' AS survey, 1996 AS year, 'w96' AS wave, wave AS wave_native, count(*)::BIGINT AS n FROM person GROUP BY wave""")
def _(t):
    return R.stamp(t.person.select("wave"), "survey", 1996, "w96").groupBy("survey", "year", "wave", "wave_native").agg(F.count("*").alias("n"))


_KEY = "regexp_replace(lower(regexp_replace(strip_accents(x), '^\\s*\\d+\\s*[-–—.]?\\s*', '')), '[^a-z0-9]', '', 'g')"


@query("str_01_name_key", f"""SELECT key, count(*)::BIGINT AS n FROM (SELECT {_KEY} AS key FROM (SELECT p_brand || ' 12. ' || p_type AS x FROM part UNION ALL SELECT '07 - É' || p_type FROM part)) GROUP BY key""")
def _(t):
    names = t["part"].select(F.concat("p_brand", F.lit(" 12. "), "p_type").alias("x")).unionAll(t["part"].select(F.concat(F.lit("07 - É"), "p_type").alias("x")))
    return names.groupBy(X.name_key(C("x")).alias("key")).agg(F.count("*").alias("n"))


_TOK = "list_distinct([w for w in string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' ') if length(w) > 1 AND w NOT IN ('the', 'a', 'an', 'of', 'in', 'to', 'for', 'is', 'are', 'was', 'were', 'do', 'does', 'did', 'name', 'names', 'you', 'your', 'he', 'she', 'his', 'her', 'and', 'or', 'at', 'on', 'by', 'with')])"


@query("str_02_jaccard", f"""WITH p AS (SELECT p_partkey, {_TOK.format('p_type')} AS a, {_TOK.format("p_name || ' of ' || p_type")} AS b FROM part)
SELECT p_partkey, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE END, 8) AS similarity FROM p""")
def _(t):
    a, b = X.tokens(C("p_type")), X.tokens(F.concat("p_name", F.lit(" of "), "p_type"))
    return t["part"].select("p_partkey", F.round(X.jaccard(a, b), 8).alias("similarity"))


@query("str_03_same_category")
def _(t):
    kinds = t["part"].select("p_type").distinct()
    pairs = kinds.select(C("p_type").alias("a"), F.lower(F.regexp_replace("p_type", "E", "I")).alias("b"))
    return X.same_category(pairs, "a", "b")


@query("str_04_clean_label", """WITH p AS (SELECT DISTINCT p_type, replace(p_type, 'STANDARD', 'usual') AS x FROM part) SELECT 'q12. ' || p_type || ' (total)' AS raw, regexp_replace(upper(substr(x, 1, 1)) || lower(substr(x, 2)), '\\btin\\b', 'TIN', 'gi') AS label FROM p""")
def _(t):
    return t["part"].select(F.concat(F.lit("q12. "), "p_type", F.lit(" (total)")).alias("raw")).distinct().withColumn("label", X.clean_label(C("raw"), {"standard": "usual"}, ("tin",)))


@query("str_05_translate_values", """SELECT p_brand AS variable, row_number() OVER (PARTITION BY p_brand ORDER BY p_type)::INTEGER AS code, CASE WHEN p_type IN (SELECT min(p_type) FROM part) THEN 'x + y' ELSE p_type || ' + y' END AS text, true AS changed
FROM (SELECT DISTINCT p_brand, p_type FROM part)""")
def _(t):
    from pyspark.sql.window import Window

    first = t["part"].agg(F.min("p_type").alias("word")).withColumn("to", F.lit("x"))
    words = first.unionAll(t.spark.createDataFrame([("Zebra", "y")], "word string, to string"))
    labels = t["part"].select("p_brand", "p_type").distinct()
    labels = labels.select(C("p_brand").alias("variable"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_type")).alias("code"), F.concat("p_type", F.lit(" + ZEBRA")).alias("text"))
    return X.translate_values(labels, words)


@query("str_06_apply_names", "SELECT n_nationkey AS sector, n_name AS name, n_regionkey, 'n_regionkey' AS unlisted FROM nation")
def _(t):
    df, unlisted = X.apply_names(t["nation"], {"n_nationkey": "sector", "n_name": "name"})
    return df.withColumn("unlisted", F.lit(",".join(unlisted)))
