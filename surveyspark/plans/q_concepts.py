"""Queries of the harmonised concepts: rules of the library on native items derived from persons, with their own recodes in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.operators import concepts as K

from .base import query

# Native items of each dataset with their number of codes; each takes values from 0 on, missing in one row of 13.
ITEMS = {
    "labour": "a02 16, a05 9, b02a 8, b06 4, status1 5, d05 9, indd03 24, indd01 12",
    "census": "p02 16, p26 11, p29 8, p06 9, p16 20, p17 70, p18a 6, p30a 9, p20 5, p32 40, p21 10, rp2024 10, p23 9, p49 9, p24 1000, rp27 24, p47a 24, p22 1000, rp25 12, p48a 12",
    "living": "s1q2 16, s1q4 10, s2aq2 4, s4aq1 4, s2aq3 100, s2cq3 50, s4aq2 50, s2aq4 12, s2bq23 12, s2cq4 12, s4aq3 17, s2cq1 4, s2dq1 4, s2dq3 4, s4bq3 4, s4bq4 4, s4bq5 4, s4bq6 4, econstatus 7, lfs6 5, "
    "s6aq2 4, s6aq3 3, s6aq4 3, s6aq5 3, s6aq6 4, s6aq7 3, s6aq8 3, s6aq9 9, s4bq14 8, workstats 8, s6bq7 10, mainisic 100, isicgroup 100, isic 24, s6bq4 24, occupation_group 12, isco 12, s6bq3 12",
    "farm": "s1q2 16, s1q3 9, s1q4 15, s1q7 10, s1q8 14, s4aq1 4, s4aq2 9, s4aq3 17, s4bq4 4, s4bq6 4, s6aq2 3, s6aq4 3, s6aq5 3, s6aq6 3, s6aq7 3, s6aq8 3, s6aq9 3, s6bq7 10",
    "food": "s12 4, q102 4, s1_01_3 4, s13 130, q103 130, s1_01_4 130, s14 10, q104 4, s1_01_7 4, s15 11, q105 9, s1_01_8 10, s16a 8, q107 7, s1_01_10 8, s124a 10, q102_03 5, s13_02_3 4, s12_01_4 4, s125aa 10, q102_04 9, s13_02_4 10, s12_01_5 10",
}
WAVES = {"labour": (2017, 2019, 2020, 2023, 2024, 2025), "census": (2002, 2012, 2022), "living": (1, 2, 3, 4, 5, 7), "farm": (2017, 2020, 2024), "food": (2006, 2009, 2012, 2015, 2018, 2021, 2024)}


def items(dataset: str) -> dict[str, str]:
    """SQL of each item, the same in both engines."""
    out = {}
    for i, pair in enumerate(ITEMS[dataset].split(", ")):
        name, n = pair.split()
        out[name] = f"CASE WHEN (hhid + 5 * pid + {i}) % 13 <> 0 THEN (hhid * {2 * i + 1} + pid * {i + 3} + size * {i + 1} + hhid % {i + 7}) % {n} END"
    return out


def wave_sql(dataset: str) -> str:
    waves = WAVES[dataset]
    return f"CASE hhid % {len(waves)} {' '.join(f'WHEN {i} THEN {w}' for i, w in enumerate(waves))} END"


def source(dataset: str) -> str:
    return f"WITH @person, f AS (SELECT hhid, pid, wt, {wave_sql(dataset)} AS wave, {', '.join(f'{sql} AS {name}' for name, sql in items(dataset).items())} FROM person)"


def natives(t, dataset: str):
    return t.person.select("hhid", "pid", "wt", F.expr(wave_sql(dataset)).alias("wave"), *[F.expr(sql).alias(name) for name, sql in items(dataset).items()])


def tall(df, names: list[str]):
    """(wave, concept, value, n)."""
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("concept"), F.col(c).alias("value")) for c in names]))
    return df.groupBy("wave", *names).agg(F.count("*").alias("m")).select("wave", "m", rows).groupBy("wave", "concept", "value").agg(F.sum("m").alias("n"))


def tall_sql(names: list[str]) -> str:
    return f"SELECT wave, unnest([{', '.join(repr(c) for c in names)}]) AS concept, unnest([{', '.join(names)}]) AS value FROM h) SELECT wave, concept, value::INTEGER AS value, count(*)::BIGINT AS n FROM u GROUP BY ALL"


def concepts_query(name: str, dataset: str, cases: dict[str, str], rules: str | None = None):
    """Register one dataset's concepts; ``cases`` is the SQL of each, where later ones may name earlier ones."""
    names, steps, before = list(cases), [], "f"
    for i, (c, sql) in enumerate(cases.items()):
        steps.append(f"g{i} AS (SELECT *, {sql} AS {c} FROM {before})")
        before = f"g{i}"
    sql = f"{source(dataset)}, {', '.join(steps)}, h AS (SELECT * FROM {before}), u AS ({tall_sql(names)}"

    @query(name, sql)
    def _(t):
        return tall(K.add_concepts(natives(t, dataset), rules or dataset), names)


_LIST14 = "CASE WHEN {0} IN (1, 2) THEN {0} WHEN {0} IN (3, 4) THEN 3 WHEN {0} BETWEEN 5 AND 11 THEN 4 WHEN {0} BETWEEN 12 AND 14 THEN 5 END"
_UNION = "CASE WHEN {0} = 6 THEN 1 WHEN {0} IN (1, 2, 3) THEN 2 WHEN {0} IN (4, 5) THEN 3 WHEN {0} = 7 THEN 4 END"
_WORKED = "CASE status WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 END"

concepts_query("har_01_labour_concepts", "labour", {
    "relation": f"CASE WHEN wave >= 2024 THEN {_LIST14.format('a02')} WHEN a02 IN (1, 2) THEN a02 WHEN a02 IN (3, 4) THEN 3 WHEN a02 >= 5 AND a02 < 10 THEN 4 WHEN a02 IN (10, 11) THEN 5 END",
    "marital": _UNION.format("a05"),
    "educ": "CASE WHEN b02a IN (1, 2) THEN 0 WHEN b02a = 3 THEN 1 WHEN b02a IN (4, 5) THEN 2 WHEN b02a = 6 THEN 3 END",
    "attend": "CASE WHEN b02a = 1 THEN 0 WHEN b02a > 1 AND b02a < 7 THEN 1 END",
    "literacy": "CASE b06 WHEN 1 THEN 1 WHEN 2 THEN 0 END",
    "status": "CASE WHEN status1 BETWEEN 1 AND 3 THEN status1 END",
    "definition": "CASE WHEN status > 0 THEN 1 END",
    "employed": _WORKED,
    "empstat": "CASE WHEN d05 = 1 THEN 1 WHEN d05 = 2 THEN CASE WHEN wave < 2025 THEN 1 END WHEN d05 = 3 THEN 2 WHEN d05 = 4 THEN 3 WHEN d05 = 5 THEN 5 WHEN d05 = 6 THEN 4 WHEN d05 = 7 THEN CASE WHEN wave < 2025 THEN 5 END END",
    "industry": "CASE WHEN indd03 BETWEEN 1 AND 21 THEN indd03 END",
    "industry_approx": "CASE WHEN industry > 0 THEN 0 END",
    "occupation": "CASE WHEN indd01 BETWEEN 1 AND 9 THEN indd01 END",
    "occupation_approx": "CASE WHEN occupation > 0 THEN 0 END",
})

_OLD_DIVISION = """CASE WHEN p24 // 10 IN (1, 2, 5) THEN 1 WHEN p24 // 10 BETWEEN 10 AND 14 THEN 2 WHEN p24 // 10 BETWEEN 15 AND 37 THEN 3 WHEN p24 // 10 = 40 THEN 4 WHEN p24 // 10 IN (41, 90) THEN 5 WHEN p24 // 10 = 45 THEN 6
 WHEN p24 // 10 BETWEEN 50 AND 52 THEN 7 WHEN p24 // 10 = 55 THEN 9 WHEN p24 // 10 BETWEEN 60 AND 63 THEN 8 WHEN p24 // 10 IN (64, 72) THEN 10 WHEN p24 // 10 BETWEEN 65 AND 67 THEN 11 WHEN p24 // 10 = 70 THEN 12
 WHEN p24 // 10 IN (73, 74) THEN 13 WHEN p24 // 10 = 71 THEN 14 WHEN p24 // 10 = 75 THEN 15 WHEN p24 // 10 = 80 THEN 16 WHEN p24 // 10 = 85 THEN 17 WHEN p24 // 10 = 92 THEN 18 WHEN p24 // 10 IN (91, 93) THEN 19
 WHEN p24 // 10 = 95 THEN 20 WHEN p24 // 10 = 99 AND p24 <> 999 THEN 21 END"""
concepts_query("har_02_census_concepts", "census", {
    "relation": f"CASE WHEN wave = 2022 THEN {_LIST14.format('p02')} WHEN p02 IN (1, 2) THEN p02 WHEN p02 IN (3, 4) THEN 3 WHEN p02 BETWEEN 5 AND 8 THEN 4 WHEN p02 = 9 THEN 5 END",
    "marital": f"CASE wave WHEN 2002 THEN CASE WHEN p26 = 1 THEN 1 WHEN p26 BETWEEN 2 AND 7 THEN 2 WHEN p26 = 8 THEN 3 WHEN p26 = 9 THEN 4 END WHEN 2012 THEN CASE p29 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 5 THEN 3 WHEN 4 THEN 4 END ELSE {_UNION.format('p06')} END",
    "attend": "CASE wave WHEN 2002 THEN CASE p16 WHEN 1 THEN 1 WHEN 2 THEN 0 END WHEN 2012 THEN CASE p17 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 END ELSE CASE p29 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 0 END END",
    "educ": """CASE wave WHEN 2002 THEN CASE WHEN p16 = 2 THEN 0 WHEN p17 BETWEEN 10 AND 19 THEN 1 WHEN p17 BETWEEN 20 AND 59 THEN 2 WHEN p17 BETWEEN 60 AND 69 THEN 3 END
      WHEN 2012 THEN CASE WHEN p17 = 1 OR p18a = 0 THEN 0 WHEN p18a = 1 THEN 1 WHEN p18a IN (2, 3) THEN 2 WHEN p18a = 4 THEN 3 END
      ELSE CASE WHEN p29 = 3 OR p30a IN (1, 2) THEN 0 WHEN p30a = 3 THEN 1 WHEN p30a IN (4, 5, 6) THEN 2 WHEN p30a = 7 THEN 3 END END""",
    "literacy": "CASE wave WHEN 2002 THEN CASE WHEN p20 = 1 THEN 1 WHEN p20 IN (2, 3) THEN 0 END WHEN 2012 THEN CASE WHEN p16 = 0 THEN 0 WHEN p16 < 16 THEN 1 END ELSE CASE WHEN p32 = 0 THEN 0 WHEN p32 < 32 THEN 1 END END",
    "status": """CASE wave WHEN 2002 THEN CASE WHEN p21 = 1 THEN 1 WHEN p21 IN (2, 3, 8) THEN 2 WHEN p21 BETWEEN 4 AND 7 THEN 3 END
      WHEN 2012 THEN CASE WHEN rp2024 = 9 THEN CASE p23 WHEN 1 THEN 2 WHEN 2 THEN 3 END WHEN rp2024 = 1 THEN 1 WHEN rp2024 IN (2, 3) THEN 2 WHEN rp2024 BETWEEN 4 AND 7 THEN 3 END END""",
    "definition": "CASE WHEN status IS NOT NULL THEN CASE wave WHEN 2002 THEN 2 ELSE 3 END END",
    "employed": _WORKED,
    "empstat": """CASE wave WHEN 2002 THEN CASE p23 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 4 WHEN 7 THEN 5 END WHEN 2012 THEN CASE WHEN p26 BETWEEN 1 AND 4 THEN p26 WHEN p26 IN (5, 6) THEN 5 END
      ELSE CASE p49 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 5 WHEN 6 THEN 4 WHEN 7 THEN 5 END END""",
    "industry": f"CASE wave WHEN 2002 THEN {_OLD_DIVISION} WHEN 2012 THEN CASE WHEN rp27 BETWEEN 1 AND 21 THEN rp27 END ELSE CASE WHEN p47a BETWEEN 1 AND 21 THEN p47a END END",
    "industry_approx": "CASE WHEN industry IS NOT NULL THEN (wave = 2002)::INTEGER END",
    "occupation": "CASE wave WHEN 2002 THEN CASE WHEN p22 = 101 THEN 0 WHEN p22 BETWEEN 111 AND 998 THEN p22 // 100 END WHEN 2012 THEN CASE WHEN rp25 BETWEEN 1 AND 9 THEN rp25 END ELSE CASE WHEN p48a BETWEEN 1 AND 9 THEN p48a END END",
    "occupation_approx": "CASE WHEN occupation IS NOT NULL THEN (wave = 2002)::INTEGER END",
})

_GROUP = """CASE WHEN {0} BETWEEN 11 AND 14 THEN 1 WHEN {0} IN (21, 22) THEN 2 WHEN {0} BETWEEN 31 AND 38 THEN 3 WHEN {0} = 41 THEN 4 WHEN {0} BETWEEN 51 AND 53 THEN 6 WHEN {0} IN (61, 62, 63, 65) THEN 7 WHEN {0} = 64 THEN 9 WHEN {0} IN (71, 72) THEN 8
 WHEN {0} = 73 THEN 10 WHEN {0} IN (81, 82) THEN 11 WHEN {0} = 83 THEN 12 WHEN {0} = 84 THEN 13 WHEN {0} = 91 THEN 15 WHEN {0} = 92 THEN 18 WHEN {0} = 93 THEN 20 END"""
_READS = "CASE WHEN {0} = 1 AND {1} = 1 THEN 1 WHEN {0} = 2 OR {1} = 2 THEN 0 END"
_CLASS = "CASE WHEN {0} = 1 THEN 0 WHEN {0} BETWEEN 10 AND 19 THEN 1 WHEN {0} BETWEEN 20 AND 39 THEN 2 WHEN {0} BETWEEN 40 AND 49 THEN 3 END"
_LEVEL = "CASE WHEN s4aq1 = 2 THEN 0 WHEN s4aq3 BETWEEN 11 AND 15 THEN 3 WHEN s4aq2 IN (1, 2) THEN 0 WHEN s4aq2 = 3 THEN 1 WHEN s4aq2 IN (4, 5, 6) THEN 2 WHEN s4aq2 = 7 THEN 3 END"
_SEVEN = "CASE WHEN 1 IN (s6aq2, s6aq4, s6aq5, s6aq6, s6aq7, s6aq8, s6aq9) THEN 1 WHEN s6aq2 = 2 AND s6aq4 = 2 AND s6aq5 = 2 AND s6aq6 = 2 AND s6aq7 = 2 AND s6aq8 = 2 AND s6aq9 = 2 THEN 3 END"
_JOB = "CASE s6bq7 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 5 WHEN 6 THEN 4 WHEN 7 THEN 5 WHEN 8 THEN 5 END"
concepts_query("har_03_living_concepts", "living", {
    "relation": f"""CASE WHEN wave = 7 THEN {_LIST14.format('s1q2')} WHEN s1q2 IN (1, 2, 3) THEN s1q2 WHEN wave = 1 THEN CASE WHEN s1q2 BETWEEN 4 AND 6 THEN 4 WHEN s1q2 IN (7, 8) THEN 5 END WHEN s1q2 = 4 THEN 3
      WHEN wave = 2 THEN CASE WHEN s1q2 BETWEEN 5 AND 8 THEN 4 WHEN s1q2 = 9 THEN 5 END WHEN s1q2 BETWEEN 5 AND 10 THEN 4 WHEN s1q2 IN (11, 12) THEN 5 END""",
    "marital": f"""CASE WHEN wave IN (3, 7) THEN {_UNION.format('s1q4')} WHEN wave = 1 THEN CASE WHEN s1q4 = 5 THEN 1 WHEN s1q4 IN (1, 2, 8, 9) THEN 2 WHEN s1q4 IN (3, 4) THEN 3 WHEN s1q4 = 6 THEN 4 END
      WHEN wave = 2 THEN CASE WHEN s1q4 = 5 THEN 1 WHEN s1q4 IN (1, 2, 3, 7) THEN 2 WHEN s1q4 = 4 THEN 3 WHEN s1q4 = 6 THEN 4 END ELSE CASE WHEN s1q4 = 7 THEN 1 WHEN s1q4 BETWEEN 1 AND 4 THEN 2 WHEN s1q4 IN (5, 6) THEN 3 WHEN s1q4 = 8 THEN 4 END END""",
    "attend": "CASE CASE WHEN wave <= 3 THEN s2aq2 ELSE s4aq1 END WHEN 1 THEN 1 WHEN 2 THEN 0 END",
    "educ": f"""CASE WHEN wave = 7 THEN {_LEVEL} WHEN CASE WHEN wave <= 3 THEN s2aq2 ELSE s4aq1 END = 2 THEN 0 WHEN CASE wave WHEN 1 THEN s2aq4 WHEN 2 THEN s2bq23 WHEN 3 THEN s2cq4 ELSE s4aq3 END BETWEEN 6 AND 10 THEN 3
      WHEN wave = 1 AND s2aq3 = 99 THEN 0 WHEN wave <= 2 THEN {_CLASS.format('s2aq3')} WHEN wave = 3 THEN {_CLASS.format('s2cq3')} ELSE {_CLASS.format('s4aq2')} END""",
    "literacy": f"CASE WHEN wave <= 2 THEN {_READS.format('s2cq1', 's2cq3')} WHEN wave = 3 THEN {_READS.format('s2dq1', 's2dq3')} WHEN wave = 4 THEN {_READS.format('s4bq3', 's4bq4')} WHEN wave = 5 THEN {_READS.format('s4bq4', 's4bq5')} ELSE {_READS.format('s4bq4', 's4bq6')} END",
    "status": f"""CASE WHEN wave <= 2 THEN CASE WHEN econstatus IN (1, 2, 3) THEN econstatus WHEN econstatus = 5 THEN 3 END WHEN wave = 4 THEN CASE WHEN lfs6 IN (1, 2, 3) THEN lfs6 END WHEN wave = 7 THEN {_SEVEN}
      WHEN 1 IN (s6aq2, s6aq3, s6aq4, s6aq5, s6aq6) THEN 1 WHEN wave = 5 THEN CASE WHEN s6aq9 = 1 THEN 2 WHEN s6aq9 BETWEEN 2 AND 7 THEN 3 END WHEN s6aq2 = 2 AND s6aq3 = 2 AND s6aq4 = 2 AND s6aq5 = 2 AND s6aq6 IN (2, 3) THEN 3 END""",
    "definition": "CASE WHEN status IS NOT NULL THEN CASE wave WHEN 4 THEN 6 WHEN 7 THEN 7 WHEN 3 THEN 5 WHEN 5 THEN 5 ELSE 4 END END",
    "employed": _WORKED,
    "empstat": f"CASE wave WHEN 1 THEN CASE WHEN s4bq14 BETWEEN 1 AND 5 THEN s4bq14 END WHEN 2 THEN CASE WHEN workstats IN (1, 4) THEN 1 WHEN workstats IN (2, 5) THEN 3 WHEN workstats IN (3, 6) THEN 4 END WHEN 7 THEN {_JOB} END",
    "industry": f"CASE wave WHEN 1 THEN {_GROUP.format('mainisic')} WHEN 2 THEN {_GROUP.format('isicgroup')} WHEN 4 THEN CASE WHEN isic BETWEEN 1 AND 21 THEN isic END WHEN 7 THEN CASE WHEN s6bq4 BETWEEN 1 AND 21 THEN s6bq4 END END",
    "industry_approx": "CASE WHEN industry IS NOT NULL THEN (wave <= 2)::INTEGER END",
    "occupation": "CASE WHEN wave <= 2 THEN CASE WHEN occupation_group = 1 THEN 2 WHEN occupation_group = 2 THEN 1 WHEN occupation_group = 3 THEN 4 WHEN occupation_group IN (4, 5) THEN 5 WHEN occupation_group BETWEEN 6 AND 9 THEN occupation_group END WHEN wave = 4 THEN CASE WHEN isco BETWEEN 1 AND 9 THEN isco END WHEN wave = 7 THEN CASE WHEN s6bq3 BETWEEN 1 AND 9 THEN s6bq3 END END",
    "occupation_approx": "CASE WHEN occupation IS NOT NULL THEN (wave <= 2)::INTEGER END",
})

concepts_query("har_04_farm_concepts", "farm", {
    "relation": f"CASE wave WHEN 2017 THEN CASE WHEN s1q3 IN (1, 2, 3) THEN s1q3 WHEN s1q3 IN (4, 5) THEN 4 WHEN s1q3 IN (6, 7) THEN 5 END WHEN 2020 THEN CASE WHEN s1q4 IN (1, 2) THEN s1q4 WHEN s1q4 IN (3, 4) THEN 3 WHEN s1q4 IN (11, 13) THEN 5 WHEN s1q4 BETWEEN 5 AND 12 THEN 4 END ELSE {_LIST14.format('s1q2')} END",
    "marital": f"CASE WHEN wave = 2024 THEN {_UNION.format('s1q4')} END",
    "educ": f"CASE wave WHEN 2017 THEN CASE WHEN s1q7 = 4 THEN 0 WHEN s1q7 IN (1, 2, 3) THEN s1q7 END WHEN 2020 THEN CASE WHEN s1q7 = 8 THEN 0 WHEN s1q7 IN (1, 2) THEN 1 WHEN s1q7 IN (3, 4, 5) THEN 2 WHEN s1q7 IN (6, 7) THEN 3 END ELSE {_LEVEL} END",
    "attend": "CASE wave WHEN 2017 THEN CASE WHEN s1q7 = 4 THEN 0 WHEN s1q7 BETWEEN 1 AND 3 THEN 1 END WHEN 2020 THEN CASE WHEN s1q7 = 8 THEN 0 WHEN s1q7 BETWEEN 1 AND 7 THEN 1 END ELSE CASE s4aq1 WHEN 1 THEN 1 WHEN 2 THEN 0 END END",
    "literacy": f"CASE WHEN wave = 2024 THEN {_READS.format('s4bq4', 's4bq6')} END",
    "status": f"CASE wave WHEN 2017 THEN CASE WHEN s1q8 = 4 THEN 3 WHEN s1q8 BETWEEN 1 AND 6 THEN 1 END WHEN 2020 THEN CASE WHEN s1q8 BETWEEN 1 AND 9 THEN 1 WHEN s1q8 BETWEEN 10 AND 12 THEN 3 END ELSE {_SEVEN} END",
    "definition": "CASE WHEN status IS NOT NULL THEN CASE wave WHEN 2024 THEN 7 ELSE 8 END END",
    "employed": _WORKED,
    "empstat": f"CASE wave WHEN 2020 THEN CASE WHEN s1q8 IN (1, 5, 6, 7) THEN 3 WHEN s1q8 IN (2, 4, 8, 9) THEN 1 WHEN s1q8 = 3 THEN 4 END WHEN 2024 THEN {_JOB} END",
})

_LATE = "wave IN (2015, 2018, 2021, 2024)"
concepts_query("har_05_food_head_concepts", "food", {
    "head_sex": f"CASE WHEN CASE WHEN wave = 2006 THEN s12 WHEN wave = 2012 THEN q102 WHEN {_LATE} THEN s1_01_3 END IN (1, 2) THEN CASE WHEN wave = 2006 THEN s12 WHEN wave = 2012 THEN q102 ELSE s1_01_3 END END",
    "head_age": f"CASE WHEN CASE WHEN wave = 2006 THEN s13 WHEN wave = 2012 THEN q103 WHEN {_LATE} THEN s1_01_4 END BETWEEN 10 AND 120 THEN CASE WHEN wave = 2006 THEN s13 WHEN wave = 2012 THEN q103 ELSE s1_01_4 END END",
    "head_literacy": f"CASE WHEN wave = 2006 THEN CASE s14 WHEN 1 THEN 1 WHEN 0 THEN 0 END ELSE CASE CASE WHEN wave = 2012 THEN q104 WHEN {_LATE} THEN s1_01_7 END WHEN 1 THEN 1 WHEN 0 THEN 0 WHEN 2 THEN 0 END END",
    "head_educ": f"""CASE WHEN wave = 2006 THEN CASE WHEN s15 = 1 THEN 0 WHEN s15 IN (2, 3) THEN 1 WHEN s15 BETWEEN 4 AND 7 THEN 2 WHEN s15 IN (8, 9) THEN 3 END WHEN wave = 2012 THEN CASE WHEN q105 = 1 THEN 0 WHEN q105 IN (2, 3) THEN 1 WHEN q105 BETWEEN 4 AND 6 THEN 2 WHEN q105 = 7 THEN 3 END
      WHEN {_LATE} THEN CASE WHEN s1_01_8 = 1 THEN 0 WHEN s1_01_8 IN (2, 3) THEN 1 WHEN s1_01_8 BETWEEN 4 AND 6 THEN 2 WHEN s1_01_8 IN (7, 8) THEN 3 END END""",
    "head_marital": f"CASE WHEN wave = 2012 THEN CASE WHEN q107 = 5 THEN 1 WHEN q107 IN (1, 2) THEN 2 WHEN q107 IN (3, 4) THEN q107 END ELSE CASE WHEN wave = 2006 THEN CASE WHEN s16a = 6 THEN 1 WHEN s16a IN (1, 2) THEN 2 WHEN s16a IN (3, 4) THEN 3 WHEN s16a = 5 THEN 4 END WHEN {_LATE} THEN CASE WHEN s1_01_10 = 6 THEN 1 WHEN s1_01_10 IN (1, 2) THEN 2 WHEN s1_01_10 IN (3, 4) THEN 3 WHEN s1_01_10 = 5 THEN 4 END END END",
}, "food_head")

concepts_query("har_05_food_woman_concepts", "food", {
    "literacy": "CASE wave WHEN 2006 THEN CASE s124a WHEN 1 THEN 1 WHEN 0 THEN 0 END WHEN 2012 THEN CASE WHEN q102_03 = 3 THEN 1 WHEN q102_03 < 3 THEN 0 END WHEN 2015 THEN CASE s13_02_3 WHEN 1 THEN 1 WHEN 0 THEN 0 WHEN 2 THEN 0 END WHEN 2024 THEN CASE s12_01_4 WHEN 1 THEN 1 WHEN 0 THEN 0 WHEN 2 THEN 0 END END",
    "educ": """CASE wave WHEN 2006 THEN CASE WHEN s125aa IN (1, 2) THEN s125aa - 1 WHEN s125aa BETWEEN 3 AND 6 THEN 2 WHEN s125aa IN (7, 8) THEN 3 END WHEN 2012 THEN CASE WHEN q102_04 = 1 THEN 0 WHEN q102_04 IN (2, 3) THEN 1 WHEN q102_04 BETWEEN 4 AND 6 THEN 2 WHEN q102_04 = 7 THEN 3 END
      WHEN 2015 THEN CASE WHEN s13_02_4 = 1 THEN 0 WHEN s13_02_4 IN (2, 3) THEN 1 WHEN s13_02_4 BETWEEN 4 AND 6 THEN 2 WHEN s13_02_4 IN (7, 8) THEN 3 END WHEN 2024 THEN CASE WHEN s12_01_5 = 1 THEN 0 WHEN s12_01_5 IN (2, 3) THEN 1 WHEN s12_01_5 BETWEEN 4 AND 6 THEN 2 WHEN s12_01_5 IN (7, 8) THEN 3 END END""",
}, "food_woman")


_AV = "CASE WHEN wave = 2012 THEN CASE WHEN rp2024 = 9 THEN CASE p23 WHEN 1 THEN 2 WHEN 2 THEN 3 END WHEN rp2024 IN (1, 2) THEN rp2024 WHEN rp2024 = 3 THEN 2 WHEN rp2024 BETWEEN 4 AND 7 THEN 3 END END"
_HEADS = "CASE WHEN wave = 2022 AND p02 = 1 OR wave < 2022 AND p02 = 1 THEN 1 END"


@query("har_08_second_route", f"""{source("census")}, s AS (SELECT wave, {_AV} AS status, CASE WHEN wave = 2022 THEN {_UNION.format("p06")} END AS marital, {_HEADS} AS head FROM f),
 l AS (SELECT wave, unnest(['status by availability', 'marital of the last list', 'head']) AS "check", unnest([count(status), count(marital), count(head)]) AS n FROM s GROUP BY wave)
 SELECT wave, "check", n::BIGINT AS n_known, n::BIGINT AS n_equal, 0::BIGINT AS n_extra FROM l""")
def _(t):
    df = K.add_concepts(natives(t, "census"), "census")
    code = F.col("rp2024")
    status = F.when(code == 9, F.element_at(F.create_map(F.lit(1), F.lit(2), F.lit(2), F.lit(3)), F.col("p23").cast("int"))).otherwise(F.element_at(F.create_map(*[F.lit(x) for pair in ((1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (6, 3), (7, 3)) for x in pair]), code.cast("int")))
    marital = F.element_at(F.create_map(*[F.lit(x) for pair in ((6, 1), (1, 2), (2, 2), (3, 2), (4, 3), (5, 3), (7, 4)) for x in pair]), F.col("p06").cast("int"))
    at = lambda w, c: F.when(F.col("wave") == w, c)
    checks = {
        "status by availability": (at(2012, F.col("status")), at(2012, status)),
        "marital of the last list": (at(2022, F.col("marital")), at(2022, marital)),
        "head": (F.when(F.col("relation") == 1, 1), F.when(F.col("p02") == 1, 1)),
    }
    return K.second_route(df, checks, ["wave"])
