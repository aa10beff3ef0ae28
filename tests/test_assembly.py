"""Key discovery and survey assembly on small modules."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from surveyspark.operators import assembly as Y


def test_keys_are_minimal_and_exact(spark):
    rnd = random.Random(1)
    rows = [(h, p, h * 10 + p, None if h == 3 else h * 10 + p, rnd.randint(0, 2), h // 5) for h in range(300) for p in range(1, 4)]
    df = spark.createDataFrame(rows, "hhid int, pid int, serial int, gap int, c int, area int").repartition(4)
    assert Y.discover_keys(df, ["serial", "hhid", "pid", "gap", "gone"]) == [["serial"], ["hhid", "pid"]]
    assert Y.discover_keys(df, ["hhid", "c", "area"]) == [] and Y.discover_keys(df.limit(0), ["hhid"]) == [] and Y.discover_keys(df, []) == []
    almost = df.unionAll(df.filter("hhid = 7 AND pid = 1"))
    assert Y.discover_keys(almost, ["serial", "hhid", "pid"]) == []  # one row twice: the sketch lets it pass, the count does not
    found = {r.column: (r.n_groups, r.n_varying, r.depends) for r in Y.dependencies(df, ["hhid"], ["pid", "area", "gap"]).collect()}
    assert found == {"pid": (300, 300, False), "area": (300, 0, True), "gap": (300, 299, False)}


def modules(spark):
    f = spark.createDataFrame
    return {
        "cover": f([(1, 11, 2.0, "tin"), (2, 12, 1.0, None), (3, 11, 1.5, "clay")], "hhid int, dist int, wt double, roof string"),
        "poverty": f([(1, 0.5, "tin"), (2, 0.7, "clay"), (3, 0.2, "clay")], "hhid int, score double, roof string"),
        "people": f([(1, 1, 40, "m"), (1, 2, 38, "f"), (2, 1, 50, "f"), (3, 1, 30, "m"), (3, 2, 5, "m")], "hhid int, pid int, age int, sex string"),
        "health": f([(1, 1, "well", 40), (1, 2, "ill", 39), (3, 1, "well", 30)], "hhid int, pid int, state string, age int"),
        "old": f([(101, "wood"), (103, "gas")], "hhid int, fuel string"),
        "codes": f([(1, 101), (2, 102), (3, 103)], "hhid int, oldkey int"),
        "items": f([(1, 1, "maize"), (1, 1, "beans"), (2, 1, "maize")], "hhid int, pid int, item string"),
        "village": f([(1, "x")], "village int, name string"),
        "strangers": f([(71, 1), (72, 2)], "hhid int, v int"),
    }


def test_assemble_wave(spark):
    wave = Y.assemble_wave(modules(spark), "hhid", "pid", ["cover", "poverty"], "people", ["dist", "wt"], crosswalk=("codes", "oldkey"), head=(F.col("pid") == 1, ["age", "sex"]))
    level = {m: (lvl, n, key) for m, lvl, n, key, _ in wave.levels}
    assert {m: v[0] for m, v in level.items()} == {"cover": "household", "poverty": "household", "people": "person", "health": "person", "old": "household", "codes": "household", "items": "multi", "village": "other", "strangers": "other"}
    assert level["people"][2] == "hhid+pid" and level["items"][2] is None and wave.report().count() == 9
    homes = {r.hhid: r for r in wave.household.collect()}
    assert [(homes[h].roof, homes[h].fuel, homes[h].hhsize, homes[h].head_age, homes[h].head_sex, homes[h].dist) for h in (1, 2, 3)] == [("tin", "wood", 2, 40, "m", 11), ("clay", None, 1, 50, "f", 12), ("clay", "gas", 2, 30, "m", 11)]
    people = {(r.hhid, r.pid): r for r in wave.person.collect()}
    assert people[1, 2].age == 38 and people[1, 2].age_health == 39 and people[1, 2].state == "ill" and people[3, 2].wt == 1.5 and people[3, 2].state is None
    assert {r["item"]: r.dist for r in wave.modules["items"].collect()} == {"maize": 12, "beans": 11} or wave.modules["items"].filter("dist IS NULL").count() == 0
    assert [r.n_filled for r in wave.joins["poverty"].collect()] == [1] and {r.result for r in Y.check_wave(wave, "hhid", "pid", "wt").collect()} == {"ok"}


def test_a_wave_without_a_roster(spark):
    wave = Y.assemble_wave({k: v for k, v in modules(spark).items() if k in ("cover", "village")}, "hhid", "pid", ["cover"], None, ["dist", "wt"])
    assert wave.person is None and wave.household.count() == 3


def test_checks_find_faults(spark):
    m = modules(spark)
    m["cover"] = m["cover"].withColumn("wt", F.when(F.col("hhid") > 1, F.col("wt")))
    wave = Y.assemble_wave({k: m[k] for k in ("cover", "people")}, "hhid", "pid", ["cover"], "people", ["dist", "wt"])
    assert {r.name: r.ours for r in Y.check_wave(wave, "hhid", "pid", "wt").filter("result = 'FAIL'").collect()} == {"household weights": 1.0, "person weights": 2.0}
