"""A wave's modules are made once, whatever is asked of the wave."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.operators import assembly as Y


def test_modules_are_made_once(spark):
    f, seen = spark.createDataFrame, {}

    def counted(name, df):
        seen[name] = spark.sparkContext.accumulator(0)

        def count(batches, n=seen[name]):
            for batch in batches:
                n.add(len(batch))
                yield batch

        return df.mapInPandas(count, df.schema)

    people = [(h, p, 10 * h + p, "m" if p == 1 else "f") for h in range(1, 9) for p in range(1, 4)]
    rows = {
        "cover": f([(h, h % 2, 1.0, None if h % 3 else "tin") for h in range(1, 9)], "hhid int, dist int, wt double, roof string"),
        "people": f(people, "hhid int, pid int, age int, sex string"),
        "work": f([(h, p, 100 * h, s + ".") for h, p, _, s in people if p < 3], "hhid int, pid int, job int, sex string"),
        "old": f([(100 + h, "clay" if h % 3 else "tin") for h in range(1, 7)], "hhid int, roof string"),
        "codes": f([(h, 100 + h) for h in range(1, 9)], "hhid int, oldkey int"),
        "plots": f([(h, 1, i) for h in range(1, 9) for i in range(2)], "hhid int, pid int, plot int"),
        "none": f([], "hhid int, pid int, v int"),
    }
    wave = Y.assemble_wave({k: counted(k, df) for k, df in rows.items()}, "hhid", "pid", ["cover"], "people", ["dist", "wt"], crosswalk=("codes", "oldkey"), head=(F.col("pid") == 1, ["age"]))
    assert {r.module: (r.level, r.n, r.key, r.match_rate) for r in wave.report().collect()} == {
        "cover": ("household", 8, "hhid", 1.0), "people": ("person", 24, "hhid+pid", 1.0), "work": ("person", 16, "hhid+pid", 1.0), "old": ("household", 6, "hhid", 1.0),
        "codes": ("household", 8, "hhid", 1.0), "plots": ("multi", 16, None, 1.0), "none": ("other", 0, None, None),
    }
    assert wave.person.columns == ["hhid", "pid", "age", "sex", "dist", "wt", "job", "sex_work"]
    assert {(r.hhid, r.pid): tuple(r)[2:] for r in wave.person.collect()} == {(h, p): (a, s, h % 2, 1.0, 100 * h if p < 3 else None, s + "." if p < 3 else None) for h, p, a, s in people}
    assert {r.hhid: tuple(r)[1:] for r in wave.household.collect()} == {h: (h % 2, 1.0, "tin" if h % 3 == 0 else "clay" if h < 7 else None, 100 + h, 3, 10 * h + 1) for h in range(1, 9)}
    assert set(wave.joins) == {"work", "old", "codes"} and {r.result for r in Y.check_wave(wave, "hhid", "pid", "wt").collect()} == {"ok"}
    assert {k: v.value for k, v in seen.items()} == {k: df.count() for k, df in rows.items()}
