"""Operators that need their input several times run what makes it once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from surveyspark.operators import econ as E
from surveyspark.operators import sensor as N
from surveyspark.plans import pipelines as P

CASES = {
    "fit": lambda df: E.fe_ols(df, "y", ["x"], ["u", "t"], "u"),
    "blocks": lambda df: E.twfe(df, "y", ["x"], "u", "t", "u", block="d"),
    "weights": lambda df: E.overlap_report(E.overlap_weights(df, ["x", "z"], "on", group="t"), ["x", "z"], "on"),
    "selection": lambda df: E.pds_lasso(df, "y", "x", ["z", "t"], "d", "u"),
    "gaps": lambda df: P.gap_by_waves(df, ["y", "z"], "u", "t", F.col("on") == 1, 0, [1, 2], "u"),
    "districts": lambda df: P.district_models(df, "d", "t", (F.col("y"), F.col("z")), ["x"], ["z"], {"one": (["x"], []), "two": (["x"], ["d", "t"])}),
    "outcomes": lambda df: P.outcome_regressions(df, {"a": F.col("y"), "b": F.col("x")}, "z", "n", "u", "d", "t", 0),
    "forest": lambda df: P.forest_event_study(df, "y", "u", "t", F.col("on") == 1, ["x", "z"], 0, 1, [0, 1, 2]),
    "map": lambda df: N.quantile_map(df, "x", "z", 5),
}


@pytest.mark.parametrize("name", CASES)
def test_read_once(spark, name):
    rnd = random.Random(3)
    rows = [(u, t, u % 2, int(u % 3 == 0), rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.random() + 1, rnd.random() + 1) for u in range(12) for t in range(3)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.createDataFrame(rows, "u int, t int, d int, on int, y double, x double, z double, n double")
    assert CASES[name](df.mapInPandas(count, df.schema)).collect()
    assert seen.value == len(rows)
