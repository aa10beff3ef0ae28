"""Copies are dropped in tasks of a bounded number of rows, apart from what makes the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.operators import align as V
from surveyspark.operators import sets as S
from surveyspark.sources import scratch


def counting(df):
    """``df`` and how many of its rows were made so far."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(count, df.schema), seen


def test_exact_duplicates_are_made_once_and_dealt(spark, monkeypatch):
    monkeypatch.setattr(scratch, "DEALT", 10, raising=False)
    df, seen = counting(spark.createDataFrame([(i % 40, i % 2, None if i % 3 else "a", 0.5) for i in range(240)], "id int, wave int, name string, wt double"))
    kept, report = S.drop_exact_duplicates(df, "wave", "wt")
    assert kept.rdd.getNumPartitions() == 24 and kept.count() == 80
    assert {tuple(r) for r in report.collect()} == {(0, 80, 40.0), (1, 80, 40.0)} and seen.value == 240


def test_pooled_versions_are_made_once_and_dealt(spark, monkeypatch):
    monkeypatch.setattr(scratch, "DEALT", 10, raising=False)
    frame = lambda w, kind: spark.createDataFrame([(w, i % 50, str(i % 7) if kind == "string" else i % 7) for i in range(100)], f"wave int, hhid int, v {kind}").withColumn("gap", F.lit(None))
    (a, seen_a), (b, seen_b) = (counting(f.drop("gap")) for f in (frame(1, "string"), frame(2, "int")))
    out = V.pool_versions({1: a.withColumn("gap", F.lit(None)), 2: b}, [("v", 2, "v_v2")], ["wave", "hhid"])
    assert out.rdd.getNumPartitions() == 20 and out.columns == ["wave", "hhid", "v", "gap", "v_v2"]
    assert {(r.wave, r.hhid, r.v, r.v_v2) for r in out.collect()} == {(1, i % 50, str(i % 7), None) for i in range(100)} | {(2, i % 50, None, i % 7) for i in range(100)}
    assert (seen_a.value, seen_b.value) == (100, 100)
