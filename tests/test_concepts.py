"""Concept rules on rows whose answers are known."""

from __future__ import annotations

from graphlib import CycleError

import pytest
from pyspark.sql import functions as F

from surveyspark.operators import concepts as K
from surveyspark.operators.concept_rules import DATASETS


def one(spark, dataset, wave, **items):
    df = spark.createDataFrame([(wave, *items.values())], "wave int, " + ", ".join(f"{n} {'string' if isinstance(v, str) else 'double'}" for n, v in items.items()))
    return K.add_concepts(df, dataset).first()


def test_tables_compile(spark):
    for name, table in DATASETS.items():
        rules = K.read_rules(table)
        items = sorted({s for r in rules for s in r.needs} - {r.concept for r in rules})
        df = spark.createDataFrame([(2020, *[1] * len(items))], "wave int, " + ", ".join(f"{i} int" for i in items))
        assert K.add_concepts(df, name).columns == [*df.columns, *dict.fromkeys(r.concept for r in rules)]
        quality = {r.quality for r in K.concept_map(spark, name, df.columns).collect()}
        assert quality <= {"exact", "approximate", "missing"} and K.concept_map(spark, name, []).filter("quality <> 'missing'").count() == 0


def test_residual_code_goes_by_availability(spark):
    for rp, av, status in ((9.0, 1.0, 2), (9.0, 2.0, 3), (9.0, None, None), (1.0, 1.0, 1), (8.0, 1.0, None), (None, 1.0, None)):
        row = one(spark, "census", 2012, rp2024=rp, p23=av)
        assert (row.status, row.definition, row.employed) == (status, 3 if status else None, None if status is None else int(status == 1))
    assert one(spark, "census", 2002, rp2024=9.0, p23=1.0).status is None


def test_diploma_over_class_and_never_over_both(spark):
    for never, cls, diploma, educ in ((1.0, 12.0, None, 1), (1.0, 12.0, 7.0, 3), (2.0, 12.0, 7.0, 0), (1.0, 90.0, None, None), (1.0, 45.0, 2.0, 3), (None, 99.0, None, 0)):
        assert one(spark, "living", 1, s2aq2=never, s2aq3=cls, s2aq4=diploma).educ == educ
    assert one(spark, "living", 2, s2aq2=1.0, s2aq3=99.0, s2bq23=1.0).educ is None


def test_literacy_and_status_from_several_items(spark):
    for r, w, literacy in ((1.0, 1.0, 1), (1.0, 2.0, 0), (None, 2.0, 0), (1.0, None, None), (3.0, 1.0, None)):
        assert one(spark, "living", 3, s2dq1=r, s2dq3=w).literacy == literacy
    work = lambda *v: one(spark, "living", 3, **{f"s6aq{i + 2}": x for i, x in enumerate(v)})
    assert work(2.0, 2.0, 2.0, 2.0, 3.0).status == 3 and work(3.0, 2.0, 2.0, 2.0, 2.0).status is None
    assert work(2.0, None, 2.0, 1.0, 2.0).employed == 1 and work(2.0, None, 2.0, 2.0, 2.0).status is None
    five = lambda w, why: one(spark, "living", 5, s6aq2=w, s6aq9=why).status
    assert [five(1.0, 1.0), five(2.0, 1.0), five(2.0, 4.0), five(2.0, None), five(None, 9.0)] == [1, 2, 3, None, None]


def test_codes_as_text_and_by_carrier(spark):
    row = one(spark, "labour", 2020, a02="05", status1=" 2 ", indd03="x", b06="1.5", d05="7.0")
    assert (row.relation, row.status, row.industry, row.literacy, row.empstat) == (4, 2, None, None, 5)
    df = spark.createDataFrame([(2023, 3, 10), (2024, 3, 10)], "wave int, a02 int, a02_v2 int")
    found = K.add_concepts(df, "labour", carriers={("a02", 2024): "a02_v2"}).orderBy("wave").collect()
    assert [r.relation for r in found] == [3, 4] and [r.a02_v2 for r in found] == [10, 10]


def test_what_cannot_be_compiled(spark):
    df = spark.createDataFrame([(1, 2, 3)], "wave int, x int, a int")
    with pytest.raises(ValueError):
        K.add_concepts(df, K.read_rules("1 | a | codes | x | 1=1 | exact |"))
    with pytest.raises(ValueError):
        K.read_rules("1 | a | guess | x | 1=1 | exact |")
    with pytest.raises(CycleError):
        K.add_concepts(df, K.read_rules("1 | b | known | c | 1 | exact |\n1 | c | known | b | 1 | exact |"))
    assert K.add_concepts(df, K.read_rules("1 | b | codes | gone | 1=1 | exact |")).first().b is None
    assert K.add_concepts(df.limit(0), "farm").count() == 0


def test_second_route(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (1, 5, None), (2, None, 4)], "wave int, ours int, theirs int")
    assert [tuple(r) for r in K.second_route(df, {"same": (F.col("ours"), F.col("theirs"))}, ["wave"]).orderBy("wave").collect()] == [(1, "same", 2, 1, 1), (2, "same", 1, 0, 0)]
