"""The baseline control block on rows whose shares are known."""

from __future__ import annotations

import math

import pytest

from surveyspark.operators import controls as K


def test_the_table(spark):
    controls = K.read_controls()
    assert len(controls) == len({c.name for c in controls}) == 53 and [len(v) for v in K.blocks().values()] == [10, 5, 7, 3, 2, 3, 5, 6, 8, 4]
    assert {c.level for c in controls} == {"household", "person", "terrain", "access", "shape", "climate"}


def test_not_stated_is_no_answer(spark):
    table = """
a | tv | home | share | tv | 1-3 | 9
a | rooms | home | mean | rooms | 0-89 |
a | head | home | flag | sex | 2 |
a | bike | home | above | bikes | 0 | 99
a | sexes | home | ratio | male/female | |
a | seen | home | ratio | absent/male+female | |
a | people | home | log_sum | | |
b | young | home | of | age+rel | 0-17; 1 |
c | far | place | given | km | log |
"""
    rows = [
        (1, 2.0, 1, 3, 2, "0", 1, 2, 1, 16, 1),
        (1, 1.0, 5, 99, None, "4", 2, 2, 0, 40, 1),
        (1, None, 9, 5, 1, "99", 3, 0, None, 5, 3),
        (2, 1.0, 9, None, 1, "x", 1, 0, 0, None, None),
    ]
    df = spark.createDataFrame(rows, "unit int, w double, tv int, rooms int, sex int, bikes string, male int, female int, absent int, age int, rel int")
    place = spark.createDataFrame([(1, math.e**2)], "unit int, km double")
    one, two = K.control_block({"home": df}, "unit", "w", {"place": place}, table).orderBy("unit").collect()
    assert one.tv == pytest.approx(2 / 3) and one.rooms == pytest.approx((2 * 3 + 5) / 3) and one["head"] == pytest.approx(2 / 4) and one.bike == pytest.approx(1 / 3)
    assert one.sexes == pytest.approx((2 + 2 + 3) / (4 + 2)) and one.seen == pytest.approx(2 / (7 + 6)) and one.people == pytest.approx(math.log(4)) and one.young == pytest.approx(2 / 3) and one.far == pytest.approx(2)
    assert (two.tv, two.rooms, two["head"], two.bike, two.sexes, two.young, two.far) == (None, None, 0.0, None, None, None, None)
    with pytest.raises(ValueError):
        K.control_block({"home": df}, "unit", "w", {}, table)
