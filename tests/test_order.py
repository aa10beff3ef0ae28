"""Order statistics against sorting, and one large group over many partitions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.operators import agg, order, sensor, window


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, None]), rnd.choice([None, float(rnd.randint(-5, 5)), rnd.gauss(0, 1e6)]), float(rnd.randint(0, 4)), i) for i in range(700)]
    return out + [("alone", 1, None, 1.0, 900), ("one", 1, 7.5, 0.0, 901)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g string, h int, x double, w double, id long").repartition(5)


def groups(rows):
    out = {}
    for g, h, x, w, _ in rows:
        out.setdefault((g, h), [])
        if x is not None:
            out[g, h].append((x, w))
    return out


@pytest.fixture(params=[1, 7])
def parts(spark, request):
    """One range partition, or seven that groups are cut over."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_quantiles_and_moments(df, rows, parts):
    probs = [0.0, 0.01, 0.37, 0.5, 1.0]
    found = {(r.g, r.h): r for r in order.describe(df, ["g", "h"], "x", probs).collect()}
    same = {(r.g, r.h): r.quantiles for r in order.quantiles(df, ["g", "h"], "x", probs).collect()}
    assert set(found) == set(same) == set(groups(rows))
    for key, values in groups(rows).items():
        x = np.array([v for v, _ in values])
        if not len(x):
            assert found[key].mean is None and same[key] == [None] * 5
            continue
        assert found[key].quantiles == pytest.approx(np.quantile(x, probs).tolist()) and same[key] == found[key].quantiles
        assert found[key].mean == pytest.approx(x.mean()) and (found[key].sd is None if len(x) < 2 else found[key].sd == pytest.approx(x.std(ddof=1)))


def test_ranks_and_numbers(df, rows, parts):
    got = {r.id: r for r in agg.average_rank(df, "x", ["g", "h"], "rank").collect()}
    number = {r.id: (r["__r"], r["__n"]) for r in order.row_numbers(df, ["g"], ["x", "id"]).collect()}
    assert len(got) == len(rows) == len(number)
    for g, h, x, _, i in rows:
        values = [v for v, _ in groups(rows)[g, h]]
        assert got[i]["rank"] == (None if x is None else sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2)
        mine = [(r[2] is not None, r[2], r[4]) for r in rows if r[0] == g]
        assert number[i] == (1 + sum(m < (x is not None, x, i) if x is not None or m[0] is False else False for m in mine) if x is not None else 1 + sum(not m[0] and m[2] < i for m in mine), len(mine))


def test_weighted_quantile(df, rows, parts):
    for q in (0.0, 0.5, 0.9, 1.0):
        found = {(r.g, r.h): r.wquantile for r in agg.wquantile(df, ["g", "h"], "x", "w", q).collect()}
        for key, values in groups(rows).items():
            if values:
                up, total = 0.0, sum(w for _, w in values)
                for x in sorted({v for v, _ in values}):
                    up += sum(w for v, w in values if v == x)
                    if up >= q * total:
                        break
                assert found[key] == x


def test_grid(spark, df, rows, parts):
    x = [r[2] for r in rows if r[2] is not None]
    for n in (2, 11, 1001):
        got = [r.value for r in order.quantile_grid(df, "x", n).orderBy("k").collect()]
        assert got == pytest.approx(np.quantile(x, np.linspace(0, 1, n)).tolist())
    assert [r.value for r in order.quantile_grid(df.filter("g = 'one'"), "x", 3).orderBy("k").collect()] == [7.5] * 3
    assert sensor.quantile_map(df.withColumn("y", -F.col("x")), "x", "y", 5).count() == 5


def test_spearman_and_tails(df, rows, parts):
    both = df.withColumn("y", F.pow("x", F.lit(3.0)))
    assert all(r.r is None or r.r == pytest.approx(1.0) for r in agg.corr_matrix(both, ["x", "y"], ["h"], "spearman").collect())
    limits = window.tails(df, "x", ["g"])
    kept = window.trim(df, "x", ["g"], limits=limits)
    assert kept.columns == df.columns and 0 < kept.count() < len(rows) and window.winsorise(df, "x", ["g"]).count() == len(rows)


def test_no_rows(df):
    none = df.limit(0)
    assert order.quantiles(none, ["g"], "x", [0.5]).count() == 0 and order.row_numbers(none, ["g"], ["x"]).count() == 0 and order.quantile_grid(none, "x", 5).count() == 0


def test_one_group_of_five_million_values(spark):
    n, before = 5_000_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        values = spark.range(n).select(F.lit(1).alias("g"), ((F.col("id") * 2_654_435_761) % n / 8).alias("x"))
        dealt = order.counted(values, ["g"], "x")
        sizes = [r["count"] for r in dealt.groupBy("__part").count().collect()]
        assert len(sizes) == 16 and max(sizes) < n / 8  # no task holds the group
        found = order.running(dealt, ["g"], ["x"], ["n"]).groupBy("g").agg(F.array(*[order.picked(p, "x") for p in (0.0, 0.25, 0.5, 1.0)]).alias("q"), F.count_if(F.col("before_n") != F.col("x") * 8).alias("wrong")).first()
        assert found.wrong == 0 and found.q == [0.0, (n - 1) / 32, (n - 1) / 16, (n - 1) / 8]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
