"""Operators on tiny hand-built frames: duplicates, ties, gaps, nulls and the identities that must hold."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.functions import recode as R
from surveyspark.functions import text as X
from surveyspark.operators import agg as A
from surveyspark.operators import align as V
from surveyspark.operators import econ as E
from surveyspark.operators import harmonise as H
from surveyspark.operators import joins as J
from surveyspark.operators import quality as Q
from surveyspark.operators import sensor as N
from surveyspark.operators import sets as S
from surveyspark.operators import spatial as G
from surveyspark.operators import window as W
from surveyspark.plans import registry
from surveyspark.sources import io as IO

C = F.col


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_recodes(spark):
    df = spark.createDataFrame([(1, "a", "1"), (2, "b", "2.5"), (3, None, "x"), (None, "z", None)], "k int, s string, n string")
    assert rows(df.select(R.recode(C("k"), {7: [1, 2], 8: [3]}))) == [(7,), (7,), (8,), (None,)]
    assert rows(df.select(R.share(C("k"), [1], na=[3]))) == [(0.0,), (1.0,), (None,), (None,)]
    assert rows(df.select(R.make_key([C("k"), C("s")]))) == [("1_a",), ("2_b",), (None,), (None,)]
    assert rows(df.select(R.band(C("k"), [0, 1, 3], ["low", "high"]))) == [("high",), ("high",), ("low",), (None,)]
    assert rows(df.select(R.any_of([C("k") > 1, C("s") == "z"]))) == [(0,), (1,), (1,), (1,)]
    assert dict(R.destring(df).dtypes)["n"] == "string" and dict(R.destring(df.filter("n <> 'x'")).dtypes)["n"] == "double"
    wide = spark.createDataFrame([(100, 30000, 1.5, 2.0)], "a long, b long, c double, d double")
    assert [t for _, t in R.compress(wide, keep_double=("d",)).dtypes] == ["tinyint", "smallint", "double", "double"]
    clash = spark.createDataFrame([(1, None, 3)], "A int, a int, B int").toDF("A", "a", "B")
    assert R.lower_names(clash).columns == ["a", "b"]
    a, b = R.resolve_types([df.select("n"), df.select(C("k").alias("n"))])
    assert {dict(x.dtypes)["n"] for x in (a, b)} == {"string"}
    with_labels = R.decode(df, "k", spark.createDataFrame([(1, "one")], "code int, text string"), "label")
    assert rows(with_labels, "label") == [("2",), ("3",), ("one",), (None,)]
    ids = spark.createDataFrame([(123456,)], "i long")
    assert tuple(ids.select(*R.split_id(C("i"), 10000, 100)).first()) == (12, 34, 56)


def test_texts(spark):
    names = ["07 - Égypte (Nord)", "egypte-nord", " EGYPTE NORD ", "11 -Egypte–Nord", None, "Ｋigali ①", "21- Nyanza", "Nyanza"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(names)], "i int, s string")
    assert [r[0] for r in df.orderBy("i").select(X.name_key(C("s"))).collect()] == ["egyptenord"] * 4 + ["", "kigali1", "nyanza", "nyanza"]
    cases = {("Yes", "yes "): True, ("Yego", "YES"): True, ("Others (specify)", "Other"): True, ("DK", "not stated"): True, ("na", "Unknown"): True, ("not stated", None): False, ("private firm", "firm"): True, ("farmer", "farmers"): True, ("cat", "dog"): False}
    pairs = spark.createDataFrame(list(cases), "a string, b string")
    assert {(r.a, r.b): r.same for r in X.same_category(pairs, "a", "b").collect()} == cases
    one = spark.createDataFrame([("q12. Total ict workers [sum]",)], "s string")
    assert one.select(X.clean_label(C("s"), {"workers": "staff"}, ("ict",))).first()[0] == "Total ICT staff"
    empty = spark.createDataFrame([("the", "")], "a string, b string")
    assert empty.select(X.jaccard(X.tokens(C("a")), X.tokens(C("b")))).first()[0] == 1.0
    label = spark.createDataFrame([("What is the name of your AGE-group x 5?",)], "s string")
    assert sorted(label.select(X.tokens(C("s"))).first()[0]) == ["age", "group", "what"]
    assert X.invert_names({"a": "b"}) == {"b": "a"}
    with pytest.raises(ValueError):
        X.invert_names({"a": "c", "b": "c"})


def test_aggregations(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 0.0), (1, 2.0, 1.0), (1, 9.0, 2.0), (2, None, 5.0)], "g int, x double, w double")
    assert rows(A.wquantile(df, ["g"], "x", "w")) == [(1, 2.0)]
    assert rows(df.groupBy("g").agg(A.wmean(C("x"), C("w")))) == [(1, 21 / 4), (2, None)]
    assert rows(df.groupBy("g").agg(A.sum_min_count(C("x"), 1))) == [(1, 14.0), (2, None)]
    people = spark.createDataFrame([(1, 1, "u", 5), (1, 2, "u", 6), (2, 1, "v", None), (2, 2, "v", 7)], "h int, p int, town string, age int")
    homes, report = A.collapse_constant(people, ["h"], C("p"), ["age"])
    assert rows(homes, "h", "town", "size", "head_age") == [(1, "u", 2, 5), (2, "v", 2, None)]
    assert {r.column for r in report.collect()} == {"p", "age"}
    bins = A.binscatter(spark.createDataFrame([(i, float(i % 5)) for i in range(20)], "i int, x double").withColumn("y", C("x")), "x", ["y"], 4, [], ["i"])
    assert sum(r.n for r in bins.collect()) == 20
    moves = spark.createDataFrame([(1, "a", "a", 5.0), (1, "a", "b", 2.0), (1, "b", "a", 1.0)], "d int, from string, to string, ha double")
    assert sum(r.net for r in A.gross_flows(moves, "d").collect()) == 0


def test_joins(spark):
    base = spark.createDataFrame([(1, "x", None), (2, "y", 5), (3, None, 6)], "k int, a string, b int")
    other = spark.createDataFrame([(1, "x", 9), (2, "z", 5), (3, "w", None)], "k int, a string, b int")
    out, report = J.coalescing_join(base, other, ["k"], "o")
    assert rows(out, "k", "a", "a_o", "b") == [(1, "x", "x", 9), (2, "y", "z", 5), (3, None, "w", 6)]
    assert {r.column: (r.n_filled, r.n_conflict) for r in report.collect()} == {"a": (1, 1), "b": (1, 0)}
    left = spark.createDataFrame([("p", "Kigali"), ("p", "Kigaly"), ("q", "Huye")], "b string, name string")
    right = spark.createDataFrame([("p", "KIGALI"), ("p", "Kigale"), ("r", "Huye")], "b string, name string")
    assert rows(J.fuzzy_match(left, right, "b", 0.6), "left_name", "right_name") == [("Kigali", "KIGALI"), ("Kigaly", "Kigale")]
    left = spark.createDataFrame([("p", "Gasaka"), ("p", "Gasake"), ("p", "Zz"), ("p", None)], "b string, name string")
    right = spark.createDataFrame([("p", "Gasakx"), ("p", "Gasabo")], "b string, name string")
    assert rows(J.fuzzy_match(left, right, "b"), "left_name", "right_name") == [("Gasaka", "Gasakx"), ("Gasake", "Gasabo")]
    assert rows(J.fuzzy_match(left, right, "b", one_to_one=False), "left_name", "right_name") == [("Gasaka", "Gasakx"), ("Gasake", "Gasakx")]
    knots = spark.createDataFrame([("u", 2, 10.0), ("u", 6, 20.0)], "u string, t int, v double")
    got = J.bracket_join(spark.createDataFrame([("u", i) for i in (1, 2, 4, 7)], "u string, t int"), knots, ["u"], "t", "v")
    assert rows(got, "t", "t0", "t1") == [(1, None, 2), (2, 2, 2), (4, 2, 6), (7, 6, None)]
    keyed = J.map_keys_if_better(spark.createDataFrame([(-1,), (-2,)], "k int"), "k", spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(-1, 1), (-2, 2)], "old int, new int"))
    assert rows(keyed) == [(1,), (2,)]


def test_windows_and_sets(spark):
    df = spark.createDataFrame([("u", i, float(v)) for i, v in enumerate([3, 1, 4, 1, 5])], "u string, t int, x double")
    assert rows(W.depleting_stock(df.withColumn("s", F.lit(7.0)), "u", "t", "x", "s"), "t", "stock") == [(0, 7.0), (1, 4.0), (2, 3.0), (3, 0.0), (4, 0.0)]
    ranks = {r.t: r.pct_rank for r in W.anomaly(df, ["u"], "x").collect()}
    assert ranks[1] == ranks[3] == pytest.approx(0.3)
    blocks = W.blocks(spark.createDataFrame([(1, i, k) for i, k in enumerate([1, 2, 5, 1, 3, 2])], "g int, i int, k int"), ["g"], "i", "k")
    assert [r.block for r in blocks.orderBy("i").collect()] == [0, 0, 0, 1, 1, 2]
    knots = spark.createDataFrame([("u", 0, 1.0), ("u", 2, 4.0)], "u string, t int, v double")
    got = {r.t: r.v for r in W.interp_log(spark.createDataFrame([("u", i) for i in (-1, 1, 2, 4)], "u string, t int"), knots, ["u"], "t", "v").collect()}
    assert got[-1] is None and got[1] == pytest.approx(2.0) and got[2] == pytest.approx(4.0) and got[4] == pytest.approx(16.0)
    dup = spark.createDataFrame([(1, None, 2.0), (1, None, 2.0), (1, 5, 2.0)], "w int, a int, wt double")
    kept, report = S.drop_exact_duplicates(dup, "w", "wt")
    assert kept.count() == 2 and rows(report) == [(1, 1, 2.0)]
    assert rows(S.missing_from(dup.select("a"), spark.createDataFrame([(5,)], "a int"))) == [(None,)]


def test_alignment(spark):
    labels = spark.createDataFrame([("v", 1, 1, "Yes"), ("v", 1, 2, "No"), ("v", 2, 1, "yes"), ("v", 2, 2, "no"), ("v", 3, 1, "Male"), ("v", 3, 2, "Female")], "variable string, wave int, code int, text string")
    seen = V.observed(spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 7), (4, 99)], "wave int, v int"), "wave", ["v"])
    assert rows(seen.filter("wave = 4"), "low", "high") == [(7.0, 7.0)]
    pairs = {(r.wave_a, r.wave_b): r.compatible for r in V.compatible_pairs(labels, seen).collect()}
    assert pairs == {(1, 2): True, (1, 3): False, (2, 3): False, (1, 4): False, (2, 4): False, (3, 4): False}
    names = spark.createDataFrame([("v", w, "owns land") for w in (1, 2, 3, 4)], "variable string, wave int, label string")
    both = V.compatible_pairs(labels, seen).join(V.similar_pairs(names, 0.25), ["variable", "wave_a", "wave_b"])
    groups = {r.wave: r.pooled_column for r in V.version_groups(both, [1, 2, 3, 4]).collect()}
    assert groups == {1: "v", 2: "v", 3: "v_v2", 4: "v_v3"}
    decided = V.version_groups(both, [1, 2, 3, 4])
    assert V.audit_versions(labels, seen, decided).count() == 0
    split = {r.wave: r.pooled_column for r in V.version_groups(both, [1, 2, 3, 4], split={"v": [[1], [2]]}).collect()}
    assert split[1] != split[2]


def test_harmonise_and_quality(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 3, 2), (2, 9, 1)], "wave int, a int, b int")
    rules = [H.Rule("d", (1,), "c", ("a",), codes={5: [1, 2], 6: [3]}), H.Rule("d", (2,), "c", ("b",), kind="flag")]
    assert rows(H.harmonise(df, rules, "d"), "c") == [(1,), (5,), (6,)]
    with pytest.raises(ValueError):
        H.harmonise(df.withColumn("c", F.lit(1)), rules, "d")
    assert H.document(spark, rules).count() == 2
    bad = Q.check_keys(spark.createDataFrame([(1, "x"), (1, "q"), (None, "x")], "k int, d string"), ["k"], {"d": ["x"]})
    assert {r.name: r.result for r in bad.collect()} == {"unique": "FAIL", "complete": "FAIL", "domain d": "FAIL"}
    with pytest.raises(ValueError):
        Q.require(bad)
    heads = Q.check_constant(spark.createDataFrame([(1, 1, 5), (1, 1, 5), (2, 1, None), (2, 2, 4)], "h int, r int, x int"), ["h"], ["x"], C("r") == 1)
    assert {r.name: r.ours for r in heads.collect()} == {"x": 1.0, "one head": 1.0}


def test_sources(spark, tmp_path):
    path = f"file://{tmp_path}"
    spark.range(5).withColumn("w", C("id") % 2).write.parquet(f"{path}/src")
    assert IO.extract(spark, f"{path}/src", ["id"], f"{path}/out", {"id": "k"}).columns == ["k"]
    spark.range(9).withColumn("w", C("id")).write.mode("overwrite").parquet(f"{path}/src")
    assert IO.extract(spark, f"{path}/src", ["id"], f"{path}/out", {"id": "k"}).count() == 5
    table = IO.LabelledTable(spark.range(2), spark.createDataFrame([("id", "n" * 100)], "variable string, label string"), spark.createDataFrame([("id", 1, "one")], "variable string, code int, text string"))
    table.write(f"{path}/t")
    assert len(IO.LabelledTable.read(spark, f"{path}/t").data.schema["id"].metadata["label"]) == 80
    half = spark.createDataFrame([("id", 1.5, "x")], "variable string, code double, text string")
    with pytest.raises(ValueError):
        IO.LabelledTable(table.data, table.var_labels, half).write(f"{path}/u")
    written = IO.write_by_wave(spark.createDataFrame([(1, 1, None), (2, None, 5)], "wave int, a int, b int"), f"{path}/waves", "wave", [])
    assert written == {1: ["a"], 2: ["b"]}
    assert IO.list_files(spark, f"{path}/waves", "*.parquet").count() >= 2


def test_spatial(spark):
    square = lambda u, x: [(u, x, 0.0, x + 1.0, 0.0), (u, x + 1.0, 0.0, x + 1.0, 1.0), (u, x + 1.0, 1.0, x, 1.0), (u, x, 1.0, x, 0.0)]
    edges = spark.createDataFrame(square(1, 0.0) + square(2, 1.0), "unit int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 1.5, 0.0), (4, 5.0, 0.5)], "id int, x double, y double")
    assert rows(G.points_in(points, edges, "id", "unit", 0.3)) == [(1, 1), (2, 2), (3, 2)]  # the shared edge counts once
    assert rows(G.adjacency(edges, "unit")) == [(1, 2), (2, 1)]
    stats = {r.unit: r for r in G.shape_stats(edges, "unit").collect()}
    assert stats[1].area == 1.0 and stats[2].cx == pytest.approx(1.5) and stats[1].compactness == pytest.approx(math.pi / 4)
    assert rows(G.touches(G.adjacency(edges, "unit"), spark.createDataFrame([(1,)], "unit int"))) == [(2,)]
    share = G.label_pixels(spark.createDataFrame([(0, 0), (0, 1)], "row int, col int"), edges, "unit", 0.3, s=2)
    assert sum(r.share for r in share.collect()) == 2.0


def test_quantile_map_is_monotone(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(float(rnd.randint(0, 5)), rnd.random()) for _ in range(200)], "a double, b double")
    lut = N.quantile_map(df, "a", "b", 51)
    ys = [r.y for r in lut.orderBy("k").collect()]
    assert ys == sorted(ys)
    mapped = N.apply_map(df, lut, "a", "m").orderBy("a").collect()
    assert all(x.m <= y.m for x, y in zip(mapped, mapped[1:]))


@pytest.fixture(scope="module")
def panel():
    rnd = np.random.default_rng(4)
    out = []
    for u in range(12):
        for t in range(8):
            if rnd.random() < 0.85:
                x, z = rnd.standard_normal(2)
                out.append((u, t, u % 5, float(2 * x - z + u + t + rnd.standard_normal()), float(x), float(z), float(rnd.integers(1, 5))))
    return out


def test_fixed_effects(spark, panel):
    df = spark.createDataFrame(panel, "u int, t int, g int, y double, x double, z double, w double")
    flat = E.absorb(df, ["y"], ["u", "t"])
    for fe in ("u", "t"):
        assert max(abs(r[0]) for r in flat.groupBy(fe).avg("y").select("avg(y)").collect()) < 1e-6
    assert E.dummy_rank(df, ["u", "t"]) == np.linalg.matrix_rank(np.array([[float(r[0] == u) for u in range(12)] + [float(r[1] == t) for t in range(8)] for r in panel]))
    two = spark.createDataFrame([("a", "x"), ("b", "y")], "f string, g string")
    assert E.dummy_rank(two, ["f", "g"]) == 2
    got = {r.term: r for r in E.fe_ols(df, "y", ["x", "z"], ["u", "t"], "g", w="w").collect()}
    w = np.array([r[6] for r in panel])
    X = np.array([[r[4], r[5]] + [float(r[0] == u) for u in range(12)] + [float(r[1] == t) for t in range(1, 8)] for r in panel])
    y = np.array([r[3] for r in panel])
    bread = np.linalg.inv(X.T @ (w[:, None] * X))
    b = bread @ X.T @ (w * y)
    e, g = y - X @ b, np.array([r[2] for r in panel])
    meat = sum(np.outer(s, s) for s in (X[g == k].T @ (w * e)[g == k] for k in range(5)))
    n, k = X.shape
    se = np.sqrt(np.diag(bread @ meat @ bread) * 5 / 4 * (n - 1) / (n - k))
    assert got["x"].coef == pytest.approx(b[0], rel=1e-6) and got["x"].se == pytest.approx(se[0], rel=1e-6)
    with pytest.raises(ValueError):
        E.fe_ols(df.withColumn("c", C("u") * 1.0), "y", ["c"], ["u", "t"], "g")


def test_wild_bootstrap_is_the_row_form(spark, panel):
    df = spark.createDataFrame(panel, "u int, t int, g int, y double, x double, z double, w double")
    _, m, _, _ = E.fe_ols(df, "y", ["x", "z"], [], "g", extra=True)
    got = E.wild_p(m, ["x", "z"], ["z"], weights="rademacher", rank=1).first()
    X = np.array([[r[4], r[5]] for r in panel])
    y, g = np.array([r[3] for r in panel]), np.array([r[2] for r in panel])
    X, y = X - X.mean(axis=0), y - y.mean()

    def t_of(yy, j=1):
        bread = np.linalg.inv(X.T @ X)
        b = bread @ X.T @ yy
        e = yy - X @ b
        meat = sum(np.outer(s, s) for s in (X[g == k].T @ e[g == k] for k in range(5)))
        return b[j] / math.sqrt((bread @ meat @ bread)[j, j])

    b0 = (X[:, 0] @ y) / (X[:, 0] @ X[:, 0])
    u = y - X[:, 0] * b0
    signs = [[1.0 if d >> i & 1 else -1.0 for i in range(5)] for d in range(32)]
    p = np.mean([abs(t_of(X[:, 0] * b0 + np.array(s)[g] * u)) >= abs(t_of(y)) * (1 - 1e-12) for s in signs])
    assert got.draws == 32 and got.p == pytest.approx(p)

    # drawn weights, two terms, clusters dealt over several tasks
    rows = {r.term: r for r in E.wild_p(m.repartition(3), ["x", "z"], ["x", "z"], draws=40, rank=1).collect()}
    for j, x in enumerate(["x", "z"]):
        o = X[:, 1 - j]
        fit = o * ((o @ y) / (o @ o))
        drawn = [np.array([E.WEBB[E.hash_draw(1, d, k) % 6] for k in range(5)])[g] for d in range(40)]
        assert rows[x].draws == 40 and rows[x].p == pytest.approx(np.mean([abs(t_of(fit + w * (y - fit), j)) >= abs(t_of(y, j)) for w in drawn]))


def test_seasonal_on_an_incomplete_panel(spark):
    rows = [(u, m, u % 3, 2.0 * m + u + (u * m) % 5) for u in range(9) for m in range(1, 13) if (u + m) % 4]
    got = {r.term: r.coef for r in E.seasonal(spark.createDataFrame(rows, "u int, m int, g int, y double"), "y", "m", 1, ["u"], "g").collect()}
    X = np.array([[float(m == k) for k in range(2, 13)] + [float(u == k) for k in range(9)] for u, m, _, _ in rows])
    b = np.linalg.lstsq(X, np.array([r[3] for r in rows]), rcond=None)[0]
    assert got == pytest.approx({f"month_{k}": b[k - 2] for k in range(2, 13)}, abs=1e-6)


def test_pairwise_by_blocks(spark):
    rows = [(i, i * 1.5, (i * 7) % 5 * 1.0) for i in range(12)]
    got = {(r.a, r.b): r.distance for r in J.pairwise(spark.createDataFrame(rows, "k int, x double, y double"), "k", "x", "y", blocks=3).collect()}
    assert got == pytest.approx({(p[0], q[0]): math.hypot(p[1] - q[1], p[2] - q[2]) for p in rows for q in rows if p[0] < q[0]})


def test_tails_and_adjustments(spark):
    assert E.t_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6) and E.t_tail(1.0, 1) == pytest.approx(0.5)
    assert E.f_tail(4.0, 2, 10) == pytest.approx(0.0528, abs=5e-4) and E.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and E.chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert E.chi2_tail(7.814728, 3) == pytest.approx(0.05, abs=1e-6) and E.chi2_tail(11.0705, 5) == pytest.approx(0.05, abs=1e-5)
    ps = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "o string, p double")
    assert {r.o: round(r.p_holm, 6) for r in E.holm(ps, "p").collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    graph = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (None, 4)], "a int, b int")
    assert rows(E.components(graph, "a", "b")) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    assert E.hash_draw(1, 2, 3) == spark.range(1).select(E.draw(1, F.lit(2), F.lit(3))).first()[0]


def test_selection(spark):
    rnd = np.random.default_rng(3)
    data = [(int(i % 10), float(3 * x[0] + 0.5 * d + e), float(d), *map(float, x)) for i in range(400) for x in [rnd.standard_normal(6)] for d in [x[0] + rnd.standard_normal()] for e in [rnd.standard_normal()]]
    df = spark.createDataFrame(data, "g int, y double, d double, " + ", ".join(f"c{i} double" for i in range(6)))
    out = {r.term: r.coef for r in E.pds_lasso(df, "y", "d", [f"c{i}" for i in range(6)], "g", "g").collect()}
    assert "c0" in out and out["d"] == pytest.approx(0.5, abs=0.2)
    weighted = E.overlap_weights(df.withColumn("treat", (C("d") > 0).cast("int")), ["c0", "c1"], "treat")
    mean = weighted.groupBy("treat").agg((F.sum(C("c0") * C("overlap_weight")) / F.sum("overlap_weight")).alias("m")).collect()
    assert abs(mean[0].m - mean[1].m) < 1e-4


def test_components_of_all_orders(spark, tmp_path):
    keys = [(o, o * o % 97) for o in range(1, 200)] + [(200, None)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for o, c in keys:
        if c is not None:
            a, b = sorted((root(f"c{c}"), root(f"o{o % 5000 + o % 7 * 100000}")))
            parent[b] = a
    got = registry.QUERIES["eco_22_components_all"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in parent)


def test_draws_and_selection(spark):
    import random

    rnd = random.Random(3)
    panel = []
    for u in range(60):
        level = rnd.gauss(0, 1)
        panel += [(u, p, level + 0.1 * p + rnd.gauss(0, 1) + (1.5 if u < 20 and p >= 3 else 0), int(u < 20), rnd.gauss(0, 1)) for p in range(6)]
    df = spark.createDataFrame(panel, "u int, t int, y double, d int, z double")
    ri = E.pretrend_ri(df, "y", "d", "u", "t", 2, 2, 99).first()
    wald = E.pretrend(df, "y", "d", "u", "t", list(range(6)), 2, 2, "u").first()
    assert ri.df == wald.df == 2 and ri.draws == 99 and ri.chi2 == pytest.approx(wald.chi2 * 359 / 290, rel=0.05)  # the factor of the clustered form
    at = lambda p: F.max(F.when(C("t") == p, C("y")))
    units = df.groupBy("u").agg(at(0).alias("a"), at(5).alias("b"), F.max("d").alias("d"))
    boot = {r.what: r for r in E.boot_did(units, "u", "a", "b", "d", 199).collect()}
    change = {k: [r.b - r.a for r in units.filter(f"d = {k}").collect()] for k in (0, 1)}
    gap = sum(change[1]) / 20 - sum(change[0]) / 40
    assert boot["difference"].change == pytest.approx(gap) and boot["difference"].low < gap < boot["difference"].high and boot["difference"].p < 0.1
    picked = E.relabelled(units, "u", 7, 20, 1).groupBy("draw").count().collect()
    assert len(picked) == 7 and {r["count"] for r in picked} == {20}
    wide = df.withColumns({"x": 2 * C("y") + 0.1 * C("z"), "noise": F.sin(C("u") * 7.0 + C("t") * 13.0)})
    assert E.pds_lasso(wide, "x", "z", ["y", "noise"], "t", "u").first().selected >= 1
    weights = E.overlap_weights(df, ["z"], "d", group="t")
    report = E.overlap_report(weights, ["z"], "d").first()
    assert abs(report.weighted_gap) < 1e-3 and 0 < report.ess_treated <= 120 and report.ess_control <= 240
    areas = E.l1_logit_cv(df, "d", ["z"], "u", (0.5,), 3, forced=["y"]).first()
    assert areas.auc > 0.5 and 0 < areas.pr_auc <= 1


def test_nearest_of_many_segments(spark):
    rnd = np.random.default_rng(8)
    segments = [(x, y, x + dx, y + dy) for x, y, dx, dy in rnd.random((60, 4)) * [100, 100, 5, 5]] + [(0.0, 0.0, 100.0, 3.0), (50.0, 50.0, 50.0, 50.0)]
    segments = [tuple(map(float, s)) for s in segments]
    spots = [(i, float(x), float(y)) for i, (x, y) in enumerate(rnd.random((80, 2)) * 140 - 20)] + [(90, 500.0, -400.0)]

    def far(x, y, s):
        dx, dy = s[2] - s[0], s[3] - s[1]
        k = min(max(((x - s[0]) * dx + (y - s[1]) * dy) / (dx * dx + dy * dy), 0), 1) if dx or dy else 0
        return np.hypot(x - s[0] - k * dx, y - s[1] - k * dy)

    points, lines = spark.createDataFrame(spots, "id int, x double, y double"), spark.createDataFrame(segments, "x1 double, y1 double, x2 double, y2 double")
    for most in (1000, 10):
        got = {r.id: r.distance for r in G.dist_to(points, lines, "id", most).collect()}
        assert len(got) == len(spots) and all(got[i] == pytest.approx(min(far(x, y, s) for s in segments)) for i, x, y in spots)
