"""Vector codes against all distances, in whole numbers of any size."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from surveyspark.llm import codes


def brute_learn(rows, parts, entries, rounds):
    """rows: (id, vector). Codebooks and codes by comparing every part with every entry."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(ordered[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(cut(v, p)) for _, v in ordered[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v in ordered:
                members.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, some in members.items():
                books[p][e] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    return books, lambda v: [near(cut(v, p), books[p])[::-1] for p in range(parts)]


def test_nearest_entries():
    rnd = np.random.default_rng(1)
    for n, width, spread in ((1, 3, 50), (7, 1, 3), (64, 4, 4), (65, 5, 1000), (256, 16, 120), (300, 2, codes.LIMIT)):
        entries, x = rnd.integers(-spread, spread + 1, (n, width)), rnd.integers(-2 * spread, 2 * spread + 1, (200, width))
        x[:20] = entries[rnd.integers(0, n, 20)]
        x[20:23] = 50 * spread
        apart = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        code, error = codes.Slices(entries).nearest(x)
        assert (code == apart.argmin(axis=1)).all() and (error == apart.min(axis=1)).all()
    slices = codes.Slices(np.array([[0, 0], [4, 4], [9, 0]]))
    row, entry = slices.inside(np.array([[1, 1], [8, 2]]), np.array([3, 100]))
    assert list(zip(row.tolist(), entry.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]


@pytest.fixture(scope="module")
def vectors():
    rnd = random.Random(3)
    rows = [(rnd.randrange(500), [rnd.choice((rnd.gauss(0, 0.2), 0.5)) for _ in range(rnd.choice((8, 8, 8, 6, 3)))], rnd.choice((1, 1, 1, 2, None))) for _ in range(120)]
    rows += [(900, rows[0][1], 5), (900, rows[0][1], 5), (None, rows[1][1], None), (901, [], 1), (902, [1e30] * 8, 2), (903, [-1e300] * 8, 2)]
    rows += [(1, None, 1), (2, [None] + [0.0] * 7, 1), (3, [float("nan")] + [0.0] * 7, 1), (4, [float("inf")] * 8, None)]
    return rows


def whole(v):
    return [math.floor(max(min(1024 * x, codes.LIMIT), -codes.LIMIT)) for x in v] + [0] * (8 - len(v))


@pytest.mark.parametrize("entries", [4, 40, 256])
def test_compress(spark, vectors, entries):
    df = spark.createDataFrame([(*r, 7) for r in vectors], "vec_id long, embedding array<double>, label int, error int").repartition(3)
    coded, books = codes.compress(df, entries=entries)
    assert coded.columns == ["vec_id", "label", "error", "codes"] and all(r.error == 7 for r in coded.collect())
    rows = [(i, whole(v), label) for i, v, label in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected, code = brute_learn([r[:2] for r in rows], 4, entries, 4)
    assert [b.tolist() for b in books] == expected
    got = [(r.vec_id, r.label, list(r.codes.codes), r.codes.error) for r in coded.collect()]
    want = [(i, label, [e for e, _ in code(v)], sum(d for _, d in code(v))) for i, v, label in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_query(spark, vectors, tmp_path):
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(i, whole(v), label) for i, v, label in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    books, code = brute_learn([r[:2] for r in rows], 4, 256, 4)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    error = {id(v): sum(d for _, d in code(v)) for _, v, _ in rows}
    of_label = {}
    for _, v, label in rows:
        of_label[label] = of_label.get(label, 0) + error[id(v)]
    want = [(i, "".join(f"{e:02x}" for e, _ in code(v)), error[id(v)], of_label[label], digest) for i, v, label in rows]
    assert sorted(map(tuple, codes.op12_codes(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_no_rows(spark):
    none = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    for df in (none, none.limit(0)):
        coded, books = codes.compress(df)
        assert coded.count() == 0 and books == []
