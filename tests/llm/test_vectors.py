"""Near vectors with one large component and one vector that very many rows share."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from surveyspark.llm import common, embeddings


def test_a_large_component_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 5)
    rnd = np.random.default_rng(6)
    base = rnd.standard_normal(12)
    rows = [(i, (base + 0.05 * rnd.standard_normal(12)).tolist(), 1) for i in range(10, 500)]
    rows += [(i, base.tolist(), 1) for i in range(500, 900)] + [(i, rnd.standard_normal(12).tolist(), 2) for i in range(900, 960)] + [(5, (-base).tolist(), 1), (6, base.tolist(), 3), (7, None, 1), (None, base.tolist(), 1)]
    x = np.array([r[1] if r[1] else [0.0] * 12 for r in rows])
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    label = np.array([r[2] for r in rows])
    links = (x @ x.T >= embeddings.COSINE) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)).collect()}
    assert len(found) == len(rows)
    for i, r in enumerate(rows):
        assert found[r[0]][0] == links[i].sum()  # the queries are the whole table, so that every link is found
    assert all(found[i][1] == 10 for i in range(10, 900)) and found[None][1] == 10 and [found[i][1] for i in (5, 6, 7)] == [5, 6, 7]


@pytest.mark.parametrize("n", [1000, 6000])
def test_every_link_is_found_at_every_size(spark, monkeypatch, n):
    """Single pairs at the least cosine, beside a dense group, in many cells, regions and blocks: the same links as brute force."""
    monkeypatch.setattr(embeddings, "PER_CELL", 20)
    monkeypatch.setattr(embeddings, "BLOCK", 300, raising=False)
    rnd = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    x = unit(rnd.standard_normal((n, 32)))
    half = n // 2
    aside = rnd.standard_normal((half, 32))
    x[half:] = 0.932 * x[:half] + (1 - 0.932**2) ** 0.5 * unit(aside - (aside * x[:half]).sum(axis=1)[:, None] * x[:half])
    x[: n // 10] = unit(x[0] + 0.1 * rnd.standard_normal((n // 10, 32)))
    label = np.arange(n) % half % 3
    links = (x @ x.T >= embeddings.COSINE) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    least = np.arange(n)
    while (lower := np.where(links, least[None, :], n).min(axis=1).clip(max=least)).tolist() != least.tolist():
        least = lower
    table = pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist(), "label": label})
    found = embeddings.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").repartition(5)).toPandas().sort_values("vec_id")
    assert found["n_links"].tolist() == links.sum(axis=1).tolist() and found["component_id"].tolist() == least.tolist()


def test_the_traversal_stops_behind_the_last_cell_with_a_link():
    """Neighbours at the least cosine stand in reached cells, of clustered vectors few cells are reached, and equal codewords do no harm."""
    rnd = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    for spread, most in ((10.0, 1.0), (0.1, 0.2)):
        x = unit(rnd.standard_normal((30, 24))[rnd.integers(0, 30, 1500)] + spread * rnd.standard_normal((1500, 24)) / 24**0.5)
        books = tuple(np.concatenate([embeddings.codebook(h, 20), h[:1], h[:1], h[:1] + 1e-9]) for h in (x[:, :12], x[:, 12:]))
        aside = rnd.standard_normal(x.shape)
        y = 0.93 * x + (1 - 0.93**2) ** 0.5 * unit(aside - (aside * x).sum(axis=1)[:, None] * x)
        reached = np.zeros((len(x), 23 * 23), bool)
        for rows, cells in embeddings.traversal(x, books, 2 - 2 * 0.93 + 1e-9):
            reached[rows, cells] = True
        at = np.arange(len(x))
        assert reached[at, embeddings.own_cells(x, books)].all() and reached[at, embeddings.own_cells(y, books)].all()
        assert reached.mean() <= most


def test_small_labels_have_few_regions_beside_a_large_one(spark, monkeypatch):
    """One label of 3,000 vectors in 30 regions, 1,500 of one pair each: the pairs meet and are not dealt to 30 regions."""
    monkeypatch.setattr(embeddings, "BLOCK", 100)
    rnd = np.random.default_rng(10)
    x = rnd.standard_normal((6000, 16))
    x[4500:] = x[3000:4500] + 0.05 * rnd.standard_normal((1500, 16))
    label = np.concatenate([np.zeros(3000, int), np.tile(np.arange(1, 1501), 2)])
    dealt, materialize = {}, embeddings.materialize
    monkeypatch.setattr(embeddings, "materialize", lambda df, name: dealt.setdefault(name, materialize(df, name)))
    found = embeddings.near_vectors(spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(6000), "embedding": x.tolist(), "label": label}), "vec_id long, embedding array<double>, label int")).toPandas().sort_values("vec_id")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = (unit @ unit.T >= embeddings.COSINE) & (label[:, None] == label[None, :])
    assert found["n_links"].tolist() == (links.sum(axis=1) - 1).tolist()
    reached = dealt["regions"].selectExpr("label = 0 AS large", "size(reached) AS n").groupBy("large").max("n").collect()
    assert {r[0]: r[1] <= embeddings.LEAST_REGIONS for r in reached} == {True: False, False: True}
