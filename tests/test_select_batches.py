"""Selection holds few rows of candidates at once, and scores by cluster are the same however rows are cut into batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from surveyspark.operators import select as L


def test_scores_and_tiles_come_from_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD", 600, raising=False)
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    rnd = np.random.default_rng(2)
    x, unit = rnd.standard_normal((900, 5)), rnd.integers(0, 40, 900)
    try:
        rows = L.with_features(spark.createDataFrame([(int(u), v.tolist()) for u, v in zip(unit, x, strict=True)], "u int, v array<double>").coalesce(1), "v", ["u"], "x")
        sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32())], ["u"]) for b in batches), "u int")
        assert max(r.u for r in sizes.collect()) <= 256
        b = np.array([0.5, -1.0, 0.0])
        found = L.score_squares(rows, "u", [b, 0 * b], [0, 1], np.array([2, 3, 4]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    e = np.stack([x[:, 0] - x[:, 2:] @ b, x[:, 1]])
    sums = np.array([[(x[unit == u][:, 2:] * e[k][unit == u, None]).sum(axis=0) for u in range(40)] for k in range(2)])
    assert np.allclose(found, (sums**2).sum(axis=1))
