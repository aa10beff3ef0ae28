"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into halves; an independent codebook for each half makes a product grid of cells. Each vector stands
in the cell of its nearest codewords. Its search goes through both halves' codewords in the order of the least distance that
anything in their cells can have from it (multi-sequence traversal) and stops where the sum of both is beyond the distance
of the least cosine. So no link is lost, whatever the table's size and the codebooks. Every candidate is verified by its cosine.

Codebooks are fitted on at most ``SAMPLE`` vectors; all vectors are indexed and all search. Equal vectors of a label are one
class first, so that copies cost nothing. Neighbouring cells make a region, of which a label has the more the more vectors it has;
the members of a region are cut into blocks of bounded size. Every pair of blocks is a group of its own, in which those vectors of either meet that reach the other's
region; it gives counts and a spanning forest of its links, never all pairs. Where vectors have no structure all regions are
reached, and the work grows with the square of the largest label.

Defined cases: vectors that are null, empty or zero or hold null or non-finite components, and rows without a label, link
with nothing; vectors of different lengths are never compared; rows that repeat id and vector link with each other; a null
vec_id never is a component's smallest id unless all its ids are null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, spread_join
from .components import components

COSINE = 0.93
SAMPLE = 8192
#: Vectors for each cell of the grid, about, and codewords of a book at most.
PER_CELL, MOST_CODES = 1000, SAMPLE // 8
#: Vectors of a block, and regions of a label at least.
BLOCK, LEAST_REGIONS = 4096, 4
#: Vectors of a block that are multiplied with another at once.
STRIP = 512
#: Errors of arithmetic, far above those of double precision on unit vectors.
SLACK = 1e-11


def codebook(rows: np.ndarray, k: int) -> np.ndarray:
    """k-means from evenly spread rows of ``rows`` in the order of their first principal direction."""
    order = np.argsort(rows @ np.linalg.svd(rows - rows.mean(axis=0), full_matrices=False)[2][0], kind="stable")
    centres = rows[order[np.linspace(0, len(rows) - 1, k).astype(int)]]
    for _ in range(10):
        nearest = distances(rows, centres).argmin(axis=1)
        centres = np.stack([rows[nearest == i].mean(axis=0) if (nearest == i).any() else c for i, c in enumerate(centres)])
    return centres


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1), 0)


def least_distances(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distance of each row from each codeword's cell, or less.

    What is nearer to c than to c' lies beyond the plane between them, which is (|x - c|^2 - |x - c'|^2) / (2 |c - c'|) from x.
    """
    d, out = distances(rows, book), np.zeros((len(rows), len(book)))
    for c, centre in enumerate(book):
        between = np.maximum(2 * np.linalg.norm(book - centre, axis=1), 1e-300)
        out[:, c] = ((d[:, c, None] - d - SLACK) / between).max(axis=1)
    return np.maximum(out, 0) ** 2


def traversal(rows: np.ndarray, books: tuple, limit: float):
    """(rows, cells) of all cells within the squared distance ``limit`` of each row: one codeword of the first half after the other, nearest first."""
    half = rows.shape[1] // 2
    a, b = least_distances(rows[:, :half], books[0]), least_distances(rows[:, half:], books[1])
    oa, ob = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
    a, b = np.take_along_axis(a, oa, 1), np.take_along_axis(b, ob, 1)
    for i in range(a.shape[1]):
        at = np.flatnonzero(a[:, i] + b[:, 0] <= limit)
        if not len(at):
            return
        row, j = np.nonzero(a[at, i, None] + b[at] <= limit)
        yield at[row], oa[at[row], i] * b.shape[1] + ob[at[row], j]


def own_cells(rows: np.ndarray, books: tuple) -> np.ndarray:
    half = rows.shape[1] // 2
    return distances(rows[:, :half], books[0]).argmin(axis=1) * len(books[1]) + distances(rows[:, half:], books[1]).argmin(axis=1)


def fit(classes: DataFrame, length: int, sample: int) -> dict:
    """Codebooks for vectors of ``length`` and the share of sampled vectors ahead of each cell, by which a label's regions are dealt.

    The grid grows with the number of vectors. Regions decide what is compared together, not what links.
    """
    mine = classes.filter(F.col("length") == length)
    n = mine.count()
    k = int(min(MOST_CODES, max(4, (n / PER_CELL) ** 0.5)))
    picked = mine.orderBy("cid").limit(sample).select("unit").toPandas()
    rows = np.stack([np.frombuffer(u, np.float64) for u in picked["unit"]])
    half = length // 2
    k = min(k, len(rows))
    books = (codebook(rows[:, :half], k) if half else np.zeros((1, 0)), codebook(rows[:, half:], k))
    held = np.bincount(own_cells(rows, books), minlength=len(books[0]) * len(books[1]))
    return {"n": n, "books": books, "ahead": np.minimum((np.cumsum(held) - held) / len(rows), 1 - 1e-12)}


def block_links(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Counts (class, n) and forest links (class, other) of one pair of blocks; a block paired with itself has no ``second`` side."""
    units, weight = np.stack([np.frombuffer(u, np.float64) for u in rows["unit"]]), rows["m"].to_numpy()
    same = rows["first"].iloc[0] == rows["second"].iloc[0]
    side = rows["side"].to_numpy()
    x_at = np.arange(len(rows)) if same else np.flatnonzero(~side)
    y_at = x_at if same else np.flatnonzero(side)
    y = units[y_at]
    n, parent, forest = np.zeros(len(rows), np.int64), list(range(len(rows))), []

    def root(u):
        while parent[u] != u:
            parent[u] = parent[parent[u]]
            u = parent[u]
        return u

    def join(some_x, some_y):
        for u, v in zip(some_x.tolist(), some_y.tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[a] = b
                forest.append((u, v))

    for start in range(0, len(x_at) if len(y_at) else 0, STRIP):
        strip = x_at[start : start + STRIP]
        near = units[strip] @ y.T >= cosine
        if same:
            near[np.arange(len(strip)), start + np.arange(len(strip))] = False
        i, j = np.nonzero(near)
        if not len(i):
            continue
        i, j = strip[i], y_at[j]
        n += np.bincount(i, weights=weight[j], minlength=len(rows)).astype(np.int64)
        if not same:
            n += np.bincount(j, weights=weight[i], minlength=len(rows)).astype(np.int64)
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))  # a first link for each row joins most at once
        join(i[first], j[first])
        trees = np.array([root(u) for u in range(len(rows))])
        apart = np.flatnonzero(trees[i] != trees[j])
        between = np.unique(trees[i[apart]] * len(rows) + trees[j[apart]], return_index=True)[1]
        join(i[apart[between]], j[apart[between]])
    cid, some = rows["cid"].to_numpy(), np.flatnonzero(n)
    counts = pd.DataFrame({"cid": cid[some], "other": None, "n": n[some]})
    u, v = np.array(forest, np.int64).reshape(-1, 2).T
    return pd.concat([counts, pd.DataFrame({"cid": cid[u], "other": cid[v], "n": np.int64(0)})])


def near_vectors(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) -> vec_id, n_links, component_id; one row a vector."""
    bounded_batches(vectors.sparkSession)

    @F.pandas_udf("binary")
    def unit(arrays: pd.Series) -> pd.Series:
        out = []
        for a in arrays:
            v = None if a is None or not len(a) else np.array([np.nan if c is None else c for c in a], np.float64)
            if v is None or not np.isfinite(v).all() or not v.any():
                out.append(None)
                continue
            v /= np.abs(v).max()
            out.append((v / np.sqrt((v * v).sum())).tobytes())
        return pd.Series(out, dtype=object)

    rows = vectors.select("vec_id", "label", unit("embedding").alias("unit"))
    usable = F.col("unit").isNotNull() & F.col("label").isNotNull()
    rows = materialize(rows.withColumn("cid", F.when(usable, F.md5(F.concat(F.col("label").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("unit"))))), "vectors")
    classes = rows.filter("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    classes = materialize(classes.withColumn("length", (F.octet_length("unit") / 8).cast("int")), "classes")
    lengths = [r.length for r in classes.select("length").distinct().collect()]
    found = [search(classes.filter(F.col("length") == n), fit(classes, n, sample), cosine) for n in lengths]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    links = found[0]
    for more in found[1:]:
        links = links.unionAll(more)
    links = materialize(links, "links")
    counts = links.groupBy("cid").agg(F.sum("n").alias("n"))
    comps = components(links.filter("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    placed = classes.join(comps, classes["cid"] == comps["node"], "left").join(counts, "cid", "left").select("cid", "m", "least", "n", F.coalesce("component", "cid").alias("component"))
    placed = materialize(placed, "placed")
    # Neither a large component nor a vector with very many copies is gathered in one task.
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("__n"))
    table = spread_join(placed, least, "component", placed.count()).select("cid", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id", F.col("m").alias("__n"))
    linked = spread_join(rows.filter("cid IS NOT NULL").select("vec_id", "cid"), table, "cid", rows.count()).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return linked.unionAll(rows.filter("cid IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def search(classes: DataFrame, model: dict, cosine: float) -> DataFrame:
    """(cid, other, n): counts where ``other`` is null, else links of spanning forests."""
    limit = 2 - 2 * cosine + 100 * SLACK

    @F.pandas_udf("region int, reached array<int>")
    def dealt(units: pd.Series, regions: pd.Series) -> pd.DataFrame:
        if not len(units):
            return pd.DataFrame({"region": pd.Series(dtype=np.int32), "reached": pd.Series(dtype=object)})
        rows, regions = np.stack([np.frombuffer(u, np.float64) for u in units]), regions.to_numpy(np.int64)
        region = lambda at, cells: (model["ahead"][cells] * regions[at]).astype(np.int32)
        seen = np.zeros((len(rows), regions.max()), bool)
        for at, cells in traversal(rows, model["books"], limit):
            seen[at, region(at, cells)] = True
        return pd.DataFrame({"region": region(np.arange(len(rows)), own_cells(rows, model["books"])), "reached": [np.flatnonzero(s).astype(np.int32) for s in seen]})

    # A small label has few regions, however large others are.
    sizes = classes.groupBy("label").agg(F.count("*").alias("__n")).withColumn("regions", F.greatest(F.ceil(F.col("__n") / BLOCK), F.lit(LEAST_REGIONS)).cast("int"))
    placed = spread_join(classes.select("cid", "m", "label", "unit"), materialize(sizes, "sizes"), "label", model["n"])
    placed = materialize(placed.withColumn("at", dealt("unit", "regions")).select("cid", "m", "label", "unit", "at.*"), "regions")
    blocks = materialize(placed.groupBy("label", "region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    place = lambda region, block: F.col(region).cast("long") * (1 << 32) + block
    here = placed.join(blocks, ["label", "region"]).withColumn("here", place("region", F.pmod(F.xxhash64("cid"), F.col("blocks"))))
    there = here.select("label", "cid", "m", "unit", "here", F.explode("reached").alias("region")).join(blocks, ["label", "region"])
    there = there.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("there", place("region", F.col("block")))
    # Links are seen from both ends: a vector of either block that does not reach the other's region has none there.
    pairs = there.select("label", F.least("here", "there").alias("first"), F.greatest("here", "there").alias("second"), (F.col("here") > F.col("there")).alias("side"), "cid", "m", "unit")
    return pairs.groupBy("label", "first", "second").applyInPandas(lambda rows: block_links(rows, cosine), "cid string, other string, n long")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP10_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len([x for x in v if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in v if x <> 0]) > 0),
p AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT r, r AS t FROM e UNION SELECT reach.r, p.b FROM reach JOIN p ON reach.t = p.a),
c AS (SELECT reach.r, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = reach.t GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM e JOIN c USING (r) LEFT JOIN n USING (r)
"""
