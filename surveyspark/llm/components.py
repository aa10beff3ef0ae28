"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, spread_join

#: Links that one task takes to its forest.
FOREST = 200_000


def _stars(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """Each node hands its smallest neighbour to its larger (or smaller) neighbours. ``edges``: u > v, ``n`` of them."""
    if large:
        edges = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("__n"))
    joined = spread_join(edges, least, "u", 2 * n)
    moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def forests(edges: DataFrame, parts: int) -> DataFrame:
    """``edges`` dealt to ``parts`` tasks; each hands back its links as stars: every node with the smallest it is linked with there."""

    def reduce(batches):
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for batch in batches:
            for u, v in zip(batch["u"], batch["v"], strict=True):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if root(x) != x]
        for at in range(0, len(nodes), 10_000):
            some = nodes[at : at + 10_000]
            yield pd.DataFrame({"u": some, "v": [root(x) for x in some]})

    return edges.repartition(parts).mapInPandas(reduce, edges.schema)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a, b); nodes are of any orderable type.

    Links are first reduced to stars in parts of at most FOREST; if that is one part, the work is done. Else each round is written to
    the shared folder. A star's centre may have any number of neighbours: its rows are never gathered in one task. Nulls and
    loops are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), (F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).alias("ok"))
    edges = materialize(edges.filter("ok").select("u", "v").distinct(), "edges")
    parts = edges.count() // FOREST + 1
    whole, edges = edges, materialize(forests(edges, parts), "edges")
    drop_scratch(whole)
    before = None
    for _ in range(most_rounds if parts > 1 else 0):
        after = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if after == before or not after["n"]:
            break
        before = after
        handed = materialize(_stars(edges, after["n"], True), "edges")
        following = materialize(_stars(handed, after["n"], False), "edges")
        drop_scratch(edges, handed)
        edges = following
    else:
        if parts > 1:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
