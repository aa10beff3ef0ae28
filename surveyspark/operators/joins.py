"""Joins: coalescing, fallback, bracketing, matching by name and self-joins of instruments."""

from __future__ import annotations

import math
from difflib import SequenceMatcher
from functools import reduce
from itertools import combinations
from os.path import commonprefix
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from surveyspark.functions.text import name_key
from surveyspark.sources.scratch import drop_scratch, materialize


def join_panels(frames: list[DataFrame], on: list[str], how: str = "inner") -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, how), frames)


def coalescing_join(base: DataFrame, other: DataFrame, on: list[str], tag: str, prefer_other: bool = False, never: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """1:1 left join in which columns that agree wherever both are there become one and fill each other's gaps; those that differ keep a copy with ``tag``.

    Also returns a report row per shared column: n_filled, n_conflict, and the match rate. ``never`` columns are never merged.
    """
    shared = [c for c in other.columns if c in base.columns and c not in on]
    right = other.select(*on, *[F.col(c).alias(f"__o_{c}" if c in shared else c) for c in other.columns if c not in on], F.lit(True).alias("__hit"))
    joined = base.join(right, on, "left")
    pair = lambda c: (F.col(c), F.col(f"__o_{c}"))
    stats = [F.avg(F.coalesce("__hit", F.lit(False)).cast("double")).alias("__rate")]
    for c in shared:
        a, b = pair(c)
        stats += [F.count_if(a.isNull() & b.isNotNull()).alias(f"fill_{c}"), F.count_if(a.isNotNull() & b.isNotNull() & (a != b)).alias(f"conflict_{c}")]
    report = joined.agg(*stats)
    row = report.first().asDict()  # numbers that decide which columns merge
    merged, extra = {}, []
    for c in shared:
        a, b = pair(c)
        if row[f"conflict_{c}"] or c in never:
            extra.append(b.alias(f"{c}_{tag}"))
        else:
            merged[c] = F.coalesce(b, a) if prefer_other else F.coalesce(a, b)
    new = [c for c in other.columns if c not in base.columns]
    out = joined.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in base.columns], *new, *extra)
    lines = [F.struct(F.lit(c).alias("column"), F.col(f"fill_{c}").alias("n_filled"), F.col(f"conflict_{c}").alias("n_conflict"), F.col("__rate").alias("match_rate")) for c in shared]
    return out, report.select(F.inline(F.array(*lines))) if lines else report.select(F.col("__rate").alias("match_rate"))


def attach_keys(df: DataFrame, keys: DataFrame, on: list[str], flag: str = "in_sample") -> DataFrame:
    """Key columns onto every row, gaps in those it has filled; rows without a key row are flagged."""
    cols = [c for c in keys.columns if c not in on]
    right = keys.select(*on, *[F.col(c).alias(f"__k_{c}") for c in cols], F.lit(True).alias("__hit"))
    joined = df.join(right, on, "left")
    filled = [F.coalesce(F.col(c), F.col(f"__k_{c}")).alias(c) if c in df.columns else F.col(f"__k_{c}").alias(c) for c in cols]
    return joined.select(*[c for c in df.columns if c not in cols], *filled, F.coalesce("__hit", F.lit(False)).alias(flag))


def map_keys_if_better(df: DataFrame, key: str, keys: DataFrame, xwalk: DataFrame, low: float = 0.5, high: float = 0.99, rate: float | None = None) -> DataFrame:
    """``xwalk`` (old, new) is applied to ``key`` only if fewer than ``low`` of the rows match ``keys`` as they are and over ``high`` do through it; ``rate`` is the first share, if it is known."""
    known = keys.select(F.col(key).alias("__k")).distinct()
    through = df.join(xwalk.select(F.col("old").alias(key), F.col("new").alias("__new")), key, "left")
    match = lambda rows, c: rows.join(known, rows[c] == known["__k"], "left").agg(F.avg(F.col("__k").isNotNull().cast("double"))).first()[0] or 0.0
    if (match(df, key) if rate is None else rate) < low and match(through, "__new") > high:
        return through.withColumn(key, F.col("__new")).drop("__new").select(*df.columns)
    return df


def fallback_join(df: DataFrame, lookups: list[tuple[DataFrame, list[str]]], value: str, source: str = "source") -> DataFrame:
    """``value`` from the first lookup that has it, with the lookup's number (from 1) in ``source``. Lookups are made unique on their keys by the mean."""
    for i, (lookup, on) in enumerate(lookups):
        df = df.join(lookup.groupBy(*on).agg(F.avg(value).alias(f"__v{i}")), on, "left")
    values = [F.col(f"__v{i}") for i in range(len(lookups))]
    first = reduce(lambda acc, i: F.when(values[i].isNotNull(), i + 1).otherwise(acc), reversed(range(len(lookups))), F.lit(None).cast("int"))
    return df.withColumn(value, F.coalesce(*values)).withColumn(source, first).drop(*[f"__v{i}" for i in range(len(lookups))])


def semi(df: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    return df.join(members, on, "left_semi")


def anti(df: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    return df.join(members, on, "left_anti")


def join_on_name(a: DataFrame, b: DataFrame, a_name: str, b_name: str, how: str = "inner") -> DataFrame:
    """Join through normalised names."""
    left, right = a.withColumn("__name", name_key(F.col(a_name))), b.withColumn("__name", name_key(F.col(b_name))).drop(*[b_name] if b_name == a_name else [])
    return left.join(right, "__name", how).drop("__name")


def _letters(name: Column) -> Column:
    """The letters of a name with their number of occurrence: two names share as many of these as they share letters."""
    letters = F.split(name, "")
    return F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i), lambda d: d == c)).cast("string")))


def _matched(x: str, y: str) -> int:
    """Letters in matching blocks, the longest first and of these the first in ``x``, then in ``y``, as ``SequenceMatcher`` counts them in names of under 200 letters."""
    total, rest = 0, [(x, y)]
    while rest:
        x, y = rest.pop()
        low, high, at = 0, min(len(x), len(y)), 0
        while low < high:  # the longest size at which a piece of x is in y
            size = (low + high + 1) // 2
            for i in range(len(x) - size + 1):
                if x[i : i + size] in y:
                    low, at = size, i
                    break
            else:
                high = size - 1
        if low:
            j = y.find(x[at : at + low])
            total += low
            rest += [(x[:at], y[:j]), (x[at + low :], y[j + low :])]
    return total


#: Ways to leave out letters of a name up to which all are listed; names of a side in a tile; rows of a task, about.
WAYS, TILE, TASK = 1000, 500, 250_000


def _meetings(a: DataFrame, b: DataFrame, cutoff: float) -> DataFrame:
    """(block, m, n, n_a, n_b, cut, need, ways): lengths of names in a block that may be close enough, how many names there are of each, and how they meet.

    All names of both lengths begin with the same ``cut`` letters, and of what follows two close names have ``need`` letters in the same
    order; ``ways`` is the larger number of ways to keep so many letters. ``need`` is 0 if all names had better meet: if there are no more
    pairs than rests, or if so few letters are needed that nearly all names have them.
    """

    @F.pandas_udf("cut int, need int, ways double")
    def plan(low: pd.Series, high: pd.Series, m: pd.Series, n: pd.Series, left: pd.Series, right: pd.Series) -> pd.DataFrame:
        out = []
        for first, last, x, y, p, q in zip(low, high, m, n, left, right, strict=True):
            cut = len(commonprefix([first, last]))
            need = math.ceil(cutoff * (x + y) / 2 - 1e-9) - cut
            k = max(x, y) - cut
            ways = round(math.exp(min(math.lgamma(k + 1) - math.lgamma(need + 1) - math.lgamma(k - need + 1), 99.0))) if need > 2 else 0
            out.append((cut, need, ways) if p * q > min(ways, WAYS) * (p + q) > 0 else (cut, 0, 0))
        return pd.DataFrame(out, columns=["cut", "need", "ways"]).astype({"ways": "float64"})

    side = lambda df, name, size: df.groupBy("block", F.length(name).alias(size)).agg(F.min(name).alias(f"low_{name}"), F.max(name).alias(f"high_{name}"), F.count("*").alias(f"n_{name}"))
    met = side(a, "a", "m").join(side(b, "b", "n").hint("merge"), "block").filter(F.least("m", "n") >= cutoff / (2 - cutoff) * F.greatest("m", "n") - 1e-9)
    how = plan(F.least("low_a", "low_b"), F.greatest("high_a", "high_b"), "m", "n", "n_a", "n_b")
    return met.withColumn("how", how).select("block", "m", "n", "n_a", "n_b", "how.*")


def _listed(names: DataFrame, name: str, other: str) -> DataFrame:
    """(block, name, key), ``names`` having the columns of ``_meetings``: what is left of a name when all but ``need`` letters go, in all ways, or its tiles."""
    tile_size = TILE

    def keys(batches):
        for batch in batches:
            out = []
            for block, x, m, n, cut, need, mine, others in batch.itertuples(index=False):
                tile, others = crc32(x.encode()) % -(-mine // tile_size), -(-others // tile_size)
                rest = {"".join(k) for k in combinations(x[cut:], need)} if need else [f"{tile},{i}" if name == "a" else f"{i},{tile}" for i in range(others)]
                out += [(block, x, f"{m},{n},{k}") for k in rest]
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["block", name, "key"])
                    out = []
            yield pd.DataFrame(out, columns=["block", name, "key"])

    rows = names.select("block", name, "m", "n", "cut", "need", f"n_{name}", f"n_{other}")
    return rows.mapInPandas(keys, StructType([*rows.schema.fields[:2], StructField("key", StringType())]))


def _share_letters(a: DataFrame, b: DataFrame, cutoff: float) -> DataFrame:
    """(block, a, b) of all pairs that share letters enough for ``cutoff``.

    Of the letters of each name in the order of their rarity in the block, the first m - t + 1 must meet, t being the least number that
    may do: an inverted index of these prefixes, an equi join by block and letter, gives pairs whose lengths and letters are counted.
    """
    least = cutoff / (2 - cutoff)
    side = lambda df, name: df.select("block", F.col(name).alias("name"), F.length(name).alias("m"), _letters(F.col(name)).alias("letters"))
    left, right = side(a, "a"), side(b, "b")
    often = left.select("block", F.explode("letters").alias("letter")).unionAll(right.select("block", F.explode("letters").alias("letter"))).groupBy("block", "letter").agg(F.count("*").alias("often"))

    def prefixes(rows: DataFrame) -> DataFrame:
        each = rows.select("block", "name", "m", F.explode("letters").alias("letter")).join(often.hint("merge"), ["block", "letter"])
        ranked = each.groupBy("block", "name", "m").agg(F.array_sort(F.collect_list(F.struct("often", "letter"))).alias("ranked"))  # a name's letters
        need = F.ceil(cutoff * (F.col("m") + F.ceil(least * F.col("m") - 1e-9)) / 2 - 1e-9)
        return ranked.select("block", "name", F.explode(F.slice("ranked", F.lit(1), F.greatest(F.col("m") - need + 1, F.lit(1)).cast("int"))).alias("r")).select("block", "name", F.col("r.letter").alias("letter"))

    met = prefixes(left).withColumnRenamed("name", "a").join(prefixes(right).withColumnRenamed("name", "b").hint("merge"), ["block", "letter"]).select("block", "a", "b").distinct()
    size, shared = F.length("a") + F.length("b"), F.size(F.array_intersect(_letters(F.col("a")), _letters(F.col("b"))))
    short, long = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    return met.filter((short >= least * long - 1e-9) & (2 * shared >= cutoff * size - 1e-9))


def similar_names(a: DataFrame, b: DataFrame, cutoff: float) -> DataFrame:
    """(block, a, b, score) of all pairs (block, a) and (block, b) whose matching blocks cover at least ``cutoff`` of both.

    Two names of m and n letters at ``cutoff`` have at least t = cutoff * (m + n) / 2 letters in the same order. So when t letters of either are
    kept in all ways, the two have a rest in common: an equi join by block and rest gives candidates. What all names of these lengths begin
    with in the block is left out first. Where there are too many ways, candidates come from an index of rare letters; where
    few names or few letters would meet, all do, in tiles. Matching blocks are searched for pair by pair, once a pair.

    A name is many rows here, which file sizes do not tell: these joins are never broadcast, and tasks are dealt by the rows to come.
    """
    how = materialize(_meetings(a, b, cutoff), "meetings")
    few, many = how.filter(F.col("ways") <= WAYS), how.filter(F.col("ways") > WAYS)
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    tasks = how.agg(F.ceil(F.sum(F.when(F.col("need") == 0, n_a * n_b).otherwise(F.least("ways", F.lit(float(WAYS))) * (n_a + n_b))) / TASK)).first()[0]
    tasks = int(min(max(tasks or 0, 1), 4000))
    side = lambda df, name, size, how: df.withColumn(size, F.length(name)).join(how.hint("merge"), ["block", size]).repartition(tasks, name)
    met = _listed(side(a, "a", "m", few), "a", "b").join(_listed(side(b, "b", "n", few), "b", "a").hint("merge"), ["block", "key"]).select("block", "a", "b")
    if many.limit(1).count():
        names = lambda df, name, size: side(df, name, size, many.select("block", size).distinct()).select("block", name)
        met = met.unionAll(_share_letters(names(a, "a", "m"), names(b, "b", "n"), cutoff))
    each = met.repartition(tasks, "block", "a").distinct()  # a pair may have several rests in common

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            both = len(p) + len(q)
            if 2 * sum(min(p.count(c), q.count(c)) for c in set(p)) < cutoff * both - 1e-9:
                out.append(0.0)
            else:
                out.append(2.0 * _matched(q, p) / both if len(p) < 200 else SequenceMatcher(None, q, p).ratio())
        return pd.Series(out, dtype="float64")

    score = F.pandas_udf(ratio, "double").asNondeterministic()  # else the filter goes below the join and counts pairs again and again
    return each.withColumn("score", score("a", "b")).filter(F.col("score") >= cutoff)


#: Cutoffs at which the closest name is looked for before the one that is asked for.
STEPS = (0.94, 0.88, 0.82)


def fuzzy_match(left: DataFrame, right: DataFrame, block: str, cutoff: float = 0.6, one_to_one: bool = True) -> DataFrame:
    """(block, left_name, right_name, score): names matched within a parent, equal ones first, then the closest by matching blocks at or above ``cutoff``.

    ``left`` (block, name) and ``right`` (block, name), compared without case and outer blanks. With ``one_to_one`` no name is used twice:
    equal names are taken by a join, then each other left name, in order, takes the closest name that is left in its parent. Else every left
    name gets its closest right name. Of equally close names the last in order is taken. Empty names match empty ones only.

    One-to-one is settled in rounds: every left name asks for its closest right name; a right name that is asked for is lost to all
    left names after the first that asks. When nobody loses any more, the requests are the result, the same as taking turns in order.
    No parent is gathered in a task. Without ``one_to_one`` cutoffs fall step by step, and a left name that has found any name at a step
    is done: all closer names have been seen, and far ones, which are nearly all, never are.
    """
    key = F.upper(F.trim("name"))
    rows = lambda df, name: df.filter("name IS NOT NULL").groupBy(F.col(block).alias("block"), key.alias(name)).agg(F.min("name").alias(f"{name}_name"))
    a, b = materialize(rows(left, "a"), "left-names"), materialize(rows(right, "b"), "right-names")
    large = lambda df: df.hint("merge")  # noqa: E731  files of names are far smaller than the names
    equal = a.join(large(b.withColumnRenamed("b", "a")), ["block", "a"]).select("block", "a", "a_name", "b_name", F.lit(1.0).alias("score"))
    rest_a = a.join(large(equal), ["block", "a"], "left_anti").filter("a <> ''")
    rest_b = (b.join(large(equal.select("block", F.col("a").alias("b"))), ["block", "b"], "left_anti") if one_to_one else b).filter("b <> ''")
    closest = lambda df: df.groupBy("block", "a").agg(F.max(F.struct("score", "b")).alias("best")).select("block", "a", "best.b", "best.score")
    rest_a, rest_b = materialize(rest_a.select("block", "a"), "rest"), materialize(rest_b.select("block", "b"), "rest")
    if one_to_one:
        pairs = materialize(similar_names(rest_a, rest_b, cutoff), "pairs")
    else:
        pairs = None
        for step in [*(c for c in STEPS if c > cutoff), cutoff]:
            found = materialize(closest(similar_names(rest_a, rest_b, step)), "pairs")
            pairs = found if pairs is None else pairs.unionAll(found)
            rest_a = materialize(rest_a.join(large(found.select("block", "a")), ["block", "a"], "left_anti"), "rest")
            if not rest_a.limit(1).count():
                break
    while one_to_one:
        first = closest(pairs).groupBy("block", "b").agg(F.min("a").alias("__first"))
        after = materialize(pairs.join(large(first), ["block", "b"], "left").filter("__first IS NULL OR a <= __first").drop("__first"), "pairs")
        settled = after.count() == pairs.count()
        drop_scratch(pairs)
        pairs = after
        if settled:
            break
    near = (closest(pairs) if one_to_one else pairs).join(large(a), ["block", "a"]).join(large(b), ["block", "b"]).select("block", "a", "a_name", "b_name", "score")
    return equal.unionAll(near).select(F.col("block").alias(block), F.col("a_name").alias("left_name"), F.col("b_name").alias("right_name"), "score")


def match_period(df: DataFrame, period: str, mapping: dict, out: str) -> DataFrame:
    """The survey wave that a year's outcome follows; years without one go."""
    table = df.sparkSession.createDataFrame(list(mapping.items()), [period, out])
    return df.join(F.broadcast(table.withColumn(period, F.col(period).cast("int")).withColumn(out, F.col(out).cast("int"))), period)


def bracket_join(df: DataFrame, knots: DataFrame, on: list[str], t: str, value: str) -> DataFrame:
    """Each row with the knots around it: t0, v0 at or before and t1, v1 at or after, by windows over the union."""
    cols = [c for c in df.columns if c not in (*on, t)]
    rows = df.select(*on, t, F.lit(True).alias("__row"), F.lit(None).cast("double").alias("__v"), F.struct(*cols).alias("__c") if cols else F.lit(None).alias("__c"))
    both = rows.unionByName(knots.select(*on, t, F.lit(False).alias("__row"), F.col(value).cast("double").alias("__v")), allowMissingColumns=True)
    knot = F.when(~F.col("__row"), F.struct(F.col(t).alias("t"), F.col("__v").alias("v")))
    back = Window.partitionBy(*on).orderBy(t).rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*on).orderBy(t).rangeBetween(0, Window.unboundedFollowing)
    both = both.withColumn("__lo", F.max(knot).over(back)).withColumn("__hi", F.min(knot).over(ahead)).filter("__row")
    return both.select(*on, t, *([F.col("__c")[c].alias(c) for c in cols]), F.col("__lo.t").alias("t0"), F.col("__lo.v").alias("v0"), F.col("__hi.t").alias("t1"), F.col("__hi.v").alias("v1"))


def complete_grid(units: DataFrame, periods: DataFrame) -> DataFrame:
    """All units by all periods; both are dimension tables."""
    return units.crossJoin(periods)


def pairwise(df: DataFrame, key: str, x: str, y: str, blocks: int = 16) -> DataFrame:
    """(a, b, distance) between all units of a dimension table, each pair once; blocks of units meet by an equi join on both blocks' numbers."""
    side = lambda s, other: df.select(F.col(key).alias(s), F.col(x).alias(f"{s}_x"), F.col(y).alias(f"{s}_y"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias(f"__{s}"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias(f"__{other}"))
    return side("a", "b").join(side("b", "a"), ["__a", "__b"]).filter("a < b").select("a", "b", F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")).alias("distance"))


def overlap_pairs(df: DataFrame, key: list[str], source: str, value: str) -> DataFrame:
    """Two sources that see the same unit and period, each pair once."""
    side = lambda s: df.select(*key, F.col(source).alias(f"source_{s}"), F.col(value).alias(f"value_{s}"))
    return side("a").join(side("b"), key).filter("source_a < source_b")


def agree(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(column, n, n_equal) over rows of both releases; nulls are equal to nulls."""
    cols = [c for c in a.columns if c in b.columns and c not in key]
    joined = a.select(*key, *[F.col(c).alias(f"__a_{c}") for c in cols]).join(b.select(*key, *[F.col(c).alias(f"__b_{c}") for c in cols]), key)
    row = joined.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}"))).alias(c) for c in cols])
    return row.unpivot("n", cols, "column", "n_equal").select("column", "n", "n_equal")


def main_record(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first record of each group in ``order``, such as the job with the longest hours."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__r = 1").drop("__r")
