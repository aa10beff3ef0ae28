"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Sizes are words. The mix holds ``budget`` times all words; each source gets its share by weight, at most ``repeats`` times
its own size, the excess shared again by weight (water filling, in closed form over one row a source). Within a source,
documents stand in the order of the MD5 of their id; the mix reads that order round and round until the target is met, so
that a document is taken whole, but for the one at which the target falls.

The curriculum: source s is drawn at time t in 0..1 with weight target * (1 + ramp * (2t - 1)). Its integral is the demand
target * ((1 - ramp) * t + ramp * t * t); inverting it at a document's cumulative words gives the document's time, and
time times all words its training position. ``training_order`` range-sorts by position.

Scale: the running sums have two levels. A source is cut by MD5 into slices in proportion to its number of documents, so
no window holds more than about ``SLICE`` rows, however hot the source; sums of slices are small.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is one source, the last; a null id has
the first place in its source; rows alike in id and size share a place as if they followed one another; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

WEIGHTS = (3, 1, 2)
RAMPS = (0.0, 0.5, -0.5)
BUDGET, REPEATS = 1.5, 2
#: Documents of one window, about.
SLICE = 1_000


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, ramps: tuple = RAMPS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, n_docs) -> with mix_size, ramp and target. One row a source."""
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.select("*", cycle(weights, F.col("rank")).cast("double").alias("weight"), cycle(ramps, F.col("rank")).cast("double").alias("ramp"), (repeats * F.col("source_size")).cast("double").alias("cap"))
    every, by_ratio = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    share = budget * F.sum("source_size").over(every)
    left = share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    filled = ranked.select("*", share.alias("mix_size"), (left / weight_left).alias("level"), F.row_number().over(by_ratio).alias("rank_ratio"))
    # Sources fill up in this order; the first that does not fill up sets the level of the rest.
    level = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("rank_ratio", "level"))).over(every)["level"]
    filled = filled.withColumn("final", level)
    target = F.coalesce(F.least(F.col("final") * F.col("weight"), F.col("cap")), F.col("cap"))
    return filled.select("source", "source_size", "n_docs", "mix_size", "ramp", target.alias("target"))


def mixing_plan(docs: DataFrame, text: str = "text", key: tuple = (), **options) -> DataFrame:
    """One row a document: doc_id, ``key``, source, size, source_size, target, taken, copies, start, ramp, mix_size, position.

    ``position`` is that of the first word taken, null if none is.
    """
    place = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    sized = materialize(docs.select("doc_id", *key, "source", words(text).alias("size"), place.alias("place")), "sizes")  # texts are read and split once
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(sources, **options).withColumnRenamed("source", "__source")
    placed = sized.join(targets, sized["source"].eqNullSafe(targets["__source"])).drop("__source")
    fraction = F.coalesce(F.conv(F.substring("place", 1, 8), 16, 10).cast("double"), F.lit(0.0)) / 4294967296.0
    placed = placed.withColumn("slice", F.floor(fraction * F.ceil(F.col("n_docs") / SLICE)))
    sums = placed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("__source"), F.col("slice").alias("__slice"), F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("slice_start"))
    placed = placed.join(sums, placed["source"].eqNullSafe(sums["__source"]) & (placed["slice"] == sums["__slice"])).drop("__source", "__slice")
    within = Window.partitionBy("source", "slice").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("slice_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    taken = F.lit(0).cast("long")
    for turn in range(options.get("repeats", REPEATS)):
        taken += F.greatest(F.least(F.floor("target") - turn * F.col("source_size") - F.col("start"), F.col("size")), F.lit(0))
    placed = placed.withColumn("taken", taken.cast("long"))
    copies = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    kept = ("doc_id", *key, "source", "size", "source_size", "target", "taken", copies.alias("copies"), "start", "ramp", "mix_size")
    return placed.select(*kept, position(F.when(F.col("taken") > 0, F.col("start") / F.col("target"))).alias("position"))


def position(share: Column) -> Column:
    """The training position at which a source has served ``share`` of its target: its demand inverted."""
    ramp = F.col("ramp")
    root = F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * share)
    time = F.when(ramp == 0, share).otherwise((root - (1 - ramp)) / (2 * ramp))
    return F.when(share.isNotNull(), F.floor(F.least(F.greatest(time, F.lit(0.0)), F.lit(1.0)) * F.col("mix_size"))).cast("long")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each time a document is taken, range-sorted by position.

    The columns of ``docs`` stay, except that columns named like the added ones (mix_position, mix_words) are replaced;
    mix_words is under the document's size only where a source's target falls.
    """
    keyed = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-input")
    plan = mixing_plan(keyed, key=("__row",), **options).filter("taken > 0")
    copy = plan.select("__row", "size", "source_size", "target", "taken", "start", "ramp", "mix_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("turn"))
    at = position((F.col("start") + F.col("turn") * F.col("source_size")) / F.col("target"))
    mix_words = F.least(F.col("size"), F.col("taken") - F.col("turn") * F.col("size"))
    copy = copy.select(F.col("__row"), at.alias("__position"), mix_words.alias("__words"))
    rows = keyed.join(copy, "__row").drop("__row").withColumn("mix_position", F.col("__position")).withColumn("mix_words", F.col("__words")).drop("__position", "__words")
    return rows.repartitionByRange("mix_position", "doc_id").sortWithinPartitions("mix_position", "doc_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    plan = mixing_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "position")
    order = F.col("position").asc_nulls_last()
    return plan.repartitionByRange(order, "doc_id").sortWithinPartitions(order, "doc_id")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(rk - 1) % 3 + 1]::DOUBLE AS weight, [0.0, 0.5, -0.5][(rk - 1) % 3 + 1]::DOUBLE AS ramp, (2 * source_size)::DOUBLE AS cap, sum(source_size) OVER ()::BIGINT AS all_size FROM s),
f AS (SELECT *, (1.5::DOUBLE * all_size - coalesce(sum(cap) OVER prior, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER prior, 0)) AS lvl, row_number() OVER (ORDER BY cap / weight, rk) AS rr
  FROM w WINDOW prior AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min_by(lvl, rr) AS lvl FROM f WHERE lvl * weight < cap),
t AS (SELECT source, source_size, all_size, ramp, coalesce(least(l.lvl * weight, cap), cap) AS target FROM f, l),
p AS (SELECT d.doc_id, d.size, t.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (greatest(least(floor(target) - start, size), 0) + greatest(least(floor(target) - source_size - start, size), 0))::BIGINT AS taken,
  start / target AS share FROM p)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN floor(least(greatest(CASE WHEN ramp = 0 THEN share ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * share) - (1 - ramp)) / (2 * ramp) END, 0), 1) * (1.5::DOUBLE * all_size))::BIGINT END AS position
FROM k
"""
