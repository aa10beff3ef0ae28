"""Unions, duplicates and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyspark.sources.scratch import dealt, materialize


def pool(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def drop_exact_duplicates(df: DataFrame, wave: str, wt: str) -> tuple[DataFrame, DataFrame]:
    """Rows once each, and (wave, n_dropped, wt_dropped)."""
    counted = dealt(materialize(df, "rows")).groupBy(*df.columns).agg(F.count("*").alias("__n"))
    report = counted.groupBy(wave).agg(F.sum(F.col("__n") - 1).alias("n_dropped"), F.sum((F.col("__n") - 1) * F.col(wt)).alias("wt_dropped"))
    return counted.drop("__n"), report


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key and how many more there were."""
    numbered = df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).withColumn("n_more", F.count("*").over(Window.partitionBy(*key)) - 1)
    return numbered.filter("__r = 1").drop("__r")


def duplicate_keys(df: DataFrame, key: list[str], by: str) -> DataFrame:
    """(by, n_keys, n_rows) of keys that occur more than once."""
    return df.groupBy(by, *key).agg(F.count("*").alias("__n")).filter("__n > 1").groupBy(by).agg(F.count("*").alias("n_keys"), F.sum("__n").alias("n_rows"))


def missing_from(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Distinct rows of ``expected`` that ``present`` lacks; nulls equal nulls."""
    return expected.subtract(present.select(*expected.columns))


def sorted_panel(df: DataFrame, unit: str, period: str) -> DataFrame:
    return df.repartitionByRange(unit).sortWithinPartitions(unit, period)


def ranking(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(value))))
