"""A training corpus from ``documents``: five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared folder
and reads it again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm import decontaminate, jaccard, mixing, pii, quality
from surveyspark.llm.common import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Labels that are null, or of no document, teach nothing; without labels of both kinds every document has one score. A null text is
    scored as an empty one; rows are scored one by one, so that null ids and repeated rows change nothing.
    """
    model = quality.learn(docs, quality.learned_rows(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score(docs, model, out="__score").filter(F.col("__score") >= quality.THRESHOLD).drop("__score")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays.

    Of a group the row with the least id stays, of rows alike one; null ids come last. Documents without words are linked with
    nothing and all stay.
    """
    return jaccard.near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    A null or empty text holds none; an empty benchmark, or one without words, contaminates nothing.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by its kind; n_chars follows.

    A null text stays null, and so does its n_chars; without a column n_chars none is added. No row goes.
    """
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: documents repeated to the sources' targets, sorted by position.

    A null source is a source; documents without words are taken no times. Columns of documents named mix_position or mix_words are
    replaced by those of the mix; all others stay.
    """
    return mixing.training_order(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
