"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

_OWN: dict[str, str] = {}
#: Rows of a task that ``dealt`` gives, about.
DEALT = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may go without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    untyped = [f.name for f in df.schema if isinstance(f.dataType, NullType)]  # Parquet has no such type
    df = df.withColumns({c: F.col(c).cast("string") for c in untyped})
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).withColumns({c: F.lit(None) for c in untyped})


def dealt(rows: DataFrame) -> DataFrame:
    """``rows``, a written table, dealt by all columns: equal rows meet in tasks of about ``DEALT`` rows, apart from the joins that made them."""
    return rows.repartition(max(1, -(-rows.count() // DEALT)), *rows.columns)


def drop_scratch(*frames: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            target = jvm.org.apache.hadoop.fs.Path(file)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
