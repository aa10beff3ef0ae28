"""Sources and sinks: extracts, labelled tables, discovery by file name, catalogues, partitions by wave, pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def extract(spark: SparkSession, src: str, cols: list[str], out: str, rename: dict | None = None, redo: bool = False) -> DataFrame:
    """A subset of columns written once; an extract that is there already stays unless ``redo``."""
    rename = rename or {}
    picked = spark.read.parquet(src).select(*[F.col(c).alias(rename.get(c, c)) for c in cols])
    picked.write.mode("overwrite" if redo else "ignore").parquet(out)
    return spark.read.parquet(out)


def scan_agg(df: DataFrame, where: Column, by: list[str], aggs: list[Column]) -> DataFrame:
    """Filtered scan with partial aggregation: the filter and the columns used reach the file scan."""
    return df.filter(where).groupBy(*by).agg(*aggs)


def read_panel(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_panel(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


class LabelledTable:
    """Data with variable labels and value labels, kept as Parquet beside each other; variable labels also ride on the schema."""

    LABEL_CHARS = 80

    def __init__(self, data: DataFrame, var_labels: DataFrame, value_labels: DataFrame) -> None:
        """``var_labels`` (variable, label); ``value_labels`` (variable, code, text)."""
        self.data, self.var_labels, self.value_labels = data, var_labels, value_labels

    def write(self, path: str) -> None:
        """Label texts are cut to LABEL_CHARS; codes that are not 32-bit integers raise."""
        code = F.col("code").cast("double")
        if self.value_labels.filter((code % 1 != 0) | ~code.between(-(1 << 31), (1 << 31) - 1)).limit(1).count():
            raise ValueError("value labels need 32-bit integer codes")
        self.data.write.mode("overwrite").parquet(f"{path}/data")
        self.var_labels.select("variable", F.substring("label", 1, self.LABEL_CHARS).alias("label")).write.mode("overwrite").parquet(f"{path}/var_label")
        self.value_labels.select("variable", F.col("code").cast("int").alias("code"), F.substring("text", 1, self.LABEL_CHARS).alias("text")).write.mode("overwrite").parquet(f"{path}/value_label")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> LabelledTable:
        names = spark.read.parquet(f"{path}/var_label")
        texts = {r.variable: r.label for r in names.collect()}  # a row a column
        data = spark.read.parquet(f"{path}/data")
        data = data.select(*[F.col(c).alias(c, metadata={"label": texts[c]}) if c in texts else F.col(c) for c in data.columns])
        return cls(data, names, spark.read.parquet(f"{path}/value_label"))


def discover(files: DataFrame, patterns: list[tuple[str, list[str]]], path: str = "path") -> DataFrame:
    """Parts of a file's name by the first pattern that matches: ``[(regex, [names of its groups])]``."""
    names = list(dict.fromkeys(n for _, ns in patterns for n in ns))
    out = {n: F.lit(None).cast("string") for n in names}
    for regex, groups in reversed(patterns):
        hit = F.col(path).rlike(regex)
        for n in names:
            value = F.regexp_extract(path, regex, groups.index(n) + 1) if n in groups else F.lit(None).cast("string")
            out[n] = F.when(hit, value).otherwise(out[n])
    return files.withColumns(out)


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length) of all files under a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root).select("path", "length")


def catalog_scan(spark: SparkSession, tables: dict[str, DataFrame], labels: dict[str, str] | None = None) -> DataFrame:
    """(dataset, variable, type, label, n_rows): a row for each column of each table."""
    out = None
    for name, df in tables.items():
        rows = [(name, f.name, f.dataType.simpleString(), (labels or {}).get(f.name) or f.metadata.get("label")) for f in df.schema]
        one = spark.createDataFrame(rows, "dataset string, variable string, type string, label string").crossJoin(df.agg(F.count("*").alias("n_rows")))
        out = one if out is None else out.unionAll(one)
    return out


def catalog_find(index: DataFrame, pattern: str, regex: bool = False) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "variable", "label"))
    return index.filter(text.rlike(pattern.lower()) if regex else text.contains(pattern.lower()))


def write_by_wave(df: DataFrame, path: str, wave: str, keys: list[str]) -> dict:
    """One folder a wave with only the columns it has values in (and ``keys``); returns the columns written by wave."""
    cols = [c for c in df.columns if c not in (wave, *keys)]
    filled = df.groupBy(wave).agg(*[F.count(c).alias(c) for c in cols]).collect()  # a row a wave
    written = {r[wave]: [*keys, *[c for c in cols if r[c]]] for r in filled}
    for w, held in written.items():
        df.filter(F.col(wave) == w).select(*held).write.mode("overwrite").parquet(f"{path}/{wave}={w}")
    return written


def poolable(meta: DataFrame, min_rows: int, min_years: int = 2) -> DataFrame:
    """Modules of ``meta`` (module, year, n_rows) that have enough rows in enough years."""
    kept = meta.filter(F.col("n_rows") >= min_rows)
    return kept.groupBy("module").agg(F.count_distinct("year").alias("n_years"), F.sum("n_rows").alias("n_rows")).filter(F.col("n_years") >= min_years)


def pixels(df: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Centre and area in hectares of each pixel (row, col, value) of a grid in degrees whose upper left corner is x0, y0."""
    lon, lat = x0 + (F.col("col") + 0.5) * dx, y0 - (F.col("row") + 0.5) * dy
    metres = 6371008.8 * 3.141592653589793 / 180
    return df.withColumns({"lon": lon, "lat": lat, "ha": dx * dy * metres * metres * F.cos(F.radians(lat)) / 10000})


