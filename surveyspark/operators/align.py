"""Wave alignment: which waves of a variable share one pooled column, and pooling by these decisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.recode import compress, resolve_types
from surveyspark.functions.text import jaccard, same_category, tokens
from surveyspark.sources.scratch import dealt, materialize

from .sets import pool

#: Codes for "don't know" that are left out of observed ranges.
SENTINELS = (98, 99, 998, 999, 9998, 9999)


def observed(df: DataFrame, wave: str, cols: list[str], sentinels: tuple = SENTINELS) -> DataFrame:
    """(variable, wave, low, high, codes): range and codes seen, sentinels left out. Codes are few; kept as a sorted array."""
    long = df.select(F.col(wave).alias("wave"), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(["wave"], cols, "variable", "value")
    seen = long.filter(F.col("value").isNotNull() & ~F.col("value").isin(*map(float, sentinels)))
    return seen.groupBy("variable", "wave").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.array_sort(F.collect_set("value")).alias("codes"))


def compatible_pairs(labels: DataFrame, seen: DataFrame) -> DataFrame:
    """(variable, wave_a, wave_b, compatible, reason) for all pairs of waves, a before b, of each variable.

    Waves conflict where one code has texts of different meaning, or where a wave without labels has values beyond the
    other's codes. ``labels`` (variable, wave, code, text) and ``seen`` are catalogues.
    """
    waves = seen.select("variable", "wave").union(labels.select("variable", "wave")).distinct()
    pairs = waves.withColumnRenamed("wave", "wave_a").join(waves.withColumnRenamed("wave", "wave_b"), "variable").filter("wave_a < wave_b")
    side = lambda s: labels.select("variable", "code", F.col("wave").alias(f"wave_{s}"), F.col("text").alias(f"text_{s}"))
    both = side("a").join(side("b"), ["variable", "code"]).filter("wave_a < wave_b")
    texts = same_category(both.select("text_a", "text_b").distinct(), "text_a", "text_b")
    conflicts = both.join(texts, ["text_a", "text_b"]).groupBy("variable", "wave_a", "wave_b").agg(F.min(F.when(~F.col("same"), F.concat_ws(": ", F.col("code").cast("string"), F.concat_ws(" / ", "text_a", "text_b")))).alias("conflict"))
    top = labels.groupBy("variable", "wave").agg(F.max("code").cast("double").alias("top"))
    ends = waves.join(top, ["variable", "wave"], "left").join(seen.select("variable", "wave", "high"), ["variable", "wave"], "left")
    end = lambda s: ends.select("variable", F.col("wave").alias(f"wave_{s}"), F.col("top").alias(f"top_{s}"), F.col("high").alias(f"high_{s}"))
    out = pairs.join(conflicts, ["variable", "wave_a", "wave_b"], "left").join(end("a"), ["variable", "wave_a"]).join(end("b"), ["variable", "wave_b"])
    beyond = (F.col("top_a").isNull() & (F.col("high_a") > F.col("top_b"))) | (F.col("top_b").isNull() & (F.col("high_b") > F.col("top_a")))
    reason = F.when(F.col("conflict").isNotNull(), F.col("conflict")).when(F.coalesce(beyond, F.lit(False)), "values beyond labels")
    return out.select("variable", "wave_a", "wave_b", reason.isNull().alias("compatible"), reason.alias("reason"))


def similar_pairs(var_labels: DataFrame, threshold: float) -> DataFrame:
    """(variable, wave_a, wave_b, similarity, similar) by token overlap of variable labels."""
    side = lambda s: var_labels.select("variable", F.col("wave").alias(f"wave_{s}"), F.col("label").alias(f"label_{s}"))
    pairs = side("a").join(side("b"), "variable").filter("wave_a < wave_b")
    value = jaccard(tokens(F.col("label_a")), tokens(F.col("label_b")))
    return pairs.select("variable", "wave_a", "wave_b", value.alias("similarity"), (value >= threshold).alias("similar"))


def version_groups(pairs: DataFrame, order: list, align: dict | None = None, split: dict | None = None) -> DataFrame:
    """(variable, wave, pooled_column) from ``pairs`` (variable, wave_a, wave_b, similar, compatible).

    Waves are taken in ``order``; each joins the first open group with whose every wave it is similar and compatible, else
    it opens a group. ``align`` variables need no similar labels; ``split`` gives closed groups of waves. The largest group
    (the first of equals) keeps the name, the others get _v2, _v3.
    """
    rank = {w: i for i, w in enumerate(order)}
    align, split = set(align or ()), split or {}

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        variable = rows["variable"].iloc[0]
        ok = {(r.wave_a, r.wave_b): bool(r.compatible) and (bool(r.similar) or variable in align) for r in rows.itertuples()}
        waves = sorted({*rows["wave_a"], *rows["wave_b"]}, key=lambda w: rank.get(w, len(rank)))
        groups = [[w for w in g if w in waves] for g in split.get(variable, [])]
        closed = {w for g in groups for w in g}
        free: list[list] = []
        for w in waves:
            if w in closed:
                continue
            fits = next((g for g in free if all(ok.get((min(w, v), max(w, v)), False) for v in g)), None)
            free.append([w]) if fits is None else fits.append(w)
        groups = [g for g in groups + free if g]
        first = max(range(len(groups)), key=lambda i: (len(groups[i]), -i))
        names = [variable if i == first else "" for i in range(len(groups))]
        n = 1
        for i in range(len(groups)):
            if i != first:
                n += 1
                names[i] = f"{variable}_v{n}"
        return pd.DataFrame([(variable, w, name) for g, name in zip(groups, names, strict=True) for w in g], columns=["variable", "wave", "pooled_column"])

    wave = pairs.schema["wave_a"].dataType.simpleString()
    return pairs.groupBy("variable").applyInPandas(decide, f"variable string, wave {wave}, pooled_column string")


def merge_labels(labels: DataFrame, decisions: DataFrame, rank: str = "wave") -> DataFrame:
    """(pooled_column, code, text, n_texts): the latest wave's text wins; how many texts there were."""
    placed = labels.join(decisions, ["variable", "wave"])
    return placed.groupBy("pooled_column", "code").agg(F.max_by("text", rank).alias("text"), F.count_distinct("text").alias("n_texts"))


def pool_versions(frames: dict, decisions: list[tuple], keys: list[str]) -> DataFrame:
    """Waves renamed by ``decisions`` (variable, wave, pooled_column), types resolved, united, keys first, compressed, exact copies dropped.

    Each wave is written on its own, so that no task makes several waves and drops copies as well.
    """
    names: dict = {}
    for variable, wave, column in decisions:
        names.setdefault(wave, {})[variable] = column
    renamed = [df.select(*[F.col(c).alias(names.get(w, {}).get(c, c)) for c in df.columns]) for w, df in frames.items()]
    out = pool(resolve_types([materialize(df, "wave") for df in renamed]))
    return dealt(compress(out.select(*keys, *[c for c in out.columns if c not in keys]), keep_double=tuple(keys))).dropDuplicates()


def pool_modules(modules: dict, canonical: dict, keys: list[str], least: int = 2) -> dict[str, DataFrame]:
    """Modules ``{(wave, stem): frame}`` pooled under their canonical names, those with at least ``least`` waves."""
    groups: dict[str, dict] = {}
    for (wave, stem), df in modules.items():
        groups.setdefault(canonical.get(stem, stem), {})[wave] = df
    return {name: pool_versions(frames, [], keys) for name, frames in groups.items() if len(frames) >= least}


def classify_level(df: DataFrame, household: str, person: str | None) -> DataFrame:
    """One row: n, households, and the level: household, person, multi or other, from how unique the keys are."""
    keys = df.groupBy(household).agg(F.count("*").alias("n"), (F.count_distinct(person) if person else F.lit(0)).alias("p"))
    stats = keys.agg(F.sum("n").alias("n"), F.count("*").alias("households"), F.sum("p").alias("persons"))
    level = F.when(F.col("n") == F.col("households"), "household").when(F.col("n") == F.col("persons"), "person").when(F.col("persons") > 0, "multi").otherwise("other")
    return stats.select("n", "households", level.alias("level"))


def audit_versions(labels: DataFrame, seen: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs of waves inside one pooled column that are not compatible; must be empty."""
    pairs = compatible_pairs(labels, seen).filter("NOT compatible")
    side = lambda s: decisions.select("variable", F.col("wave").alias(f"wave_{s}"), F.col("pooled_column").alias(f"column_{s}"))
    return pairs.join(side("a"), ["variable", "wave_a"]).join(side("b"), ["variable", "wave_b"]).filter("column_a = column_b")
