"""Harmonised concepts from a rule table: one generic job applies it and documents it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.recode import lookup, rule_text

from .agg import wshare


@dataclass(frozen=True)
class Rule:
    """How one concept comes from a wave's columns. ``kind``: map (codes of the first source), flag (any source equals ``yes``), range (first source in low..high), override (map, then ``when`` sets ``to``)."""

    dataset: str
    waves: tuple
    concept: str
    sources: tuple
    kind: str = "map"
    codes: dict = field(default_factory=dict)
    yes: tuple = (1,)
    when: str = ""
    to: int | None = None
    quality: str = "exact"
    note: str = ""

    def column(self) -> Column:
        first = F.col(self.sources[0])
        if self.kind == "map":
            return lookup(first, {s: t for t, sources in self.codes.items() for s in sources})
        if self.kind == "flag":
            cond = [F.coalesce(F.col(s).isin(*self.yes), F.lit(False)) for s in self.sources]
            known = F.coalesce(*[F.col(s).cast("string") for s in self.sources]).isNotNull()
            hit = cond[0]
            for c in cond[1:]:
                hit = hit | c
            return F.when(known, hit.cast("int"))
        if self.kind == "range":
            return F.when(first.between(self.codes["low"], self.codes["high"]), first)
        if self.kind == "override":
            return F.when(F.expr(self.when), self.to).otherwise(lookup(first, {s: t for t, sources in self.codes.items() for s in sources}))
        raise ValueError(f"unknown kind of rule: {self.kind}")


def harmonise(df: DataFrame, rules: list[Rule], dataset: str, wave: str = "wave") -> DataFrame:
    """A column for each concept; null in waves without a rule. Rows and native columns stay; a concept may not clash with a column."""
    mine = [r for r in rules if r.dataset == dataset]
    concepts = list(dict.fromkeys(r.concept for r in mine))
    if clash := set(concepts) & set(df.columns):
        raise ValueError(f"concepts clash with columns: {sorted(clash)}")
    out = {}
    for c in concepts:
        value = F.lit(None).cast("int")
        for r in reversed([r for r in mine if r.concept == c]):
            value = F.when(F.col(wave).isin(*r.waves), r.column().cast("int")).otherwise(value)
        out[c] = value
    return df.withColumns(out)


def document(spark, rules: list[Rule]) -> DataFrame:
    """The rule table as documentation rows."""
    rows = [(r.dataset, ",".join(map(str, r.waves)), r.concept, ",".join(r.sources), r.kind, rule_text(r.codes) if r.kind in ("map", "override") else str(r.codes or r.yes), r.quality, r.note) for r in rules]
    return spark.createDataFrame(rows, "dataset string, waves string, concept string, sources string, kind string, rule string, quality string, note string")


def harmonise_all(tables: dict[str, DataFrame], rules: list[Rule], keys: dict[str, Column]) -> DataFrame:
    """Every dataset's keys and concepts in one table, with the dataset's name; row counts are unchanged."""
    out = None
    for name, df in tables.items():
        concepts = list(dict.fromkeys(r.concept for r in rules if r.dataset == name))
        one = harmonise(df, rules, name).select(F.lit(name).alias("dataset"), "wave", *[k.alias(n) for n, k in keys.items()], *concepts)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def employment_ratio(df: DataFrame, by: list[str], status: str, employed: tuple, w: str) -> DataFrame:
    flag = F.when(F.col(status).isNotNull(), F.col(status).isin(*employed))
    return df.groupBy(*by).agg(wshare(flag, F.col(w)).alias("ratio"), F.sum(F.when(F.col(status).isNotNull(), F.col(w))).alias("people"))
