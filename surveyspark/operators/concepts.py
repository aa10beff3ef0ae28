"""A compiler of concept rules: a text table becomes projections.

Rows of the table name waves, a concept and how it comes from native columns or from other concepts. Concepts are ordered by
what they need, level by level; each becomes one expression, in which every row is gated by its waves and a later row stands
over an earlier one. A level is one projection, however many waves and rows there are, without a join or a shuffle.

Defined cases: codes that no row names, and text that is no number, are missing; a row with a source that the table does not
have is left out and documented as missing; concepts that need each other are an error, as is a concept named like a column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce
from graphlib import TopologicalSorter
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .concept_rules import DATASETS

HOW = ("codes", "same", "yes", "no", "both", "known", "none")


@dataclass(frozen=True)
class ConceptRule:
    waves: tuple[tuple[int, int], ...]
    concept: str
    how: str
    sources: tuple[str, ...]
    rule: str
    quality: str
    note: str
    condition: tuple[str, str] | None = None

    @property
    def needs(self) -> tuple[str, ...]:
        return self.sources + (self.condition[:1] if self.condition else ())


def spans(text: str) -> tuple[tuple[int, int], ...]:
    """'1,4-6' as ((1, 1), (4, 6))."""
    return tuple((int(a), int(b or a)) for a, _, b in (part.strip().partition("-") for part in text.split(",")))


def read_rules(table: str) -> list[ConceptRule]:
    out = []
    for line in filter(None, map(str.strip, table.splitlines())):
        waves, concept, how, sources, rule, quality, note = (x.strip() for x in line.split("|"))
        if how not in HOW:
            raise ValueError(f"unknown kind of rule: {line}")
        condition = re.match(r"if (\w+)=([\d,-]+):\s*", rule)
        out.append(ConceptRule(spans(waves), concept, how, tuple(s.strip() for s in sources.split("+") if s.strip()), rule[condition.end() :] if condition else rule, quality, note, condition.groups() if condition else None))
    return out


def within(value: Column, text: str) -> Column:
    """The value is one of the codes; false where it is missing."""
    return F.coalesce(reduce(or_, [value.between(a, b) if a != b else value == a for a, b in spans(text)]), F.lit(False))


def target_of(value: Column, rule: str) -> Column:
    """Targets by code: one array from the least code to the greatest, read at the code's place."""
    at = {code: int(target) for target, codes in (part.split("=") for part in rule.split(";")) for a, b in spans(codes) for code in range(a, b + 1)}
    first = min(at)
    return F.get(F.array(*[F.lit(at.get(c)).cast("int") for c in range(first, max(at) + 1)]), value - first)


def value_of(rule: ConceptRule, of: dict[str, Column]) -> Column:
    """The rule's value in its own waves; null where it says nothing."""
    sources = [of[s] for s in rule.sources]
    if rule.how == "codes":
        out = target_of(sources[0], rule.rule)
    elif rule.how == "same":
        out = F.when(within(sources[0], rule.rule), sources[0])
    elif rule.how == "yes":
        out = F.when(reduce(or_, [within(s, "1") for s in sources]), int(rule.rule))
    elif rule.how == "no":
        target, *more = (x.strip() for x in rule.rule.split(","))
        also = dict(x.split("=") for x in more)
        out = F.when(reduce(and_, [within(of[s], f"2,{also[s]}" if s in also else "2") for s in rule.sources]), int(target))
    elif rule.how == "both":
        out = F.when(reduce(and_, [within(s, "1") for s in sources]), 1).when(reduce(or_, [within(s, "2") for s in sources]), 0)
    else:  # known
        out = F.when(sources[0].isNotNull(), int(rule.rule))
    return F.when(within(of[rule.condition[0]], rule.condition[1]), out) if rule.condition else out


def usable(rules: list[ConceptRule], columns: set[str]) -> list[ConceptRule]:
    """Rules with all that they need; of yes and no rules those items that are there. A concept is there if one of its rules is."""
    known, before = set(columns) | {r.concept for r in rules}, None
    while known != before:
        before, out = known, []
        for r in rules:
            have = tuple(s for s in r.sources if s in known)
            if r.how in ("yes", "no"):
                r = replace(r, sources=have)
            if r.how != "none" and have and all(s in known for s in r.needs):
                out.append(r)
        known = set(columns) | {r.concept for r in out}
    return out


def carrier(native: str, wave: str, columns: list[str], carriers: dict[tuple[str, int], str]) -> Column | None:
    """The native item's code by wave: of the column that carries it in the waves named in ``carriers``, elsewhere of that of its own name."""
    named = {w: c for (item, w), c in carriers.items() if item == native and c in columns}
    text = lambda c: F.col(f"`{c}`").cast("string")
    if not named and native not in columns:
        return None
    out = text(native) if native in columns else F.lit(None).cast("string")
    for w, c in named.items():
        out = F.when(F.col(wave) == w, text(c)).otherwise(out)
    # Whole numbers, however they are written; what is no number or no whole one has no code.
    number = out.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def levels(rules: list[ConceptRule]) -> list[list[str]]:
    """Concepts by what they need: those of a level need only native items and concepts of earlier levels."""
    names = list(dict.fromkeys(r.concept for r in rules))
    sorter, out = TopologicalSorter({c: {s for r in rules if r.concept == c for s in r.needs if s in names} for c in names}), []
    sorter.prepare()
    while sorter.is_active():
        ready = sorter.get_ready()
        out.append([c for c in names if c in ready])
        sorter.done(*ready)
    return out


def add_concepts(df: DataFrame, dataset: str | list[ConceptRule], wave: str = "wave", carriers: dict[tuple[str, int], str] | None = None) -> DataFrame:
    """``df`` with a column for each concept of a dataset; rows and native columns stay. ``wave`` is a number."""
    rules = read_rules(DATASETS[dataset]) if isinstance(dataset, str) else dataset
    names = list(dict.fromkeys(r.concept for r in rules))
    if clash := set(names) & set(df.columns):
        raise ValueError(f"concepts clash with columns: {sorted(clash)}")
    codes = {n: c for n in sorted({s for r in rules for s in r.needs} - set(names)) if (c := carrier(n, wave, df.columns, carriers or {})) is not None}
    of = {n: F.col(f"__{n}") for n in codes} | {c: F.col(c) for c in names}
    use, out = usable(rules, set(codes)), df.withColumns({f"__{n}": c for n, c in codes.items()})
    for some in levels(rules):
        rows = {c: [F.when(reduce(or_, [F.col(wave).between(a, b) for a, b in r.waves]), value_of(r, of)) for r in use if r.concept == c] for c in some}
        out = out.withColumns({c: F.coalesce(*reversed(rows[c]), F.lit(None).cast("int")) for c in some})
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *names)


def concept_map(spark: SparkSession, dataset: str | list[ConceptRule], columns: list[str], carriers: dict[tuple[str, int], str] | None = None) -> DataFrame:
    """The rules as documentation; a rule whose sources are not there has quality 'missing'."""
    rules = read_rules(DATASETS[dataset]) if isinstance(dataset, str) else dataset
    have = {item for (item, _), c in (carriers or {}).items() if c in columns} | set(columns)
    known = {(r.waves, r.concept, r.how, r.rule) for r in usable(rules, have)}
    text = lambda pairs: ",".join(str(a) if a == b else f"{a}-{b}" for a, b in pairs)
    rows = [(text(r.waves), r.concept, "+".join(r.sources), r.how, ("if {}={}: ".format(*r.condition) if r.condition else "") + r.rule, r.quality if (r.waves, r.concept, r.how, r.rule) in known else "missing", r.note) for r in rules]
    return spark.createDataFrame(rows, "waves string, concept string, sources string, how string, rule string, quality string, note string")


def second_route(df: DataFrame, checks: dict[str, tuple[Column, Column]], by: list[str]) -> DataFrame:
    """(by, check, n_known, n_equal): a concept against an independent recode of its sources, in one pass over ``df``."""
    named = list(checks.items())
    sums = [x for i, (_, (a, b)) in enumerate(named) for x in (F.count_if(b.isNotNull()).alias(f"k{i}"), F.count_if(a.eqNullSafe(b) & b.isNotNull()).alias(f"e{i}"), F.count_if(a.isNotNull() & b.isNull()).alias(f"x{i}"))]
    wide = df.groupBy(*by).agg(*sums)
    rows = F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"k{i}").alias("n_known"), F.col(f"e{i}").alias("n_equal"), F.col(f"x{i}").alias("n_extra")) for i, (name, _) in enumerate(named)]))
    return wide.select(*by, rows)
