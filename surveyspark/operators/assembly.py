"""Assembly of a survey wave: modules in, a person and a household file out.

Keys are discovered, not declared. One pass over a module sketches the number of distinct rows of every small set of its
candidate columns; only sets that the sketch lets pass are counted exactly, smallest first, and a set that holds a known key is
not looked at. From the keys follow each module's level, and from exact counts of varying groups which columns depend on the
household alone. Modules then join by level along a tree: household modules onto the household base, person modules onto
the roster, the household's keys onto both, the roster's counts and head back onto the household.

Defined cases: a key has no missing part; a module without rows has no key and level ``other``; modules whose household ids meet
the base in under half of their rows go through a crosswalk if that meets it nearly always, else they are ``other``; modules
with several rows a person or household (``multi``) stay as they are, with the household's keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from surveyspark.sources.scratch import dealt, materialize

from .joins import attach_keys, coalescing_join, map_keys_if_better

#: Relative error of the sketches; a set passes with twice that.
ERROR = 0.03


def small_sets(df: DataFrame, candidates: list[str], most: int = 3) -> list[list[str]]:
    cols = [c for c in candidates if c in df.columns]
    return [list(s) for k in range(1, most + 1) for s in combinations(cols, k)]


def sketches(sets: list[list[str]]) -> list[Column]:
    """Aggregates of one pass: the rows, about how many distinct ones without a gap each set has, and the gaps of each column."""
    whole = lambda s: F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in s], F.lit(0)) == 0, F.xxhash64(*s))
    gaps = [F.count_if(F.col(s[0]).isNull()).alias(f"m_{s[0]}") for s in sets if len(s) == 1]
    return [F.count("*").alias("n"), *[F.approx_count_distinct(whole(s), ERROR).alias(f"d{i}") for i, s in enumerate(sets)], *gaps]


def exact_keys(df: DataFrame, sets: list[list[str]], row: Row) -> list[list[str]]:
    """Those of ``sets`` that are keys, none within another; ``row`` holds their sketches. Only what the sketch lets pass is counted, in tasks of a bounded number of rows."""
    found: list[list[str]] = []
    for i, s in enumerate(sets):
        if not row["n"] or any(row[f"m_{c}"] for c in s) or any(set(k) <= set(s) for k in found) or row[f"d{i}"] < (1 - 2 * ERROR) * row["n"]:
            continue
        if dealt(df.select(*s)).groupBy(*s).count().filter("count > 1").limit(1).count() == 0:
            found.append(s)
    return found


def discover_keys(df: DataFrame, candidates: list[str], most: int = 3) -> list[list[str]]:
    """The minimal sets of up to ``most`` candidate columns that identify a row and are never missing, small sets first."""
    sets = small_sets(df, candidates, most)
    return exact_keys(df, sets, df.agg(*sketches(sets)).first()) if sets else []


def dependencies(df: DataFrame, on: list[str], columns: list[str] | None = None) -> DataFrame:
    """(column, n_groups, n_varying, depends): for each column in how many groups of ``on`` it varies; missing values count as a value."""
    cols = [c for c in columns or df.columns if c not in on]
    state = [x for i, c in enumerate(cols) for x in (F.min(F.xxhash64(c)).alias(f"a{i}"), F.max(F.xxhash64(c)).alias(f"b{i}"))]
    groups = df.groupBy(*on).agg(*state)
    counts = groups.agg(F.count("*").alias("n_groups"), *[F.count_if(F.col(f"a{i}") != F.col(f"b{i}")).alias(f"v{i}") for i in range(len(cols))])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("n_varying"), (F.col(f"v{i}") == 0).alias("depends")) for i, c in enumerate(cols)]))
    return counts.select("n_groups", rows)


class Wave:
    """The files of a wave and what was found on the way: (module, level, rows, key, match_rate) and the joins' reports. Files are made when they are asked for."""

    def __init__(self, spark: SparkSession, modules: dict[str, DataFrame], levels: list[tuple], joins: dict[str, DataFrame], make_person: Callable[[dict], DataFrame | None], make_household: Callable[[dict, DataFrame | None], DataFrame]) -> None:
        self.spark, self.modules, self.levels = spark, modules, levels
        self._joins, self._make_person, self._make_household = joins, make_person, make_household

    @cached_property
    def person(self) -> DataFrame | None:
        return self._make_person(self._joins)

    @cached_property
    def household(self) -> DataFrame:
        return self._make_household(self._joins, self.person)

    @property
    def joins(self) -> dict[str, DataFrame]:
        return self._joins if self.household is not None else {}

    def report(self) -> DataFrame:
        return self.spark.createDataFrame(self.levels, "module string, level string, n long, key string, match_rate double")


def level_of(keys: list[list[str]], household: str, person: str, rate: float | None) -> str:
    """household, person, multi or other, from a module's keys and its match with the household base."""
    if rate is not None and rate < 0.5:
        return "other"
    sets = [frozenset(k) for k in keys]
    return "household" if {household} in sets else "person" if any(k <= {household, person} for k in sets) else "multi"


def assemble_wave(
    modules: dict[str, DataFrame], household: str, person: str, base: list[str], roster: str | None, key_columns: list[str],
    candidates: list[str] = (), crosswalk: tuple[str, str] | None = None, prefer: tuple = (), head: tuple[Column, list[str]] | None = None,
) -> Wave:
    """Person and household file of one wave.

    ``base``: modules that make the household base; ``roster``: the module with a row a person; ``key_columns``: the household's
    design columns, which go onto every row; ``crosswalk``: (module, old key column) for modules under an older household key;
    ``prefer``: modules that are the canonical source of what they share with the base; ``head``: which person is the head, and the
    fields of the head that go onto the household.
    """
    joins: dict[str, DataFrame] = {}
    # Every module with a household is made once.
    modules = {name: materialize(df, name) if household in df.columns else df for name, df in modules.items()}
    homes = modules[base[0]]
    for name in base[1:]:
        homes, joins[name] = coalescing_join(homes, modules[name], [household], name, name in prefer, tuple(key_columns))
    homes = materialize(homes, "household-base") if len(base) > 1 else homes
    keys = materialize(homes.select(household, *[c for c in key_columns if c in homes.columns]).dropDuplicates([household]), "household-keys")
    known = keys.select(F.col(household).alias("__known"))
    old = None
    if crosswalk and crosswalk[0] in modules:
        old = modules[crosswalk[0]].select(F.col(crosswalk[1]).alias("old"), F.col(household).alias("new")).dropDuplicates(["old"])
    levels, plain, placed = [], {}, {}
    for name, df in modules.items():
        rate, n, found = None, None, []
        if household in df.columns:
            sets = small_sets(df, list(dict.fromkeys([household, person, *candidates])))
            ids = list(dict.fromkeys(c for s in sets for c in s))
            # Rows, match and sketches of keys come from one pass.
            look = lambda df, ids=ids, sets=sets: df.select(*ids).join(known, F.col(household) == F.col("__known"), "left").agg(F.avg(F.col("__known").isNotNull().cast("double")).alias("rate"), *sketches(sets)).first()
            row = look(df)
            if old is not None and name != crosswalk[0]:
                mapped = map_keys_if_better(df, household, keys, old, rate=row["rate"] or 0.0)
                if mapped is not df:
                    df = materialize(mapped, name)
                    row = look(df)
            rate, n, found = row["rate"], row["n"], exact_keys(df, sets, row)
        level = "other" if rate is None else level_of(found, household, person, rate)
        plain[name] = df
        placed[name] = attach_keys(df, keys, [household]).drop("in_sample") if level != "other" and name not in base else df
        levels.append((name, level, df.count() if n is None else n, "+".join(found[0]) if found else None, rate))
    of = {name: level for name, level, *_ in levels}
    design = {household, person, *key_columns}
    extra = lambda df, on: df.select(*on, *[c for c in df.columns if c not in design])

    def make_person(joins: dict) -> DataFrame | None:
        if not roster:
            return None
        people, order = plain[roster], placed[roster].columns
        for name, df in plain.items():
            if name != roster and of[name] == "person":
                people, joins[name] = coalescing_join(people, extra(df, [household, person]), [household, person], name, name in prefer)
        # The household's keys come last, so that what the joins look at is not joined with them each time.
        if of[roster] != "other" and roster not in base:
            people = attach_keys(people, keys, [household]).drop("in_sample")
        return materialize(people.select(*order, *[c for c in people.columns if c not in order]), "person-file")

    def make_household(joins: dict, people: DataFrame | None) -> DataFrame:
        out = homes.withColumnsRenamed({"hhsize": "hhsize_native"}) if people is not None and "hhsize" in homes.columns else homes
        for name, df in plain.items():
            if name not in base and of[name] == "household":
                out, joins[name] = coalescing_join(out, extra(df, [household]), [household], name, name in prefer)
        if people is None:
            return out
        sums = [F.count("*").alias("hhsize")]
        if head:
            sums += [F.first(F.when(head[0], F.col(c)), ignorenulls=True).alias(f"head_{c}") for c in head[1]]
        return out.join(people.groupBy(household).agg(*sums), household, "left")

    return Wave(keys.sparkSession, placed, levels, joins, make_person, make_household)


def check_wave(wave: Wave, household: str, person: str, weight: str) -> DataFrame:
    """(section, name, ours, reference, result): unique households and persons, weights there and positive, sizes adding up to the persons, heads."""
    homes = wave.household.agg(F.count("*").alias("n"), F.count_distinct(household).alias("d"), F.sum("hhsize").alias("size"), F.count_if(~F.coalesce(F.col(weight) > 0, F.lit(False))).alias("bad"))
    people = wave.person.agg(F.count("*").alias("p"), F.count_distinct(household, person).alias("q"), F.count_if(~F.coalesce(F.col(weight) > 0, F.lit(False))).alias("pbad"))
    line = lambda name, a, b: F.struct(F.lit("wave").alias("section"), F.lit(name).alias("name"), a.cast("double").alias("ours"), b.cast("double").alias("reference"), F.when(a == b, "ok").otherwise("FAIL").alias("result"))
    c = F.col
    lines = [line("households", c("d"), c("n")), line("persons", c("q"), c("p")), line("sizes", c("size"), c("p")), line("household weights", c("bad"), F.lit(0)), line("person weights", c("pbad"), F.lit(0))]
    return homes.crossJoin(F.broadcast(people)).select(F.inline(F.array(*lines)))  # two rows of counts
