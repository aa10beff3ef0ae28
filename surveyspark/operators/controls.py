"""A baseline control block by unit from a text table: household and person items in one aggregation each, geography joined.

Fixed values: the table states which codes of a baseline questionnaire count, and which mean "not stated"; these are missing.
Columns of a row: block | control | level | how | sources | counts | not stated.

how: ``share`` weighs the rows whose code counts against all other real codes; ``mean`` is a weighted mean; ``flag`` is a share in which
a missing code is a no; ``above`` is the share of values over a bound; ``ratio`` divides weighted sums (sources a/b, where b
may be a sum a+b); ``of`` is the share of values in the range among the rows whose second source has the code; ``log_sum``
is the logarithm of all weights; ``given`` comes from a table of the caller.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .agg import wmean
from .concepts import spans

BASELINE = """
household composition | hh_size | household | mean | household_size | |
household composition | female_head | household | flag | head_sex | 2 |
household composition | head_age | household | mean | head_age | |
household composition | share_u15 | person | flag | age | 0-14 |
household composition | share_65p | person | flag | age | 65-200 |
household composition | extended | person | share | relation_head | 7-8 | 99
household composition | nonrelative | person | share | relation_head | 9 | 99
household composition | child_head | person | of | age+relation_head | 0-17; 1 |
household composition | never_married | person | share | marital_grouped | 1 | 99
household composition | divorced | person | share | marital_grouped | 8 | 99
war and genocide legacy | widowed | person | share | marital_grouped | 9 | 99
war and genocide legacy | handicap | person | share | handicap_type | 2-8 | 9
war and genocide legacy | war_disab | person | flag | handicap_cause | 4-6 |
war and genocide legacy | orphan_double | person | share | parents_survival | 4 | 5,9
war and genocide legacy | orphan_any | person | share | parents_survival | 2-4 | 5,9
resettlement and origin | newcomer5 | person | share | residence_duration | 0-4 | 98
resettlement and origin | foreign_born | person | share | birth_place | 2000-9998 | 9999
resettlement and origin | prev_abroad | person | share | previous_residence | 2000-9998 | 9999
resettlement and origin | foreign_national | person | share | nationality | 0-99,101-998 | 999
resettlement and origin | english | person | share | languages_spoken | 8-15,24-31 | 99
resettlement and origin | french | person | share | languages_spoken | 2-3,6-7,10-11,14-15,18-19,22-23,26-27,30-31 | 99
resettlement and origin | swahili | person | share | languages_spoken | 4-7,12-15,20-23,28-31 | 99
mobility and residence | absent_share | household | ratio | absent/residents | |
mobility and residence | visitor_share | household | ratio | visitors/residents+visitors | |
mobility and residence | sex_ratio | household | ratio | male/female | |
marriage | cohabiting | person | share | marital_status | 2 | 99
marriage | polygamous | person | share | marital_status | 4-7 | 99
religion | catholic | person | share | religion | 1 | 99
religion | protestant | person | share | religion | 2 | 99
religion | muslim | person | share | religion | 6 | 99
settlement and structure | urban | household | flag | urban | 1 |
settlement and structure | log_pop | person | log_sum | | |
settlement and structure | planned | household | share | settlement | 1,4 | 9
settlement and structure | onehh_house | household | share | dwelling_type | 1 | 9
settlement and structure | owner | household | share | tenure | 1 | 9
baseline amenities and assets | electric | household | share | lighting_source | 1-2 | 9
baseline amenities and assets | firewood | household | share | cooking_energy | 4 | 9
baseline amenities and assets | rooms | household | mean | living_rooms | 0-89 |
baseline amenities and assets | radiotv | household | share | radio_television | 1-3 | 9
baseline amenities and assets | phone | household | share | telephone | 1-3 | 9
baseline amenities and assets | bicycle | household | above | bicycles | 0 | 99
terrain and access | elev_mean | terrain | given | mean | |
terrain and access | elev_sd | terrain | given | sd | |
terrain and access | slope_mean | terrain | given | slope | |
terrain and access | log_dist_capital | access | given | capital | log |
terrain and access | log_area | shape | given | area | log |
terrain and access | compactness | shape | given | compactness | |
terrain and access | log_dist_border | access | given | border | log |
terrain and access | log_dist_town | access | given | town | log |
climate | rain_mean | climate | given | mean | |
climate | rain_cv | climate | given | cv | |
climate | dry_months | climate | given | dry_months | |
climate | drought_freq | climate | given | drought_share | |
"""


@dataclass(frozen=True)
class Control:
    block: str
    name: str
    level: str
    how: str
    source: str
    counts: str
    unstated: str

    def column(self, w: str) -> Column:
        weight = F.col(w)
        of = lambda c: F.col(c.strip()).try_cast("double")
        among = lambda v, codes: reduce(or_, [v.between(a, b) for a, b in spans(codes)])
        if self.how == "log_sum":
            return F.log(F.sum(weight))
        if self.how == "ratio":
            top, bottom = (reduce(add, [F.sum(of(c) * weight) for c in side.split("+")]) for side in self.source.split("/"))
            return F.when(bottom > 0, top / F.nullif(bottom, F.lit(0.0)))
        first, *rest = self.source.split("+")
        v = of(first)
        real = v.isNotNull() & (~among(v, self.unstated) if self.unstated else F.lit(True))
        if self.how == "flag":
            x = F.coalesce(among(v, self.counts), F.lit(False)).cast("double")
        elif self.how == "share":
            x = F.when(real, among(v, self.counts).cast("double"))
        elif self.how == "above":
            x = F.when(real, (v > float(self.counts)).cast("double"))
        elif self.how == "mean":
            x = F.when(among(v, self.counts), v) if self.counts else v
        elif self.how == "of":
            inside, code = self.counts.split(";")
            x = F.when(among(of(rest[0]), code), F.coalesce(among(v, inside), F.lit(False)).cast("double"))
        else:
            raise ValueError(f"unknown kind of control: {self.how}")
        return wmean(x, weight)


def read_controls(table: str = BASELINE) -> list[Control]:
    return [Control(*(x.strip() for x in line.split("|"))) for line in table.strip().splitlines()]


def blocks(table: str = BASELINE) -> dict[str, list[str]]:
    """The controls of each block, in order."""
    out: dict[str, list[str]] = {}
    for c in read_controls(table):
        out.setdefault(c.block, []).append(c.name)
    return out


def control_block(tables: dict[str, DataFrame], unit: str, w: str, given: dict[str, DataFrame], table: str = BASELINE) -> DataFrame:
    """(unit, all controls of the table): ``tables`` by level (household, person) hold items and weights and are aggregated once each;
    ``given`` by level hold a row a unit. Units are those of the first table; what a table does not have is missing. Rows without a weight
    weigh 1. A control whose item or table is not there is an error.
    """
    controls, out = read_controls(table), None
    absent = [c.name for c in controls if c.level not in tables and c.level not in given]
    if absent:
        raise ValueError(f"no table for {absent}")
    for level, df in tables.items():
        mine = [c for c in controls if c.level == level]
        sums = df.withColumn(w, F.coalesce(F.col(w).cast("double"), F.lit(1.0))).groupBy(unit).agg(*[c.column(w).alias(c.name) for c in mine])
        out = sums if out is None else out.join(sums, unit, "left")
    for level, df in given.items():
        mine = [c for c in controls if c.level == level]
        out = out.join(df.select(unit, *[(F.log(c.source) if c.counts == "log" else F.col(c.source)).alias(c.name) for c in mine]), unit, "left")
    return out.select(unit, *[c.name for c in controls])
