"""Projections: recodes, composite keys, indicators, guarded ratios, bands and feature columns. All are column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def recode(col: Column, spec: dict) -> Column:
    """``{target: [sources]}``: the target of the value's source list, else null."""
    pairs = [(s, t) for t, sources in spec.items() for s in sources]
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), col) if pairs else F.lit(None)


def lookup(col: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), col)


def rule_text(spec: dict) -> str:
    """A recode rule in words."""
    return "; ".join(f"{'/'.join(map(str, s))} -> {t}" for t, s in spec.items())


def split_id(col: Column, *divisors: int) -> list[Column]:
    """Parts of a composite id from the left: what stands above each divisor, below the one before."""
    out, above = [], None
    for d in divisors:
        part = F.floor(col / d).cast("long")
        out.append(part if above is None else part % F.lit(above // d))
        above = d
    return out + [col % divisors[-1]]


def rebase(col: Column, group: Column, first: int = 1) -> Column:
    """A geographic code from its parent's code and its number within the parent (two digits)."""
    return group * 100 + col + first


def make_key(parts: list[Column], blank_if: Column | None = None) -> Column:
    """Parts joined by ``_``, a trailing ``.0`` taken off; null if a part is missing or not positive."""
    texts = [F.regexp_replace(p.cast("string"), r"\.0$", "") for p in parts]
    bad = reduce(or_, [p.isNull() for p in parts])
    return F.when(~(bad if blank_if is None else bad | blank_if), F.concat_ws("_", *texts))


def share(col: Column, keep: list, na: list = ()) -> Column:
    """1 in ``keep``, 0 for another real code, null if missing or in ``na``."""
    return F.when(col.isNull() | (col.isin(*na) if na else F.lit(False)), None).otherwise(col.isin(*keep).cast("double"))


def by_wave(wave: Column, cases: dict) -> Column:
    """One expression for each wave, null in other waves."""
    out = F.lit(None)
    for w, value in reversed(list(cases.items())):
        out = F.when(wave == w, value).otherwise(out)
    return out


def any_of(cols: list[Column]) -> Column:
    """1 if any is true, 0 if none is, null if all are null."""
    known = reduce(or_, [c.isNotNull() for c in cols])
    return F.when(known, reduce(or_, [F.coalesce(c, F.lit(False)) for c in cols]).cast("int"))


def any_yes(cols: list[Column], yes=1) -> Column:
    return reduce(or_, [c.eqNullSafe(F.lit(yes)) for c in cols])


def all_no(cols: list[Column], no=2, extra: list[Column] = ()) -> Column:
    return reduce(and_, [c.eqNullSafe(F.lit(no)) for c in cols] + list(extra))


def schooling_years(level: Column, grade: Column, start: dict, most: dict) -> Column:
    """Years from a level and the grade within it: years before the level plus the grade, at most what the level has."""
    base, cap = lookup(level, start), lookup(level, most)
    return F.when(level.isNull(), None).otherwise(base + F.least(F.coalesce(grade, F.lit(0)), cap))


def crosswalk(df: DataFrame, col: str, table: DataFrame, to: str) -> DataFrame:
    """``table`` (code, target, approximate) joined on ``col``: ``to`` and ``to``_approx; codes without a target are null."""
    known = table.select(F.col("code").alias(col), F.col("target").alias(to), F.col("approximate").alias(f"{to}_approx"))
    return df.join(known, col, "left")


def guarded_ratio(num: Column, den: Column, least: float = 0) -> tuple[Column, Column]:
    """The ratio where the denominator reaches ``least`` (and is not 0), and whether it is usable."""
    usable = F.coalesce((den >= least) & (den != 0), F.lit(False))
    return F.when(usable, num / den), usable


def bracket_mid(col: Column, mids: dict, top: float) -> Column:
    """Midpoint of a bracket code, the top bracket capped."""
    return F.least(lookup(col, mids), F.lit(top))


def deflate(df: DataFrame, value: str, year: str, index: DataFrame, base: int, out: str) -> DataFrame:
    """Real value at prices of ``base``; ``index`` (year, price) carries its last year forward. Index tables have a row a year."""
    last = index.agg(F.max("year").alias("__last"), F.max(F.when(F.col("year") == base, F.col("price"))).alias("__base"))
    joined = df.crossJoin(F.broadcast(last)).withColumn("__year", F.least(F.col(year), F.col("__last")))
    joined = joined.join(F.broadcast(index.select(F.col("year").alias("__year"), F.col("price").alias("__price"))), "__year", "left")
    return joined.withColumn(out, F.col(value) * F.col("__base") / F.col("__price")).drop("__year", "__price", "__last", "__base")


def band(col: Column, edges: list, labels: list[str], right: bool = True) -> Column:
    """Interval label: (a, b] if ``right``, else [a, b); null outside."""
    out = F.lit(None).cast("string")
    for a, b, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        out = F.when((col > a) & (col <= b) if right else (col >= a) & (col < b), label).otherwise(out)
    return out


def one_hot(col: str, values: list, omit=None, prefix: str | None = None) -> list[Column]:
    """0/1 columns for each value but ``omit``; null stays null."""
    return [(F.col(col) == v).cast("double").alias(f"{prefix or col}_{v}") for v in values if v != omit]


def drop_constant(df: DataFrame, cols: list[str]) -> DataFrame:
    """Without those of ``cols`` that do not vary; one pass over the data."""
    spread = df.agg(*[F.coalesce(F.var_pop(c), F.lit(0.0)).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if not spread[c] > 0])


def expand_candidates(cols: list[str], by: str | None = None) -> Column:
    """Squares and all pairwise products of ``cols`` as one array, times ``by`` if given."""
    terms = [F.col(a) * F.col(b) for i, a in enumerate(cols) for b in cols[i:]]
    return F.array(*[t * F.col(by) if by else t for t in terms])


def pairwise(x: Column) -> Column:
    """Squares and all pairwise products of an array's elements as one array, however many."""
    return F.flatten(F.transform(x, lambda v, i: F.transform(F.slice(x, i + 1, F.size(x)), lambda u: u * v)))


def zscore(df: DataFrame, cols: list[str], where: Column | None = None) -> DataFrame:
    """``c``_z with mean and deviation over the rows ``where`` (all rows otherwise)."""
    on = lambda c: F.when(where, F.col(c)) if where is not None else F.col(c)
    stats = df.agg(*[f(on(c)).alias(f"__{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.select(*df.columns, *[((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).alias(f"{c}_z") for c in cols])


def asinh_pos(col: Column) -> Column:
    return F.asinh(F.greatest(col, F.lit(0.0)))


def exposure(cohort: Column, last_unexposed: int, years: int) -> Column:
    """Ramp of a cohort's exposure from 0 to 1."""
    return F.least(F.greatest(cohort - last_unexposed, F.lit(0)), F.lit(years)) / years


def interact(flag: Column, period: Column, values: list, prefix: str) -> list[Column]:
    return [(flag.cast("double") * (period == v).cast("double")).alias(f"{prefix}_{v}") for v in values]


def fe_key(*cols: str) -> Column:
    return F.concat_ws("_", *cols)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in km."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(h))


def nearest_of(cols: dict[str, Column]) -> tuple[Column, Column]:
    """Smallest value and the name of the first column that has it."""
    least, name = F.least(*cols.values()), F.lit(None).cast("string")
    for n, c in reversed(list(cols.items())):
        name = F.when(c == least, n).otherwise(name)
    return least, name


def decay(volume: Column, km: Column, scale: float = 10.0) -> Column:
    return F.log1p(volume) * F.exp(-km / scale)


def shift_share(shares: DataFrame, shocks: DataFrame, unit: str, part: str, period: str) -> DataFrame:
    """Sum over parts of a unit's share times the part's shock in a period, with the sum of shares as a control."""
    joined = shares.join(shocks, part)
    return joined.groupBy(unit, period).agg(F.sum(F.col("share") * F.col("shock")).alias("exposure"), F.sum("share").alias("sum_shares"))


def derive_parent(child: Column, parent: Column, div: int) -> tuple[Column, Column]:
    """The parent's code, filled from the child where missing, and whether it was filled."""
    return F.coalesce(parent, F.floor(child / div).cast("int")), parent.isNull() & child.isNotNull()


def decode(df: DataFrame, col: str, labels: DataFrame, out: str, wave: str | None = None) -> DataFrame:
    """Text of a code in the wave's own ``labels`` ([wave,] code, text); codes without a label keep their number as text."""
    on = [c for c in (wave, col) if c]
    known = labels.select(*([F.col("wave").alias(wave)] if wave else []), F.col("code").alias(col), F.col("text").alias("__text"))
    return df.join(known, on, "left").withColumn(out, F.coalesce("__text", F.col(col).cast("string"))).drop("__text")


def strip_wave_prefix(df: DataFrame, wave: str, waves: list[str], sep: str = "_") -> DataFrame:
    """Columns without a wave prefix and those of ``wave``, the prefix taken off."""
    other = tuple(w + sep for w in waves if w != wave)
    own = wave + sep
    return df.select(*[F.col(c).alias(c.removeprefix(own)) for c in df.columns if not c.startswith(other)])


def label_fixes(value_label: DataFrame, fixes: DataFrame) -> DataFrame:
    """First matching fix by priority replaces a label: ``fixes`` (priority, pattern, wave_from, wave_to, code, text)."""
    from pyspark.sql.window import Window

    on = F.expr("variable RLIKE pattern AND wave BETWEEN wave_from AND wave_to AND code = fix_code")
    hits = value_label.join(F.broadcast(fixes.withColumnRenamed("text", "fix_text").withColumnRenamed("code", "fix_code")), on, "left")
    first = Window.partitionBy("variable", "wave", "code").orderBy(F.col("priority").asc_nulls_last())
    return hits.withColumn("__r", F.row_number().over(first)).filter("__r = 1").select("variable", "wave", "code", F.coalesce("fix_text", "text").alias("text"), F.col("fix_text").isNotNull().alias("fixed"))


def stamp(df: DataFrame, survey: str, year: int, wave: str, suffix: str = "_native") -> DataFrame:
    """Key columns first; native columns with their names are renamed."""
    clash = {c: c + suffix for c in ("survey", "year", "wave") if c in df.columns}
    named = df.withColumnsRenamed(clash)
    return named.select(F.lit(survey).alias("survey"), F.lit(year).alias("year"), F.lit(wave).alias("wave"), *named.columns)


def lower_names(df: DataFrame) -> DataFrame:
    """Lower-case names; of names that meet, all-missing columns go and the rest get ``_2``, ``_3``."""
    groups: dict[str, list[int]] = {}
    for i, c in enumerate(df.columns):
        groups.setdefault(c.lower(), []).append(i)
    flat = df.toDF(*[f"__{i}" for i in range(len(df.columns))])
    clash = [i for g in groups.values() if len(g) > 1 for i in g]
    filled = flat.agg(*[F.count(f"__{i}").alias(f"__{i}") for i in clash]).first() if clash else {}
    out = []
    for name, at in groups.items():
        kept = [i for i in at if len(at) == 1 or filled[f"__{i}"]] or at[:1]
        out += [(i, name if k == 0 else f"{name}_{k + 1}") for k, i in enumerate(kept)]
    return flat.select(*[F.col(f"__{i}").alias(n) for i, n in sorted(out)])


def destring(df: DataFrame, skip: tuple = ()) -> DataFrame:
    """Text columns whose every non-blank value parses become numbers; one pass decides."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]
    if not texts:
        return df
    value = lambda c: F.trim(F.col(c)).try_cast("double")
    bad = df.agg(*[F.count_if((F.trim(F.col(c)) != "") & value(c).isNull()).alias(c) for c in texts]).first()
    return df.withColumns({c: value(c) for c in texts if not bad[c]})


def compress(df: DataFrame, keep_double: tuple = ()) -> DataFrame:
    """Smallest exact integer type for each numeric column, by one pass over minima, maxima and fractions."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, (T.IntegralType, T.DoubleType, T.FloatType)) and f.name not in keep_double]
    if not numeric:
        return df
    whole = lambda c: F.coalesce(F.bool_and(F.col(c).cast("double") % 1 == 0), F.lit(True))
    row = df.agg(*[x for c in numeric for x in (F.min(c).alias(f"{c}__a"), F.max(c).alias(f"{c}__b"), whole(c).alias(f"{c}__w"))]).first()
    casts = {}
    for c in numeric:
        a, b = row[f"{c}__a"] or 0, row[f"{c}__b"] or 0
        if row[f"{c}__w"]:
            for kind, lo, hi in (("byte", -127, 100), ("short", -32767, 32740), ("int", -2147483620, 2147483620)):
                if lo <= a and b <= hi:
                    casts[c] = F.col(c).cast(kind)
                    break
    return df.withColumns(casts)


def resolve_types(frames: list[DataFrame], keep_str: tuple = ()) -> list[DataFrame]:
    """Columns that are text in some frames and numbers in others: numbers if all text parses, else text."""
    kinds: dict[str, set] = {}
    for df in frames:
        for f in df.schema:
            kinds.setdefault(f.name, set()).add(isinstance(f.dataType, T.StringType))
    mixed = [c for c, k in kinds.items() if len(k) == 2]
    parsed = [destring(df, skip=tuple(c for c in df.columns if c not in mixed or c in keep_str)) for df in frames]
    text = {c for c in mixed for df in parsed if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)}
    return [df.withColumns({c: F.col(c).cast("string") for c in text if c in df.columns}) for df in parsed]
