"""Names, labels and category texts."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say nothing about what a label means.
STOP_WORDS = (
    "the", "a", "an", "of", "in", "to", "for", "is", "are", "was", "were", "do", "does", "did",
    "name", "names", "you", "your", "he", "she", "his", "her", "and", "or", "at", "on", "by", "with",
)


def _plain_forms() -> tuple[str, str]:
    """Letters and digits whose compatibility decomposition is one ASCII letter or digit and marks; and these."""
    pairs = []
    for code in range(0x80, 0x10000):
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0].isascii() and base[0].isalnum():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _plain_forms()


def name_key(col: Column) -> Column:
    """The key of a place's name: without accents, leading code and case, and only its letters and digits. Null has the key ''."""
    plain = F.translate(F.coalesce(col, F.lit("")), MARKED, PLAIN)
    return F.regexp_replace(F.lower(F.regexp_replace(plain, r"^\s*\d+\s*[-\u2013\u2014.]?\s*", "")), r"[^a-z0-9]", "")


def tokens(col: Column, stop: tuple = STOP_WORDS) -> Column:
    """Distinct lower-case words of a label of two letters at least, without stop words."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; both empty is 1, one empty is 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


#: Category texts that stand for a missing answer, and words with another form.
MISSING_LIKE = ("not stated", "missing", "dont know", "dk", "unknown", "not known", "non determine", "nd", "ns", "not applicable", "na")
SYNONYMS = {"others": "other", "yego": "yes", "oya": "no", "specify": "", "please": "", "specified": ""}


def category_words(col: Column, synonyms: dict[str, str] = SYNONYMS) -> Column:
    """The words of a category's text in order, lower-case, each in its common form; those whose form is empty go."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z0-9]+", " "), " ")
    forms = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    return F.filter(F.transform(words, lambda w: F.coalesce(F.element_at(forms, w), w)), lambda w: w != "")


def block_ratio(x: str | None, y: str | None) -> float:
    """Share of two texts that stands in matching blocks."""
    return SequenceMatcher(None, x or "", y or "").ratio()


def same_category(pairs: DataFrame, a: str, b: str, out: str = "same", cut: float = 0.6) -> DataFrame:
    """Whether two category texts mean the same: equal words, both missing-like, one's words inside the other's, or a ratio of ``cut``.

    The ratio (on longest matching blocks) is taken on distinct pairs that the other rules leave open.
    """

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([block_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    tx, ty = category_words(F.col(a)), category_words(F.col(b))
    x, y = F.array_join(tx, " "), F.array_join(ty, " ")
    inside = (F.size(tx) > 0) & (F.size(ty) > 0) & ((F.size(F.array_except(tx, ty)) == 0) | (F.size(F.array_except(ty, tx)) == 0))
    plain = (x == y) | (x.isin(*MISSING_LIKE) & y.isin(*MISSING_LIKE)) | inside
    held = pairs.withColumns({"__x": x, "__y": y, "__plain": plain})
    open_ = held.filter("NOT __plain").select("__x", "__y").distinct().withColumn("__ratio", ratio("__x", "__y"))
    joined = held.join(open_, ["__x", "__y"], "left")
    return joined.withColumn(out, F.col("__plain") | F.coalesce(F.col("__ratio") >= cut, F.lit(False))).select(*pairs.columns, out)


def clean_label(col: Column, dictionary: dict[str, str] | None = None, acronyms: tuple = ()) -> Column:
    """Item codes and brackets off, dictionary phrases translated, blanks joined, first letter upper, acronyms upper."""
    out = F.regexp_replace(col, r"^\s*[A-Za-z]?[0-9]+[A-Za-z]?[.:)\-]\s*", "")
    out = F.regexp_replace(out, r"[\[(][^\])]*[\])]", " ")
    for phrase, to in (dictionary or {}).items():
        out = F.regexp_replace(out, rf"(?i)\b{phrase}\b", to)
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    out = F.concat(F.upper(F.substring(out, 1, 1)), F.lower(F.substring(out, 2, 1 << 20)))
    for word in acronyms:
        out = F.regexp_replace(out, rf"(?i)\b{word}\b", word.upper())
    return out


def translate_values(labels: DataFrame, words: DataFrame, sep: str = r"\s*\+\s*") -> DataFrame:
    """Labels (variable, code, text) with each part of ``a + b`` translated by ``words`` (word, to); and whether a label changed."""
    table = F.broadcast(words.agg(F.map_from_entries(F.collect_list(F.struct(F.lower("word"), "to"))).alias("__m")))  # a dictionary
    parts = F.transform(F.split("text", sep), lambda p: F.coalesce(F.element_at(F.col("__m"), F.lower(p)), p))
    out = labels.crossJoin(table).withColumn("__new", F.array_join(parts, " + "))
    return out.select("variable", "code", F.col("__new").alias("text"), (~F.col("__new").eqNullSafe(F.col("text"))).alias("changed"))


def apply_names(df: DataFrame, names: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """Columns renamed by the table; those it does not list keep their name and are reported."""
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns]), [c for c in df.columns if c not in names]


def invert_names(names: dict[str, str]) -> dict[str, str]:
    out = {v: k for k, v in names.items()}
    if len(out) != len(names):
        raise ValueError("two native names share a clean name")
    return out
