"""Periodic runs of words by a dictionary of basic factors, and texts without their repetitions.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` words and ``RATIO`` periods long, that no
neighbouring word extends keeping period q.

For each power of two, every factor of so many words that occurs more than once in its text has a name, made of the names of
its halves. Successor occurrences of a name at most twice its length apart, three at equal distance, propose that distance as
a period: a run of period q with four periods has three such occurrences, q apart, of its factors of the least power of two
not under q. A successor is the next occurrence, so no smaller period comes with a proposal. Proposals are extended word by
word as far as the period holds; those inside a run known already are the same run.

Scale: one pass over the rows without any shuffle; a text is worked on whole, in blocks of texts of up to ``BLOCK`` words, a
longer text alone (about 100 bytes a word). Factors that occur once are dropped at once, so that plain prose costs two or
three sorts and only repetitive texts cost a sort for every power of two.

Defined cases: a null text counts as empty, and an empty one has no words, no runs and an empty result; rows are independent,
so repeated rows, null ids and extra columns change nothing; a column named like ``out`` is replaced; of runs that overlap each
drops its own words, and words are dropped once.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

LEAST, RATIO = 6, 4
#: Words of texts worked on together.
BLOCK = 400_000
RUNS = "array<struct<start:long,length:long,period:long>>"


def proposals(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows (period, first, past): stretches of ``words`` that keep a period. Words of different texts differ; ``longest`` is the longest text's number."""
    found, at, key, size = [np.zeros((0, 3), np.int64)], np.arange(len(words)), words.astype(np.int64), 1
    while len(at) and 2 * size <= longest:
        order = np.argsort(key, kind="stable")
        place, sorted_key = at[order], key[order]
        same = sorted_key[1:] == sorted_key[:-1]
        gap = np.zeros(len(words), np.int64)
        gap[place[:-1][same]] = np.diff(place)[same]
        # Three occurrences at equal distances, at most twice the factor's length.
        start = at[(gap[at] > 0) & (gap[at] <= 2 * size)]
        start = start[gap[start + gap[start]] == gap[start]]
        if len(start):
            period = gap[start]
            cut = np.flatnonzero((np.diff(start) != 1) | (np.diff(period) != 0)) + 1
            first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(start)])) - 1
            found.append(np.stack([period[first], start[first], start[last] + period[first] + size], axis=1))
        # Names of the next length. A factor that reaches into the next text has occurred once and is gone.
        often = np.zeros(len(place), bool)
        often[1:] |= same
        often[:-1] |= same
        name = np.full(len(words) + size, -1, np.int64)
        name[place[often]] = np.cumsum(np.concatenate(([0], ~same)))[often]
        at = np.flatnonzero(name >= 0)
        at = at[name[at + size] >= 0]
        key = name[at] * np.int64(len(words) + 1) + name[at + size]
        size *= 2
    return np.concatenate(found)


def matches(x: np.ndarray, y: np.ndarray, backward: bool = False) -> int:
    """Equal words from the start (or from the end) of two stretches of the same length."""
    n, step = 0, 64
    while n < len(x):
        a, b = (x[max(0, len(x) - n - step) : len(x) - n][::-1], y[max(0, len(y) - n - step) : len(y) - n][::-1]) if backward else (x[n : n + step], y[n : n + step])
        unlike = np.flatnonzero(a != b)
        if len(unlike):
            return n + int(unlike[0])
        n, step = n + len(a), step * 2
    return n


def find_runs(words: np.ndarray, longest: int, least: int = LEAST, ratio: int = RATIO) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period."""
    if ratio < 4:
        raise ValueError("three occurrences need runs of four periods")
    out, found = [], proposals(words, longest)
    known, before = 0, 0
    for period, first, past in found[np.lexsort(found.T[::-1])].tolist():
        if period == before and past <= known:
            continue
        first -= matches(words[:first], words[period : period + first], backward=True)
        past += matches(words[past:], words[past - period : len(words) - period])
        known, before = past, period
        if past - first >= max(least, ratio * period):
            out.append((first, past - first, period))
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def blocks(texts: list[list[bytes]], block: int):
    """Slices of ``texts`` with up to ``block`` words, at least one text each."""
    at = 0
    while at < len(texts):
        to, n = at + 1, len(texts[at])
        while to < len(texts) and n + len(texts[to]) <= block:
            n, to = n + len(texts[to]), to + 1
        yield texts[at:to]
        at = to


def runs_of(texts: list[list[bytes]], least: int, ratio: int) -> tuple[list[np.ndarray], list[bytes]]:
    """The runs of each text and its words without repetitions, joined by spaces."""
    names, base = [], 0
    for words in texts:
        ids: dict[bytes, int] = {}
        fresh = count()
        names.append(np.fromiter((i if (i := ids.get(w)) is not None else ids.setdefault(w, next(fresh)) for w in words), np.int64, len(words)) + base)
        base += len(ids)
    ends = np.cumsum([len(w) for w in texts])
    found = find_runs(np.concatenate(names), max(map(len, texts)), least, ratio)
    edge = np.zeros(int(ends[-1]) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(edge[:-1]) == 0
    of, runs, left = np.searchsorted(ends, found[:, 0], "right"), [], []
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    for i, words in enumerate(texts):
        start = int(ends[i]) - len(words)
        runs.append(found[cuts[i] : cuts[i + 1]] - [start, 0, 0])
        left.append(b" ".join([w for w, k in zip(words, kept[start : int(ends[i])].tolist(), strict=True) if k] if len(runs[-1]) else words))
    return runs, left


def periodic_runs(docs: DataFrame, text: str = "text", out: str = "runs", least: int = LEAST, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, runs (start, length, period; by start and period) and collapsed, the words
    ``[^\\x20\\x09-\\x0D]+`` that no run contains after its first period, joined by one space."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(f"n_words long, runs {RUNS}, collapsed string")
    def find(texts: pa.Array) -> pa.Array:
        split = [(t or b"").split() for t in texts.cast(pa.binary()).to_pylist()]  # bytes split at the blanks named above
        runs, left = [], []
        for some in blocks(split, block):
            found, kept = runs_of(some, least, ratio)
            runs += found
            left += kept
        every = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
        fields = pa.StructArray.from_arrays([pa.array(every[:, i]) for i in range(3)], ["start", "length", "period"])
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))), pa.int32()), fields)
        return pa.StructArray.from_arrays([pa.array([len(w) for w in split], pa.int64()), listed, pa.array(left, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])

    return docs.withColumn(out, find(F.col(text)))


def greatest_run(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties by start, then period."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.reduce(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(best.isNull() | more(r, best), r).otherwise(best))


def planted(doc_id: str, text: str) -> Column:
    """The text in which the words of one document in ten repeat from some word on, by the CRC of the id."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, h = F.size(words), F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    repeated = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]"), repeated).otherwise(F.col(text))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted("doc_id", "text").alias("text"))
    found = periodic_runs(docs).select("doc_id", "runs.*").withColumn("best", greatest_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    of = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[of[c].alias(c) for c in ("start", "length", "period")], F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
