"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, offsets mapped to the original text.

Words are the maximal runs of ASCII letters, digits and all non-ASCII characters after lower-casing A-Z. A window is ten
consecutive words of an item, or the whole item if it is shorter. Every text is normalised once (words joined by single
blanks) and scanned once; a hit's place is mapped back to word numbers and to code points of the original text.

Defined cases: a null or empty text has no words and no hits; an item without words has no window; a null item_id is
ignored; equal items share their windows and are all reported; repeated documents are judged row by row.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, char_offsets, encode, materialize

WINDOW = 10
#: Bytes of window text in one automaton; a larger benchmark is scanned in several blocks.
BLOCK_BYTES = 32 << 20
_SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_NORMAL = bytes.maketrans(bytes(range(65, 91)) + _SEPARATORS, bytes(range(97, 123)) + b" " * len(_SEPARATORS))


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(_NORMAL).split()


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, items): each distinct window with the ids, as text, of the items that hold it."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words = normal_words(encode(text))
            n = max(1, len(words) - window + 1) if words else 0
            out.append([b" ".join(words[i : i + window]).decode() for i in range(n)])
        return pd.Series(out)

    ids = F.col("item_id").cast("string")
    rows = benchmark.filter(F.col("item_id").isNotNull()).select(ids.alias("item"), F.explode(cut("text")).alias("window"))
    return rows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def window_blocks(windows: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The windows in blocks of bounded size, streamed through the driver one at a time."""
    block, size = [], 0
    for row in windows.toLocalIterator():
        block.append((row.window, row["items"]))
        size += len(row.window) + 16 + sum(map(len, row["items"]))
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


class Scanner:
    """The automaton of one block, built once in each Python worker."""

    def __init__(self, block: list) -> None:
        self.block, self.automaton = block, None

    def __getstate__(self) -> list:
        return self.block

    def __setstate__(self, block: list) -> None:
        self.__init__(block)

    def build(self) -> None:
        self.automaton = ahocorasick.Automaton()
        self.length = np.array([len(w.encode()) + 2 for w, _ in self.block])
        self.words = np.array([w.count(" ") + 1 for w, _ in self.block])
        for i, (w, _) in enumerate(self.block):
            self.automaton.add_word(f" {w} ".encode().decode("latin-1"), i)  # a character a byte
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list, list]:
        """Number of words; merged hits (first word, last word, start, end); items."""
        if self.automaton is None:
            self.build()
        raw = encode(text)
        flat = raw.translate(_NORMAL)
        words = flat.split()
        if not words or not self.block:
            return len(words), [], []
        found = list(self.automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")))
        if not found:
            return len(words), [], []
        ends, which = np.array(found).T
        heads = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))  # the blank before each word
        first = np.searchsorted(heads, ends - self.length[which] + 1)
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, first + self.words[which], -1)
        hit = np.concatenate(([0], np.cumsum(cover[:-1]) > 0, [0])).astype(np.int8)
        edge = np.diff(hit)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        is_word = np.concatenate(([0], np.frombuffer(flat, np.uint8) != 32, [0])).astype(np.int8)
        turns, at = np.diff(is_word), char_offsets(raw)
        starts, stops = at[np.flatnonzero(turns == 1)], at[np.flatnonzero(turns == -1)]
        spans = [(int(x), int(y), int(starts[x]), int(stops[y])) for x, y in zip(a, b, strict=True)]
        return len(words), spans, sorted({i for k in set(which.tolist()) for i in self.block[k][1]})


def scan_udf(scanner: Scanner, schema: str):
    @F.pandas_udf(schema)
    def scan(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scanner.scan(t) for t in texts], columns=["n_words", "spans", "items"])

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text: str = "text", out: str = "contamination") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, spans (first_word, last_word, start, end), items.

    All other columns of ``docs`` stay as they are. Spans are merged. A benchmark of more than one block is scanned block by block, each
    held once at a time; the hits of each are written to the shared folder.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    schema = "n_words long, spans array<struct<first_word:long,last_word:long,start:long,end:long>>, items array<string>"
    blocks = window_blocks(item_windows(benchmark, window), block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return docs.withColumn("__f", scan_udf(Scanner(first), schema)(F.col(text))).withColumn(out, _counted("__f", "__f")).drop("__f")
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    hits = []
    for block in chain((first, second), blocks):
        found = rows.select("__row", scan_udf(Scanner(block), schema)(F.col(text)).alias("f")).filter(F.size("f.spans") > 0)
        hits.append(materialize(found.select("__row", "f.spans", "f.items"), "hits"))
    by_row = reduce(DataFrame.unionAll, hits).groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merge = F.pandas_udf(merged, "array<struct<first_word:long,last_word:long,start:long,end:long>>")
    by_row = by_row.select("__row", F.struct(merge("spans").alias("spans"), "items").alias("__f"))
    words = scan_udf(Scanner([]), schema)(F.col(text))
    found = rows.withColumn("__words", words).join(by_row, "__row", "left").withColumn("__f", F.coalesce("__f", F.struct(F.col("__words.spans").alias("spans"), F.col("__words.items").alias("items"))))
    return found.withColumn(out, _counted("__words", "__f")).drop("__row", "__words", "__f")


def _counted(words: str, found: str):
    n_hit = F.aggregate(f"{found}.spans", F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return F.struct(F.col(f"{words}.n_words").alias("n_words"), n_hit.alias("n_hit"), F.col(f"{found}.spans").alias("spans"), F.col(f"{found}.items").alias("items"))


def merged(all_spans: pd.Series) -> pd.Series:
    """Spans of several blocks as the scan of one would give them: runs of hit words."""
    out = []
    for spans in all_spans:
        runs: list[dict] = []
        for s in sorted(spans, key=lambda s: (s["first_word"], s["last_word"])):
            if runs and s["first_word"] <= runs[-1]["last_word"] + 1:
                if s["last_word"] > runs[-1]["last_word"]:
                    runs[-1] |= {"last_word": s["last_word"], "end": s["end"]}
            else:
                runs.append(dict(s))
        out.append(runs)
    return pd.Series(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a window of an item."""
    found = contamination(docs, benchmark, out="__found", **options)
    return found.filter(F.col("__found.n_hit") == 0).drop("__found")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="f")
    n_items = F.size("f.items").cast("long")
    return found.select(
        "doc_id", "f.n_words", "f.n_hit", n_items.alias("n_items"), F.sha2(F.array_join("f.items", ","), 256).alias("items_sha256"), (F.col("f.n_hit") > 0).alias("contaminated")
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT item, len(ws[i:i + 9]) AS n, array_to_string(ws[i:i + 9], ' ') AS w
  FROM b, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS t(i) WHERE len(ws) > 0),
lengths AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM d, lengths, unnest(range(1, len(ws) - n + 2)) AS t(i)),
found AS (SELECT DISTINCT r, i, g.n, item FROM grams g JOIN win ON g.n = win.n AND g.w = win.w),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS t(p) GROUP BY r),
it AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
