"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, found by slices of bitmasks.

A codebook of up to 256 entries keeps, for each dimension, its coordinates in order and, for every prefix of that order, the
mask of the entries in it. A vector and a radius select a range in each dimension; two prefix masks give the entries of a
range, and the masks of all dimensions ANDed give the entries in the box, among them all within the radius. Distances are
taken to these only. If the best of them is within the radius it is the nearest; else its distance is the next radius, and
an empty box doubles the radius. Results are exact, ties go to the lower index.

Codebooks are learned by rounds over all vectors: tasks assign and hand back sums and counts by part and entry (numbers of a
fixed size), which Spark adds up. The integer vectors are written once to the shared folder and read in each round.

Defined cases: vectors that are null or hold a null or non-finite component are dropped; a vector with fewer components than
the longest, or a longest that parts do not divide, is filled up with zeros; components count as at most ``LIMIT`` / 1024
(32,768) either way, so that sums of squares stay exact in 64 bits for vectors of up to 2,048 components; entries start from
the rows of the smallest ids, null ids last, rows of one id by their components; fewer rows than entries make a smaller
codebook, and no rows give none; repeated rows count each; extra columns stay, one named like an added one is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop_scratch, materialize, spread_join

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 25
#: Vectors that meet the codebook together.
BLOCK = 1024


class Slices:
    """The entries of one part: sorted coordinates with the masks of their prefixes, dimension by dimension."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        n, width = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, 0)
        words = (n + 63) // 64
        own = np.zeros((n, words), np.uint64)
        own[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.prefix = np.zeros((width, n + 1, words), np.uint64)
        for d in range(width):
            self.prefix[d, 1:] = np.bitwise_or.accumulate(own[order[:, d]], axis=0)
        self.whole = np.bitwise_or.reduce(own, axis=0)
        # The initial radius: what half of the entries need to reach another.
        apart = [np.sort(((entries - e) ** 2).sum(axis=1))[min(1, n - 1)] for e in entries]
        self.radius = int(np.ceil(np.sqrt(np.median(apart)))) + 1

    def inside(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of all entries in the boxes around the rows of ``x``, by row and entry."""
        masks = np.broadcast_to(self.whole, (len(x), len(self.whole))).copy()
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            masks &= self.prefix[d, high] ^ self.prefix[d, low]
        bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        return np.nonzero(bits)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest entry of each row of ``x``."""
        code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        left, radius = np.arange(len(x)), np.full(len(x), self.radius, np.int64)
        while len(left):
            row, entry = self.inside(x[left], radius)
            apart = ((x[left[row]] - self.entries[entry]) ** 2).sum(axis=1)
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            met = row[starts]
            best = np.minimum.reduceat(apart, starts) if len(starts) else apart
            at = left[met]
            error[at] = best
            ties = np.where(apart == np.repeat(best, np.diff(np.append(starts, len(row)))), entry, len(self.entries))
            code[at] = np.minimum.reduceat(ties, starts) if len(starts) else ties
            following = radius * 2
            following[met] = np.maximum(np.ceil(np.sqrt(best.astype(np.float64))).astype(np.int64) + 1, radius[met])
            done = np.zeros(len(left), bool)
            done[met] = best <= radius[met] ** 2
            left, radius = left[~done], following[~done]
        return code, error


class Coder:
    """Codes of whole vectors; indexes are built in the task, once."""

    def __init__(self, books: list[np.ndarray]) -> None:
        self.books, self.slices = books, None

    def __getstate__(self) -> dict:
        return {"books": self.books, "slices": None}

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), a column a part."""
        self.slices = self.slices or [Slices(b) for b in self.books]
        width = x.shape[1] // len(self.books)
        out = np.zeros((2, len(x), len(self.books)), np.int64)
        for at in range(0, len(x), BLOCK):
            for p, s in enumerate(self.slices):
                out[0, at : at + BLOCK, p], out[1, at : at + BLOCK, p] = s.nearest(x[at : at + BLOCK, p * width : (p + 1) * width])
        return out[0], out[1]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column whose arrays all have the same length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def integers(rows: DataFrame, vector: str, parts: int = PARTS) -> DataFrame:
    """``rows`` whose vector can be coded, with its integer components in ``__v``, all of one length."""
    ok = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce(ok, F.lit(False)))
    longest = rows.agg(F.max(F.size(vector))).first()[0] or 0
    length = max(1, -(-longest // parts)) * parts
    scaled = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    return rows.withColumn("__v", F.slice(F.concat(scaled, F.array_repeat(F.lit(0), length)), 1, length))


def learn(rows: DataFrame, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part, from the integer vectors ``__v``."""
    first = rows.select(F.col(key).alias("key"), "__v").orderBy(F.col("key").asc_nulls_last(), "__v").limit(entries).collect()  # ``entries`` rows
    if not first:
        return []
    start = np.array([r["__v"] for r in first], np.int64)
    width = start.shape[1] // parts
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    fields = [f"s{i}" for i in range(width)]
    for _ in range(rounds):
        coder = Coder(books)

        def assign(batches, coder=coder):
            sums = [np.zeros((len(b), width + 1), np.int64) for b in coder.books]
            for batch in batches:
                x = matrix(batch.column("__v"))
                codes, _ = coder.codes(x)
                for p, total in enumerate(sums):
                    part = np.concatenate([np.ones((len(x), 1), np.int64), x[:, p * width : (p + 1) * width]], axis=1)
                    np.add.at(total, codes[:, p], part)
            for p, total in enumerate(sums):
                used = np.flatnonzero(total[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p)), pa.array(used), *[pa.array(total[used, i]) for i in range(width + 1)]], ["part", "entry", "n", *fields])

        sums = rows.select("__v").mapInArrow(assign, "part long, entry long, n long, " + ", ".join(f"{f} long" for f in fields))
        totals = sums.groupBy("part", "entry").agg(*[F.sum(F.col(f).cast("decimal(38,0)")).alias(f) for f in ("n", *fields)]).collect()  # a row an entry
        books = [b.copy() for b in books]
        for r in totals:
            books[r["part"]][r["entry"]] = [int(r[f]) // int(r["n"]) for f in fields]
    return books


def encode(rows: DataFrame, books: list[np.ndarray], out: str = "codes") -> DataFrame:
    """``rows`` of ``integers`` without ``__v``, with a struct column ``out``: codes (an entry a part) and error (squared distances summed)."""
    coder = Coder(books)

    @F.arrow_udf("codes array<int>, error long")
    def code(vectors: pa.Array) -> pa.Array:
        codes, error = coder.codes(matrix(vectors))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32()), pa.array(codes.ravel(), pa.int32()))
        return pa.StructArray.from_arrays([listed, pa.array(error.sum(axis=1))], ["codes", "error"])

    return rows.withColumn(out, code("__v")).drop("__v")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", out: str = "codes", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """The coded rows of ``vectors``, the vector left out, and the codebooks."""
    bounded_batches(vectors.sparkSession)
    rows = materialize(integers(vectors, vector, parts).drop(vector), "integers")
    books = learn(rows, key, parts, entries, rounds)
    coded = materialize(encode(rows, books or [np.zeros((1, 1), np.int64)] * parts, out), "codes")
    drop_scratch(rows)
    return coded, books


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    rows = coded.select("vec_id", "codes.*", F.coalesce(F.to_json(F.struct("label")), F.lit("")).alias("group"))
    sums = materialize(rows.groupBy("group").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n")), "labels")
    rows = spread_join(rows, sums, "group", coded.count())
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return rows.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds written out: distances of all parts to all entries in lists, the nearest by (distance, entry)."""
    part = "[v[(p * w + 1):((p + 1) * w)] for p in range(0, 4)]"
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, part, x, min({{d: list_sum([(x[j] - c[j]) * (x[j] - c[j]) for j in range(1, len(x) + 1)])::BIGINT, e: entry}}) AS best FROM parts JOIN b{i} USING (part) GROUP BY r, part, x)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""m{i} AS (SELECT part, best.e AS entry, j, floor(sum(x[j]) / count(*))::BIGINT AS y FROM a{i}, (SELECT unnest(range(1, w + 1)) AS j FROM width) GROUP BY part, best.e, j),
n{i} AS (SELECT part, entry, list(y ORDER BY j) AS y FROM m{i} GROUP BY part, entry),
b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(y, c) AS c FROM b{i} LEFT JOIN n{i} USING (part, entry))"""
            )
    last = ROUNDS
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
width AS (SELECT max(len(v)) // 4 AS w FROM kept),
parts AS MATERIALIZED (SELECT r, unnest(range(0, 4)) AS part, unnest({part}) AS x FROM kept, width),
b0 AS MATERIALIZED (SELECT part, r AS entry, x AS c FROM parts WHERE r < {ENTRIES}),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM b{last}),
coded AS (SELECT r, string_agg(lower(printf('%02x', best.e)), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{last} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (r), books
"""


OP12_SQL = _sql()
