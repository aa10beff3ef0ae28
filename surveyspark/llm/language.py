"""Language identification by nearest centroid: TF-IDF n-gram vectors against several clustered centroids a language.

A text's vector counts its hashed byte trigrams (lower case, all but letters as single blanks), damped by log(1 + count), weighted by inverse document
frequency and normalised. Training documents of each language are clustered by spherical k-means; a text gets the language
of the centroid with the largest cosine. A text further from its centroid than the radius of that cluster is ``rejected``.

Document frequencies cover all training rows. Clusters are fitted on the ``sample`` rows of each language with the smallest
hash of the id; that bound is a parameter. Only cells times centroids reach the driver.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows with a null language are not learned
from; with nothing to learn from every text is ``und``; repeated rows are judged row by row; a null id is never held out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, crc_remainder, spread_join

CELLS = 4096
CENTROIDS = 4
SAMPLE = 400
#: Share of a cluster's members inside its radius.
INSIDE = 0.99
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[c for c in range(128) if not 97 <= c <= 122]] = 32


def counts(text: str | None) -> np.ndarray:
    raw = _LETTERS[np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)].astype(np.uint32)
    if len(raw):  # a run of blanks counts as one
        raw = raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))]
    if len(raw) < 3:
        raw = np.concatenate((raw, np.full(3 - len(raw), 32, np.uint32)))
    cells = (raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
    return np.bincount(cells, minlength=CELLS)


def vectors(texts: pd.Series, idf: np.ndarray) -> np.ndarray:
    out = np.stack([counts(t) for t in texts]).astype(np.float32)
    np.log1p(out, out=out)
    out *= idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Over all of ``docs``: documents with each cell, and documents; partial sums in tasks, then one row a cell."""

    def partial(batches):
        total, n = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                total += counts(text) > 0
                n += 1
        yield pd.DataFrame({"cell": np.arange(CELLS + 1), "df": np.append(total, n)})

    found = docs.select("text").mapInPandas(partial, "cell long, df long").groupBy("cell").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(CELLS + 1, np.int64)
    for row in found:
        out[row.cell] = row.df
    return out[:CELLS], int(out[CELLS])


def clusters(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from the farthest-first start: unit centroids and their radii in cosine distance."""
    picked = [0]
    for _ in range(min(k, len(rows)) - 1):
        picked.append(int(np.argmin((rows @ rows[picked].T).max(axis=1))))
    centres = rows[picked]
    for _ in range(12):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[nearest == i].sum(axis=0) if (nearest == i).any() else c for i, c in enumerate(centres)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    sims = rows @ centres.T
    nearest, best = sims.argmax(axis=1), sims.max(axis=1)
    radii = [1 - np.quantile(best[nearest == i], 1 - INSIDE) if (nearest == i).any() else 0.0 for i in range(len(centres))]
    return centres, np.array(radii)


def learn(train: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> dict:
    """A model from ``train`` (doc_id, text, lang), whose languages are not null."""
    df, n = document_frequencies(train)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    @F.pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([v.astype(np.float16).tobytes() for v in vectors(texts, idf)])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "vector"], kind="stable").head(sample)
        rows = np.stack([np.frombuffer(v, np.float16) for v in group["vector"]]).astype(np.float32)
        centres, radii = clusters(rows, centroids)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [c.tobytes() for c in centres], "radius": radii})

    sizes = train.groupBy("lang").agg(F.count("*").alias("n")).withColumn("__n", F.col("n"))
    ids = spread_join(train.select("doc_id", "lang"), sizes, "lang", n)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)  # about one and a half times the bound; the rest goes in fit
    picked = ids.filter(share * F.col("n") < 1.5 * sample + 50).select("doc_id", "lang").distinct()
    # So many ids a language at most, texts do not move.
    few = train.join(F.broadcast(picked), ["doc_id", "lang"]).select("lang", F.xxhash64("doc_id").alias("h"), vector("text").alias("vector"))
    found = few.groupBy("lang").applyInPandas(fit, "lang string, centre binary, radius double").orderBy("lang", "radius").collect()
    centres = np.stack([np.frombuffer(r.centre, np.float32) for r in found]) if found else np.zeros((0, CELLS), np.float32)
    return {"idf": idf, "centres": centres, "langs": [r.lang for r in found], "radii": [r.radius for r in found]}


def identify(docs: DataFrame, model: dict, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: lang, score (cosine in 0..1), rejected."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for at in range(0, len(texts), 256):
            part = texts.iloc[at : at + 256]
            sims = vectors(part, model["idf"]) @ model["centres"].T
            for t, s in zip(part, sims, strict=True):
                if not len(s) or not t or not any(map(str.isalpha, t)):
                    rows.append(("und", 0.0, True))
                    continue
                i = int(s.argmax())
                rows.append((model["langs"][i], float(min(max(s[i], 0.0), 1.0)), bool(1 - s[i] > model["radii"][i])))
        return pd.DataFrame(rows, columns=["lang", "score", "rejected"])

    return docs.withColumn(out, nearest(F.col(text)))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    bounded_batches(spark)
    held_out = crc_remainder("doc_id", 3) == 1
    model = learn(docs.filter(~held_out & F.col("lang").isNotNull()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.rejected")
