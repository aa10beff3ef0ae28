"""Quality classifier by attention-based multiple-instance learning: a document is a bag of passages with one label.

Every passage of a text is encoded (hashed byte trigrams and shares of character classes through a learned layer), gated
attention gives each passage a weight within its document, and the weighted sum of the encodings is scored. Encoder,
attention and scorer are learned together from document labels.

The sample to learn from is bounded by parameters: ``per_class`` labelled documents of each class, those with the smallest
hash of the id, and of each at most ``TRAIN_PASSAGES`` evenly spread passages. Scores cover whole texts, all passages.

Defined cases: a null or empty text is one passage without content and gets a score; labels that are null are not learned
from; of several labels of one id the smallest holds; with no labels of both classes every score is the share of label 1
(0.5 without labels); repeated rows are scored row by row; a null id has no label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, crc_remainder, encode

PASSAGE_BYTES = 600
CELLS, WIDTH, GATE = 512, 32, 16
PER_CLASS = 1500
TRAIN_PASSAGES = 48
THRESHOLD = 0.3
EPOCHS, BATCH, RATE = 30, 64, 0.01

_CLASS = np.full(256, 6, np.uint8)  # 0 upper, 1 lower, 2 digit, 3 blank, 4 line end, 5 punctuation, 6 other control, 7 not ASCII
_CLASS[33:127] = 5
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[9, 32]], _CLASS[[10, 13]], _CLASS[128:] = 0, 1, 2, 3, 4, 7
FEATURES = CELLS + 8 + 4


def passages(text: str | None) -> np.ndarray:
    """Feature rows of all passages of a text, at least one."""
    raw = np.frombuffer(encode(text), np.uint8)
    n = max(1, -(-len(raw) // PASSAGE_BYTES))
    which = np.arange(len(raw)) // PASSAGE_BYTES
    out = np.zeros((n, FEATURES), np.float32)
    if not len(raw):
        return out
    wide = raw.astype(np.uint32)
    cells = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(22)
    spread = np.bincount(which[: len(cells)] * 1024 + cells, minlength=n * 1024).reshape(n, 1024)
    size = np.bincount(which, minlength=n).astype(np.float32)
    folded = np.log1p((spread[:, :CELLS] + spread[:, CELLS:]).astype(np.float32))
    out[:, :CELLS] = folded / np.maximum(np.linalg.norm(folded, axis=1, keepdims=True), 1e-6)
    share = np.bincount(which * 8 + _CLASS[raw], minlength=n * 8).reshape(n, 8) / size[:, None]
    out[:, CELLS : CELLS + 8] = 2 * share
    out[:, CELLS + 8] = (spread > 0).sum(axis=1) / np.maximum(size, 1) * 2  # low where a passage repeats itself
    out[:, CELLS + 9] = spread.max(axis=1) / np.maximum(size, 1) * 4
    out[:, CELLS + 10] = np.minimum(1 / np.maximum(share[:, 3] + share[:, 4], 0.01), 30) / 10  # bytes a word
    out[:, CELLS + 11] = np.log1p(size) / 6
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict, x: np.ndarray, starts: np.ndarray) -> dict:
    """Bags are the slices of ``x`` that begin at ``starts``."""
    sizes = np.diff(np.append(starts, len(x)))
    h = np.tanh(x @ p["E"] + p["e"])
    t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    logit = (t * g) @ p["w"]
    top = np.repeat(np.maximum.reduceat(logit, starts), sizes)
    a = np.exp(logit - top)
    a /= np.repeat(np.add.reduceat(a, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"sizes": sizes, "h": h, "t": t, "g": g, "a": a, "z": z, "p": sigmoid(z @ p["c"] + p["b"])}


def gradient(p: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
    f = forward(p, x, starts)
    d = (f["p"] - y) / len(y)
    each = np.repeat(d, f["sizes"])
    value = f["h"] @ p["c"]  # what a passage adds to the score
    mean = np.repeat(np.add.reduceat(f["a"] * value, starts), f["sizes"])
    d_logit = each * f["a"] * (value - mean)
    d_t, d_g = d_logit[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), d_logit[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
    d_h = (each * f["a"])[:, None] * p["c"] + d_t @ p["V"].T + d_g @ p["U"].T
    d_in = d_h * (1 - f["h"] ** 2)
    return {"E": x.T @ d_in, "e": d_in.sum(axis=0), "V": f["h"].T @ d_t, "U": f["h"].T @ d_g, "w": ((f["t"] * f["g"]).T @ d_logit), "c": f["z"].T @ d, "b": d.sum()}


def fit(bags: list[np.ndarray], y: np.ndarray, prior: float) -> dict:
    """Adam over small batches of bags; the intercept is moved from the sample's share of label 1 to ``prior``."""
    rnd = np.random.default_rng(7)
    init = lambda *shape: (rnd.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"E": init(FEATURES, WIDTH), "e": np.zeros(WIDTH, np.float32), "V": init(WIDTH, GATE), "U": init(WIDTH, GATE), "w": init(GATE), "c": init(WIDTH), "b": np.float32(0)}
    m, v, step = {k: 0 * x for k, x in p.items()}, {k: 0 * x for k, x in p.items()}, 0
    for _ in range(EPOCHS):
        order = rnd.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            batch = [bags[i] for i in order[at : at + BATCH]]
            starts = np.cumsum([0] + [len(b) for b in batch[:-1]])
            grad = gradient(p, np.concatenate(batch), starts, y[order[at : at + BATCH]])
            step += 1
            for k, g in grad.items():
                g = g + 1e-4 * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    p["b"] = np.float32(p["b"] + np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return p


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> dict:
    """Parameters learned from ``docs`` (doc_id, text) and ``labels`` (doc_id, ``label`` 0 or 1). Fitting runs in one task on the bounded sample."""
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    by_class = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(by_class) < 2:
        return {"constant": float(next(iter(by_class), 0.5))}
    prior = by_class[1] / sum(by_class.values())
    order = F.xxhash64("doc_id")
    picked = known.filter("y = 0").orderBy(order, "doc_id").limit(per_class).unionAll(known.filter("y = 1").orderBy(order, "doc_id").limit(per_class))

    @F.pandas_udf("binary")
    def bag(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            rows = passages(t)
            out.append(rows[np.linspace(0, len(rows) - 1, min(len(rows), TRAIN_PASSAGES)).astype(int)].astype(np.float16).tobytes())
        return pd.Series(out)

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "bag"], kind="stable")
        bags = [np.frombuffer(b, np.float16).reshape(-1, FEATURES).astype(np.float32) for b in rows["bag"]]
        p = fit(bags, rows["y"].to_numpy(np.float32), prior)
        return pd.DataFrame({"name": list(p), "value": [np.asarray(x, np.float32).tobytes() for x in p.values()]})

    # The picked labels are at most twice per_class rows.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    found = sample.select("doc_id", "y", bag("text").alias("bag")).groupBy().applyInPandas(train, "name string, value binary").collect()
    shapes = {"E": (FEATURES, WIDTH), "V": (WIDTH, GATE), "U": (WIDTH, GATE), "b": ()}
    p = {r.name: np.frombuffer(r.value, np.float32).reshape(shapes.get(r.name, (-1,))) for r in found}
    return p or {"constant": prior}


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out`` in 0..1, higher where label 1 is likelier."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if "constant" in model:
            return pd.Series(np.full(len(texts), model["constant"]))
        out, bags, size = [], [], 0
        for i, t in enumerate(texts):
            bags.append(passages(t))
            size += len(bags[-1])
            if size >= 4000 or i == len(texts) - 1:
                out.append(forward(model, np.concatenate(bags), np.cumsum([0] + [len(b) for b in bags[:-1]]))["p"])
                bags, size = [], 0
        return pd.Series(np.concatenate(out).astype(float) if out else [], dtype=float)

    return docs.withColumn(out, scored(F.col(text)))


def learned_rows(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from; the others are held out."""
    return labels.filter(crc_remainder("doc_id", 5) != 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, learned_rows(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = (crc_remainder("doc_id", 5) == 0).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
