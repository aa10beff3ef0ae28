"""Selection among many candidates: tiled cross products, coordinate descent along a path, penalties by cross-validation.

Candidates are one array column, so that 1,500 of them are no wider a plan than three. A pass over the rows gives cross
products tile pair by tile pair (upper ones only): each task adds up its batches, tiles are then summed in two levels by streams
that hold one sum a tile. Solvers work on the p by p sums; what they need from the rows again (scores by cluster, gradients of
all folds and penalties at once) is one pass each.

The logit is fitted by majorisation: with every observation's curvature bounded by a quarter, each step is a lasso on the
training fold's cross products, taken as all rows' less the fold's, so rows are only read for gradients. All folds and penalties
move together, with momentum: one pass over the rows moves every model.

Defined cases: rows with a missing outcome, group or feature are left out; features without variation get no coefficient; tables
without rows raise.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.sources.scratch import drop_scratch, materialize

from . import order
from .econ import _normal_quantile, fe_ols

#: Width of a tile, and how many streams sum a tile before the last one does.
TILE, SALT = 256, 16
#: Rows and bytes of an Arrow batch, and bytes of cluster sums that a task holds before it passes them on.
BATCH, BATCH_BYTES, HELD = 256, 16 << 20, 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, since a row holds all candidates or a tile; smaller limits of the session stay."""
    for key, most in (("maxRecordsPerBatch", BATCH), ("maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < _bytes(spark.conf.get(f"spark.sql.execution.arrow.{key}")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def _bytes(size: str) -> int:
    digits = size.lower().rstrip("bkmgtp")
    return int(digits) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[size.lower()[len(digits) :][:1]]


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def with_features(df: DataFrame, features: list[str] | str, keep: list[str], out: str = "x") -> DataFrame:
    """``keep`` and the features as one array of doubles without gaps; rows with a missing value in either are left out."""
    bounded_batches(df.sparkSession)
    x = F.col(features) if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select(*keep, x.cast("array<double>").alias(out)).na.drop()
    return rows.filter(F.forall(out, lambda v: v.isNotNull() & ~F.isnan(v)))


def demean(rows: DataFrame, by: str, x: str = "x") -> DataFrame:
    """``rows`` with the array less its group's mean; group means are partial sums of vectors."""
    means = rows.groupBy(by).agg(vector_to_array(Summarizer.mean(array_to_vector(x))).alias("__m"))
    joined = rows.join(means, by)
    others = [c for c in rows.columns if c != x]

    def less(batches):
        for batch in batches:
            m = matrix(batch.column(x)) - matrix(batch.column("__m"))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], listed], [*others, x])

    types = dict(rows.dtypes)
    return materialize(joined.mapInArrow(less, ", ".join(f"`{c}` {types[c]}" for c in [*others, x])), "demeaned")


def gram_tiles(rows: DataFrame, x: str = "x", w: str | None = None, fold: str | None = None, tile: int = TILE) -> dict[int, np.ndarray]:
    """{fold: X'WX}; the number of rows' weights stands with a column of ones, if the caller has put one in."""
    spans = lambda p: [(a, min(a + tile, p)) for a in range(0, p, tile)]

    def partial(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix(batch.column("x"))
            weight = batch.column("w").to_numpy()[:, None]
            folds = batch.column("fold").to_numpy()
            for f in np.unique(folds):
                mine = m[folds == f]
                heavy = mine * weight[folds == f]
                for i, (a, b) in enumerate(spans(m.shape[1])):
                    for j, (c, d) in enumerate(spans(m.shape[1])):
                        if i <= j:
                            part = heavy[:, a:b].T @ mine[:, c:d]
                            sums[int(f), i, j] = sums.get((int(f), i, j), 0.0) + part
        yield from tiles(sums)

    def tiles(sums: dict):
        for key, v in sums.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in key], pa.array([v.shape[1]], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["fold", "i", "j", "width", "v"])

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("fold", "i", "j")), batch.column("width").to_pylist(), strict=True)
            for (*key, width), v in zip(keys, batch.column("v"), strict=True):
                sums[tuple(key)] = sums.get(tuple(key), 0.0) + np.frombuffer(v.as_buffer()).reshape(-1, width)
        yield from tiles(sums)

    schema = "fold int, i int, j int, width int, v binary"
    plain = rows.select(F.col(x).alias("x"), (F.col(w).cast("double") if w else F.lit(1.0)).alias("w"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"))
    parts = plain.mapInArrow(partial, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALT)))
    some = parts.repartition("fold", "i", "j", "salt").drop("salt").mapInArrow(add, schema)
    whole = some.repartition("fold", "i", "j").mapInArrow(add, schema).collect()  # p * p numbers a fold
    out: dict[int, np.ndarray] = {}
    for f in {r.fold for r in whole}:
        mine = {(r.i, r.j): np.frombuffer(r.v).reshape(-1, r.width) for r in whole if r.fold == f}
        n = 1 + max(i for i, _ in mine)
        out[f] = np.block([[mine[i, j] if i <= j else mine[j, i].T for j in range(n)] for i in range(n)])
    return out


def descend(g: np.ndarray, c: np.ndarray, penalty: np.ndarray, start: np.ndarray | None = None, tol: float = 1e-10, most: int = 2000) -> np.ndarray:
    """The b of least b'Gb/2 - c'b + sum of penalty * |b|: coordinate descent on an active set, which grows until no other coordinate wants to move."""
    b = np.zeros(len(c)) if start is None else start.copy()
    scale = np.diag(g)
    usable = scale > 1e-12 * max(scale.max(initial=0.0), 1e-300)
    b[~usable] = 0.0
    r = c - g @ b  # gradient of the smooth part, with its sign turned
    for _ in range(most):
        active = np.flatnonzero(usable & ((b != 0) | (np.abs(r) > penalty * (1 + 1e-9) + 1e-14)))
        if not len(active):
            break
        start_b = b.copy()
        for _ in range(most):
            moved = 0.0
            for j in active:
                z = r[j] + scale[j] * b[j]
                new = math.copysign(max(abs(z) - penalty[j], 0.0), z) / scale[j]
                if new != b[j]:
                    r -= g[:, j] * (new - b[j])
                    moved = max(moved, abs(new - b[j]) * math.sqrt(scale[j]))
                    b[j] = new
            if moved <= tol * max(1.0, np.abs(b).max() * math.sqrt(scale.max())):
                break
        if np.abs(b - start_b).max() <= tol * max(1.0, np.abs(b).max()):
            break
    return b


def score_squares(rows: DataFrame, cluster: str, coefficients: list[np.ndarray], targets: list[int], candidates: np.ndarray) -> np.ndarray:
    """For each target the sum over clusters of (sum of x * e within the cluster) squared, a number a candidate; e is the target less its fit."""
    q = len(candidates)

    def scores(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix(batch.column("x"))
            e = np.stack([m[:, t] - m[:, candidates] @ b for t, b in zip(targets, coefficients, strict=True)], axis=1)
            names, place = np.unique(np.array(batch.column("cluster").to_pylist(), dtype=object).astype(str), return_inverse=True)
            by = np.argsort(place, kind="stable")
            firsts = np.searchsorted(place[by], np.arange(len(names)))
            mine, e = m[by][:, candidates], e[by]
            sums = np.concatenate([np.add.reduceat(mine * e[:, k : k + 1], firsts, axis=0) for k in range(len(targets))], axis=1)
            for name, some in zip(names.tolist(), sums, strict=True):
                held[name] = held[name] + some if name in held else some.copy()
            if len(held) * sums.shape[1] * 8 > HELD:
                yield from listed(held)
                held = {}
        yield from listed(held)

    def listed(held: dict):
        names = list(held)
        for at in range(0, len(names), BATCH):
            sums = np.stack([held[name] for name in names[at : at + BATCH]])
            yield pa.RecordBatch.from_arrays([pa.array(names[at : at + BATCH]), pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, sums.shape[1]), pa.int32()), pa.array(sums.ravel()))], ["cluster", "s"])

    def squares(batches):
        total = np.zeros(len(targets) * q)
        for batch in batches:
            if batch.num_rows:
                total += (matrix(batch.column("s")) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    parts = rows.select(F.col(cluster).cast("string").alias("cluster"), "x").mapInArrow(scores, "cluster string, s array<double>")
    whole = parts.groupBy("cluster").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).select("s")
    row = whole.mapInArrow(squares, "s array<double>").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).first()
    return np.array(row["s"]).reshape(len(targets), q)


def plug_in(rows: DataFrame, cluster: str, targets: list[int], candidates: list[int], rounds: int = 15) -> list[list[int]]:
    """Candidates that a lasso with cluster-robust plug-in loadings keeps, for each target; ``rows`` hold demeaned arrays ``x``."""
    g = gram_tiles(rows)[0]
    counts = rows.agg(F.count("*").alias("n"), F.count_distinct(cluster).alias("g")).first()
    n, at = counts["n"], np.array(candidates)
    level = 2.2 * math.sqrt(n) * _normal_quantile(1 - 0.1 / math.log(max(counts["g"], 3)) / (2 * max(len(at), 1)))
    gg = g[np.ix_(at, at)]
    fits, kept = [np.zeros(len(at)) for _ in targets], [None] * len(targets)
    for _ in range(rounds):
        loads = np.sqrt(np.maximum(score_squares(rows, cluster, fits, targets, at) / n, 1e-20))
        after = [descend(gg, g[at, t], level / 2 * load, start=b) for t, load, b in zip(targets, loads, fits, strict=True)]
        after = [b if np.count_nonzero(b) <= n // 3 else old for b, old in zip(after, fits, strict=True)]  # too many for the rows: the sparser set stays
        now = [np.flatnonzero(b).tolist() for b in after]
        fits = after
        if now == kept:
            break
        kept = now
    return [[candidates[i] for i in some] for some in kept]


def double_selection(df: DataFrame, y: str, d: str, features: list[str] | str, fe: str, cluster: str, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Post-double-selection with any number of candidates: those kept for the outcome or for the treatment, then least squares with both.

    The table of terms, and the names of the candidates kept (their numbers, without ``names``).
    """
    rows = with_features(df, features, list(dict.fromkeys([fe, cluster, y, d])), "__x")
    stacked = rows.select(F.col(fe).alias("__fe"), F.col(cluster).alias("__cluster"), F.concat(F.array(F.col(y).cast("double"), F.col(d).cast("double")), "__x").alias("x"))
    flat = demean(stacked, "__fe")
    width = flat.select(F.size("x")).first()[0]
    kept = plug_in(flat, "__cluster", [0, 1], list(range(2, width)))
    picked = sorted(set(kept[0]) | set(kept[1]))
    wide = rows.withColumns({f"__z{i}": F.get("__x", F.lit(i - 2)) for i in picked})
    fit = fe_ols(wide, y, [d, *[f"__z{i}" for i in picked]], [fe], cluster)
    label = {f"__z{i}": names[i - 2] if names else str(i - 2) for i in picked}
    drop_scratch(flat)
    return fit.replace(label, subset=["term"]) if label else fit, list(label.values())


def areas(scored: DataFrame, y: str, score: str, w: str | None = None) -> tuple[float, float]:
    """(area under the receiver curve, average precision) of all distinct scores, exactly, ties counted half; from ranks by range partitions."""
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    values = scored.groupBy((-F.col(score)).alias("s")).agg(F.sum(weight).alias("n"), F.sum(F.when(F.col(y) == 1, weight).otherwise(0.0)).alias("p"))
    v = order.running(order.deal(values, [], ["s"]), [], ["s"], ["n", "p"])
    q = F.col("n") - F.col("p")  # others of this score; before it stand those that score higher
    higher = F.col("before_p") + F.col("p") / 2
    precision = (F.col("before_p") + F.col("p")) / (F.col("before_n") + F.col("n"))
    row = v.agg(F.sum(q * higher).alias("u"), F.sum(F.col("p") * precision).alias("ap"), F.max("all_p").alias("p"), F.max("all_n").alias("n")).first()
    if not row["n"] or not row["p"] or row["n"] == row["p"]:
        return math.nan, math.nan
    return row["u"] / (row["p"] * (row["n"] - row["p"])), row["ap"] / row["p"]


def logit_path(
    df: DataFrame, y: str, features: list[str] | str, group: str, penalties: tuple, folds: int = 5, w: str | None = None, forced: int = 0, tol: float = 1e-5, most: int = 400, names: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """L1 logit over a path of penalties with grouped cross-validation.

    The first table has (penalty, log_likelihood, auc, average_precision, chosen), all out of fold and weighted; the penalty of greatest
    likelihood is chosen. The second has (feature, coef) of the refit on all rows with it, in standard deviations. The last ``forced`` features
    carry no penalty. A penalty is a mean loss: weights are scaled to one on average. Folds are hashes of ``group``.
    """
    rows = with_features(df.withColumn("__y", F.col(y).cast("double")), features, ["__y", group, *([w] if w else [])], "__f")
    rows = rows.select("__y", "__f", (F.col(w).cast("double") if w else F.lit(1.0)).alias("__w"), F.pmod(F.xxhash64(F.col(group).cast("string")), F.lit(folds)).cast("int").alias("__fold"))
    rows = materialize(rows.withColumn("x", F.concat(F.array(F.lit(1.0)), "__f")).drop("__f"), "rows")
    whole = gram_tiles(rows, w="__w", fold="__fold")
    total = sum(whole.values())
    weight = total[0, 0]
    mean = total[0] / weight
    var = np.diag(total) / weight - mean**2
    p = len(mean)
    sd = np.where(var > 1e-12 * np.maximum(mean**2, 1e-300), np.sqrt(np.maximum(var, 0.0)), np.inf)
    sd[0], mean[0] = 1.0, 0.0

    def scaled(g: np.ndarray) -> np.ndarray:
        """Cross products of standardised columns from those of raw ones; the first column is one."""
        s = g[0]
        return (g - np.outer(mean, s) - np.outer(s, mean) + np.outer(mean, mean) * g[0, 0]) / np.outer(sd, sd) / weight

    path = sorted(penalties, reverse=True)
    parts = {f: scaled(g) for f, g in whole.items()}
    every = sum(parts.values())
    train = [every - parts.get(f, 0.0) for f in range(folds)] + [every]
    free = np.array([0.0] + [1.0] * (p - 1 - forced) + [0.0] * forced)
    models = [(f, lam) for lam in path for f in range(folds + 1)]
    b = np.zeros((p, len(models)))

    def pass_over(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of all models on their training rows, and log-likelihoods on their held rows."""
        def work(batches):
            grad, held = np.zeros((p, len(models))), np.zeros(len(models))
            of = np.array([f for f, _ in models])
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = (matrix(batch.column("x")) - mean) / sd
                yy, ww, fold = (batch.column(c).to_numpy() for c in ("__y", "__w", "__fold"))
                eta = x @ beta
                prob = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                mine = fold[:, None] == of[None, :]
                grad += x.T @ ((prob - yy[:, None]) * ww[:, None] * ~mine)
                clipped = np.clip(prob, 1e-9, 1 - 1e-9)
                held += (np.where(yy[:, None] == 1, np.log(clipped), np.log(1 - clipped)) * ww[:, None] * mine).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([grad.ravel(), held]).tolist()], pa.list_(pa.float64()))], ["s"])

        row = rows.mapInArrow(work, "s array<double>").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).first()["s"]
        s = np.array(row) / weight
        return s[:-len(models)].reshape(p, len(models)), s[-len(models):]

    step, pace, ahead, before = np.full(len(models), np.inf), np.ones(len(models)), b.copy(), b.copy()
    for _ in range(most):
        grad, _ = pass_over(ahead)
        for k, (f, lam) in enumerate(models):
            if step[k] <= tol:
                continue
            h, y0 = train[f] / 4, ahead[:, k]
            now = descend(h, h @ y0 - grad[:, k], lam * free, start=y0, tol=1e-8)
            # Momentum, given up where it would lead back.
            back = float((y0 - now) @ h @ (now - b[:, k])) > 0
            step[k] = max(np.abs(now - y0).max(), np.abs(now - b[:, k]).max())
            fast = 1.0 if back else (1 + math.sqrt(1 + 4 * pace[k] ** 2)) / 2
            before[:, k], b[:, k] = b[:, k], now
            ahead[:, k] = now if back else now + (pace[k] - 1) / fast * (now - before[:, k])
            pace[k] = fast
        if (step <= tol).all():
            break
    else:
        raise RuntimeError(f"the logit did not settle in {most} passes")
    _, held = pass_over(b)
    by_penalty = {lam: sum(held[k] for k, (f, pen) in enumerate(models) if pen == lam and f < folds) for lam in path}
    best = max(path, key=lambda lam: by_penalty[lam])
    out = []
    for lam in path:
        own = np.stack([b[:, models.index((f, lam))] for f in range(folds)], axis=1)

        def predict(batches, own=own):
            for batch in batches:
                x = (matrix(batch.column("x")) - mean) / sd if batch.num_rows else np.zeros((0, p))
                score = (x @ own)[np.arange(len(x)), batch.column("__fold").to_numpy()]
                yield pa.RecordBatch.from_arrays([batch.column("__y"), batch.column("__w"), pa.array(score)], ["y", "w", "score"])

        auc, ap = areas(rows.mapInArrow(predict, "y double, w double, score double"), "y", "score", "w")
        out.append((float(lam), float(by_penalty[lam]), auc, ap, lam == best))
    spark = df.sparkSession
    final = b[:, models.index((folds, best))]
    table = spark.createDataFrame(out, "penalty double, log_likelihood double, auc double, average_precision double, chosen boolean")
    names = names or (features if isinstance(features, list) else [str(i) for i in range(p - 1)])
    drop_scratch(rows)
    return table, spark.createDataFrame([(names[i], float(final[i + 1])) for i in range(p - 1)], "feature string, coef double")


def post_selection(df: DataFrame, y: str, features: list[str] | str, cluster: str, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Linear model of the outcome on the candidates that the plug-in lasso keeps, with clustered errors."""
    rows = with_features(df, features, list(dict.fromkeys([cluster, y])), "__x").withColumn("__all", F.lit(1))
    flat = demean(rows.select(F.col(cluster).alias("__cluster"), "__all", F.concat(F.array(F.col(y).cast("double")), "__x").alias("x")), "__all")
    width = flat.select(F.size("x")).first()[0]
    picked = plug_in(flat, "__cluster", [0], list(range(1, width)))[0] or [1]
    wide = rows.withColumns({f"__z{i}": F.get("__x", F.lit(i - 1)) for i in picked})
    fit = fe_ols(wide, y, [f"__z{i}" for i in picked], [], cluster)
    label = {f"__z{i}": names[i - 1] if names else str(i - 1) for i in picked}
    drop_scratch(flat)
    return fit.replace(label, subset=["term"]), list(label.values())
