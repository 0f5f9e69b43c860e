"""Many linear probes fitted together (M1), and scoring.

The reference fits L2 logistic regression with C=1e-4, no intercept, once per
source / held-out source / run prefix / cluster.  Here all models are fitted in
the same passes over the rows.  A row carries the ids of its models as an array,
so it is read once however many models it trains.  A pass is one Spark job: every
task returns, per model, its rows' part of the loss, the gradient and, for vectors
of up to ``NEWTON_DIM``, the Hessian of  ½‖w‖² + C Σ logloss(w·x, y)
(``partials.sum_over`` adds them), and the driver takes a Newton step per model.
Wider vectors take the step by conjugate gradients, whose products with the
Hessian are passes of the same kind (one vector per model).  A step that does not
lower the loss enough is halved.  ``status`` holds the steps and the residual
(largest element of the gradient) of each model; a model that misses the
tolerance is ``not_converged`` and has no coefficients.

Models whose training rows hold one class are not fitted (the library raises
for them); ``fit_many`` reports them in its status table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aletheia.functions.vectors import dot, sigmoid
from aletheia.operators.joins import checked_broadcast_join
from aletheia.operators.partials import matrix, sum_over

C_DEFAULT = 1e-4  # fixed value: inverse L2 strength of every probe
MAX_ITER = 10_000  # fixed value: iteration budget of every probe
TOL = 1e-10  # largest element of the gradient, over that at w = 0
NEWTON_DIM = 256  # widest vectors with a Hessian of their own
PASS_DOUBLES = 1 << 20  # doubles of a task's partials in one pass; more models take several
CG_STEPS = 100
LEAST_STEP = 2.0**-30

COEF_SCHEMA = T.StructType(
    [T.StructField("model_id", T.StringType(), False), T.StructField("w", T.ArrayType(T.DoubleType()), False)]
)
STATUS = "model_id string, n_train long, n_train_pos long, dim int, fit_status string, steps int, residual double"


def _models(df: DataFrame, model_col: str):
    """The model ids of a row as an array, whether the column holds one or several."""
    one = not isinstance(df.schema[model_col].dataType, T.ArrayType)
    return F.array(F.col(model_col).cast("string")) if one else F.col(model_col).cast("array<string>")


def fit_status(train: DataFrame, model_col: str = "model_id", y_col: str = "y", x_col: str = "x") -> DataFrame:
    """Per model: rows, positives, vector width and whether it can be fitted
    (two classes).  One partially aggregated pass; one row per model."""
    each = train.select(
        F.explode(_models(train, model_col)).alias("model_id"), F.col(y_col).cast("long").alias("y"), F.size(x_col).alias("dim")
    )
    per = each.where(F.col("model_id").isNotNull()).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_train"), F.sum("y").alias("n_train_pos"), F.max("dim").alias("dim"), F.min("dim").alias("__least")
    )
    status = F.when(F.col("__least") != F.col("dim"), "ragged").when(F.col("n_train_pos").between(1, F.col("n_train") - 1), "ok")
    return per.withColumn("fit_status", status.otherwise("one_class")).drop("__least")


def _by_model(models: pa.ListArray, number: dict[str, int]):
    """(model number, its rows) of a batch."""
    rows = np.repeat(np.arange(len(models)), np.diff(models.offsets.to_numpy()))
    coded = models.flatten().dictionary_encode()
    known = np.array([number.get(v, -1) for v in coded.dictionary.to_pylist()], np.int64)
    if not len(known):
        return
    m = known[coded.indices.to_numpy()]
    order = np.argsort(m, kind="stable")
    m, rows = m[order], rows[order]
    at = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
    for b, e in zip(at, [*at[1:], len(m)]):
        if m[b] >= 0:
            yield int(m[b]), rows[b:e]


def _pass(rows: DataFrame, tasks: int, w: dict[str, np.ndarray], hessian: bool, v: dict[str, np.ndarray] | None = None):
    """Per model, summed over its rows: (loss, gradient, Hessian or None) at
    ``w``, or with ``v`` the product of the Hessian at ``w`` with ``v``."""
    names = sorted(w)
    number = {m: i for i, m in enumerate(names)}
    bc = rows.sparkSession.sparkContext.broadcast((number, [w[m] for m in names], v and [v[m] for m in names]))

    def sums(batches):
        index, at, along = bc.value
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            x_all, y_all = matrix(b.column(2), b.num_rows), b.column(1).to_numpy()
            for m, mine in _by_model(b.column(0), index):
                x, y = x_all[mine], y_all[mine]
                z = x @ at[m]
                p = 1.0 / (1.0 + np.exp(-z))
                if along is not None:
                    part = x.T @ (p * (1 - p) * (x @ along[m]))
                else:
                    loss = (np.logaddexp(0.0, z) - y * z).sum()
                    part = np.concatenate(([loss], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel() if hessian else []))
                acc[m] = acc[m] + part if m in acc else part
        return acc

    got = sum_over(rows, tasks, sums)
    bc.unpersist()
    if v is not None:
        return {m: got[i] for m, i in number.items()}
    out = {}
    for m, i in number.items():
        d = len(w[m])
        out[m] = (got[i][0], got[i][1 : d + 1], got[i][d + 1 :].reshape(d, d) if hessian else None)
    return out


def _cg_steps(rows: DataFrame, tasks: int, w: dict, g: dict, first: dict, C: float) -> dict:
    """Newton directions of all models by conjugate gradients, side by side."""
    step = {m: np.zeros_like(g[m]) for m in g}
    r = {m: -g[m] for m in g}
    p = dict(r)
    goal = {m: min(0.1, np.sqrt(np.linalg.norm(g[m]) / first[m])) * np.linalg.norm(g[m]) for m in g}
    for _ in range(CG_STEPS):
        open_ = [m for m in g if np.linalg.norm(r[m]) > goal[m]]
        if not open_:
            break
        hp = _pass(rows, tasks, {m: w[m] for m in open_}, False, {m: p[m] for m in open_})
        for m in open_:
            along = p[m] + C * hp[m]
            rr = r[m] @ r[m]
            a = rr / (p[m] @ along)
            step[m] = step[m] + a * p[m]
            r[m] = r[m] - a * along
            p[m] = r[m] + (r[m] @ r[m]) / rr * p[m]
    return step


def _newton(rows: DataFrame, tasks: int, dims: dict[str, int], C: float, max_iter: int, tol: float):
    """(w, steps, residual, converged) per model of ``dims``."""
    full = all(d <= NEWTON_DIM for d in dims.values())
    w = {m: np.zeros(d) for m, d in dims.items()}

    def at(points):
        out = {}
        for m, (loss, g, h) in _pass(rows, tasks, points, full).items():
            v = points[m]
            out[m] = (0.5 * v @ v + C * loss, v + C * g, np.eye(len(v)) + C * h if full else None)
        return out

    now, steps, done = at(w), dict.fromkeys(w, 0), {}
    first = {m: max(np.linalg.norm(g), 1e-300) for m, (_, g, _) in now.items()}
    scale = {m: np.abs(g).max() for m, (_, g, _) in now.items()}
    size: dict[str, float] = {}
    way: dict[str, np.ndarray] = {}
    for _ in range(max_iter):
        for m in [m for m in w if m not in done and m not in way and np.abs(now[m][1]).max() <= tol * scale[m]]:
            done[m] = True
        left = [m for m in w if m not in done]
        if not left:
            break
        fresh = [m for m in left if m not in way]  # the others are trying a shorter step
        if full:
            way.update({m: np.linalg.solve(now[m][2], -now[m][1]) for m in fresh})
        elif fresh:
            way.update(_cg_steps(rows, tasks, {m: w[m] for m in fresh}, {m: now[m][1] for m in fresh}, first, C))
        size.update(dict.fromkeys(fresh, 1.0))
        tried = at({m: w[m] + size[m] * way[m] for m in left})
        for m in left:
            enough = now[m][0] + 1e-4 * size[m] * (now[m][1] @ way[m]) + 1e-13 * abs(now[m][0])
            if tried[m][0] <= enough:
                w[m], now[m], steps[m] = w[m] + size[m] * way.pop(m), tried[m], steps[m] + 1
            else:
                size[m] /= 2
                if size[m] < LEAST_STEP:
                    done[m] = False
    return {m: (w[m], steps[m], float(np.abs(now[m][1]).max()), done.get(m, False)) for m in w}


def fit_many(
    train: DataFrame,
    model_col: str = "model_id",
    x_col: str = "x",
    y_col: str = "y",
    C: float = C_DEFAULT,
    max_iter: int = MAX_ITER,
    tol: float = TOL,
) -> tuple[DataFrame, DataFrame]:
    """Fit one probe per model id; returns ``(coefs, status)``.

    ``model_col`` holds a row's model id, or an array of all its models' ids.
    ``coefs(model_id, w)`` has a row per fitted model; ``status`` has a row per
    model in ``train``: row counts, steps, residual and 'ok', 'one_class',
    'ragged' (vectors of several lengths) or 'not_converged'.
    """
    spark: SparkSession = train.sparkSession
    rows = train.select(
        _models(train, model_col).alias("models"), F.col(y_col).cast("double").alias("y"), F.col(x_col).cast("array<double>").alias("x")
    ).where(F.col("y").isNotNull() & F.col("x").isNotNull() & (F.size("models") > 0))
    tasks = max(1, rows.rdd.getNumPartitions())
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)  # read by every pass; released below
    try:
        found = {r.model_id: r for r in fit_status(rows, "models").collect()}  # one row per model
        fitted: dict[str, tuple] = {}
        by_dim: dict[int, list[str]] = {}
        for m in sorted(m for m, r in found.items() if r.fit_status == "ok"):
            by_dim.setdefault(found[m].dim, []).append(m)
        for d, names in by_dim.items():
            per = max(1, PASS_DOUBLES // (1 + d + (d * d if d <= NEWTON_DIM else 0)))
            for b in range(0, len(names), per):
                some = names[b : b + per]
                mine = rows if len(some) == len(found) else rows.where(F.arrays_overlap("models", F.lit(some))).withColumn(
                    "models", F.array_intersect("models", F.lit(some)))
                fitted |= _newton(mine, tasks, dict.fromkeys(some, d), C, max_iter, tol)
    finally:
        rows.unpersist()
    status = []
    for m, r in sorted(found.items()):
        w, steps, residual, good = fitted.get(m, (None, None, None, None))
        status.append((m, r.n_train, r.n_train_pos, r.dim, "not_converged" if good is False else r.fit_status, steps, residual))
    coefs = [(m, [float(v) for v in w]) for m, (w, _, _, good) in sorted(fitted.items()) if good]
    return spark.createDataFrame(coefs, COEF_SCHEMA), spark.createDataFrame(status, STATUS)


def score_models(rows: DataFrame, models_col: str, coefs: DataFrame, keep: Sequence[str], x_col: str = "x", missing: float | None = None) -> DataFrame:
    """Scores of every row by each of its models (array ``models_col``) in one
    pass over the vectors: ``(keep..., model_id, score)``.  Where a model has no
    coefficients: ``missing``, or no row if that is None."""
    spark = rows.sparkSession
    fitted = {r.model_id: np.asarray(r.w, float) for r in coefs.collect()}  # model state
    names = sorted(fitted)
    bc = spark.sparkContext.broadcast(({m: i for i, m in enumerate(names)}, [fitted[m] for m in names]))
    data = rows.select(*keep, F.col(models_col).cast("array<string>").alias("__models"), F.col(x_col).cast("array<double>").alias("__x"))
    data = data.where(F.col("__models").isNotNull() & F.col("__x").isNotNull())
    n_keep = len(keep)

    def run(batches):
        index, ws = bc.value
        for b in batches:
            models, x = b.column(n_keep), matrix(b.column(n_keep + 1), b.num_rows)
            if not b.num_rows:
                continue
            offsets = models.offsets.to_numpy()
            offsets = offsets - offsets[0]
            row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            out = np.full(len(row), np.nan)
            coded = models.flatten().dictionary_encode()
            number = np.array([index.get(v, -1) for v in coded.dictionary.to_pylist()], np.int64)
            which = number[coded.indices.to_numpy()] if len(row) else np.zeros(0, np.int64)
            for m in np.unique(which):
                if m >= 0:
                    mine = which == m
                    out[mine] = 1.0 / (1.0 + np.exp(-(x[row[mine]] @ ws[m])))
            scores = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out, pa.float64(), mask=np.isnan(out)))
            yield pa.RecordBatch.from_arrays([*b.columns[: n_keep + 1], scores], names=[*b.schema.names[: n_keep + 1], "__scores"])

    fields = [*data.schema.fields[: n_keep + 1], T.StructField("__scores", T.ArrayType(T.DoubleType()))]
    out = data.mapInArrow(run, T.StructType(fields))
    out = out.select(*keep, F.explode(F.arrays_zip("__models", "__scores")).alias("__s"))
    out = out.select(*keep, F.col("__s.__models").alias("model_id"), F.col("__s.__scores").alias("score"))
    return out.where(F.col("score").isNotNull()) if missing is None else out.withColumn("score", F.coalesce("score", F.lit(missing)))


def score(
    rows: DataFrame,
    coefs: DataFrame,
    model_col: str = "model_id",
    x_col: str = "x",
    score_col: str = "score",
) -> DataFrame:
    """Class-1 probability ``sigmoid(w·x)`` for each (row, model) pair
    of ``rows``; coefficient table broadcast behind a size check."""
    j = checked_broadcast_join(rows, coefs, model_col, row_bytes=64 + 8 * 4096)
    return j.withColumn(score_col, sigmoid(dot(F.col(x_col), F.col("w")))).drop("w")


def centroid_directions(rows: DataFrame, model_col: str = "model_id", x_col: str = "x", y_col: str = "y") -> DataFrame:
    """Closed-form probe per model: mean(x | y=1) − mean(x | y=0).

    Data-derived coefficients with no solver (used where a fixed, exactly
    reproducible probe is needed).  Class means are MLlib ``Summarizer``
    vector aggregates per (model, class) — partially aggregated, no explode
    of the vectors; models missing a class get no row.
    """
    means = rows.groupBy(model_col, F.col(y_col).cast("int").alias("__y")).agg(
        Summarizer.mean(array_to_vector(F.col(x_col))).alias("__mean")
    )
    means = means.select(model_col, "__y", vector_to_array("__mean").alias("__mean"))
    pos = means.where("__y = 1").select(model_col, F.col("__mean").alias("__p"))
    neg = means.where("__y = 0").select(model_col, F.col("__mean").alias("__n"))
    both = pos.join(neg, model_col)  # one row per model and class on each side
    return both.select(
        F.col(model_col).alias("model_id"), F.zip_with("__p", "__n", lambda a, b: a - b).alias("w")
    )
