"""PCA, k-means and per-cluster probes.

* PCA (M8/M11): the Gram matrix of the centred vectors is summed block row by
  block row, one partial per task; where d² doubles do not suit the driver, a
  randomised range finder with subspace iteration takes its place (partials of
  d x (k + ``OVERSAMPLE``)).  Signs: each component's largest loading positive.
* k-means (M9): seeding by k-means|| with hash-weighted draws (a draw without
  replacement in proportion to the squared distance is the smallest
  ``-ln(u) / d²``, u a hash of round and row), then Lloyd steps of which each is
  one job for all k.  So SQL can reproduce it, and no step depends on the
  partitioning but for rounding.
* Assignment (M10) of all k in one pass over the vectors: an array of cluster
  numbers per row.
* Per-cluster probes (M12): all clusters of all k through one block-fit call
  (``linear.fit_many`` with model_id = 'k<k>:c<cluster>').
* Routed AUC (M13/J4): each row scored by its cluster's model, 0.0 where the
  cluster has no model; scores of all k are an array too, exploded (without the
  vectors) only for the AUC.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aletheia.operators.auc import grouped_auc
from aletheia.operators.linear import C_DEFAULT, fit_many, score_models
from aletheia.operators.partials import matrix, sum_over
from aletheia.session import materialize

KMEANS_SEED = 42  # fixed value: k-means seed
KMEANS_MAX_ITER = 300  # fixed value: Lloyd steps at most
KMEANS_TOL = 1e-4  # fixed value: squared movement of the centres, over the mean variance, at which k-means stops
ROUNDS = 2  # seeding rounds; each draws 2 * largest k candidates
GRAM_MAX_DIM = 4096  # widest vectors whose Gram matrix goes to the driver (128 MB)
GRAM_BLOCK = 256
OVERSAMPLE = 10
SUBSPACE_STEPS = 200


def _tasks(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


def _first_and_total(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x.sum(axis=0), [len(x)]))


def mean_vector(vectors: DataFrame, tasks: int, square_about: np.ndarray | None = None) -> np.ndarray:
    """Mean of column ``x``; of its squares about a centre with ``square_about``."""

    def sums(batches):
        total = None
        for b in batches:
            x = matrix(b.column(0), b.num_rows)
            x = x if square_about is None else (x - square_about) ** 2
            total = _first_and_total(x) if total is None else total + _first_and_total(x)
        return {} if total is None else {0: total}

    got = sum_over(vectors.select("x"), tasks, sums)
    if not got:
        raise ValueError("no rows")
    return got[0][:-1] / got[0][-1]


# --- PCA ---------------------------------------------------------------------


def _centred_product(vectors: DataFrame, tasks: int, mean: np.ndarray, q: np.ndarray | None) -> np.ndarray:
    """``XᵀX`` of the centred rows, or ``Xᵀ(Xq)`` without that matrix."""
    spark, d = vectors.sparkSession, len(mean)
    bc = spark.sparkContext.broadcast((mean, q))

    def sums(batches):
        centre, basis = bc.value
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            x = matrix(b.column(0), b.num_rows) - centre
            if basis is None:  # block rows of the matrix
                parts = ((at // GRAM_BLOCK, x[:, at : at + GRAM_BLOCK].T @ x) for at in range(0, d, GRAM_BLOCK))
            else:
                parts = ((0, x.T @ (x @ basis)),)
            for key, v in parts:
                acc[key] = acc[key] + v.ravel() if key in acc else v.ravel()
        return acc

    got = sum_over(vectors.select("x"), tasks, sums)
    bc.unpersist()
    return np.concatenate([got[key] for key in sorted(got)]).reshape(d, -1)


def pca_loadings(rows: DataFrame, k: int = 3, x_col: str = "x", seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, loadings d x k) of ``x_col``, by falling variance."""
    vectors = rows.select(F.col(x_col).cast("array<double>").alias("x"))
    tasks = _tasks(vectors)
    mean = mean_vector(vectors, tasks)
    d = len(mean)
    if not 1 <= k <= d:
        raise ValueError("1 <= k <= vector length")
    if d <= GRAM_MAX_DIM:
        _, v = np.linalg.eigh(_centred_product(vectors, tasks, mean, None))
        top = v[:, ::-1][:, :k]
    else:
        width = min(d, k + OVERSAMPLE)
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
        last = None
        for _ in range(SUBSPACE_STEPS):
            y = _centred_product(vectors, tasks, mean, q)
            ritz, v = np.linalg.eigh(q.T @ y)
            top, values = q @ v[:, ::-1][:, :k], ritz[::-1][:k]
            if last is not None and np.abs(values - last).max() <= 1e-14 * max(values.max(), 0.0):
                break
            last, q = values, np.linalg.qr(y)[0]
    signs = np.where(top[np.argmax(np.abs(top), axis=0), np.arange(k)] >= 0, 1.0, -1.0)
    return mean, top * signs


def _with_columns(df: DataFrame, x_col: str, new: Sequence[T.StructField], make: Callable[[np.ndarray, dict], list[pa.Array]], value) -> DataFrame:
    """``df`` (all columns) with columns computed from the matrix of ``x_col``
    and a broadcast ``value``; a null vector gives nulls."""
    bc = df.sparkSession.sparkContext.broadcast(value)
    at = df.columns.index(x_col)

    def run(batches):
        for b in batches:
            known = b.column(at).is_valid()
            cols = make(matrix(b.column(at).filter(known), known.true_count), bc.value) if known.true_count else None
            if known.true_count < b.num_rows:
                place = pa.array(np.where(known.to_numpy(zero_copy_only=False), np.cumsum(known.to_numpy(zero_copy_only=False)) - 1, -1))
                place = pc.if_else(known, place, None)
                cols = [c.take(place) for c in cols] if cols else [pa.nulls(b.num_rows, T_ARROW[f.dataType.simpleString()]) for f in new]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *(f.name for f in new)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new]))


T_ARROW = {"double": pa.float64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a column of equal lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))


def pca3(rows: DataFrame, x_col: str = "x", keep: Sequence[str] = ("row_id", "y"), k: int = 3) -> DataFrame:
    """M8: ``(keep..., PC1..PCk)`` of centred x."""
    data = rows.select(*keep, F.col(x_col).cast("array<double>").alias("__x"))
    mean, top = pca_loadings(data, k, "__x")
    fields = [T.StructField(f"PC{j + 1}", T.DoubleType()) for j in range(k)]
    project = lambda x, m: [pa.array(c) for c in ((x - m[0]) @ m[1]).T]
    return _with_columns(data, "__x", fields, project, (mean, top)).drop("__x")


# --- k-means -------------------------------------------------------------------


def uniform_of(*parts: Column) -> Column:
    """A draw in (0, 1): 52 bits of the digest of ``parts`` joined by ``|``."""
    text = F.concat_ws("|", *(p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(rows, centres); differences first, so equal vectors are at 0 exactly."""
    out = np.empty((len(x), len(c)))
    for i, centre in enumerate(c):
        out[:, i] = ((x - centre) ** 2).sum(axis=1)
    return out


def _draw(rows: DataFrame, rnd: int, seed: int, chosen: np.ndarray | None, n: int) -> list[tuple[int, np.ndarray]]:
    """``n`` rows without replacement, in proportion to the squared distance to
    the nearest of ``chosen`` (none: all alike): (row_id, vector) by falling luck."""
    luck = -F.log(uniform_of(F.lit(seed), F.lit(rnd), F.col("row_id")))
    if chosen is not None:
        far = lambda x, c: [pa.array(squared_distances(x, c).min(axis=1))]
        rows = _with_columns(rows, "x", [T.StructField("far", T.DoubleType())], far, chosen).where(F.col("far") > 0)
        luck = luck / F.col("far")
    got = rows.select(luck.alias("luck"), "row_id", "x").orderBy("luck", "row_id").limit(n).collect()  # n vectors
    return [(r.row_id, np.asarray(r.x, float)) for r in got]


def _reduce(ids: list[int], c: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the candidates by weighted k-means++ with the same kind of draws;
    with fewer distinct ones the last centres repeat the first (empty clusters)."""
    import hashlib

    def u(t, i):
        return (int(hashlib.md5(f"{seed}|{k}|{t}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)

    picked: list[int] = []
    for t in range(k):
        w = weight if not picked else weight * squared_distances(c, c[picked]).min(axis=1)
        luck = np.array([-np.log(u(t, i)) / v if v > 0 else np.inf for i, v in zip(ids, w)])
        if not np.isfinite(luck).any():
            break
        picked.append(int(np.argmin(luck)))
    return c[picked + [picked[0]] * (k - len(picked))]


def kmeans_fit(
    rows: DataFrame, ks: Sequence[int], x_col: str = "x", id_col: str = "row_id", seed: int = KMEANS_SEED,
    max_iter: int = KMEANS_MAX_ITER, tol: float = KMEANS_TOL,
) -> dict[int, np.ndarray]:
    """M9 for every k at once: centres (k x d) per k.

    ``ROUNDS`` seeding passes draw ``2 * max(ks)`` candidates each, shared by all
    k; one pass weighs them by the rows nearest to each; then every Lloyd step is
    one pass for all k that still move.  A cluster without rows keeps its centre."""
    ks = sorted({int(k) for k in ks})
    if not ks or ks[0] < 1:
        raise ValueError("k must be >= 1")
    data = rows.select(F.col(id_col).alias("row_id"), F.col(x_col).cast("array<double>").alias("x")).where("x is not null")
    data = materialize(data)
    tasks, spark = _tasks(data), rows.sparkSession
    vectors = data.select("x")
    stop = tol * mean_vector(vectors, tasks, mean_vector(vectors, tasks)).mean()

    ids, found = zip(*_draw(data, 0, seed, None, 1))
    for rnd in range(1, ROUNDS + 1):
        more = _draw(data, rnd, seed, np.stack(found), 2 * ks[-1])
        ids, found = (*ids, *(i for i, _ in more)), (*found, *(v for _, v in more))
    candidates = np.stack(found)
    nearest = _lloyd_sums(spark, vectors, tasks, {0: candidates})[0][0]
    centres = {k: _reduce(list(ids), candidates, nearest, k, seed) for k in ks}
    moving = list(ks)
    for _ in range(max_iter):
        sums = _lloyd_sums(spark, vectors, tasks, {k: centres[k] for k in moving})
        still = []
        for k in moving:
            n, total = sums[k]
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[k])
            if ((new - centres[k]) ** 2).sum() > stop:
                still.append(k)
            centres[k] = new
        moving = still
        if not moving:
            break
    return centres


def _lloyd_sums(spark, vectors: DataFrame, tasks: int, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per k: rows and summed vectors of each centre's nearest rows, in one job."""
    bc = spark.sparkContext.broadcast(centres)

    def sums(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            x = matrix(b.column(0), b.num_rows)
            for k, c in bc.value.items():
                at = squared_distances(x, c).argmin(axis=1)
                total = np.zeros((len(c), x.shape[1] + 1))
                np.add.at(total, at, np.concatenate((np.ones((len(x), 1)), x), axis=1))
                acc[k] = acc[k] + total.ravel() if k in acc else total.ravel()
        return acc

    got = sum_over(vectors, tasks, sums)
    bc.unpersist()
    shaped = {k: got[k].reshape(len(c), -1) for k, c in centres.items()}
    return {k: (v[:, 0], v[:, 1:]) for k, v in shaped.items()}


def assign_all(df: DataFrame, centres: dict[int, np.ndarray], x_col: str = "x", out: str = "clusters") -> DataFrame:
    """M10 for every k in one pass over the vectors: an array of the numbers of
    the nearest centres (first on ties), in the order of ``sorted(centres)``."""
    ordered = [np.asarray(centres[k], float) for k in sorted(centres)]

    def nearest(x, cs):
        return [_lists(np.stack([squared_distances(x, c).argmin(axis=1) for c in cs], axis=1), pa.int32())]

    return _with_columns(df, x_col, [T.StructField(out, T.ArrayType(T.IntegerType()))], nearest, ordered)


def kmeans_assign(rows: DataFrame, k: int, x_col: str = "x", seed: int = KMEANS_SEED):
    """M9: fit on ``rows``; returns ``(centres, assign)`` where ``assign(df)``
    adds an int ``cluster`` column (M10: nearest centre)."""
    centres = kmeans_fit(rows, [k], x_col, seed=seed)

    def assign(df: DataFrame) -> DataFrame:
        return assign_all(df, centres, x_col, "__c").withColumn("cluster", F.col("__c")[0]).drop("__c")

    return list(centres[k]), assign


def cluster_members(assigned: DataFrame, k: int) -> DataFrame:
    """``cluster, n, row_ids`` for every cluster 0..k-1, the empty ones with
    no row (positions are row ids, one list per cluster, as in the reference;
    use ``cluster_sizes`` where the lists would outgrow a row)."""
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    lists = assigned.groupBy("cluster").agg(F.sort_array(F.collect_list("row_id")).alias("row_ids"))
    return every.join(lists, "cluster", "left").select(
        "cluster", F.coalesce(F.size("row_ids"), F.lit(0)).cast("long").alias("n"), F.coalesce("row_ids", F.array().cast("array<bigint>")).alias("row_ids")
    )


def first_rows_as_centres(rows: DataFrame, k: int, x_col: str = "x", id_col: str = "row_id") -> list[list[float]]:
    """k fixed centres: the vectors of the k rows with the smallest ids
    (k x d doubles of model state)."""
    return [list(r[0]) for r in rows.orderBy(id_col).select(x_col).limit(k).collect()]


def nearest_centre(df: DataFrame, centres: Sequence[Sequence[float]], x_col: str = "x", out: str = "cluster") -> DataFrame:
    """M10 with given centres: index of the nearest centre (squared Euclidean,
    first index on ties).  The centres go out by broadcast: no join, no shuffle."""
    one = assign_all(df, {len(centres): np.asarray(centres, float)}, x_col, "__c")
    return one.withColumn(out, F.col("__c")[0]).drop("__c")


def cluster_sizes(assigned: DataFrame, k: int) -> DataFrame:
    """Rows per cluster, empty clusters kept with 0."""
    spark = assigned.sparkSession
    all_c = spark.range(k).select(F.col("id").cast("int").alias("cluster"))
    counts = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return all_c.join(counts, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"))


def routed_scores(rows: DataFrame, coefs: DataFrame, model_col: str = "model_id") -> DataFrame:
    """Score with the row's cluster model; 0.0 where that model is absent."""
    keep = [c for c in rows.columns if c not in (model_col, "x")]
    models = rows.withColumn("__own", F.array(F.col(model_col)))
    return score_models(models, "__own", coefs, keep, missing=0.0).withColumnRenamed("model_id", model_col)


def model_name(k, cluster: Column) -> Column:
    return F.concat(F.lit("k"), F.lit(k).cast("string"), F.lit(":c"), cluster.cast("string"))


def kmeans_sweep(
    rows: DataFrame, ks: Sequence[int] = range(1, 7), C: float = C_DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """Per k, clusters fitted on the 'train' rows, one probe per
    cluster, routed AUC on train and on test.  Returns
    ``(table(num_clusters, roc_auc_train, roc_auc_test), coefs)``.  The vectors
    are never copied per k: a row carries an array of its clusters' models."""
    ks = sorted({int(k) for k in ks})
    rows = materialize(rows.select("row_id", "part", F.col("y").cast("int").alias("y"), F.col("x").cast("array<double>").alias("x")))
    centres = kmeans_fit(rows.where(F.col("part") == "train"), ks)
    names = F.array(*(model_name(k, F.col("clusters")[j]) for j, k in enumerate(ks)))
    assigned = materialize(assign_all(rows, centres).select("part", "y", "x", names.alias("models")))
    coefs, _ = fit_many(assigned.where(F.col("part") == "train"), "models", C=C)
    scored = score_models(assigned, "models", coefs, ["part", "y"], missing=0.0)
    each = scored.withColumn("k", F.regexp_extract("model_id", "^k([0-9]+):", 1).cast("int"))
    auc = grouped_auc(each, ["k", "part"], "score", "y")
    table = auc.groupBy("k").agg(
        F.max(F.when(F.col("part") == "train", F.col("auc"))).alias("roc_auc_train"),
        F.max(F.when(F.col("part") == "test", F.col("auc"))).alias("roc_auc_test"),
    ).select(F.col("k").alias("num_clusters"), "roc_auc_train", "roc_auc_test")
    return table, coefs
