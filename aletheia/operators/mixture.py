"""Mixture of linear classifiers with a learned router.

Model (per config): router Linear(d,H) → ReLU → Linear(H,E); E experts
Linear(d,2), with or without bias.  Soft forward: weights = softmax((router +
Gumbel noise) / T), output = Σ_e weight_e · expert_e(x).  Hard forward: the
argmax expert only.

Training is SGD over mini-batches.  Rows are dealt to the batches of an epoch by
a hash of (row_id, epoch), so batches do not depend on partitioning; they hold
``batch_size`` rows on average, not exactly.  Every config of the grid shares each
pass over the data.  Steps follow one another by nature, so the batch size, not
the data, should grow with the cluster.

* Large batches are data-parallel, a Spark job each: parameters go out by
  broadcast, each task returns the gradient sums of its rows of the batch (NumPy
  inside ``mapInArrow``, one partial per task and config; ``partials.sum_over``
  adds them in a tree), and the driver takes an SGD step with weight decay and the
  scheduled rate.  With ``batch_size=None`` a batch is the whole data, as in the
  reference's experiment: then an epoch is one Spark job.
* Batches up to ``STEP_BYTES`` hold less work than a job costs.  An epoch's rows
  are shuffled once into stretches of consecutive batches (``STRETCH_BYTES`` each,
  sorted in parallel); a job per stretch takes all its steps in one task and hands
  the parameters on to the next.

Gumbel noise comes from a counter hash of (seed, row_id, epoch, expert), so it
does not depend on partitioning or on re-execution after a lost executor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aletheia.functions.noise import EPOCH_STEP, EPS, EXPERT_STEP, MIX_1, MIX_2, ROW_STEP, SEED_STEP, gumbel, uniform
from aletheia.functions.vectors import dot, softmax2_class1
from aletheia.operators.auc import grouped_auc
from aletheia.operators.partials import PARTIAL, matrix, partial_row, sum_over
from aletheia.plans.plans import param_grid
from aletheia.session import materialize

HIDDEN = 64  # fixed value: router hidden units
EPOCHS = 500  # fixed value: epochs per config in the experiment
TEMPERATURE = 1.0  # forward() temperature actually used by the reference
BATCH_SIZE = 128  # fixed value: default rows per mini-batch
STEP_BYTES = 8 * 1024 * 1024  # mini-batches up to this size share a task, step after step
STRETCH_BYTES = 64 * 1024 * 1024  # rows whose steps one task takes
PARAM_NAMES = ("W1", "b1", "W2", "b2", "We", "be")


# ----------------------------------------------------------------------------
# parameters
# ----------------------------------------------------------------------------


def shapes(d: int, e: int, h: int = HIDDEN, bias: bool = True) -> dict[str, tuple[int, ...]]:
    """``bias``: whether the experts have bias terms (the router always has)."""
    out = {"W1": (h, d), "b1": (h,), "W2": (e, h), "b2": (e,), "We": (e, 2, d), "be": (e, 2)}
    return out if bias else {k: v for k, v in out.items() if k != "be"}


def init_params(d: int, e: int, seed: int, h: int = HIDDEN, bias: bool = True) -> dict[str, np.ndarray]:
    """Linear-layer default init: U(±1/sqrt(fan_in)) for weights and biases."""
    rng = np.random.default_rng(seed)
    fan = {"W1": d, "b1": d, "W2": h, "b2": h, "We": d, "be": d}
    return {k: rng.uniform(-1, 1, s) / math.sqrt(fan[k]) for k, s in shapes(d, e, h, bias).items()}


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in PARAM_NAMES if k in p])


def unflatten(v: np.ndarray, d: int, e: int, h: int = HIDDEN, bias: bool = True) -> dict[str, np.ndarray]:
    out, i = {}, 0
    for k, s in shapes(d, e, h, bias).items():
        n = int(np.prod(s))
        out[k] = v[i : i + n].reshape(s)
        i += n
    return out


# ----------------------------------------------------------------------------
# noise, forward, gradient (NumPy, run inside tasks)
# ----------------------------------------------------------------------------

def _mix64(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return z ^ (z >> np.uint64(31))


def uniform_noise(seed: int, row_ids: np.ndarray, epoch: int, n_experts: int) -> np.ndarray:
    """U[0,1) per (row, expert) from a counter hash (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        base = np.uint64(seed) * np.uint64(SEED_STEP) + np.uint64(epoch + 1) * np.uint64(EPOCH_STEP)
        r = row_ids.astype(np.uint64)[:, None] * np.uint64(ROW_STEP)
        k = np.arange(n_experts, dtype=np.uint64)[None, :] * np.uint64(EXPERT_STEP)
        z = _mix64(_mix64(base + r) + k)
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _softmax(a: np.ndarray) -> np.ndarray:
    a = a - a.max(axis=1, keepdims=True)
    ex = np.exp(a)
    return ex / ex.sum(axis=1, keepdims=True)


def forward(p, X, u=None, route="gumbel", temperature=TEMPERATURE):
    """Returns (logits (n,2), cache).  route: 'gumbel' (noise u), 'soft', 'hard'."""
    pre = X @ p["W1"].T + p["b1"]
    hdn = np.maximum(pre, 0.0)
    r = hdn @ p["W2"].T + p["b2"]
    z = np.einsum("ekd,nd->nek", p["We"], X)  # (n, E, 2)
    if "be" in p:
        z = z + p["be"][None, :, :]
    if route == "hard":
        sel = np.argmax(r, axis=1)
        return z[np.arange(len(X)), sel, :], {"sel": sel}
    s = r if route == "soft" else r + (-np.log(-np.log(u + EPS) + EPS))
    w = _softmax(s / temperature)
    out = np.einsum("ne,nek->nk", w, z)
    return out, {"pre": pre, "hdn": hdn, "z": z, "w": w}


def grad_sums(p, X, y, u, temperature=TEMPERATURE):
    """Sum over rows of d(cross-entropy)/d(params), and the loss sum."""
    out, c = forward(p, X, u, "gumbel", temperature)
    prob = _softmax(out)
    loss = -np.log(np.clip(prob[np.arange(len(y)), y], 1e-300, None)).sum()
    dout = prob.copy()
    dout[np.arange(len(y)), y] -= 1.0  # (n,2)
    dz = c["w"][:, :, None] * dout[:, None, :]  # (n,E,2)
    g = {"We": np.einsum("nek,nd->ekd", dz, X)}
    if "be" in p:
        g["be"] = dz.sum(0)
    dw = np.einsum("nk,nek->ne", dout, c["z"])
    ds = c["w"] * (dw - (c["w"] * dw).sum(1, keepdims=True)) / temperature
    g["W2"] = ds.T @ c["hdn"]
    g["b2"] = ds.sum(0)
    dpre = (ds @ p["W2"]) * (c["pre"] > 0)
    g["W1"] = dpre.T @ X
    g["b1"] = dpre.sum(0)
    return g, loss


def cosine_lr(lr: float, epoch: int, epochs: int, eta_min: float | None = None) -> float:
    """Rate used in ``epoch`` (0-based), annealed from lr to lr/100."""
    eta_min = lr / 100 if eta_min is None else eta_min
    return eta_min + (lr - eta_min) * (1 + math.cos(math.pi * epoch / epochs)) / 2


# ----------------------------------------------------------------------------
# distributed training and scoring
# ----------------------------------------------------------------------------

def _gradients(batch: DataFrame, tasks: int, bc, epoch: int, seed: int) -> dict[int, tuple[np.ndarray, float, float]]:
    """One Spark job: summed gradients, loss and rows of every config over the
    rows of ``batch``."""

    def sums(batches):
        payload, acc = bc.value, {}
        for rows in batches:
            X = matrix(rows.column(2), rows.num_rows)
            y, ids = rows.column(1).to_numpy().astype(np.int64), rows.column(0).to_numpy()
            for cid, (e, flat) in payload["configs"].items():
                p = unflatten(flat, payload["d"], e, payload["hidden"], payload["bias"])
                g, loss = grad_sums(p, X, y, uniform_noise(seed + cid, ids, epoch, e))
                v = np.concatenate((flatten(g), [loss, len(y)]))
                acc[cid] = acc[cid] + v if cid in acc else v
        return acc

    got = sum_over(batch.select("row_id", "y", "x"), tasks, sums)
    return {cid: (v[:-2], v[-2], v[-1]) for cid, v in got.items()}


def dealt_batch(seed: int, epoch: int, n_batches: int) -> Column:
    """The mini-batch of a row in an epoch: 52 bits of a digest of (seed, epoch, row_id)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{epoch}|"), F.col("row_id").cast("string"))), 1, 13), 16, 10)
    return F.pmod(bits.cast("bigint"), F.lit(n_batches)).cast("int")


class _Chain:
    """One config's steps over mini-batches that follow one another.  A batch may
    come in pieces; its step is taken when the next one begins."""

    def __init__(self, e: int, flat: np.ndarray, wd: float, rate: float, payload: dict):
        self.e, self.wd, self.rate = e, wd, rate
        self.flat = np.array(flat)
        self.p = unflatten(self.flat, payload["d"], e, payload["hidden"], payload["bias"])  # views: they follow the steps
        self.batch, self.sums, self.rows = None, 0.0, 0
        self.loss, self.steps = 0.0, 0

    def add(self, batch: int, X: np.ndarray, y: np.ndarray, u: np.ndarray) -> None:
        if batch != self.batch:
            self.step()
            self.batch = batch
        g, loss = grad_sums(self.p, X, y, u)
        self.sums = self.sums + np.append(flatten(g), loss)
        self.rows += len(y)

    def step(self) -> None:
        if not self.rows:
            return
        mean = self.sums / self.rows
        self.flat -= self.rate * (mean[:-1] + self.wd * self.flat)
        self.loss += mean[-1]
        self.steps += 1
        self.sums, self.rows = 0.0, 0


def _take_stretch(dealt: DataFrame, k: int, bc, epoch: int, seed: int) -> dict[int, tuple[np.ndarray, float, int]]:
    """One Spark job of one task: all steps of stretch ``k`` in order.  Parameters
    after them, sum of the steps' mean losses and number of steps of every config."""

    def run(batches):
        payload = bc.value
        chains = {cid: _Chain(*config, payload) for cid, config in payload["configs"].items()}
        for rows in batches:
            if not rows.num_rows:
                continue
            X = matrix(rows.column(2), rows.num_rows)
            y, ids = rows.column(1).to_numpy().astype(np.int64), rows.column(0).to_numpy()
            batch = rows.column(3).to_numpy()
            if batch[0] // payload["stretch"] != k or batch[-1] // payload["stretch"] != k:
                raise RuntimeError(f"mini-batches {batch[0]} to {batch[-1]} are not of stretch {k}")
            cuts = [0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(batch)]
            for cid, chain in chains.items():
                u = uniform_noise(seed + cid, ids, epoch, chain.e)
                for lo, hi in zip(cuts, cuts[1:]):
                    chain.add(int(batch[lo]), X[lo:hi], y[lo:hi], u[lo:hi])
        for cid, chain in chains.items():
            chain.step()
            yield partial_row(cid, k, np.append(chain.flat, (chain.loss, chain.steps)))

    taken = dealt.select("row_id", "y", "x", "batch").mapInArrow(run, PARTIAL).rdd
    got = {r.key: np.frombuffer(r.v) for r in dealt.sparkSession.sparkContext.runJob(taken, list, [k])}
    return {cid: (v[:-2], float(v[-2]), int(v[-1])) for cid, v in got.items()}


def _chained_epoch(
    data: DataFrame, n_batches: int, n_stretches: int, configs: dict[int, tuple], shared: dict, epoch: int, seed: int
) -> dict[int, tuple[np.ndarray, float]]:
    """The steps of an epoch of small mini-batches.  ``configs``: per id (experts,
    parameters, weight decay, rate).  Returns per id (parameters, mean loss of its steps)."""
    sc = data.sparkSession.sparkContext
    stretch = -(-n_batches // n_stretches)
    n_stretches = -(-n_batches // stretch)
    dealt = data.withColumn("batch", dealt_batch(seed, epoch, n_batches)).where(F.col("batch").isNotNull())
    dealt = dealt.repartitionById(n_stretches, F.floor(F.col("batch") / stretch).cast("int")).sortWithinPartitions("batch", "row_id")
    dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK)
    dealt.count()  # all stretches are sorted in parallel, before the first is taken
    told = {cid: [0.0, 0] for cid in configs}
    for k in range(n_stretches):
        bc = sc.broadcast({**shared, "stretch": stretch, "configs": configs})
        for cid, (flat, loss, steps) in _take_stretch(dealt, k, bc, epoch, seed).items():
            configs = {**configs, cid: (configs[cid][0], flat, *configs[cid][2:])}
            told[cid][0] += loss
            told[cid][1] += steps
        bc.unpersist()
    dealt.unpersist()
    return {cid: (configs[cid][1], loss / steps) for cid, (loss, steps) in told.items()}


def train_mixtures(
    train: DataFrame,
    grid: Sequence[tuple[int, int, float, float]],
    epochs: int = EPOCHS,
    seed: int = 0,
    schedule: Callable[[float, int, int], float] | None = cosine_lr,
    x_col: str = "x",
    batch_size: int | None = BATCH_SIZE,
    hidden_dim: int = HIDDEN,
    bias: bool = True,
) -> tuple[dict[int, dict[str, np.ndarray]], list[tuple[int, int, float]]]:
    """SGD (weight decay on all parameters) for every config ``(config_id,
    num_experts, weight_decay, lr)``, all in the same passes.  ``batch_size`` is
    the mean size of a mini-batch, None the whole data.  Returns (params per
    config, loss history rows (config_id, epoch, mean loss of its steps))."""
    if batch_size is not None and batch_size < 1:
        raise ValueError("batch_size must be positive, or None for all rows")
    spark = train.sparkSession
    data = train.select("row_id", F.col("y").cast("int").alias("y"), F.col(x_col).alias("x"))
    # hundreds of passes: lineage is cut at a reliable checkpoint first, and all
    # that is asked of the rows before training is asked of it
    data = materialize(data)
    n_rows = data.count()
    if not n_rows:
        raise ValueError("no rows to train on")
    d = len(data.select("x").first()[0])
    row_bytes = d * 8 + 24
    parts = max(spark.sparkContext.defaultParallelism, int(math.ceil(n_rows * row_bytes / (64 * 1024 * 1024))))
    tasks = min(parts, max(1, data.rdd.getNumPartitions()))
    data = data.coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    n_batches = 1 if batch_size is None else -(-n_rows // batch_size)
    chained = n_batches > 1 and batch_size * row_bytes <= STEP_BYTES
    shared = {"d": d, "hidden": hidden_dim, "bias": bias}
    params = {cid: flatten(init_params(d, e, seed + cid, hidden_dim, bias)) for cid, e, _, _ in grid}
    hist = []
    for epoch in range(epochs):
        rates = {cid: schedule(lr, epoch, epochs) if schedule else lr for cid, _, _, lr in grid}
        if chained:
            n_stretches = min(n_batches, int(math.ceil(n_rows * row_bytes / STRETCH_BYTES)))
            configs = {cid: (e, params[cid], wd, rates[cid]) for cid, e, wd, _ in grid}
            for cid, (flat, loss) in _chained_epoch(data, n_batches, n_stretches, configs, shared, epoch, seed).items():
                params[cid] = flat
                hist.append((cid, epoch, loss))
            continue
        dealt = data
        if n_batches > 1:  # in memory by batch, so that a step reads its own rows only
            dealt = data.withColumn("batch", dealt_batch(seed, epoch, n_batches)).sortWithinPartitions("batch")
            dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK)
        losses: dict[int, list[float]] = {cid: [] for cid, *_ in grid}
        for b in range(n_batches):
            bc = spark.sparkContext.broadcast({**shared, "configs": {cid: (e, params[cid]) for cid, e, _, _ in grid}})
            grads = _gradients(dealt if n_batches == 1 else dealt.where(F.col("batch") == b), tasks, bc, epoch, seed)
            for cid, _, wd, _ in grid:
                if cid not in grads:  # a batch without rows takes no step
                    continue
                g, loss, n = grads[cid]
                params[cid] = params[cid] - rates[cid] * (g / n + wd * params[cid])
                losses[cid].append(loss / n)
            bc.unpersist()
        if n_batches > 1:
            dealt.unpersist()
        hist += [(cid, epoch, sum(v) / len(v)) for cid, v in losses.items()]
    data.unpersist()
    return {cid: unflatten(params[cid], d, e, hidden_dim, bias) for cid, e, _, _ in grid}, hist


def score_mixtures(
    rows: DataFrame,
    params: dict[int, dict[str, np.ndarray]],
    route: str = "gumbel",
    seed: int = 0,
    x_col: str = "x",
) -> DataFrame:
    """M16/M17/M21 scoring: ``(config_id, row_id, source, y, score,
    selected_expert)``; score = softmax class-1 probability.  route 'gumbel'
    keeps the noise on while scoring, as the reference's evaluation does."""
    spark = rows.sparkSession
    bc = spark.sparkContext.broadcast({cid: {k: v for k, v in p.items()} for cid, p in params.items()})
    schema = "config_id int, row_id long, source string, y int, score double, selected_expert int"

    def run(batches):
        ps = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = np.stack(pdf["x"].values).astype(np.float64)
            for cid, p in ps.items():
                e = p["W2"].shape[0]
                u = uniform_noise(seed + cid + 7919, pdf["row_id"].values, -1, e) if route == "gumbel" else None
                out, c = forward(p, X, u, route)
                prob = _softmax(out)[:, 1]
                sel = c["sel"] if route == "hard" else np.full(len(X), -1)
                yield pd.DataFrame(
                    {
                        "config_id": cid,
                        "row_id": pdf["row_id"].values,
                        "source": pdf["source"].values,
                        "y": pdf["y"].values.astype(np.int32),
                        "score": prob,
                        "selected_expert": sel.astype(np.int32),
                    }
                )

    data = rows.select("row_id", "source", F.col("y").cast("int").alias("y"), F.col(x_col).alias("x"))
    return data.mapInPandas(run, schema)


def params_rows(spark, params: dict[int, dict[str, np.ndarray]]) -> DataFrame:
    """One row per config: its weights as nested arrays (``be`` NULL without bias)."""
    rows = [(cid, *(p[k].tolist() if k in p else None for k in PARAM_NAMES)) for cid, p in sorted(params.items())]
    one, two, three = "array<double>", "array<array<double>>", "array<array<array<double>>>"
    return spark.createDataFrame(rows, f"config_id int, W1 {two}, b1 {one}, W2 {two}, b2 {one}, We {three}, be {two}")


def score_mixtures_sql(
    rows: DataFrame,
    params: dict[int, dict[str, np.ndarray]],
    route: str = "gumbel",
    seed: int = 0,
    x_col: str = "x",
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """M16/M17 as column expressions, no Python workers: the rows, columns and
    values of ``score_mixtures``, which suits wide vectors better.  The weights
    are a row per config, joined by broadcast (their size is the models')."""
    if route not in ("gumbel", "soft", "hard"):
        raise ValueError(f"Unknown route {route}")
    linear = lambda w, b: F.zip_with(w, b, lambda v, c: dot(F.col("x"), v) + c)
    data = rows.select(
        "row_id", "source", F.col("y").cast("int").alias("y"), F.col(x_col).cast("array<double>").alias("x"),
        F.explode(F.array(*(F.lit(c).cast("int") for c in sorted(params)))).alias("config_id"),
    ).join(F.broadcast(params_rows(rows.sparkSession, params)), "config_id")
    data = data.withColumn("hidden", F.transform(linear("W1", "b1"), lambda v: F.greatest(v, F.lit(0.0))))
    data = data.withColumn("r", F.zip_with("W2", "b2", lambda w, c: dot(F.col("hidden"), w) + c))
    no_bias = F.transform("We", lambda w: F.array(F.lit(0.0), F.lit(0.0)))
    data = data.withColumn("z", F.zip_with("We", F.coalesce("be", no_bias), lambda w, c: linear(w, c)))
    if route == "hard":
        data = data.withColumn("selected_expert", (F.array_position("r", F.array_max("r")) - 1).cast("int"))
        data = data.withColumn("out", F.get("z", F.col("selected_expert")))
    else:
        if route == "gumbel":
            u = uniform(F.lit(seed + 7919) + F.col("config_id"), F.col("row_id"), -1, F.size("r"))
            data = data.withColumn("r", F.zip_with("r", u, lambda a, v: a + gumbel(v)))
        data = data.withColumn("w", F.transform("r", lambda v: F.exp((v - F.array_max("r")) / F.lit(temperature))))
        total = F.aggregate("w", F.lit(0.0), lambda a, b: a + b)
        data = data.withColumn("w", F.transform("w", lambda v: v / total)).withColumn("selected_expert", F.lit(-1))
        mixed = lambda k: F.aggregate(F.zip_with("w", "z", lambda w, z: w * z[k]), F.lit(0.0), lambda a, b: a + b)
        data = data.withColumn("out", F.array(mixed(0), mixed(1)))
    score = softmax2_class1(F.col("out")[0], F.col("out")[1])
    return data.select("config_id", "row_id", "source", "y", score.alias("score"), "selected_expert")


def params_table(spark, params: dict[int, dict[str, np.ndarray]]) -> DataFrame:
    """Parameters as a table ``(config_id, name, shape, values)``."""
    rows = [
        (cid, k, [int(s) for s in v.shape], [float(t) for t in v.ravel()]) for cid, p in params.items() for k, v in p.items()
    ]
    return spark.createDataFrame(rows, "config_id int, name string, shape array<int>, values array<double>")


def mixture_grid(
    rows: DataFrame,
    num_experts: Sequence[int] = (1, 2, 3, 5, 7),
    weight_decays: Sequence[float] = (1e-4,),
    lrs: Sequence[float] = (1e-3,),
    epochs: int = EPOCHS,
    seed: int = 0,
    route: str = "gumbel",
    batch_size: int | None = None,
    hidden_dim: int = HIDDEN,
    bias: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Train every grid config on the 'train' rows (full batch, as the
    experiment does, unless ``batch_size`` says otherwise), AUC per source on
    the 'test' rows.  Returns (scores(config_id, num_experts, weight_decay,
    lr, source, auc), params table)."""
    spark = rows.sparkSession
    grid_df = param_grid(spark, num_experts, weight_decays, lrs)
    grid = [(r.config_id, r.num_experts, r.weight_decay, r.lr) for r in grid_df.collect()]
    params, _ = train_mixtures(rows.where(F.col("part") == "train"), grid, epochs, seed, batch_size=batch_size, hidden_dim=hidden_dim, bias=bias)
    scored = score_mixtures(rows.where(F.col("part") == "test"), params, route, seed)
    auc = grouped_auc(scored, ["config_id", "source"], "score", "y")
    # every source for every config; NULL where it has no test rows
    named = grid_df.crossJoin(rows.select("source").distinct())  # configs x sources is the result itself
    scores = named.join(auc.select("config_id", "source", "auc"), ["config_id", "source"], "left").select(*grid_df.columns, "source", "auc")
    return scores, params_table(spark, params)
