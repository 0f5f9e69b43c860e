import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aletheia import fixtures
from aletheia.operators import evaluate as E
from aletheia.operators import mixture as MX
from aletheia.operators import partials
from aletheia.operators import report as RP
from aletheia.operators.probeset import probe_set

from conftest import SF_SMALL


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    X, y = rng.normal(size=(25, 4)), rng.integers(0, 2, 25)
    p = MX.init_params(4, 3, 1, h=5)
    u = MX.uniform_noise(3, np.arange(25), 0, 3)
    g, _ = MX.grad_sums(p, X, y, u)
    flat, gf = MX.flatten(p), MX.flatten(g)
    num = np.zeros_like(flat)
    for i in range(len(flat)):
        q1, q2 = flat.copy(), flat.copy()
        q1[i] += 1e-6
        q2[i] -= 1e-6
        num[i] = (MX.grad_sums(MX.unflatten(q1, 4, 3, 5), X, y, u)[1] - MX.grad_sums(MX.unflatten(q2, 4, 3, 5), X, y, u)[1]) / 2e-6
    assert np.abs(num - gf).max() < 1e-6


def test_noise_is_counter_based():
    a = MX.uniform_noise(1, np.array([5, 6, 7]), 3, 4)
    b = MX.uniform_noise(1, np.array([7, 5]), 3, 4)
    assert np.array_equal(a[[2, 0]], b) and ((a >= 0) & (a < 1)).all()


def test_noise_of_columns_equals_numpy(spark):
    from aletheia.functions import noise

    ids = [0, 1, 5, 2**40 + 7, 2**62 + 11]
    for seed, epoch in ((3, 0), (7919, -1), (2**33 + 1, 499)):
        df = spark.createDataFrame([(i, seed) for i in ids], "row_id long, seed long")
        for s in (seed, F.col("seed")):
            got = np.array([r.u for r in df.select(noise.uniform(s, F.col("row_id"), epoch, F.lit(4)).alias("u")).collect()])
            assert np.array_equal(got, MX.uniform_noise(seed, np.array(ids), epoch, 4))


@pytest.mark.parametrize("route", ["gumbel", "soft", "hard"])
@pytest.mark.parametrize("bias", [True, False])
def test_forward_in_columns_equals_numpy(spark, route, bias):
    rows = E.cached(probe_set(fixtures.probe(spark, SF_SMALL)))
    params = {c: MX.init_params(8, e, c + 1, h=6, bias=bias) for c, e in ((0, 1), (2, 3))}
    key = lambda r: (r.config_id, r.row_id)
    want = sorted(MX.score_mixtures(rows, params, route, seed=5).collect(), key=key)
    got = sorted(MX.score_mixtures_sql(rows, params, route, seed=5).collect(), key=key)
    assert [tuple(r)[:4] + (r.selected_expert,) for r in got] == [tuple(r)[:4] + (r.selected_expert,) for r in want]
    assert max(abs(a.score - b.score) for a, b in zip(got, want)) < 1e-12
    plan = MX.score_mixtures_sql(rows, params, route)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan


def test_cosine_schedule():
    assert MX.cosine_lr(1e-3, 0, 500) == pytest.approx(1e-3)
    assert MX.cosine_lr(1e-3, 250, 500) == pytest.approx((1e-3 + 1e-5) / 2)
    assert MX.cosine_lr(1e-3, 500, 500) == pytest.approx(1e-5)


def test_one_expert_soft_equals_its_expert():
    rng = np.random.default_rng(1)
    X = rng.normal(size=(6, 3))
    p = MX.init_params(3, 1, 0, h=4)
    out, _ = MX.forward(p, X, MX.uniform_noise(0, np.arange(6), 0, 1), "gumbel")
    assert np.allclose(out, X @ p["We"][0].T + p["be"][0])


def test_hard_routing_first_index_on_ties():
    p = MX.init_params(2, 3, 0, h=2)
    p["W2"][:] = 0.0
    p["b2"][:] = 0.0
    _, c = MX.forward(p, np.ones((4, 2)), route="hard")
    assert (c["sel"] == 0).all()


def numpy_training(train, batch_size, hidden, bias, seed, epochs, e=2, lr=1e-3, wd=1e-4):
    """The same training as one NumPy loop; batches as Spark deals them."""
    n = train.count()
    n_batches = 1 if batch_size is None else -(-n // batch_size)
    first = train.toPandas().sort_values("row_id")
    X, y, ids = np.stack(first.x.values), first.y.values.astype(int), first.row_id.values
    p = MX.flatten(MX.init_params(X.shape[1], e, seed, hidden, bias))
    steps = 0
    for ep in range(epochs):
        dealt = train.select("row_id", MX.dealt_batch(seed, ep, n_batches).alias("b")).toPandas().sort_values("row_id").b.values
        for b in range(n_batches):
            at = dealt == b
            if at.any():
                shaped = MX.unflatten(p, X.shape[1], e, hidden, bias)
                g, _ = MX.grad_sums(shaped, X[at], y[at], MX.uniform_noise(seed, ids[at], ep, e))
                p = p - MX.cosine_lr(lr, ep, epochs) * (MX.flatten(g) / at.sum() + wd * p)
                steps += 1
    return p, steps


@pytest.mark.parametrize("parts", [1, 6])
@pytest.mark.parametrize("n_batches,hidden,bias", [(1, 64, True), (7, 64, True), (7, 5, False)])
def test_distributed_training_equals_numpy_loop(spark, parts, n_batches, hidden, bias):
    rows = E.cached(probe_set(fixtures.probe(spark, SF_SMALL)))
    train = rows.where("part = 'train'")
    batch_size = None if n_batches == 1 else -(-train.count() // n_batches)
    params, hist = MX.train_mixtures(
        train.repartition(parts), [(0, 2, 1e-4, 1e-3)], epochs=3, seed=0, batch_size=batch_size, hidden_dim=hidden, bias=bias
    )
    want, steps = numpy_training(train, batch_size, hidden, bias, 0, 3)
    assert np.abs(MX.flatten(params[0]) - want).max() < 1e-12
    assert steps == 3 * n_batches and [h[:2] for h in hist] == [(0, 0), (0, 1), (0, 2)] and ("be" in params[0]) == bias


def test_partials_are_added_in_a_tree(spark, monkeypatch):
    rows = E.cached(probe_set(fixtures.probe(spark, SF_SMALL)))
    train = rows.where("part = 'train'").repartition(7)
    grid = [(0, 2, 1e-4, 1e-3), (3, 1, 1e-4, 1e-3)]
    flat, _ = MX.train_mixtures(train, grid, epochs=2, batch_size=None)
    monkeypatch.setattr(partials, "FAN_IN", 2)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 7)
    tree, _ = MX.train_mixtures(train, grid, epochs=2, batch_size=None)
    for cid in (0, 3):
        assert np.abs(MX.flatten(flat[cid]) - MX.flatten(tree[cid])).max() < 1e-12


def test_mini_batches_smaller_than_one_row_each_and_bad_input(spark):
    train = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(5)], "row_id long, y int, x array<double>")
    params, hist = MX.train_mixtures(train, [(0, 1, 0.0, 0.1)], epochs=2, batch_size=1)  # some batches are empty
    want, steps = numpy_training(train, 1, 64, True, 0, 2, e=1, lr=0.1, wd=0.0)
    assert np.abs(MX.flatten(params[0]) - want).max() < 1e-12 and 2 <= steps <= 10
    with pytest.raises(ValueError):
        MX.train_mixtures(train, [(0, 1, 0.0, 0.1)], batch_size=0)
    with pytest.raises(ValueError):
        MX.train_mixtures(train.limit(0), [(0, 1, 0.0, 0.1)])


def small_rows(spark, n=600):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 2)), rng.normal(size=3).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, y int, x array<double>").repartition(3)


def test_small_mini_batches_share_their_jobs(spark):
    train = E.cached(small_rows(spark))
    sc = spark.sparkContext
    sc.setJobGroup("steps", "mini-batches of 4 rows")
    try:
        params, hist = MX.train_mixtures(train, [(0, 2, 1e-3, 0.1)], epochs=2, batch_size=4)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    want, steps = numpy_training(train, 4, 64, True, 0, 2, lr=0.1, wd=1e-3)
    assert np.abs(MX.flatten(params[0]) - want).max() < 1e-12 and len(hist) == 2
    assert steps > 250 and len(sc.statusTracker().getJobIdsForGroup("steps")) < 40  # a job per step before


def test_stretches_of_mini_batches_equal_numpy_loop(spark, monkeypatch):
    train = E.cached(small_rows(spark, 200))
    grid = [(0, 2, 1e-3, 0.1), (3, 1, 1e-2, 0.2)]
    monkeypatch.setattr(MX, "STRETCH_BYTES", 2400)  # four stretches
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")  # mini-batches reach a task in pieces
    try:
        params, hist = MX.train_mixtures(train, grid, epochs=2, seed=2, batch_size=20)
        plain, _ = MX.train_mixtures(train, grid[:1], epochs=2, seed=2, batch_size=20, schedule=None)
        monkeypatch.setattr(MX, "STEP_BYTES", 0)  # data-parallel steps
        spread, told = MX.train_mixtures(train, grid, epochs=2, seed=2, batch_size=20)
    finally:
        spark.conf.set(key, before)
    want, _ = numpy_training(train, 20, 64, True, 2, 2, lr=0.1, wd=1e-3)
    for got in (params, spread):
        assert np.abs(MX.flatten(got[0]) - want).max() < 1e-12
    assert np.abs(MX.flatten(params[3]) - MX.flatten(spread[3])).max() < 1e-12
    assert [h[:2] for h in hist] == [h[:2] for h in told] == [(0, 0), (3, 0), (0, 1), (3, 1)]
    assert [h[2] for h in hist] == pytest.approx([h[2] for h in told])
    assert np.abs(MX.flatten(plain[0]) - want).max() > 1e-6  # no schedule: another rate


def test_repeated_and_null_ids_in_stretches(spark, monkeypatch):
    rng = np.random.default_rng(7)
    ids = [None if i % 11 == 0 else 5 if i % 3 == 0 else i for i in range(150)]  # one id holds a third of the rows
    rows = [(i, int(rng.integers(0, 2)), rng.normal(size=3).tolist()) for i in ids]
    train = E.cached(spark.createDataFrame(rows, "row_id long, y int, x array<double>"))
    args = dict(epochs=2, seed=1, batch_size=10)
    monkeypatch.setattr(MX, "STRETCH_BYTES", 2400)
    params, hist = MX.train_mixtures(train, [(0, 2, 1e-3, 0.1)], **args)
    monkeypatch.setattr(MX, "STEP_BYTES", 0)
    want, told = MX.train_mixtures(train, [(0, 2, 1e-3, 0.1)], **args)
    assert np.abs(MX.flatten(params[0]) - MX.flatten(want[0])).max() < 1e-12
    assert [h[2] for h in hist] == pytest.approx([h[2] for h in told])


def test_grid_scores_and_best(spark):
    rows = E.cached(probe_set(fixtures.probe(spark, SF_SMALL)))
    scores, ptab = MX.mixture_grid(rows, num_experts=(1, 2), epochs=3)
    scores = E.cached(scores)
    assert scores.select("config_id").distinct().count() == 2
    assert ptab.where("name = 'We'").count() == 2
    best = RP.best_config(scores).collect()
    assert len(best) == 2
    assert RP.best_table(scores, RP.best_config(scores)).count() == 2 * rows.select("source").distinct().count()


def test_grid_lists_sources_without_test_rows(spark):
    rows = E.cached(probe_set(fixtures.probe(spark, SF_SMALL)))
    gone = E.cached(rows.where("not (source = 'src0' and part = 'test')"))
    scores, _ = MX.mixture_grid(gone, num_experts=(1,), epochs=1)
    got = {r.source: r.auc for r in scores.collect()}
    assert set(got) == {r[0] for r in rows.select("source").distinct().collect()} and got["src0"] is None


def test_best_table_keeps_undefined_apart_from_absent(spark):
    sc = spark.createDataFrame(
        [(1, 0, "a", 0.7), (1, 0, "b", None), (2, 2, "a", 0.4), (2, 2, "c", 0.9)],
        "num_experts int, config_id int, source string, auc double",
    )
    got = {(r.num_experts, r.source): r.auc for r in RP.best_table(sc, RP.best_config(sc)).collect()}
    assert got == {(1, "a"): 0.7, (1, "b"): None, (1, "c"): 0.0, (2, "a"): 0.4, (2, "b"): 0.0, (2, "c"): 0.9}


def test_best_config_ties_and_all_null(spark):
    sc = spark.createDataFrame(
        [(1, 0, "a", 0.7), (1, 1, "a", 0.7), (2, 2, "a", None), (2, 3, "a", 0.2)],
        "num_experts int, config_id int, source string, auc double",
    )
    best = {r.num_experts: r.config_id for r in RP.best_config(sc).collect()}
    assert best == {1: 0, 2: 3}
