import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aletheia import fixtures
from aletheia.operators import cluster as CL
from aletheia.operators import evaluate as E
from aletheia.operators.linear import centroid_directions, fit_many
from aletheia.operators.probeset import probe_set
from aletheia.operators.similarity import cosine_matrix
from aletheia.plans import plans as P

from conftest import SF_MID, SF_SMALL


def newton(X, y, C=1e-4):
    w = np.zeros(X.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-X @ w))
        g = w + C * X.T @ (p - y)
        H = np.eye(len(w)) + C * (X.T * (p * (1 - p))) @ X
        w -= np.linalg.solve(H, g)
    return w


@pytest.fixture(scope="module")
def rows(spark):
    return E.cached(probe_set(fixtures.probe(spark, SF_MID)))


@pytest.mark.parametrize("newton_dim", [256, 4])  # with Hessians, and by conjugate gradients
def test_shared_passes_equal_separate_newton(spark, rows, monkeypatch, newton_dim):
    from aletheia.operators import linear as L

    monkeypatch.setattr(L, "NEWTON_DIM", newton_dim)
    pdf = rows.toPandas()
    for C in (1e-4, 1.0):
        coefs, status = fit_many(rows.withColumn("model_id", F.col("source")).select("model_id", "x", "y"), C=C)
        got = {r.model_id: np.array(r.w) for r in coefs.collect()}
        assert set(got) == set(pdf.source)
        for s, w in got.items():
            q = pdf[pdf.source == s]
            ref = newton(np.stack(q.x.values), q.y.values.astype(float), C)
            assert np.abs(w - ref).max() <= 1e-8 * np.abs(ref).max()
        for r in status.collect():
            assert r.fit_status == "ok" and r.steps >= 1 and 0 <= r.residual < 1e-8


def test_rows_of_several_models_ragged_and_unfinished_fits(spark, rows, monkeypatch):
    from aletheia.operators import linear as L

    several = rows.withColumn("models", F.array(F.col("source"), F.lit("all")))
    together = {r.model_id: np.array(r.w) for r in fit_many(several, "models")[0].collect()}
    alone = {r.model_id: np.array(r.w) for r in fit_many(rows.withColumn("model_id", F.lit("all")))[0].collect()}
    assert len(together) == 5 and np.abs(together["all"] - alone["all"]).max() < 1e-14
    monkeypatch.setattr(L, "PASS_DOUBLES", 8)  # one model per pass
    apart = {r.model_id: np.array(r.w) for r in fit_many(several, "models")[0].collect()}
    assert set(apart) == set(together) and all(np.abs(apart[m] - together[m]).max() < 1e-14 for m in apart)
    status = {r.model_id: r.fit_status for r in fit_many(rows.withColumn("model_id", F.col("source")), C=1.0, max_iter=1)[1].collect()}
    assert set(status.values()) == {"not_converged"}
    odd = spark.createDataFrame(
        [("r", 1, [1.0]), ("r", 0, [1.0, 2.0]), ("n", 1, None), ("n", None, [1.0]), ("ok", 1, [1.0, 0.5]), ("ok", 0, [0.2, 2.0]), (None, 1, [1.0])],
        "model_id string, y int, x array<double>",
    )
    coefs, status = fit_many(odd)
    assert {r.model_id: r.fit_status for r in status.collect()} == {"r": "ragged", "ok": "ok"} and coefs.count() == 1
    coefs, status = fit_many(odd.limit(0))
    assert coefs.count() == status.count() == 0


def test_scores_of_absent_models(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], [1.0, 2.0]), (2, ["b"], [0.0, 1.0]), (3, [], [1.0, 1.0]), (4, None, None)], "row_id long, m array<string>, x array<double>")
    coefs = spark.createDataFrame([("a", [1.0, -1.0])], "model_id string, w array<double>")
    from aletheia.operators.linear import score_models

    got = score_models(rows, "m", coefs, ["row_id"], missing=0.0).collect()
    want = 1 / (1 + np.exp(1.0))
    assert sorted((r.row_id, r.model_id, round(r.score, 12)) for r in got) == [(1, "a", round(want, 12)), (1, "b", 0.0), (2, "b", 0.0)]
    assert [r.model_id for r in score_models(rows, "m", coefs, ["row_id"]).collect()] == ["a"]


def test_single_model_and_one_class_models(spark, rows):
    one = rows.where("source = 'src0'").withColumn("model_id", F.lit("m"))
    coefs, _ = fit_many(one.select("model_id", "x", "y"))
    w = np.array(coefs.first().w)
    assert np.abs(w).max() > 0  # the M=1 path is not an empty design
    mixed = rows.withColumn("model_id", F.when(F.col("y") == 1, "pos_only").otherwise(F.col("source")))
    coefs, status = fit_many(mixed.select("model_id", "x", "y"))
    st = {r.model_id: r.fit_status for r in status.collect()}
    assert st["pos_only"] == "one_class" and "pos_only" not in {r.model_id for r in coefs.collect()}


def test_modes_and_matrix(spark, rows):
    for mode in E.MODES:
        out = E.roc_auc_for_group(rows, mode).collect()
        assert len(out) == 4 and all(r.status == "ok" and 0 <= r.auc <= 1 for r in out)
    with pytest.raises(ValueError):
        E.roc_auc_for_group(rows, "bogus")
    m, coefs = E.cross_source_matrix(rows)
    assert m.count() == 16 and coefs.count() == 4


def test_callers_list_of_sources_and_given_fits(spark, rows):
    for mode in E.MODES:
        whole = {r.source: r.auc for r in E.roc_auc_for_group(rows, mode).collect()}
        some = {r.source: (r.auc, r.status) for r in E.roc_auc_for_group(rows, mode, sources=["src1", "src0", "absent", "src1"]).collect()}
        assert set(some) == {"src0", "src1", "absent"} and some["absent"][0] is None and some["absent"][1] != "ok"
        assert all(some[s] == (pytest.approx(whole[s], abs=1e-9), "ok") for s in ("src0", "src1"))
    fits = E.holdout_fits(rows)
    a, b = (sorted(map(tuple, E.cross_source_matrix(rows, **k)[0].collect())) for k in ({"fits": fits}, {}))
    assert a == b
    assert E.cross_source_matrix(rows, sources=["src0", "src_3"])[0].count() == 4
    assert [r.train_size for r in E.incremental_curve(rows, 2, sources=["src0", "src1", "src2"])[1].orderBy("train_size").collect()] == [1, 2]


def test_plans_shapes(spark):
    srcs = ["a", "b", "c", "d"]
    tr, te = P.leave_one_out_plans(spark, srcs)
    assert tr.count() == 12 and te.count() == 4
    tr, te, mapping = P.incremental_plans(spark, srcs, n_runs=10)
    assert mapping.count() == 30
    sizes = {r.model_id: r.train_size for r in mapping.collect()}
    train_counts = {r.model_id: r["count"] for r in tr.groupBy("model_id").count().collect()}
    assert all(train_counts[m] == sizes[m] for m in train_counts)


def test_incremental_curve(spark, rows):
    per_run, curve = E.incremental_curve(rows, n_runs=3)
    assert per_run.count() == 9
    c = curve.orderBy("train_size").collect()
    assert [r.train_size for r in c] == [1, 2, 3] and all(r.std >= 0 for r in c)


@pytest.mark.parametrize("widest,block", [(4096, 256), (4096, 3), (4, 256)])  # Gram matrix, in blocks, range finder
def test_pca_matches_numpy(spark, rows, monkeypatch, widest, block):
    monkeypatch.setattr(CL, "GRAM_MAX_DIM", widest)
    monkeypatch.setattr(CL, "GRAM_BLOCK", block)
    train = rows.where("part = 'train'")
    got = CL.pca3(train).orderBy("row_id").toPandas()
    X = np.stack(train.orderBy("row_id").toPandas().x.values)
    Xc = X - X.mean(0)
    _, _, vt = np.linalg.svd(Xc, full_matrices=False)
    for j in range(3):
        v = vt[j] * np.sign(vt[j][np.argmax(np.abs(vt[j]))])
        assert np.allclose(got[f"PC{j + 1}"].values, Xc @ v, atol=1e-8)


def test_pca_of_wide_vectors_and_bad_input(spark, monkeypatch):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(60, 4)) * [9, 5, 2, 0.1] @ np.linalg.qr(rng.normal(size=(40, 4)))[0].T
    df = spark.createDataFrame([(i, 0, [float(v) for v in r]) for i, r in enumerate(X)] + [(60, 1, None)], "row_id int, y int, x array<double>")
    monkeypatch.setattr(CL, "GRAM_MAX_DIM", 8)
    got = CL.pca3(df.where("x is not null")).toPandas().sort_values("row_id")
    Xc = X - X.mean(0)
    _, _, vt = np.linalg.svd(Xc, full_matrices=False)
    for j in range(3):
        assert np.allclose(np.abs(got[f"PC{j + 1}"].values), np.abs(Xc @ vt[j]), atol=1e-7)
    with pytest.raises(ValueError):
        CL.pca3(df.limit(0))
    with pytest.raises(ValueError):
        CL.pca3(df.where("x is not null"), k=41)


def numpy_kmeans(ids, X, ks, seed=CL.KMEANS_SEED):
    """The seeding and the steps as one NumPy program."""
    def u(*parts):
        return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)

    far = lambda c: ((X[:, None, :] - c[None]) ** 2).sum(2)
    picked = []
    for rnd in range(CL.ROUNDS + 1):
        w = far(X[picked]).min(1) if picked else np.ones(len(X))
        luck = sorted((-np.log(u(seed, rnd, i)) / d, i, at) for at, (i, d) in enumerate(zip(ids, w)) if d > 0)
        picked += [at for _, _, at in luck[: 2 * max(ks) if rnd else 1]]
    c = X[picked]
    weight = np.bincount(far(c).argmin(1), minlength=len(c))
    stop = CL.KMEANS_TOL * X.var(0).mean()
    out = {}
    for k in ks:
        centres = CL._reduce([ids[p] for p in picked], c, weight, k, seed)
        for _ in range(CL.KMEANS_MAX_ITER):
            at = far(centres).argmin(1)
            new = np.stack([X[at == j].mean(0) if (at == j).any() else centres[j] for j in range(k)])
            moved, centres = ((new - centres) ** 2).sum(), new
            if moved <= stop:
                break
        out[k] = centres
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_kmeans_equals_numpy(spark, rows, parts):
    train = rows.where("part = 'train'")
    pdf = train.toPandas().sort_values("row_id")
    want = numpy_kmeans([int(i) for i in pdf.row_id], np.stack(pdf.x.values), [1, 2, 3, 5])
    got = CL.kmeans_fit(train.repartition(parts), [1, 2, 3, 5])
    for k in want:
        assert np.abs(want[k] - got[k]).max() < 1e-9
    assert np.allclose(got[1][0], np.stack(pdf.x.values).mean(0))
    clusters = {r.row_id: r.clusters for r in CL.assign_all(train, got).collect()}
    X = np.stack(pdf.x.values)
    for j, k in enumerate(sorted(got)):
        assert [clusters[i][j] for i in pdf.row_id] == ((X[:, None, :] - got[k][None]) ** 2).sum(2).argmin(1).tolist()


def test_kmeans_k1_and_sizes(spark, rows):
    centres, assign = CL.kmeans_assign(rows, 1)
    assert len(centres) == 1 and {r.cluster for r in assign(rows).collect()} == {0}
    _, assign3 = CL.kmeans_assign(rows, 3)
    sizes = CL.cluster_sizes(assign3(rows), 5).orderBy("cluster").collect()
    assert len(sizes) == 5 and sizes[4].n == 0 and sum(r.n for r in sizes) == rows.count()
    members = CL.cluster_members(assign3(rows), 5).orderBy("cluster").collect()
    assert [r.n for r in members] == [r.n for r in sizes] and members[4].row_ids == [] and members[0].row_ids == sorted(members[0].row_ids)
    with pytest.raises(ValueError):
        CL.kmeans_fit(rows, [0])


def test_kmeans_of_fewer_points_than_centres(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)] + [(9, None)], "row_id long, x array<double>")
    got = CL.kmeans_fit(same, [1, 3])
    assert got[3].tolist() == [[1.0, 2.0]] * 3
    assert [(r.row_id, r.clusters) for r in CL.assign_all(same, got).orderBy("row_id").collect()] == [*((i, [0, 0]) for i in range(4)), (9, None)]


def test_kmeans_sweep_table(spark):
    small = E.cached(probe_set(fixtures.probe(spark, SF_SMALL)))
    table, coefs = CL.kmeans_sweep(small, ks=[1, 2])
    t = table.orderBy("num_clusters").collect()
    assert [r.num_clusters for r in t] == [1, 2] and all(r.roc_auc_train is not None for r in t)


def test_cosine_matrix_properties(spark, rows):
    coefs = centroid_directions(rows, "source")
    m = {(r.a, r.b): r.cosine for r in cosine_matrix(coefs).collect()}
    keys = {a for a, _ in m}
    assert len(m) == len(keys) ** 2
    for a in keys:
        assert m[(a, a)] == pytest.approx(1.0)
        for b in keys:
            assert m[(a, b)] == pytest.approx(m[(b, a)])
    empty = spark.createDataFrame([], "model_id string, w array<double>")
    assert cosine_matrix(empty).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_cosines_by_blocks(spark, block):
    rng = np.random.default_rng(block)
    w = rng.normal(size=(7, 5))
    w[3] = 0
    df = spark.createDataFrame([(f"m{i}", [float(v) for v in r]) for i, r in enumerate(w)], "model_id string, w array<double>").repartition(3)
    out = cosine_matrix(df, block=block)
    got = {(r.a, r.b): r.cosine for r in out.collect()}
    n = np.linalg.norm(w, axis=1)
    assert len(got) == 49 and out.count() == 49
    for i in range(7):
        for j in range(7):
            want = 0.0 if 3 in (i, j) else w[i] @ w[j] / n[i] / n[j]
            assert got[(f"m{i}", f"m{j}")] == pytest.approx(want, abs=1e-12)


def test_nearest_centre_ties_first(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([2.0, 0.0],)], "x array<double>")
    out = [r.cluster for r in CL.nearest_centre(df, [[1.0, 0.0], [1.0, 0.0], [3.0, 0.0]]).collect()]
    assert out == [0, 0]


def test_separate_mode_statuses_on_natural_sources(spark):
    """20 real sources: single-class ones get NULL ('one_class'), sources the
    stratified splitter refuses get NULL ('too_few'), the rest an AUC."""
    from aletheia.functions.text import label_binary
    from aletheia.operators.split import stratified_allocation

    nat = fixtures.natural(spark, SF_MID)
    rows = E.cached(probe_set(nat, sample_size=None))
    out = {r.source: (r.auc, r.status) for r in E.roc_auc_for_group(rows, "separate").collect()}
    assert len(out) == 20
    alloc = stratified_allocation(nat.select("row_id", "source", label_binary("label").alias("y")))
    classes = {}
    for r in alloc.collect():
        classes.setdefault(r.source, []).append(r)
    for src, (auc, status) in out.items():
        cls = classes[src]
        if len(cls) == 1:
            assert auc is None and status == "one_class"
        elif cls[0].status == "too_few":
            assert auc is None and status == "too_few"
        else:
            assert status in ("ok", "one_class_test") and (auc is None) == (status != "ok")
    m, _ = E.cross_source_matrix(rows)  # reuses the same fits
    diag = {r.train_source: r.auc for r in m.collect() if r.train_source == r.test_source}
    assert all(diag[s] == out[s][0] for s in out if out[s][1] == "ok")


def test_all_modes_concurrent_equals_sequential(spark, rows):
    seq = sorted(tuple(r) for m in E.MODES for r in E.roc_auc_for_group(rows, m).collect())
    con = sorted(tuple(r) for r in E.all_modes(rows).collect())
    assert seq == con and len(con) == 12
