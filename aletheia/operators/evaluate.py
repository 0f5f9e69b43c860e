"""Evaluation modes (M3-M7): one plan-driven job per mode.

rows ⋈ train_plan → all models fitted in shared passes → rows ⋈ test_plan →
score with the broadcast coefficients → AUC per (model, source).
Input rows: ``(row_id, source, y, part, x)`` from ``probeset.probe_set``
(``part`` = the 80/20 split per (source, label)); ``with_holdout`` adds the
stratified hold-out column ``spart`` ('fit'/'eval') used by the per-source
and matrix modes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aletheia.operators.auc import grouped_auc
from aletheia.operators.linear import C_DEFAULT, fit_many, score_models
from aletheia.operators.rank import _small_side
from aletheia.operators.split import split_stratified
from aletheia.plans import plans as P
from aletheia.session import materialize

MODES = ("separate", "all_vs_each", "leave_one_out")
PLAN_ROW_BYTES = 16_384  # a source's row of a folded plan: some 250 model ids
HOLDOUT_SEED = 42  # fixed value: seed of the stratified per-source hold-out


def cached(df: DataFrame) -> DataFrame:
    """Write a frame that feeds several jobs (fit passes, scoring, AUC) once.

    Lineage is cut with a reliable ``checkpoint()`` into the session's
    ``spark.checkpoint.dir``, so a lost executor re-reads the checkpoint instead
    of replaying the preparation plan; without such a folder a cluster session
    raises.  Nothing stays in executor memory.  A frame that was written so
    already is returned as it is."""
    if getattr(df, "_written_once", False):
        return df
    out = materialize(df)
    out._written_once = True
    return out


def sources_of(rows: DataFrame) -> list[str]:
    """Sorted distinct sources (the plans' only input; one name per source)."""
    return [r[0] for r in rows.select("source").where(F.col("source").isNotNull()).distinct().orderBy("source").collect()]


def with_holdout(rows: DataFrame) -> DataFrame:
    """Add ``spart`` ('fit'/'eval') and ``split_status`` (W4, seed 42)."""
    return split_stratified(rows, "source", "y", seed=HOLDOUT_SEED, part_col="spart")


def with_models(rows: DataFrame, plan: DataFrame, out: str = "models") -> DataFrame:
    """Each row once, with the ids of all models that the
    plan assigns it to (rows of none are left out).  The plan, folded to one row
    per source, is broadcast behind a counted size check."""
    folded = plan.groupBy("source").agg(F.collect_set(F.struct("model_id", "part")).alias("__plan"))
    part = [F.col("part"), F.col("spart")] if "spart" in rows.columns else [F.col("part")]
    fits = lambda m: m["part"].isNull() | F.coalesce(m["part"].isin(*part), F.lit(False))
    folded, small = _small_side(folded, PLAN_ROW_BYTES)
    j = rows.join(F.broadcast(folded) if small else folded, "source")
    j = j.withColumn(out, F.array_sort(F.transform(F.filter("__plan", fits), lambda m: m["model_id"]))).drop("__plan")
    return j.where(F.size(out) > 0)


def evaluate_plans(
    rows: DataFrame,
    train_plan: DataFrame,
    test_plan: DataFrame,
    C: float = C_DEFAULT,
    coefs: DataFrame | None = None,
    status: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fit (unless ``coefs`` given) and score; returns (scores, coefs) with
    ``scores(model_id, source, n_pos, n_neg, auc, status)``."""
    if coefs is None:
        coefs, status = fit_many(with_models(rows, train_plan), "models", C=C)
    scored = score_models(with_models(rows, test_plan), "models", coefs, ["source", "y"])
    auc = grouped_auc(scored, ["model_id", "source"], "score", "y")
    planned = test_plan.select("model_id", "source").distinct()
    out = planned.join(auc, ["model_id", "source"], "left")
    if status is not None:
        out = out.join(status.select("model_id", "fit_status"), "model_id", "left")
    else:
        out = out.withColumn("fit_status", F.lit("given"))
    out = out.withColumn(
        "status",
        F.when(F.col("fit_status").isNull(), "no_train_rows")
        .when(F.col("fit_status") != F.lit("given"), F.when(F.col("fit_status") != "ok", F.col("fit_status")))
        .otherwise(F.lit(None)),
    )
    out = out.withColumn(
        "status",
        F.coalesce(
            "status",
            F.when(F.col("auc").isNull(), F.lit("one_class_test")).otherwise(F.lit("ok")),
        ),
    ).withColumn("auc", F.when(F.col("status") == "ok", F.col("auc")))
    return out.select("model_id", "source", "n_pos", "n_neg", "auc", "status"), coefs


def holdout_fits(rows: DataFrame, C: float = C_DEFAULT, sources: Sequence[str] | None = None):
    """Per-source probes on the stratified 'fit' rows (M3), the models of the
    per-source mode and of the cross-source matrix (M6), which take them as
    ``fits``.  ``sources``: the caller's list (default: all of the rows).

    Returns ``(rows_with_holdout, sources, coefs, status, too_few)``."""
    spark = rows.sparkSession
    h = cached(with_holdout(cached(rows)))
    sources = sources_of(h) if sources is None else list(dict.fromkeys(sources))
    ok = [r[0] for r in h.where("split_status = 'ok'").select("source").distinct().collect()]
    tr, _ = P.separate_plans(spark, sources)
    tr = tr.where(F.col("source").isin(ok)) if ok else tr.where(F.lit(False))
    coefs, status = fit_many(with_models(h, tr), "models", C=C)
    too_few = [s for s in sources if s not in set(ok)]
    return h, sources, coefs, status, too_few


def roc_auc_for_group(
    rows: DataFrame, mode: str = "separate", C: float = C_DEFAULT, sources: Sequence[str] | None = None, fits=None
) -> DataFrame:
    """M3/M4/M5: ``(mode, source, auc, status)`` for one of the three modes, one
    row per source of ``sources`` (default: all of the rows).  A shorter list
    tests fewer sources; the shared and the held-out models still train on the
    rows of all sources.  A listed source without rows has a NULL AUC."""
    if mode not in MODES:
        raise ValueError(f"Unknown mode {mode}")
    spark = rows.sparkSession
    rows = cached(rows)
    every = [] if mode == "separate" else sources_of(rows)
    tested = list(dict.fromkeys(sources)) if sources is not None else every
    if mode == "separate":
        h, sources, coefs, status, too_few = fits or holdout_fits(rows, C, sources)
        tr, te = P.separate_plans(spark, sources)
        scores, _ = evaluate_plans(h, tr, te, C, coefs=coefs, status=status)
        scores = scores.withColumn(
            "status", F.when(F.col("source").isin(too_few), F.lit("too_few")).otherwise(F.col("status"))
        ) if too_few else scores
    elif mode == "all_vs_each":
        tr, te = P.all_vs_each_plans(spark, every, tested=tested)
        scores, _ = evaluate_plans(rows, tr, te, C)
    elif mode == "leave_one_out":
        tr, te = P.leave_one_out_plans(spark, every, tested=tested)
        scores, _ = evaluate_plans(rows, tr, te, C)
    return scores.select(F.lit(mode).alias("mode"), "source", "auc", "status")


def all_modes(rows: DataFrame, modes=MODES, C: float = C_DEFAULT) -> DataFrame:
    """M3-M5 together: ``(mode, source, auc, status)`` for every mode.

    The modes are independent chains of small jobs (one block fit each), so
    they are submitted concurrently and share the cluster."""
    from concurrent.futures import ThreadPoolExecutor

    rows = cached(rows)
    with ThreadPoolExecutor(max_workers=len(modes)) as pool:
        parts = list(pool.map(lambda m: cached(roc_auc_for_group(rows, m, C)), modes))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_source_matrix(rows: DataFrame, C: float = C_DEFAULT, sources: Sequence[str] | None = None, fits=None) -> tuple[DataFrame, DataFrame]:
    """M6: long ``(train_source, test_source, auc, status)`` and the coefs, over
    ``sources`` (default: all of the rows); ``fits`` of ``holdout_fits`` are used
    if given.

    Train on each source's stratified 'fit' rows (the per-source models of
    M3); test on all rows of the other sources, on the hold-out on the
    diagonal."""
    spark = rows.sparkSession
    h, sources, coefs, status, too_few = fits or holdout_fits(rows, C, sources)
    tr, _ = P.separate_plans(spark, sources)
    te = P.matrix_test_plan(spark, sources)
    scores, coefs = evaluate_plans(h, tr, te, C, coefs=coefs, status=status)
    if too_few:
        scores = scores.withColumn(
            "status", F.when(F.col("model_id").isin(too_few), F.lit("too_few")).otherwise(F.col("status"))
        )
    out = scores.select(
        F.col("model_id").alias("train_source"), F.col("source").alias("test_source"), "auc", "status"
    )
    return out, coefs


def incremental_curve(
    rows: DataFrame, n_runs: int = 10, C: float = C_DEFAULT, sources: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """M7 + A8: per (run, size) mean AUC over the remaining sources, then per
    size the mean and population std over runs, over ``sources`` (default: all
    of the rows).  Returns (per_run, curve)."""
    spark = rows.sparkSession
    rows = cached(rows)
    sources = sources_of(rows) if sources is None else list(dict.fromkeys(sources))
    tr, te, mapping = P.incremental_plans(spark, sources, n_runs)
    scores, _ = evaluate_plans(rows, tr, te, C)
    per_model = scores.groupBy("model_id").agg(F.avg("auc").alias("mean_auc"))
    per_run = mapping.join(per_model, "model_id", "left").select("run", "train_size", "mean_auc")
    return per_run, curve_stats(per_run)


def curve_stats(per_run: DataFrame) -> DataFrame:
    """Mean and population std of the run means per train size."""
    return per_run.groupBy("train_size").agg(
        F.avg("mean_auc").alias("mean"),
        F.stddev_pop("mean_auc").alias("std"),
    ).select(
        "train_size",
        "mean",
        "std",
        (F.col("mean") - F.col("std")).alias("lower"),
        (F.col("mean") + F.col("std")).alias("upper"),
    )
