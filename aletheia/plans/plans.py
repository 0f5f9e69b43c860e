"""Plan tables for the evaluation modes."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PLAN_SCHEMA = T.StructType(
    [
        T.StructField("model_id", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("part", T.StringType(), True),
    ]
)


def _df(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), PLAN_SCHEMA)


def separate_plans(spark: SparkSession, sources: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """M3: model per source, fit on its stratified 'fit' rows, test on 'eval'."""
    return (
        _df(spark, ((s, s, "fit") for s in sources)),
        _df(spark, ((s, s, "eval") for s in sources)),
    )


def all_vs_each_plans(
    spark: SparkSession, sources: Sequence[str], model_id: str = "all", tested: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """M4: one model on every source's 'train' rows, tested per source (of
    ``tested``, default all) on 'test'."""
    return (
        _df(spark, ((model_id, s, "train") for s in sources)),
        _df(spark, ((model_id, s, "test") for s in (sources if tested is None else tested))),
    )


def leave_one_out_plans(
    spark: SparkSession, sources: Sequence[str], tested: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """M5: model per held-out source h (of ``tested``, default all): train on all
    rows of the others, test on all of h."""
    held = sources if tested is None else tested
    return (
        _df(spark, ((h, s, None) for h in held for s in sources if s != h)),
        _df(spark, ((h, h, None) for h in held)),
    )


def leave_one_out_table(sources: DataFrame) -> DataFrame:
    """M5/P4 as a table: ``(model_id, source)`` for every ordered pair of
    different sources.  ``sources(source)`` holds each name once."""
    held = sources.select(F.col("source").alias("model_id"))
    return held.join(sources.select("source"), F.col("model_id") != F.col("source"))


def incremental_order_table(sources: DataFrame, n_runs: int = 10) -> DataFrame:
    """W6 as a table: ``(run, source, pos)``, per run the sources in the order
    of md5('<run>|<source>'), pos from 1."""
    runs = sources.select(F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))).alias("run"), "source")
    key = F.md5(F.concat(F.col("run").cast("string"), F.lit("|"), F.col("source")))
    pos = F.row_number().over(Window.partitionBy("run").orderBy(key, "source"))
    return runs.select("run", "source", pos.alias("pos"))


def matrix_test_plan(spark: SparkSession, sources: Sequence[str]) -> DataFrame:
    """M6: separate-mode models tested on all rows of every other source and on
    their own hold-out ('eval') on the diagonal."""
    return _df(spark, ((s, t, "eval" if s == t else None) for s in sources for t in sources))


def incremental_orders(sources: Sequence[str], n_runs: int = 10) -> list[tuple[int, str, int]]:
    """Per run a seeded permutation of the sources: ``(run, source, pos)``,
    pos 1-based, order = md5('<run>|<source>') (same as SQL ``md5``)."""
    out = []
    for run in range(n_runs):
        keyed = sorted(sources, key=lambda s: (hashlib.md5(f"{run}|{s}".encode()).hexdigest(), s))
        out.extend((run, s, pos) for pos, s in enumerate(keyed, start=1))
    return out


def incremental_plans(
    spark: SparkSession, sources: Sequence[str], n_runs: int = 10
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M7: model (run, i) trains on all rows of the first i sources of run's
    order and tests on each remaining one.  Runs whose first i sources form
    the same set share one model id (the fit would be identical).
    Returns (train_plan, test_plan, model_map(run, size, model_id))."""
    orders = incremental_orders(sources, n_runs)
    by_run: dict[int, list[str]] = {}
    for run, s, pos in orders:
        by_run.setdefault(run, []).append(s)
    train, test, mapping, seen = [], [], [], set()
    for run, seq in by_run.items():
        for i in range(1, len(seq)):
            key = "|".join(sorted(seq[:i]))
            model_id = "inc:" + hashlib.md5(key.encode()).hexdigest()[:16]
            mapping.append((run, i, model_id))
            if model_id not in seen:
                seen.add(model_id)
                train.extend((model_id, s, None) for s in seq[:i])
                test.extend((model_id, s, None) for s in seq[i:])
    model_map = spark.createDataFrame(mapping, "run int, train_size int, model_id string")
    return _df(spark, train), _df(spark, test), model_map


def param_grid(
    spark: SparkSession,
    num_experts: Sequence[int] = (1, 2, 3, 5, 7),
    weight_decays: Sequence[float] = (1e-4,),
    lrs: Sequence[float] = (1e-3,),
) -> DataFrame:
    """The experiment grid in the reference's loop order, with config_id."""
    rows, cid = [], 0
    for e in num_experts:
        for wd in weight_decays:
            for lr in lrs:
                rows.append((cid, int(e), float(wd), float(lr)))
                cid += 1
    return spark.createDataFrame(rows, "config_id int, num_experts int, weight_decay double, lr double")
