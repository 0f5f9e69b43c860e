"""Result tables behind the reference's charts (A8, A9, V1-V4); no drawing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def modes_table(scores: DataFrame, sources: DataFrame, modes: Sequence[str] = ("separate", "all_vs_each", "leave_one_out")) -> DataFrame:
    """``(source, separate, all_vs_each, leave_one_out)``; a source
    missing from a mode gets NULL.  ``scores(mode, source, auc)``."""
    wide = scores.groupBy("source").pivot("mode", list(modes)).agg(F.first("auc"))
    return sources.select("source").join(wide, "source", "left").select("source", *modes)


def matrix_table(matrix: DataFrame, sources: Sequence[str]) -> DataFrame:
    """V2: train_source × test_source AUC matrix (fixed pivot values)."""
    return matrix.groupBy("train_source").pivot("test_source", list(sources)).agg(F.first("auc"))


def best_config(scores: DataFrame, group_col: str = "num_experts", key_col: str = "config_id") -> DataFrame:
    """Per group the key with the highest mean AUC over its sources
    (NULL AUCs skipped); ties go to the first key (smallest key_col); a key
    whose scores are all NULL has a NULL mean and ranks last."""
    means = scores.groupBy(group_col, key_col).agg(F.avg("auc").alias("mean_auc"))
    # Means are compared at 1e-12 so that equal means summed in a different
    # order (a last-bit difference) still tie and the first key wins.
    w = Window.partitionBy(group_col).orderBy(F.desc_nulls_last(F.round("mean_auc", 12)), F.col(key_col))
    return means.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def best_table(scores: DataFrame, best: DataFrame, group_col: str = "num_experts", key_col: str = "config_id") -> DataFrame:
    """V4: for each group's best key, its AUC per source label; labels are the
    union of sources in the best keys' scores (one name per source); a label
    the key has no row for gets 0.0, as in the chart; an undefined (NULL) AUC
    stays NULL."""
    sc = scores.join(best.select(group_col, key_col), [group_col, key_col])
    wanted = best.select(group_col, key_col).distinct().crossJoin(sc.select("source").distinct())  # the chart's grid
    found = sc.select(group_col, key_col, "source", F.col("auc").alias("__auc"), F.lit(True).alias("__has"))
    auc = F.when(F.col("__has"), F.col("__auc")).otherwise(F.lit(0.0))
    return wanted.join(found, [group_col, key_col, "source"], "left").select(group_col, key_col, "source", auc.alias("auc"))
