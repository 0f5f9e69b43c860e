"""Parquet scans and writes.

* S1/S2: ``read_table`` takes an optional column list so Catalyst prunes the
  scan (``ReadSchema`` shows only those columns) and an optional filter that is
  pushed to the Parquet reader.
* S3: ``write_generations`` writes the long generation table partitioned by
  ``gen_idx`` with dynamic partition overwrite, so re-running one generation
  replaces only its own folder (the reference wrote one file per generation).
* S4: ``write_wide_generations`` pivots to ``Generation_1..N`` with explicit
  pivot values (no extra job to discover them) and writes one dataset.
* A generation run that must survive a crash uses ``resumable``.
* S5: ``save_table`` / ``load_table`` persist scores, coefficients and mixture
  parameters as Parquet instead of pickles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    if columns is not None:
        df = df.select(*columns)
    return df


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One of the driver tables under ``sf_dir``."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", columns)


def write_generations(long_df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: long generations ``(row_id, gen_idx, ...)`` partitioned by gen_idx."""
    # the writer's own option: the session's setting stays as the caller left it
    long_df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("gen_idx").parquet(path)


def wide_generations(
    long_df: DataFrame,
    n_generations: int,
    key_cols: Sequence[str] = ("row_id", "Question", "Answer", "source"),
    value_cols: Sequence[str] = ("generation",),
    prefixes: Sequence[str] = ("Generation_",),
) -> DataFrame:
    """Long -> wide ``Generation_1..N`` (one aggregate, fixed pivot values).
    A ``gen_idx`` beyond N raises: no generation is left out unseen."""
    keys = [k for k in key_cols if k in long_df.columns]
    inside = F.col("gen_idx").isNull() | F.col("gen_idx").between(1, n_generations)
    long_df = long_df.where(F.assert_true(inside, F.lit(f"gen_idx outside 1..{n_generations}")).isNull())
    aggs = []
    for v, p in zip(value_cols, prefixes):
        for i in range(1, n_generations + 1):
            aggs.append(F.max(F.when(F.col("gen_idx") == i, F.col(v))).alias(f"{p}{i}"))
    return long_df.groupBy(*keys).agg(*aggs)


def write_wide_generations(long_df: DataFrame, path: str, n_generations: int, mode: str = "overwrite") -> None:
    wide_generations(long_df, n_generations).write.mode(mode).parquet(path)


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
