"""Resumable generation sink (S3, S5): finished units are recorded, a restart
computes the missing ones only.

A dataset is a folder with two tables:

* ``data/attempt=<id>/gen_idx=<n>/bucket=<b>``: rows as any Spark write leaves
  them;
* ``manifest``: one row per finished unit ``(gen_idx, bucket)`` with the attempt
  that holds it, appended by a single task once the attempt's job has succeeded.

A unit is the rows of one generation whose ``id_col`` hashes to one bucket.  An
attempt that dies leaves data that no manifest row names, so it is never read; a
file of its manifest is there whole or not at all.  If two attempts finish the
same unit, the one of the smaller id counts, for every reader.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16
MANIFEST = "attempt string, gen_idx int, bucket int"


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path).schema
    except AnalysisException:  # no such folder, or no file in it yet
        return False
    return True


def bucket_of(id_col: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)).cast("int")


def finished(spark: SparkSession, path: str) -> DataFrame:
    """``(gen_idx, bucket, attempt)``, one row per finished unit."""
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST).select("gen_idx", "bucket", "attempt")
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return rows.groupBy("gen_idx", "bucket").agg(F.min("attempt").alias("attempt"))


def write_attempt(rows: DataFrame, path: str, units: Iterable[tuple[int, int]], id_col: str = "row_id", buckets: int = BUCKETS, commit: bool = True) -> str:
    """Write ``rows`` (with ``gen_idx``) of the given units as one attempt, then
    record them (``commit=False`` leaves the attempt unrecorded).  Units without
    rows are recorded as well: they are finished."""
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    placed = rows.withColumn("bucket", bucket_of(id_col, buckets))
    # few files per unit; AQE splits a large unit over several tasks
    placed.hint("rebalance", "gen_idx", "bucket").write.partitionBy("gen_idx", "bucket").parquet(f"{path}/data/attempt={attempt}")
    if commit:
        done = spark.createDataFrame([(attempt, g, b) for g, b in units], MANIFEST)
        done.coalesce(1).write.mode("append").parquet(f"{path}/manifest")  # one file: all units or none
    return attempt


def resume(
    inputs: DataFrame,
    path: str,
    run: Callable[[DataFrame, int], DataFrame],
    n_generations: int,
    id_col: str = "row_id",
    buckets: int = BUCKETS,
) -> int:
    """Run ``run(inputs of the missing buckets, gen_idx)`` for every generation
    with missing units and write what it returns (with the columns of ``id_col``
    and its own).  One attempt per generation, so a crash loses at most the one
    under way.  Returns the number of units that were run."""
    spark = inputs.sparkSession
    have = {(r.gen_idx, r.bucket) for r in finished(spark, path).collect()}  # generations x buckets
    ran = 0
    for g in range(1, n_generations + 1):
        missing = [b for b in range(buckets) if (g, b) not in have]
        if not missing:
            continue
        part = inputs if len(missing) == buckets else inputs.where(bucket_of(id_col, buckets).isin(missing))
        write_attempt(run(part, g).withColumn("gen_idx", F.lit(g)), path, [(g, b) for b in missing], id_col, buckets)
        ran += len(missing)
    return ran


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of finished units (columns as written, with ``gen_idx``)."""
    units = finished(spark, path)
    data = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    # the manifest has generations x buckets rows; it prunes the folders of other attempts
    return data.join(F.broadcast(units), ["attempt", "gen_idx", "bucket"]).drop("attempt", "bucket")


def save_run(path: str, **tables: DataFrame) -> str:
    """Several tables (scores, parameters) as one run; a run counts once its
    marker, written last, is there."""
    spark, run = next(iter(tables.values())).sparkSession, uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/run={run}/{name}")
    marker = spark.createDataFrame([(run, name) for name in sorted(tables)], "run string, name string")
    marker = marker.withColumn("saved_at", F.current_timestamp())
    marker.coalesce(1).write.mode("append").parquet(f"{path}/runs")
    return run


def load_run(spark: SparkSession, path: str, run: str | None = None) -> dict[str, DataFrame]:
    """The tables of a saved run (the latest, if none is named)."""
    if not _exists(spark, f"{path}/runs"):
        raise FileNotFoundError(f"no finished run in {path}")
    runs = spark.read.parquet(f"{path}/runs")
    if run is None:
        run = runs.orderBy(F.desc("saved_at"), "run").first()["run"]
    names = [r.name for r in runs.where(F.col("run") == run).select("name").distinct().collect()]
    if not names:
        raise FileNotFoundError(f"no finished run {run} in {path}")
    return {name: spark.read.parquet(f"{path}/run={run}/{name}") for name in names}
