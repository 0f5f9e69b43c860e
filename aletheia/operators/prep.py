"""Probe-set preparation: canonical sources, keep-first de-duplication,
per-group sampling and the counts the reference prints (A1-A6, W1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aletheia.functions.text import canonical_source
from aletheia.operators.rank import rank_in_hash_order


def with_canonical_source(df: DataFrame, col: str = "source") -> DataFrame:
    """F1 applied in place."""
    return df.withColumn(col, canonical_source(col))


def key_digest(subset: Sequence[str]) -> list[Column]:
    """Three 64-bit hashes of a key; NULL is a value of its own."""
    parts = [p for c in subset for p in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(k), *parts) for k in range(3)]


def dedup_first(
    df: DataFrame,
    subset: Sequence[str] = ("Question", "Answer"),
    order_col: str = "row_id",
) -> DataFrame:
    """A1: keep the first row (smallest ``order_col``, unique) of each ``subset`` key.

    Two levels.  The key is reduced to 128 bits and its least ``order_col`` is
    found by a hash aggregate over three numbers (map-side combine: a key that
    holds a third of all rows costs one row per map task; no text is sorted or
    shuffled).  The rows that stay are those found, by a semi join on the number
    and the digest; wide columns move in it only if it cannot be broadcast.  A
    third hash guards the digest: different keys of equal 128 bits raise.  NULL
    keys compare equal (as in the reference)."""
    d1, d2, d3 = key_digest(subset)
    marked = df.withColumn("__d1", d1).withColumn("__d2", d2)
    first = marked.withColumn("__d3", d3).groupBy("__d1", "__d2").agg(
        F.min(order_col).alias(order_col), F.min("__d3").alias("__lo"), F.max("__d3").alias("__hi")
    )
    alone = F.assert_true(F.col("__lo") == F.col("__hi"), F.lit("two keys share a digest")).isNull()
    first = first.where(alone).drop("__lo", "__hi")
    return marked.join(first, [order_col, "__d1", "__d2"], "left_semi").select(*df.columns)


def sample_by_group(
    df: DataFrame,
    keys: Sequence[str] | str,
    n: int,
    seed: int = 0,
    id_col: str = "row_id",
) -> DataFrame:
    """Per group, ``n`` rows without replacement when the group is larger,
    else the whole group.  Rows with a NULL group key are dropped (pandas
    ``groupby`` default).  The choice is the first ``n`` rows in the seeded
    hash order, so it is repeatable and independent of partitioning.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    not_null = None
    for k in keys:
        c = F.col(k).isNotNull()
        not_null = c if not_null is None else not_null & c
    kept = rank_in_hash_order(df.where(not_null), keys, seed, id_col, rank_col="__rn", count_col=None, limit=n)
    return kept.drop("__rn")


def value_counts(df: DataFrame, keys: Sequence[str] | str, count_col: str = "count") -> DataFrame:
    """A2/A3 with T2 order: counts per key, NULL keys excluded, largest
    first — within each leading key for several keys (source, then count
    descending, then label).  The result is small (one row per key)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    counts = df.where(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
    return counts.orderBy(*keys[:-1], F.desc(count_col), keys[-1])


def distinct_sorted(df: DataFrame, col: str = "source") -> DataFrame:
    """A4: sorted distinct non-NULL values (a small result)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def count_nonnull(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows, and non-NULL cells over ``cols`` summed."""
    total = sum((F.count(c) for c in cols), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.cast("long").alias("n_nonnull"))
