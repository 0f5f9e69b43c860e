"""Join helpers: broadcast only behind a size check, shuffle join otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aletheia.session import materialize

# Largest side we broadcast, in rows and in estimated bytes.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 * 1024 * 1024


def checked_broadcast_join(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    row_bytes: int = 64,
    max_rows: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Join ``big`` with ``small``: broadcast ``small`` only when its counted
    size (rows, and rows x ``row_bytes``) is under the limits; otherwise a
    regular shuffle join (AQE may still pick a broadcast from runtime sizes).
    ``small`` is written once (a reliable checkpoint), so the count costs one pass
    over it and nothing stays in executor memory.
    """
    max_rows = BROADCAST_MAX_ROWS if max_rows is None else max_rows  # read at call time
    max_bytes = BROADCAST_MAX_BYTES if max_bytes is None else max_bytes
    small = materialize(small)
    n = small.count()
    if n <= max_rows and n * row_bytes <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


# Bits per id in a membership filter (one false hit in about eight).
FILTER_BITS = 8


def keep_members(big: DataFrame, ids: DataFrame, keys: Sequence[str], n_ids: int) -> DataFrame:
    """Rows of ``big`` whose ``keys`` may occur in ``ids`` (all that do, and about
    one in eight others): a bitmap of hashed ids, built by a partial aggregate,
    is broadcast to the scan of ``big`` behind a check of its size, so rows
    without a partner go before a shuffle.  Past the limit ``big`` stays whole."""
    bits = 1 << 15
    while bits < FILTER_BITS * n_ids:
        bits *= 2
    if bits // 8 > BROADCAST_MAX_BYTES:
        return big
    place = F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1
    maps = ids.select(F.bitmap_bucket_number(place).alias("__bucket"), F.bitmap_bit_position(place).alias("__bit"))
    maps = maps.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__map"))  # 4 KB a row
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(__byte, cast(__at % 8 as int))").bitwiseAND(F.lit(1)) == 1
    placed = big.withColumn("__bucket", F.bitmap_bucket_number(place)).withColumn("__at", bit)
    return placed.join(F.broadcast(maps), "__bucket").withColumn("__byte", byte).where(hit).select(*big.columns)


# Target bytes per partition for iterative MLlib / gradient inputs.
ITERATIVE_PARTITION_BYTES = 64 * 1024 * 1024


def size_partitions(df: DataFrame, n_rows: int, row_bytes: int, target: int = ITERATIVE_PARTITION_BYTES) -> DataFrame:
    """Coalesce (no shuffle) to about ``target`` bytes per partition.

    Iterative jobs (L-BFGS steps, k-means iterations, mixture epochs) pay a
    scheduling cost per task and per pass; partitions far below ``target``
    only add that cost, while large inputs keep one task per ``target``.  Never
    below the cluster's parallelism: these jobs are bound by computing."""
    import math

    want = max(df.sparkSession.sparkContext.defaultParallelism, int(math.ceil(n_rows * row_bytes / target)))
    return df.coalesce(want) if want < df.rdd.getNumPartitions() else df
