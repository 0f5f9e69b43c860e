"""Exact, skew-safe ranks inside groups.

A plain ``row_number() OVER (PARTITION BY g ORDER BY k)`` sends each group to
one task; with few groups (sources × labels) or none at all (a global AUC) that
is one task for a third of the data.  Here the rows are dealt by range over
``(group, order)`` instead, so a group takes as many partitions as it fills:

1. ``in_range_order`` range-partitions and sorts the rows, writes them once (a
   reliable checkpoint: Spark draws the range bounds from a sample, so they must
   not be drawn again) and numbers them by partition and position.
2. Totals per (group, partition) are one small table: a group lies in
   consecutive partitions, so there are at most partitions + groups rows.
   Their running sums are the offset of each partition.
3. A rank is the offset plus the position inside the partition: no window over
   rows at all.  (``auc`` adds up prefix sums the same way, without writing.)

A top-n (``limit``) does not order whole groups: it counts digest prefixes and
drops all prefixes past the limit map-side, before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aletheia.session import materialize

#: Rows that one digest prefix of a group should hold in a top-n.
PREFIX_ROWS = 50_000


def hash_order(seed: int | str, id_col: str = "row_id") -> Column:
    """Seeded random order of rows: ``md5('<seed>|<row_id>')``.

    Replaces RNG-driven shuffles: repeatable, independent of partitioning and
    of recomputation after executor loss, and reproducible in plain SQL.
    """
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


# Rows of a per-group table that may go over the driver to be broadcast.
LOCAL_ROWS = 20_000


def _small_side(df: DataFrame, row_bytes: int) -> tuple[DataFrame, bool]:
    """A per-group/per-partition table, computed once, and whether it may be
    broadcast: up to ``LOCAL_ROWS`` it is taken to the driver, beyond it is
    written and counted (rows and bytes under the join limits)."""
    from aletheia.operators.joins import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS

    most = min(LOCAL_ROWS, BROADCAST_MAX_ROWS)
    rows = df.take(most + 1)
    if len(rows) <= most:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    df = materialize(df)
    n = df.count()
    return df, n <= BROADCAST_MAX_ROWS and n * row_bytes <= BROADCAST_MAX_BYTES


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], broadcast: bool = False) -> DataFrame:
    """Inner equi-join on ``keys`` where NULL matches NULL (group keys may be
    NULL).  ``broadcast`` joins map-side, so left rows without a partner are
    dropped before any shuffle."""
    lft, rgt = left.alias("__l"), (F.broadcast(right) if broadcast else right).alias("__r")
    cond = None
    for k in keys:
        c = F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.{k}"))
        cond = c if cond is None else cond & c
    out = lft.join(rgt, cond, "inner")
    return out.select(
        *[F.col(f"__l.{c}").alias(c) for c in left.columns],
        *[F.col(f"__r.{c}").alias(c) for c in right.columns if c not in keys],
    )


def in_range_order(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, written once; adds
    ``__part`` (partition) and ``__at`` (position in it).  The order should be
    total: rows that tie in all of it share a partition."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("__pos", F.monotonically_increasing_id()))
    return placed.select(
        *df.columns,
        F.shiftright("__pos", 33).alias("__part"),
        F.col("__pos").bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"),
    )


def range_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    rank_col: str = "rn",
    count_col: str | None = "n",
) -> DataFrame:
    """Add ``rank_col`` = 1-based position of each row in its group (``keys``,
    NULL a value of its own; none: all rows) by ``order``, and optionally
    ``count_col`` = group size.  One range shuffle; no window over rows."""
    keys = list(keys)
    placed = in_range_order(df, [*(F.col(k) for k in keys), *order])
    per = placed.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__c"))
    group = [F.col(k) for k in keys] or [F.lit(0)]  # the table has at most partitions + groups rows
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        *keys, "__part",
        (F.coalesce(F.sum("__c").over(before), F.lit(0)) - F.col("__first")).alias("__off"),
        F.sum("__c").over(Window.partitionBy(*group)).alias("__gn"),
    )
    offsets, small = _small_side(offsets, 64)
    x = _null_safe_join(placed, offsets, [*keys, "__part"], broadcast=small)
    x = x.withColumn(rank_col, (F.col("__off") + F.col("__at") + 1).cast("long"))
    if count_col:
        x = x.withColumn(count_col, F.col("__gn").cast("long"))
    return x.drop("__part", "__at", "__off", "__gn")


def rank_in_hash_order(
    df: DataFrame,
    keys: Sequence[str],
    seed: int | str,
    id_col: str = "row_id",
    rank_col: str = "rn",
    count_col: str | None = "n",
    limit: int | None = None,
) -> DataFrame:
    """Add ``rank_col`` = 1-based position of each row in ``hash_order(seed)``
    within its group (ties on the digest broken by ``id_col``), and optionally
    ``count_col`` = group size.  With ``limit`` only rows with rank <= limit are
    returned (a top-n that never moves a hot group to one task).
    """
    keys = list(keys)
    x = df.withColumn("__h", hash_order(seed, id_col))
    if limit is None:
        return range_rank(x, keys, ["__h", id_col], rank_col, count_col).drop("__h")
    return _top_of_hash_order(x, keys, id_col, rank_col, count_col, limit)


def _top_of_hash_order(x: DataFrame, keys: list[str], id_col: str, rank_col: str, count_col: str | None, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group by ``__h``.  Rows per digest
    prefix are counted (partial aggregates); prefixes that start past the limit
    go before the shuffle.  The prefix is as long as the largest group asks."""
    largest = x.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    digits = 1
    while digits < 15 and largest > PREFIX_ROWS * 16**digits:
        digits += 1
    b = "__b"
    x = x.withColumn(b, F.substring("__h", 1, digits))
    counts = x.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__c"))
    wk = Window.partitionBy(*keys).orderBy(b)
    offsets = counts.select(
        *keys, b,
        F.coalesce(F.sum("__c").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.sum("__c").over(Window.partitionBy(*keys)).alias("__gn"),
    ).where(F.col("__off") < limit)
    offsets, small = _small_side(offsets, 64)
    x = _null_safe_join(x, offsets, keys + [b], broadcast=small)
    local = F.row_number().over(Window.partitionBy(*keys, b).orderBy("__h", id_col))
    x = x.withColumn(rank_col, (F.col("__off") + local).cast("long")).where(F.col(rank_col) <= limit)
    if count_col:
        x = x.withColumn(count_col, F.col("__gn").cast("long"))
    return x.drop("__h", b, "__off", "__gn")
