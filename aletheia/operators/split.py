"""Train/test splits.

Both splits are a ``part`` column computed once (train ∪ test = all rows,
disjoint), never two filtered re-reads.  The seeded shuffle of the reference
(W2) is the hash order of ``rank.hash_order``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aletheia.operators.rank import _null_safe_join, _small_side, rank_in_hash_order

TRAIN_SHARE = 0.8  # fixed value: share of each group used for training
TEST_SIZE = 0.2  # fixed value: stratified hold-out share


def _not_null(keys: Sequence[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def split_prefix(
    df: DataFrame,
    keys: Sequence[str] = ("source", "label"),
    seed: int = 0,
    train_share: float = TRAIN_SHARE,
    id_col: str = "row_id",
    part_col: str = "part",
) -> DataFrame:
    """Per group, the first ``int(n * share)`` rows in seeded order are
    'train', the rest 'test' (n=1 gives no train row).  NULL keys dropped."""
    keys = list(keys)
    r = rank_in_hash_order(df.where(_not_null(keys)), keys, seed, id_col, rank_col="__rn", count_col="__n")
    cut = F.floor(F.col("__n") * F.lit(float(train_share))).cast("long")
    return r.withColumn(part_col, F.when(F.col("__rn") <= cut, "train").otherwise("test")).drop("__rn", "__n")


def stratified_allocation(
    df: DataFrame, group: str = "source", y: str = "y", test_size: float = TEST_SIZE
) -> DataFrame:
    """Per (group, y): class size and the number of rows to fit on.

    Hold-out size ``ceil(test_size * n)``; the ``n_train`` fit rows go to the
    classes in proportion, floors first, the remaining rows one each to the
    largest fractional parts (ties: smaller y first).  ``status`` is
    'too_few' where the stratified splitter refuses the input (a class with
    one row, or fewer fit/hold-out rows than classes), else 'ok'.
    The table has one row per (group, class): tiny.
    """
    cls = df.where(F.col(group).isNotNull() & F.col(y).isNotNull()).groupBy(group, y).agg(
        F.count(F.lit(1)).alias("n_c")
    )
    wg = Window.partitionBy(group)
    cls = (
        cls.withColumn("n", F.sum("n_c").over(wg))
        .withColumn("n_classes", F.count(F.lit(1)).over(wg))
        .withColumn("min_c", F.min("n_c").over(wg))
        .withColumn("n_test", F.ceil(F.lit(float(test_size)) * F.col("n")).cast("long"))
        .withColumn("n_train", F.col("n") - F.col("n_test"))
        .withColumn("cont", F.col("n_c").cast("double") / F.col("n") * F.col("n_train"))
        .withColumn("base", F.floor("cont").cast("long"))
        .withColumn("rem", F.col("cont") - F.col("base"))
        .withColumn("need", F.col("n_train") - F.sum("base").over(wg))
        .withColumn("rem_rank", F.row_number().over(wg.orderBy(F.desc("rem"), F.col(y))))
        .withColumn("n_fit", F.col("base") + F.when(F.col("rem_rank") <= F.col("need"), 1).otherwise(0))
        .withColumn(
            "status",
            F.when(
                (F.col("min_c") < 2) | (F.col("n_train") < F.col("n_classes")) | (F.col("n_test") < F.col("n_classes")),
                "too_few",
            ).otherwise("ok"),
        )
    )
    return cls.select(group, y, "n_c", "n", "n_fit", "status")


def split_stratified(
    df: DataFrame,
    group: str = "source",
    y: str = "y",
    seed: int = 42,
    test_size: float = TEST_SIZE,
    id_col: str = "row_id",
    part_col: str = "part",
) -> DataFrame:
    """Stratified hold-out within each group: 'fit' / 'eval' column plus
    the group's ``split_status``.  Rows are ranked per (group, y) in the seeded
    hash order; the first ``n_fit`` are 'fit'."""
    alloc = stratified_allocation(df, group, y, test_size).select(
        group, y, F.col("n_fit").alias("__fit"), F.col("status").alias("split_status")
    )
    ranked = rank_in_hash_order(
        df.where(F.col(group).isNotNull() & F.col(y).isNotNull()), [group, y], seed, id_col, rank_col="__rn", count_col=None
    )
    # alloc has one row per (group, class): broadcast after a counted size check
    alloc, small = _small_side(alloc, 64)
    out = _null_safe_join(ranked, alloc, [group, y], broadcast=small)
    return out.withColumn(part_col, F.when(F.col("__rn") <= F.col("__fit"), "fit").otherwise("eval")).drop(
        "__rn", "__fit"
    )
