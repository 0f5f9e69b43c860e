"""ROC AUC per group and over all rows (A7), exact and skew-safe.

AUC = (Σ over positives of #negatives with a lower score + ½ #tied negatives)
      / (P · N)

1. One row per (group, score) with positive/negative counts (partial
   aggregation: ties collapse map-side).
2. These are range-partitioned and sorted by (group, score), so no group sits on
   one task, and every task sums up its part of each group, counting only the
   negatives that lie in the same partition: a row per (group, partition).
3. On that small table (at most partitions + groups rows) a running sum over the
   partitions gives the negatives that lie before each, which every positive of
   the partition has below it as well.

Rows are shuffled twice, narrow, and read once; nothing is written in between.
NULL when the group has only one class (the library refuses such input; the
reference records NaN).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_SUMS = [("__part", T.IntegerType(), pa.int32()), ("__u", T.DoubleType(), pa.float64()),
         ("__p", T.LongType(), pa.int64()), ("__n", T.LongType(), pa.int64())]


def _partition_sums(batches):
    """Rows (keys..., group, p, n) sorted by group and score -> per group of the
    partition: its keys, U among its own rows, positives, negatives."""
    part = TaskContext.get().partitionId()
    held = None  # (group, its keys as one row, u, p, n) that may go on in the next batch

    def row(group):
        _, keys, u, p, n = group
        return pa.RecordBatch.from_arrays(
            [*keys.columns, *(pa.array([v], t) for v, (_, _, t) in zip((part, u, p, n), _SUMS))], names=[*keys.schema.names, *(x for x, _, _ in _SUMS)]
        )

    for b in batches:
        if not b.num_rows:
            continue
        names = b.schema.names
        keys = b.select(names[:-3])
        coded = b.column(len(names) - 3).dictionary_encode()
        codes = coded.indices.to_numpy()
        p, n = (b.column(len(names) - k).to_numpy() for k in (2, 1))
        cuts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        for at, end in zip(cuts, [*cuts[1:], len(codes)]):
            name = coded.dictionary[int(codes[at])].as_py()
            if held and held[0] != name:
                yield row(held)
                held = None
            _, first, u, ps, ns = held or (name, keys.slice(at, 1), 0.0, 0, 0)
            pp, nn = p[at:end].astype(float), n[at:end].astype(float)
            before = ns + np.cumsum(nn) - nn
            held = (name, first, u + float(pp @ (before + nn / 2)), ps + int(p[at:end].sum()), ns + int(n[at:end].sum()))
    if held:
        yield row(held)


def grouped_auc(
    df: DataFrame,
    keys: Sequence[str] = ("source",),
    score_col: str = "score",
    label_col: str = "y",
    auc_col: str = "auc",
) -> DataFrame:
    keys = list(keys)
    y = F.col(label_col).cast("long")
    per_score = (
        df.where(F.col(score_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(*keys, score_col)
        .agg(F.sum(y).alias("__p"), F.sum(F.lit(1) - y).alias("__n"))
    )
    order = [F.col(k) for k in [*keys, score_col]]
    placed = per_score.repartitionByRange(*order).sortWithinPartitions(*order)
    group = F.to_json(F.array(*(F.col(k).cast("string") for k in keys))) if keys else F.lit("")  # NULL a value of its own
    placed = placed.select(*keys, group.alias("__g"), "__p", "__n")
    fields = [*placed.schema.fields[: len(keys)], *(T.StructField(name, t) for name, t, _ in _SUMS)]
    sums = placed.mapInArrow(_partition_sums, T.StructType(fields))
    each = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(each), F.lit(0)))
    out = (sums.groupBy(*keys) if keys else sums.groupBy()).agg(
        F.sum(F.col("__u") + F.col("__p").cast("double") * F.col("__before")).alias("__u"),
        F.sum("__p").alias("n_pos"),
        F.sum("__n").alias("n_neg"),
    )
    denom = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return out.select(
        *keys,
        F.col("n_pos").cast("long").alias("n_pos"),
        F.col("n_neg").cast("long").alias("n_neg"),
        F.when(denom > 0, F.col("__u") / denom).alias(auc_col),
    )


def global_auc(df: DataFrame, score_col: str = "score", label_col: str = "y", auc_col: str = "auc") -> DataFrame:
    """One AUC over all rows (no partition key; still spread over ranges)."""
    return grouped_auc(df, [], score_col, label_col, auc_col)
