"""Sums of model-sized vectors over a table: one partial per task, added in a tree.

Iterative fits (mixtures, k-means, PCA) need, per pass, a few vectors summed
over all rows.  ``sum_over`` runs a function over the Arrow batches of each task
(it returns one NumPy vector per integer key), adds the tasks' partials ``FAN_IN``
at a time on the cluster while there are more of them, and hands at most
``FAN_IN`` partials per key to the driver.  Neighbours are added in the order of
their tasks, so the result is the same on every run of the same partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 16
PARTIAL = "key int, task long, v binary"
_ARROW = pa.schema([("key", pa.int32()), ("task", pa.int64()), ("v", pa.binary())])


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """An array<double> column of equal lengths as a (rows, length) matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64, copy=False)


def partial_row(key: int, task: int, v: np.ndarray) -> pa.RecordBatch:
    """A vector as a row of ``PARTIAL``."""
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((key, task, v.tobytes()), _ARROW)], schema=_ARROW)


def _add_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (group, key, task) -> their sum per (group, key)."""
    at, total = None, None
    for batch in batches:
        for r in batch.to_pylist():
            v = np.frombuffer(r["v"])
            if at == (r["group"], r["key"]):
                total = total + v
                continue
            if at:
                yield partial_row(at[1], at[0], total)
            at, total = (r["group"], r["key"]), v
    if at:
        yield partial_row(at[1], at[0], total)


def sum_over(df: DataFrame, tasks: int, sums: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sum of ``sums(batches of a task)`` over the ``tasks`` partitions of
    ``df``, per key; a task without rows may return nothing."""

    def run(batches):
        for key, v in sums(b for b in batches if b.num_rows).items():
            yield partial_row(key, TaskContext.get().partitionId(), np.asarray(v, np.float64))

    parts = df.mapInArrow(run, PARTIAL)
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        near = parts.withColumn("group", F.expr(f"task div {FAN_IN}")).repartition(tasks, "group")
        parts = near.sortWithinPartitions("group", "key", "task").mapInArrow(_add_neighbours, PARTIAL)
    out: dict[int, np.ndarray] = {}
    for r in sorted(parts.collect(), key=lambda r: (r.key, r.task)):  # at most FAN_IN model-sized vectors a key
        v = np.frombuffer(r.v)
        out[r.key] = out[r.key] + v if r.key in out else v
    return out
