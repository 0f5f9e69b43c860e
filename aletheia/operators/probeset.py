"""The probe set: from a classification table to pooled, split training rows.

Reference flow (notebook and mixture experiment): canonical source (F1) →
keep-first on (Question, Answer) (A1) → seeded 80/20 split per (source, raw
label) (W3) → max-pool of the first 3 activation steps (F9) and
y = (lower(label) == 'true') (F2).  The reference keeps 500 rows per (source,
label) first (W1); here that bound holds for rows that fit a probe only, and
all others are scored.

Spark plan: every step before the last runs on narrow key columns only
(row_id, Question, Answer, source, label); the activations — by far the
widest column — are read once, pooled in the scan's projection and joined to
the selected row ids at the end, by broadcast only behind a counted size check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aletheia.functions.text import canonical_source, label_binary
from aletheia.functions.vectors import pool
from aletheia.operators.joins import checked_broadcast_join
from aletheia.operators.prep import dedup_first, sample_by_group
from aletheia.operators.split import split_prefix

SAMPLE_SIZE = 500  # fixed value: train rows kept per (source, label)
CAP_SEED = 0
SPLIT_SEED = 1


def select_rows(
    df: DataFrame,
    sample_size: int | None = SAMPLE_SIZE,
    cap_seed: int = CAP_SEED,
    split_seed: int | None = SPLIT_SEED,
) -> DataFrame:
    """Narrow selection ``(row_id, source, label, y[, part])``.  The bound
    ``sample_size`` holds for train rows (fits) only: every other row stays."""
    keys = df.select(
        "row_id", "Question", "Answer", canonical_source("source").alias("source"), "label"
    )
    d = dedup_first(keys, ["Question", "Answer"], "row_id")
    d = d.where(F.col("source").isNotNull() & F.col("label").isNotNull())
    if split_seed is not None:
        d = split_prefix(d, ["source", "label"], seed=split_seed)
        if sample_size is not None:
            fit = sample_by_group(d.where(F.col("part") == "train"), ["source", "label"], sample_size, seed=cap_seed)
            d = fit.select(*d.columns).unionByName(d.where(F.col("part") != "train"))
    return d.withColumn("y", label_binary("label")).drop("Question", "Answer")


def attach_vectors(
    selected: DataFrame,
    df: DataFrame,
    pool_fn: Callable[[Column], Column] | None = None,
    x_col: str = "x",
) -> DataFrame:
    """Join activations to the selected row ids, then pool.

    The id side is broadcast only behind a counted size check; then the join runs in the scan's stage, so only selected rows are pooled (the
    activations of dropped rows are read but never expanded or shuffled)."""
    pool_fn = pool_fn or (lambda hs: pool(hs, "max", 3))
    acts = df.select("row_id", "hidden_states")
    j = checked_broadcast_join(acts, selected, "row_id", row_bytes=96)
    return j.withColumn(x_col, pool_fn(F.col("hidden_states"))).drop("hidden_states")


def probe_set(
    df: DataFrame,
    sample_size: int | None = SAMPLE_SIZE,
    pool_fn: Callable[[Column], Column] | None = None,
    split_seed: int | None = SPLIT_SEED,
) -> DataFrame:
    """``(row_id, source, label, y, part, x)`` ready for the evaluators."""
    sel = select_rows(df, sample_size, split_seed=split_seed)
    return attach_vectors(sel, df, pool_fn)
