"""Cosine similarity of probe coefficient vectors.

The M x M matrix is a blocked product W·Wᵀ: models are numbered and dealt into
blocks of ``BLOCK``; a pair of blocks is one group, which holds at most 2 x
``BLOCK`` vectors and is multiplied as matrices.  A vector is copied once per
block, not once per model, and brings its norm along.  Absent models (empty
clusters) simply have no row; no models gives an empty table; a zero vector has
cosine 0 with every model.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aletheia.functions.vectors import l2_norm
from aletheia.operators.rank import range_rank

BLOCK = 256


def _products(pdf: pd.DataFrame) -> pd.DataFrame:
    """Cosines between the two blocks of a pair, both ways (within one block, once)."""
    lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
    parts = []
    for block in (lo, hi):
        own = pdf[pdf["block"] == block].sort_values("number")
        w = np.stack(own["w"].to_numpy())
        norm = own["norm"].to_numpy()[:, None]
        parts.append((own["model_id"].to_numpy(), np.divide(w, norm, out=np.zeros_like(w), where=norm > 0)))
    (a, x), (b, y) = parts
    cos = x @ y.T
    out = pd.DataFrame({"a": np.repeat(a, len(b)), "b": np.tile(b, len(a)), "cosine": cos.ravel()})
    return out if lo == hi else pd.concat([out, out.rename(columns={"a": "b", "b": "a"})[["a", "b", "cosine"]]])


def cosine_matrix(coefs: DataFrame, model_col: str = "model_id", w_col: str = "w", block: int | None = None) -> DataFrame:
    """``(a, b, cosine)`` for every ordered pair of models."""
    size = block or BLOCK
    rows = coefs.select(F.col(model_col).cast("string").alias("model_id"), F.col(w_col).cast("array<double>").alias("w"))
    rows = range_rank(rows.withColumn("norm", l2_norm("w")), [], ["model_id"], "number", "n")
    rows = rows.withColumn("block", F.expr(f"(number - 1) div {size}L")).withColumn("blocks", F.expr(f"(n + {size - 1}L) div {size}L"))
    each = rows.select("model_id", "w", "norm", "number", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    each = each.select("model_id", "w", "norm", "number", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return each.groupBy("lo", "hi").applyInPandas(_products, "a string, b string, cosine double")
