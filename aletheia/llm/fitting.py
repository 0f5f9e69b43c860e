"""Fitting rows for the two classifiers: bounded, deterministic, folds by id."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aletheia.llm.common import id_text, release_memory

#: Bound on labelled documents that a fit reads (fits only; scoring is over all).
MAX_FIT_DOCS = 8_000
#: Longer texts (in UTF-8 bytes) are not fitted on; with the bound above a fit
#: reads at most a gigabyte, whatever the corpus.
MAX_FIT_BYTES = 1 << 17


def fold(folds: int) -> Column:
    """crc32 of the decimal ``doc_id``, modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def fit_on(docs: DataFrame, labels: DataFrame, label: str, keep: Column, train: Callable, max_docs: int = MAX_FIT_DOCS, max_bytes: int = MAX_FIT_BYTES):
    """``train(texts, y)`` in one task over at most ``max_docs`` labelled rows,
    those with the smallest id hash among rows for which ``keep`` holds.
    Labels other than 0 and 1 are ignored, and so are texts of more than
    ``max_bytes``.  Returns what ``train`` returns."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    chosen = y.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & keep)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_docs)  # its bound lets it be broadcast
    rows = id_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    rows = rows.where(F.octet_length("text") <= max_bytes)

    def run(batches):
        pdf = pd.concat(list(batches), ignore_index=True)
        pdf = pdf[pdf["y"].notna()].astype({"y": "int64"})
        pdf = pdf.sort_values(["doc_id", "text", "y"], kind="stable").drop_duplicates(["text", "y"])
        yield pd.DataFrame({"model": [pickle.dumps(train(pdf["text"].tolist(), pdf["y"].to_numpy()))]})
        del pdf
        release_memory()

    # the row without a label keeps the task alive when nothing is labelled
    empty = docs.sparkSession.createDataFrame([(None, "", None)], "doc_id long, text string, y int")
    got = rows.unionByName(empty).repartition(1).mapInPandas(run, "model binary").collect()  # one small row
    return pickle.loads(got[0][0])
