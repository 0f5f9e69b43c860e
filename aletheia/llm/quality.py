"""Document quality by a linear-chain conditional random field over lines.

A line takes its document's label in the fitting rows.  The field sees the
make-up of a line (shares of capitals, digits, signs, spaces, ...; its length;
repeats within the document) and of the lines before and after it.
Forward-backward marginals, weighted by line length, make the document's
quality, calibrated on the fitting rows.

Null and empty texts have no lines and get the score of no evidence.  Texts are
taken whole, and so are their chains of lines.  Rows repeat as given;
without labelled rows every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aletheia.llm import crf
from aletheia.llm.common import NOT_SPACE, blocks, find_words, hash_words, id_text, text_buffer, tidy
from aletheia.llm.fitting import fit_on, fold

FOLDS, HELD_OUT = 3, 1

_CLASSES = {
    "upper": bytes(range(65, 91)), "digit": b"0123456789", "bang": b"!?", "bar": b"|", "sign": b"#$%&*+/<=>@\\^_`{}~[]()",
    "mark": b".,;:'\"-", "space": b" \t", "high": bytes(range(128, 256)),
}


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_TABLES = [_table(c) for c in _CLASSES.values()]


def line_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, text number and length of every line that holds a word.
    Lines are cut at newlines and text ends."""
    ends = np.unique(np.concatenate([np.flatnonzero(buf == 10) + 1, offs[1:]]))
    ends = ends[ends > 0]
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    doc = np.searchsorted(offs, starts, "right") - 1
    size = (ends - starts).astype(float)
    cols = []
    for t in _TABLES:
        c = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(t[buf], out=c[1:])
        cols.append((c[ends] - c[starts]) / np.maximum(size, 1))
    ws, we, wd = find_words(buf, offs, NOT_SPACE & (np.arange(256) != 10))
    at = np.searchsorted(ends, ws, "right")
    n_words = np.bincount(at, minlength=len(ends)).astype(float)
    # words that repeat within their line
    h = hash_words(buf, ws, we)
    o = np.lexsort((h, at))
    again = np.zeros(len(h), bool)
    again[1:] = (h[o][1:] == h[o][:-1]) & (at[o][1:] == at[o][:-1])
    repeats = np.bincount(at[o], again, minlength=len(ends)) / np.maximum(n_words, 1)
    # lines that repeat within their text
    lh = hash_words(buf, starts, ends)
    lo = np.lexsort((lh, doc))
    same = np.zeros(len(lh), bool)
    same[1:] = (lh[lo][1:] == lh[lo][:-1]) & (doc[lo][1:] == doc[lo][:-1])
    copy = np.zeros(len(lh))
    copy[lo] = same
    cols += [np.log1p(n_words) / 5, size / np.maximum(n_words, 1) / 10, repeats, copy]
    full = n_words > 0
    return np.stack(cols, axis=1)[full], doc[full], size[full]


def _design(f: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    f = np.concatenate([f, np.minimum(f * 8, 1)], axis=1)  # small shares count as well
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    ends = np.cumsum(lengths)[lengths > 0]
    before[ends - lengths[lengths > 0]] = 0
    after[ends - 1] = 0
    return np.concatenate([np.ones((len(f), 1)), f, before, after], axis=1)


def _document_features(p: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    weight = np.bincount(doc, size, minlength=n)
    mean = np.bincount(doc, size * p, minlength=n) / np.maximum(weight, 1)
    none = (weight == 0).astype(float)
    least = np.ones(n)
    np.minimum.at(least, doc, p)
    logit = np.log((mean + 1e-3) / (1 - mean + 1e-3)) * (1 - none)
    return np.stack([np.ones(n), logit, least * (1 - none), none], axis=1)


def train(texts: list[str], y: np.ndarray) -> dict:
    k = 2 * (len(_TABLES) + 4)
    model = {"w": np.zeros(1 + 3 * k), "move": np.zeros((2, 2)), "cal": np.zeros(4)}
    if not len(texts) or y.min() == y.max():
        model["cal"][0] = 0.0 if not len(texts) else (4.0 if y[0] else -4.0)
        return model
    buf, offs = text_buffer(pa.array(texts, pa.large_string()))
    parts = [(i, *line_features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])) for i, j in blocks(offs)]
    f = np.concatenate([x[1] for x in parts])
    d = np.concatenate([x[2] + x[0] for x in parts])
    size = np.concatenate([x[3] for x in parts])
    n = len(texts)
    lengths = np.bincount(d, minlength=n)
    if len(f):
        x = _design(f, lengths)
        model["w"], model["move"] = crf.fit(x, y[d].astype(np.int64), lengths, l2=1e-4)
        p = crf.marginals(x @ model["w"], lengths, model["move"])
    else:
        p = np.zeros(0)
    model["cal"] = crf.fit_logistic(_document_features(p, d, size, n), y.astype(float))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, **bound) -> dict:
    return fit_on(docs, labels, "quality", fold(FOLDS) != HELD_OUT, train, **bound)


def quality_scores(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score, n_lines, bad_lines`` (lines with a marginal below 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def score(batches):
        m = shared.value
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for i, j in blocks(offs):
                f, d, size = line_features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                lengths = np.bincount(d, minlength=j - i)
                p = crf.marginals(_design(f, lengths) @ m["w"], lengths, m["move"])
                z = crf.sigmoid(_document_features(p, d, size, j - i) @ m["cal"])
                n = np.bincount(d, minlength=j - i)
                bad = np.bincount(d, p < 0.5, minlength=j - i).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(z, pa.float64()), pa.array(n, pa.int64()), pa.array(bad, pa.int64())],
                    names=["doc_id", "score", "n_lines", "bad_lines"],
                )

    return id_text(docs).mapInArrow(tidy(score), "doc_id long, score double, n_lines long, bad_lines long")


def quality(docs: DataFrame, labels: DataFrame, **bound) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_lines, bad_lines`` for every row."""
    scored = quality_scores(docs, fit_quality(docs, labels, **bound))
    return scored.select(
        "doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "bad_lines"
    )
