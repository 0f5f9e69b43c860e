"""Toxic spans by a linear-chain conditional random field over words.

Token labels: in the fitting rows a word is offending if it is far likelier in
toxic documents than in others, and a token of such a word in a toxic document
is labelled 1.  The field sees, for a token and its neighbours, how far (in
bins) the word leans to toxic documents.  Forward-backward marginals of all
tokens give the offending spans and, summed, the document's score, calibrated
on the fitting rows.  The field is fitted on all tokens of the fitting rows
(``fit_on`` bounds their number and the bytes of each).

Null, empty and wordless texts get the score of a text without offending
words; without any labelled rows nothing is offending and every score is low.  Texts are taken whole: neighbours
and forward-backward run over whole texts.  Only the fit counts the moves of a
text in pieces of ``FIT_CHAIN`` words (no move across a cut).  Rows repeat as given.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aletheia.llm import crf
from aletheia.llm.common import LOWER, U64, blocks, find_words, hash_words, id_text, text_buffer, tidy
from aletheia.llm.fitting import fit_on, fold

FOLDS, HELD_OUT = 5, 0
#: Words of a piece in which the fit counts moves (a parameter, ``fit_chain``).
FIT_CHAIN = 64
#: Bins of a word's log-odds between toxic and other documents.
BINS = np.array([0.7, 1.5, 2.5, 3.5])
K = len(BINS) + 1
OFFENDING = 2  # from this bin on (log-odds 1.5)

_WORD = np.zeros(256, bool)
_WORD[[*range(97, 123), *range(65, 91), *range(128, 256)]] = True


def _tokens(buf, offs):
    s, e, d = find_words(buf, offs, _WORD)
    return s, e, d, hash_words(LOWER[buf], s, e)


def _features(h: np.ndarray, lengths: np.ndarray, model: dict) -> np.ndarray:
    """Bin of each token, and of the tokens before and after it in its text."""
    at = np.searchsorted(model["words"], h)
    at[at == len(model["words"])] = 0
    known = model["words"][at] == h if len(model["words"]) else np.zeros(len(h), bool)
    bin_ = np.where(known, model["bins"][at] if len(model["words"]) else 0, 0)
    before, after = np.zeros_like(bin_), np.zeros_like(bin_)
    before[1:], after[:-1] = bin_[:-1], bin_[1:]
    ends = np.cumsum(lengths)
    before[(ends - lengths)[lengths > 0]] = 0
    after[ends[lengths > 0] - 1] = 0
    return np.stack([bin_, before, after], axis=1)


def _one_hot(f: np.ndarray) -> np.ndarray:
    n = len(BINS) + 1
    x = np.zeros((len(f), 3 * n))
    for i in range(3):
        x[np.arange(len(f)), i * n + f[:, i]] = 1
    return x


def _unary(f: np.ndarray, model: dict) -> np.ndarray:
    n = len(BINS) + 1
    w = model["w"]
    return w[f[:, 0]] + w[n + f[:, 1]] + w[2 * n + f[:, 2]]


def _document_features(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    total = np.bincount(doc, p, minlength=n)
    size = np.bincount(doc, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, doc, p)
    return np.stack([np.ones(n), np.log1p(total), most, np.log1p(100 * total / np.maximum(size, 20))], axis=1)


def _runs(texts: list[str]):
    """(first text, texts, text number and word hash of every token) of runs of whole texts."""
    buf, offs = text_buffer(pa.array(texts, pa.large_string()))
    for i, j in blocks(offs):
        _, _, d, h = _tokens(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        yield i, j - i, d, h


def _offending_words(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (hashes, sorted) that lean to toxic documents, and their bins."""
    found = []
    for i, _, d, h in _runs(texts):  # documents of either kind that hold a word, run by run
        o = np.lexsort((d, h))
        first = np.ones(len(h), bool)
        first[1:] = (h[o][1:] != h[o][:-1]) | (d[o][1:] != d[o][:-1])
        words, which = np.unique(h[o][first], return_inverse=True)
        found.append((words, np.bincount(which, minlength=len(words)), np.bincount(which, y[i + d[o][first]], minlength=len(words))))
    words, which = np.unique(np.concatenate([w for w, _, _ in found]), return_inverse=True)
    every, bad = (np.bincount(which, np.concatenate([f[k] for f in found]), minlength=len(words)) for k in (1, 2))
    good, n, n_toxic = every - bad, len(texts), int(y.sum())
    odds = np.log((bad + 0.5) / (n_toxic + 1)) - np.log((good + 0.5) / (n - n_toxic + 1))
    keep = (bad >= max(3, 0.01 * n_toxic)) & (odds > BINS[0])
    return words[keep], np.searchsorted(BINS, odds[keep])


def _bins_of(code: np.ndarray) -> np.ndarray:
    return np.stack([code // (K * K), code // K % K, code % K], axis=1)


def train(texts: list[str], y: np.ndarray, fit_chain: int = FIT_CHAIN) -> dict:
    """The fitted field.  Texts are gone through in runs; of a token only one
    byte stays (its features and label)."""
    model = {"words": np.zeros(0, U64), "bins": np.zeros(0, np.int64), "w": np.zeros(3 * (len(BINS) + 1)), "move": np.zeros((2, 2)), "cal": np.zeros(4)}
    if not len(texts) or y.min() == y.max():
        model["cal"][0] = 4.0 if len(texts) and y[0] else -4.0
        return model
    model["words"], model["bins"] = _offending_words(texts, y)
    codes, runs = [], []
    for i, m, d, h in _runs(texts):
        lengths = np.bincount(d, minlength=m)
        f = _features(h, lengths, model)
        label = (f[:, 0] >= OFFENDING) & (y[i + d] == 1)
        codes.append((2 * (f @ [K * K, K, 1]) + label).astype(np.uint8))
        runs.append(lengths)
    code = np.concatenate(codes)
    if len(code):
        # every chain counts; equal ones are summed once
        at, sizes, times = crf.distinct_chains(code, crf.cut_chains(np.concatenate(runs), fit_chain))
        kinds, row = np.unique(code[at] >> 1, return_inverse=True)
        x = _one_hot(_bins_of(kinds.astype(np.int64)))
        model["w"], model["move"] = crf.fit(x, (code[at] & 1).astype(np.int64), sizes, row=row, times=times)
    features = []
    for part, lengths in zip(codes, runs):
        p = crf.marginals(_unary(_bins_of((part >> 1).astype(np.int64)), model), lengths, model["move"])
        features.append(_document_features(p, np.repeat(np.arange(len(lengths)), lengths), len(lengths)))
    model["cal"] = crf.fit_logistic(np.concatenate(features), y.astype(float))
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, **bound) -> dict:
    """``bound``: ``max_docs`` and ``max_bytes`` of ``fit_on``, ``fit_chain`` of ``train``."""
    chain = bound.pop("fit_chain", FIT_CHAIN)
    return fit_on(docs, labels, "toxic", fold(FOLDS) != HELD_OUT, partial(train, fit_chain=chain), **bound)


SCHEMA = "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>"


def _score(b: np.ndarray, o: np.ndarray, model: dict):
    """Of a run of texts: tokens (start, end, text), marginals, scores."""
    s, e, d, h = _tokens(b, o)
    lengths = np.bincount(d, minlength=len(o) - 1)
    p = crf.marginals(_unary(_features(h, lengths, model), model), lengths, model["move"])
    return s, e, d, p, crf.sigmoid(_document_features(p, d, len(o) - 1) @ model["cal"])


def toxicity_spans(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score, spans``: spans are runs of tokens with a marginal of
    0.5 or more, in code points, with the largest marginal of the run."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fitting rows
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def score(batches):
        m = shared.value
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for i, j in blocks(offs):
                o, b = offs[i : j + 1] - offs[i], buf[offs[i] : offs[j]]
                s, e, d, p, z = _score(b, o, m)
                chars = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))  # code points before each byte
                t = np.flatnonzero(p >= 0.5)
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1] + 1) | (d[t[1:]] != d[t[:-1]])
                first = np.flatnonzero(new)
                last = np.concatenate((first[1:], [len(t)]))[: len(first)] - 1
                own = d[t[first]]
                zero = chars[o[own]]
                most = np.maximum.reduceat(p[t], first) if len(first) else np.zeros(0)
                spans = pa.StructArray.from_arrays(
                    [pa.array(chars[s[t[first]]] - zero), pa.array(chars[e[t[last]]] - zero), pa.array(most)], fields=list(span)
                )
                ends = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=j - i))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(z, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)],
                    names=["doc_id", "score", "spans"],
                )

    return id_text(docs).mapInArrow(tidy(score), SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, **bound) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` for every row of ``docs``."""
    scored = toxicity_spans(docs, fit_toxicity(docs, labels, **bound))
    return scored.select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def keep_clean(docs: DataFrame, labels: DataFrame, **bound) -> DataFrame:
    """Rows of ``docs`` (all columns) that score below 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, **bound))

    def clean(batches):
        m = shared.value
        for batch in batches:
            buf, offs = text_buffer(batch.column(batch.schema.get_field_index("text")))
            z = [_score(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], m)[-1] for i, j in blocks(offs)]
            yield batch.filter(pa.array(np.concatenate(z) < 0.5)) if z else batch

    return docs.mapInArrow(tidy(clean), docs.schema)
