"""Duplicate-substring removal by content-defined samples and hashed names.

No suffix order is built and nothing recurses: equal strings are found by
sampling blocks, grouping them by hash and comparing bytes, on one level.

Removes every byte that lies in a ``length``-byte string which also starts
earlier in the corpus (smaller doc_id, or same document and earlier start).

The difference cover is content-defined: in each ``length``-byte window the
``NAME``-byte block with the least hash is sampled, so equal windows sample the
same place wherever they stand - the property that lets cover positions stand
in for all others - at about two positions in seventy.

1. Group the sample: every sampled position carries its name (hash of its block)
   and the name of the text around it, the union of all windows that chose it.
   Tasks first drop repeats among their own texts, so a text that a third of all
   documents hold leaves each task once.  Samples meet by name in a bucket; all
   but the first of equal surroundings are covered whole.
2. Windows of what the names leave open: places whose block is shared but whose
   surroundings differ.  Only there the windows themselves are named, by triples
   (3, 9, 27, 81 bytes, each name made of three of the last level, the last
   pair overlapping to ``length``).
3. Merge: windows are sorted by (name, doc_id, start), adjacent prefixes are
   compared byte by byte, and all but the first of each run are covered.
4. Covered stretches return to their documents, which drop the bytes.

Numbers move as packed blocks, one row per (task, bucket).  A null text is
empty; a null doc_id sorts first; rows that repeat a doc_id are one document,
whose spans apply to all its rows (cut to their length).  Texts shorter than
``length`` bytes lose nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aletheia.llm.common import BLOCK_BYTES, U64, _BASE, _BYTE_CODE, blocks, hash_words, id_text, materialize, mix, text_buffer

LENGTH, NAME = 100, 32
NO_ID = -(2**63)
#: Buckets for each shuffle partition; more make smaller working sets.
BUCKETS_PER_PARTITION = 4
_POSITION_BITS = 21  # of a block's positions; blocks are cut to fit

SAMPLE = np.dtype([("name", "<u8"), ("around", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "<u4")])
SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4")])
OPEN = np.dtype([("name", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "<u4")])


def _block_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` (a power of two) bytes from every position on."""
    x, m, b = _BYTE_CODE[buf], 1, _BASE
    while m < width:
        x = x[:-m] * b + x[m:] if len(x) > m else x[:0]
        b, m = U64(pow(int(b), 2, 1 << 64)), 2 * m
    return mix(x)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    m = 1
    while 2 * m <= width:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return np.minimum(x[: len(x) - (width - m)], x[width - m :]) if width > m else x


def sample_block(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that chose the same position: name, surroundings' name,
    text number, first window, number of windows."""
    none = (np.zeros(0, U64), np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3)))
    if len(buf) < length:
        return none
    h = _block_hashes(buf, NAME)
    low = U64((1 << _POSITION_BITS) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=U64)
    least = (_window_min(key, length - NAME + 1) & low).astype(np.int64)
    inside = np.zeros(len(least) + 1, np.int32)  # windows that lie in one text
    long = np.flatnonzero(np.diff(offs) >= length)
    if not len(long):
        return none
    np.add.at(inside, offs[long], 1)
    np.add.at(inside, offs[long + 1] - length + 1, -1)
    ok = np.cumsum(inside[:-1]) > 0
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
    s = np.flatnonzero(new)
    change = np.flatnonzero(np.concatenate((new[1:] | ~ok[1:], [True])) & ok)
    n = change - s + 1
    return h[least[s]], hash_words(buf, s, s + n - 1 + length), np.searchsorted(offs, s, "right") - 1, s, n


def _samples(buf: np.ndarray, offs: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """All samples of a batch; texts longer than a block are cut with overlap."""
    parts = []
    for i, j in blocks(offs):
        lo, hi = int(offs[i]), int(offs[j])
        step = BLOCK_BYTES if j == i + 1 else hi - lo
        for a in range(lo, max(hi, lo + 1), max(step, 1)):
            b = min(hi, a + step + length - 1)
            o = np.array([0, b - a]) if j == i + 1 else offs[i : j + 1] - lo
            name, around, doc, s, n = sample_block(buf[a:b], o, length)
            r = np.empty(len(s), SAMPLE)
            r["name"], r["around"], r["doc"], r["n"] = name, around, ids[i + doc], n
            r["start"] = s - (offs[i + doc] - lo) + (a - lo)
            parts.append(r)
    return np.concatenate(parts) if parts else np.zeros(0, SAMPLE)


def _later(r: np.ndarray) -> np.ndarray:
    """Which samples have the surroundings of one that starts earlier."""
    order = np.lexsort((r["start"], r["doc"], r["around"], r["name"]))
    x = r[order]
    same = np.zeros(len(x), bool)
    same[1:] = (x["name"][1:] == x["name"][:-1]) & (x["around"][1:] == x["around"][:-1])
    # equal places of one document (a repeated row) don't cover each other
    group = np.cumsum(~same) - 1
    first = np.flatnonzero(~same)
    own = (x["doc"] == x["doc"][first][group]) & (x["start"] == x["start"][first][group])
    out = np.zeros(len(r), bool)
    out[order] = same & ~own
    return out


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Union of spans per document, as SPAN rows."""
    out = np.zeros(0, SPAN)
    if not len(doc):
        return out
    o = np.lexsort((start, doc))
    d, s, e = doc[o], start[o].astype(np.int64), end[o].astype(np.int64)
    turn = np.concatenate(([True], d[1:] != d[:-1]))
    # the largest end so far within a document: shift documents apart
    shift = np.cumsum(turn) * (int(e.max()) + 2)
    far = np.maximum.accumulate(e + shift)
    new = turn.copy()
    new[1:] |= (s + shift)[1:] > far[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(d)])) - 1
    out = np.empty(len(at), SPAN)
    out["doc"], out["start"], out["end"] = d[at], s[at], far[last] - shift[last]
    return out


def _bucket_of(name: np.ndarray, n: int) -> np.ndarray:
    return (mix(name + _BASE) % U64(n)).astype(np.int64)


def _split(r: np.ndarray, bucket: np.ndarray, n: int) -> list[bytes]:
    o = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[o], np.arange(n + 1))
    r = r[o]
    return [r[cut[k] : cut[k + 1]].tobytes() for k in range(n)]


def _by_bucket(batches, fields: int):
    """Rows sorted by their first column -> (bucket, joined bytes of each field)."""
    at, held = None, [[] for _ in range(fields)]
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(fields + 1)]
        for b, *xs in zip(*cols):
            if b != at and at is not None:
                yield at, [b"".join(h) for h in held]
                held = [[] for _ in range(fields)]
            at = b
            for h, x in zip(held, xs):
                h.append(x)
    if at is not None:
        yield at, [b"".join(h) for h in held]


def name_windows(text: np.ndarray, length: int) -> np.ndarray:
    """Names of the ``length``-byte windows, from triples of shorter names."""
    x, m = _BYTE_CODE[text], 1
    while 3 * m <= length:
        x = mix(mix(x[: -2 * m] * _BASE + x[m:-m]) * _BASE + x[2 * m :])
        m *= 3
    rest = length - m
    while rest > 0:  # overlapping names reach the full length
        step = min(rest, m)
        x = mix(x[:-step] * _BASE + x[step:])
        m, rest = m + step, rest - step
    return x


def _open_windows(r: np.ndarray, texts: np.ndarray, length: int) -> np.ndarray:
    """Windows of open places that start later than an equal one, as spans."""
    size = r["n"].astype(np.int64) + length - 1
    begin = np.cumsum(size) - size
    n = r["n"].astype(np.int64)
    which = np.repeat(np.arange(len(r)), n)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[which] + inner
    name = name_windows(texts, length)[at]
    doc, start = r["doc"][which], r["start"][which].astype(np.int64) + inner
    o = np.lexsort((start, doc, name))
    same = np.concatenate(([False], name[o][1:] == name[o][:-1]))
    group = np.cumsum(~same) - 1
    first = o[np.flatnonzero(~same)][group]  # the earliest of each run
    later = o[same & ((doc[o] != doc[first]) | (start[o] != start[first]))]
    head = first[same & ((doc[o] != doc[first]) | (start[o] != start[first]))]
    # compare the prefixes themselves
    for a in range(0, len(later), 65536):
        p, q = at[later[a : a + 65536], None], at[head[a : a + 65536], None]
        span = np.arange(length)
        if not (texts[p + span] == texts[q + span]).all():
            raise ArithmeticError("two different windows share a 64-bit name")
    return merge_spans(doc[later], start[later], start[later] + length)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining
    bytes), one row per row of ``docs``."""
    if not NAME <= length <= BLOCK_BYTES // 2:
        raise ValueError(f"length must be at least {NAME}")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = BUCKETS_PER_PARTITION * parts + 1  # odd, as documents are dealt by id
    text = id_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))

    def sample(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            buf, offs = text_buffer(batch.column(1))
            r = _samples(buf, offs, ids, length)
            late = _later(r)
            spans = merge_spans(r["doc"][late], r["start"][late], r["start"][late].astype(np.int64) + r["n"][late] - 1 + length)
            first = r[~late]
            a = _split(first, _bucket_of(first["name"], n_buckets), n_buckets)
            b = _split(spans, spans["doc"] % n_buckets, n_buckets)
            keep = [k for k in range(n_buckets) if a[k] or b[k]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keep, pa.int32()), pa.array([a[k] for k in keep], pa.binary()), pa.array([b[k] for k in keep], pa.binary())],
                names=["bucket", "samples", "spans"],
            )

    def meet(batches):
        for bucket, (samples, spans) in _by_bucket(batches, 2):
            r, known = np.frombuffer(samples, SAMPLE), np.frombuffer(spans, SPAN)
            late = _later(r)
            x = r[late]
            end = x["start"].astype(np.int64) + x["n"] - 1 + length
            found = merge_spans(*(np.concatenate(c) for c in zip((known["doc"], known["start"], known["end"]), (x["doc"], x["start"], end))))
            first = r[~late]
            names, which, many = np.unique(first["name"], return_inverse=True, return_counts=True)
            left = first[many[which] > 1]
            places = np.empty(len(left), OPEN)
            for c in OPEN.names:
                places[c] = left[c]
            a = _split(found, found["doc"] % n_buckets, n_buckets)
            b = _split(places, places["doc"] % n_buckets, n_buckets)
            keep = [k for k in range(n_buckets) if a[k] or b[k]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keep, pa.int32()), pa.array([a[k] for k in keep], pa.binary()), pa.array([b[k] for k in keep], pa.binary())],
                names=["bucket", "spans", "places"],
            )

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        """The text around a document bucket's open places, by name bucket."""
        r = np.frombuffer(b"".join(x for x in right.column("places").to_pylist() if x), OPEN)
        ids = left.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        rows: list[tuple[int, bytes, bytes]] = []
        if len(r) and len(ids):
            buf, offs = text_buffer(left.column("text").combine_chunks())
            at = order[np.minimum(np.searchsorted(ids[order], r["doc"]), len(ids) - 1)]
            size = r["n"].astype(np.int64) + length - 1
            ok = (ids[at] == r["doc"]) & (r["start"] + size <= np.diff(offs)[at])
            r, begin, size = r[ok], (offs[at] + r["start"])[ok], size[ok]
            bucket = _bucket_of(r["name"], n_buckets)
            o = np.argsort(bucket, kind="stable")
            for k, g in zip(*np.unique(bucket[o], return_index=True)):
                g = o[g : np.searchsorted(bucket[o], k, "right")]
                place = np.repeat(begin[g], size[g]) + np.arange(size[g].sum()) - np.repeat(np.cumsum(size[g]) - size[g], size[g])
                rows.append((int(k), r[g].tobytes(), buf[place].tobytes()))
        return pa.Table.from_arrays(
            [pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "places", "texts"]
        )

    def compare(batches):
        for _, (places, texts) in _by_bucket(batches, 2):
            spans = _open_windows(np.frombuffer(places, OPEN), np.frombuffer(texts, np.uint8), length)
            a = _split(spans, spans["doc"] % n_buckets, n_buckets)
            keep = [k for k in range(n_buckets) if a[k]]
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([a[k] for k in keep], pa.binary())], names=["bucket", "spans"])

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(x for x in right.column("spans").to_pylist() if x), SPAN)
        r = merge_spans(r["doc"], r["start"], r["end"])
        ids, rows = left.column("doc_id").to_pylist(), []
        for doc, t in zip(ids, left.column("text").to_pylist()):
            raw = t.encode()
            a, b = np.searchsorted(r["doc"], doc, "left"), np.searchsorted(r["doc"], doc, "right")
            keep, at, gone, runs = [], 0, 0, 0
            for s, e in zip(r["start"][a:b].tolist(), r["end"][a:b].tolist()):
                s, e = min(s, len(raw)), min(e, len(raw))
                if s < e:
                    keep.append(raw[at:s])
                    gone, runs, at = gone + e - s, runs + 1, e
            kept = b"".join(keep) + raw[at:]
            rows.append((None if doc == NO_ID else doc, len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.Table.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)

    def meeting(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket")

    first = text.mapInArrow(sample, "bucket int, samples binary, spans binary")
    first = materialize(meeting(first).mapInArrow(meet, "bucket int, spans binary, places binary"))  # read twice
    dealt = text.withColumn("bucket", F.pmod("doc_id", F.lit(n_buckets)).cast("int")).groupBy("bucket")
    places = first.select("bucket", "places").groupBy("bucket")
    around = dealt.cogroup(places).applyInArrow(lambda a, b: cut_out(a, b), "bucket int, places binary, texts binary")
    more = materialize(meeting(around).mapInArrow(compare, "bucket int, spans binary"))
    spans = first.select("bucket", "spans").unionByName(more).groupBy("bucket")
    return dealt.cogroup(spans).applyInArrow(lambda a, b: drop(a, b), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

