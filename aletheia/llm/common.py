"""Shared helpers: table access, Arrow text buffers and vectorised word hashes.

Every operator selects the columns it needs first, so extra columns of the
caller (also such with clashing names) never meet an internal column.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aletheia.session import ensure_checkpoint_dir, materialize  # noqa: F401  (reliable checkpoint, shared folder)

#: Bytes handled per vectorised step; bounds the temporary arrays of a task.
BLOCK_BYTES = 1 << 20

U64 = np.uint64
_MIX1 = U64(0xFF51AFD7ED558CCD)
_MIX2 = U64(0xC4CEB9FE1A85EC53)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def release_memory() -> None:
    """Give memory that a finished task left in the allocators back to the system.
    Python workers are reused by later tasks and stand beside the JVM meanwhile."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run):
    """``run(batches)`` that releases memory once its batches are through."""

    def whole(batches):
        yield from run(batches)
        release_memory()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as compressed Parquet in the shared checkpoint
    folder and read back: wide intermediate rows take a fraction of a
    checkpoint's space, and a reader takes only the columns it needs."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``; a null text is the empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n+1 offsets in them."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def blocks(offs: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole texts of about ``most`` bytes (a longer text alone)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def byte_class(chars: bytes, rest: bool = False) -> np.ndarray:
    """Boolean table over byte values: those in ``chars`` (or all others)."""
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return ~t if rest else t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of the whitespace kind: [^\x20\x09-\x0D]+
NOT_SPACE = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d", rest=True)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (wrapping arithmetic)."""
    x = x ^ (x >> U64(33))
    x = x * _MIX1
    x ^= x >> U64(33)
    x *= _MIX2
    return x ^ (x >> U64(33))


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * _BASE)
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _pow or len(_pow["up"]) < n + 1:
        size = max(n + 1, BLOCK_BYTES + 1)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        _pow["up"], _pow["down"] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if size > 8 * BLOCK_BYTES:  # a single huge text: don't keep tables of its size
            return _pow.pop("up"), _pow.pop("down")
    return _pow["up"], _pow["down"]


def find_words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words never cross texts."""
    w = is_word[buf]
    if not len(w):
        e = np.zeros(0, np.int64)
        return e, e, e
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    full = offs[1:] > offs[:-1]
    b, e = offs[:-1][full], offs[1:][full] - 1
    first[b] = w[b]
    last[e] = w[e]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(offs, s, "right") - 1


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes; depends on nothing else."""
    up, down = _powers(len(buf))
    c = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE_CODE[buf] * up[: len(buf)], out=c[1:])
    return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(U64) * _MIX2)


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and their text numbers.  A text of fewer
    than k words but at least one has its whole sequence as its only shingle."""
    m = len(h)
    count = np.bincount(doc, minlength=n_docs)
    starts = np.concatenate(([0], np.cumsum(count)[:-1])) if n_docs else np.zeros(0, int)
    out_h, out_d = [], []
    if m >= k:
        s = h[: m - k + 1].copy()
        for i in range(1, k):
            s = mix(s * _BASE + h[i : m - k + 1 + i])
        ok = doc[: m - k + 1] == doc[k - 1 :]
        out_h.append(s[ok])
        out_d.append(doc[: m - k + 1][ok])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        s = h[starts[short]].copy()
        for i in range(1, k):
            more = count[short] > i
            s[more] = mix(s[more] * _BASE + h[starts[short][more] + i])
        out_h.append(mix(s + count[short].astype(U64)))
        out_d.append(short)
    if not out_h:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    hh, dd = np.concatenate(out_h), np.concatenate(out_d)
    o = np.argsort(dd, kind="stable")
    return hh[o], dd[o]
