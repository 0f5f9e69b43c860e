"""Fill-in-the-middle rearrangement over a sparse index of multibyte characters.

Texts are handled as UTF-8 bytes.  ``SparseIndex`` records only the characters
of more than one byte: their byte positions and how many bytes they hold beyond
the first, summed up.  Between two of them bytes and code points advance alike,
so a cut is converted either way by one ``searchsorted`` and an addition; a text
of plain ASCII needs the addition alone.

A text is cut into units (lines, ``[^\\n]*\\n|[^\\n]+``, or code points).  Two
draws of a digest of the seed and ``doc_id`` give the cuts, a third whether the
text is transformed at all, a fourth the order (suffix-prefix-middle or
prefix-suffix-middle).

A null text is empty; an empty text, a text that holds one of the marks and a
row without a doc_id (no draw) stay plain.  Rows repeat as given.  Texts are
taken whole, whatever their length.  An empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aletheia.llm.common import blocks, id_text, text_buffer, tidy


@dataclass(frozen=True)
class FimFormat:
    """Marks and shares.  No mark may end as it begins, nor hold another one:
    then each is found again as its first occurrence."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 7
    #: of 100 texts so many are transformed, and of 100 of these so many suffix first
    rate: int = 100
    spm: int = 50
    #: "line" or "char"
    unit: str = "line"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if any(not m or any(m[:k] == m[-k:] for k in range(1, len(m))) for m in marks):
            raise ValueError("a mark must not be empty nor end as it begins")
        if any(a in b or any(a[:k] == b[-k:] for k in range(1, min(len(a), len(b)))) for a in marks for b in marks if a is not b):
            raise ValueError("marks must not hold or overlap each other")
        if self.unit not in ("line", "char"):
            raise ValueError("unit is line or char")


class SparseIndex:
    """Byte positions <-> code points of a run of texts laid end to end."""

    def __init__(self, buf: np.ndarray):
        self.at = np.flatnonzero(buf >= 0xC0)  # first bytes of multibyte characters
        lead = buf[self.at]
        #: bytes beyond one a character, of all such characters up to here
        self.excess = np.concatenate(([0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))))
        self.at_char = self.at - self.excess[:-1]

    def chars(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte position (between characters)."""
        return byte - self.excess[np.searchsorted(self.at, byte, "left")]

    def bytes(self, char: np.ndarray) -> np.ndarray:
        """Byte position of each code point."""
        return char + self.excess[np.searchsorted(self.at_char, char, "left")]


def draws(seed: int, ids: list[int | None]) -> np.ndarray:
    """The first four 32-bit numbers of the digest of ``seed:doc_id``."""
    raw = b"".join(hashlib.sha256(b"%d:%d" % (seed, i or 0)).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _transform(ids: pa.Array, texts: pa.Array, b: np.ndarray, o: np.ndarray, fmt: FimFormat) -> pa.RecordBatch:
    index = SparseIndex(b)
    begin, end = o[:-1], o[1:]
    first_char = index.chars(begin)
    if fmt.unit == "line":
        stop = np.flatnonzero(b == 10) + 1  # each line's end
        low, high = np.searchsorted(stop, begin, "right"), np.searchsorted(stop, end, "right")
        last = np.where(high > 0, stop[np.maximum(high, 1) - 1] if len(stop) else 0, 0)
        n = high - low + ((end > begin) & ((high == low) | (last != end)))
    else:
        n = index.chars(end) - first_char
    h = draws(fmt.seed, ids.to_pylist())
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    cut = []
    for c in (np.minimum(one, two), np.maximum(one, two)):
        if fmt.unit == "char":
            cut.append(index.bytes(first_char + c))
        else:  # after c lines: the end of the c-th, which may lack its newline
            inside = np.minimum(low + c, high) - 1
            line_end = stop[np.maximum(inside, 0)] if len(stop) else np.zeros(len(c), np.int64)
            cut.append(np.where(c == 0, begin, np.where(low + c > high, end, line_end)))
    marked = np.zeros(len(n), bool)
    for mark in (fmt.prefix, fmt.suffix, fmt.middle):
        marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = (end == begin) | marked | (h[:, 2] % 100 >= fmt.rate) | pc.is_null(ids).to_numpy(zero_copy_only=False)
    form = np.where(plain, "plain", np.where(h[:, 3] % 100 < fmt.spm, "spm", "psm"))
    x, y = (m.encode() for m in (fmt.prefix, fmt.suffix))
    z, raw, out = fmt.middle.encode(), b.tobytes(), []
    for f, s, p, q, e in zip(form.tolist(), begin.tolist(), cut[0].tolist(), cut[1].tolist(), end.tolist()):
        if f == "plain":
            out.append(raw[s:e])
        elif f == "psm":
            out.append(b"".join((x, raw[s:p], y, raw[q:e], z, raw[p:q])))
        else:
            out.append(b"".join((y, raw[q:e], x, raw[s:p], z, raw[p:q])))
    c1, c2 = index.chars(cut[0]), index.chars(cut[1])
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array(n.astype(np.int64)), pa.array(form.tolist(), pa.string()),
            pa.array(c1 - first_char, pa.int64(), mask=plain), pa.array(c2 - c1, pa.int64(), mask=plain),
            pa.array(out, pa.binary()).cast(pa.string()),
        ],
        names=[x.split()[0] for x in SCHEMA.split(", ")],
    )


def fill_in_middle(docs: DataFrame, fmt: FimFormat = FimFormat()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row:
    units, form, code points of prefix and middle, and the rearranged text."""

    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for i, j in blocks(offs):
                yield _transform(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], fmt)

    return id_text(docs).mapInArrow(tidy(run), SCHEMA)


def restore(filled: DataFrame, fmt: FimFormat = FimFormat()) -> DataFrame:
    """Adds ``restored``: the text, from ``output`` and ``form`` alone (what lies
    between the marks, put back in order)."""
    marks = "|".join("\\Q" + m + "\\E" for m in (fmt.prefix, fmt.suffix, fmt.middle))
    part = lambda k: F.get("__parts", F.lit(k))
    text = F.when(F.col("form") == "psm", F.concat(part(1), part(3), part(2)))
    text = text.when(F.col("form") == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.col("output"))
    return filled.withColumn("__parts", F.split("output", marks, 4)).withColumn("restored", text).drop("__parts")


def digests(docs: DataFrame, fmt: FimFormat = FimFormat()) -> DataFrame:
    """The contract's row per document, with the output's and the restored text's digests."""
    return restore(fill_in_middle(docs, fmt), fmt).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(F.col("restored"), 256).alias("restored_sha256"),
    )
