"""Best-fit packing: plan over the length histogram, then join on rank.

1. Texts are tokenised and cut into pieces of at most ``size`` tokens (a task
   at a time, no shuffle); a piece row carries its length and checksum only.
2. Pieces are counted per length: at most ``size`` counts, whatever the corpus.
3. ``plan_bins`` places counts, longest first, each into the tightest open
   bins: runs of equal bins are one record, so the plan does not grow with the
   number of documents.
4. Pieces get their rank within their length (counted per (length, bucket),
   so a length that holds a third of all rows is spread over all tasks) and
   join the plan's slots on (length, rank).

Null and empty texts are one piece holding the end token alone.  Repeated rows
are packed once each.  An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aletheia.llm.common import LOWER, NOT_SPACE, U64, blocks, byte_class, find_words, hash_words, id_text, materialize, text_buffer, tidy

SIZE = 4096
END_ID = 1
#: Words of which a Python worker keeps the ids (about 50 bytes each).
MEMO_WORDS = 1_000_000
#: Plan records that may be broadcast (about 50 bytes each).
PLAN_BROADCAST_ROWS = 500_000

#: fixed value: a special token of the vocabulary and its id
SPECIAL = (b"<|endoftext|>", 49407)
ROW_WORDS = 2000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start[0], start[0] + 1, ... of all runs end to end."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(length.sum())


#: Kinds of bytes: other signs 0, letters 1, digits 2, apostrophe and beyond ASCII 3, white space 4.
_KIND = np.zeros(256, np.int8)
_KIND[byte_class(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[byte_class(b"0123456789")] = 2
_KIND[0x80:], _KIND[39], _KIND[~NOT_SPACE] = 3, 3, 4


def word_parts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the parts that the vocabulary's own rule
    never joins: runs of letters, single digits and runs of other signs.  Only
    ASCII and the letters U+00C0 to U+00FF are split so; a word that holds an
    apostrophe, ``<|`` or any other character is one part."""
    s, e, d = find_words(buf, offs, NOT_SPACE)
    if not len(s):
        return s, e, d
    after = np.append(buf[1:], np.uint8(0))
    kind = _KIND[buf]
    high = np.flatnonzero(buf == 0xC3)  # the letters U+00C0 to U+00FF, without the signs x and :
    high = high[(after[high] >= 0x80) & (after[high] != 0x97) & (after[high] != 0xB7)]
    kind[high] = kind[high + 1] = 1
    cut = kind == 2
    cut[1:] |= kind[1:] != kind[:-1]
    cut &= kind != 4
    cut[s] = True  # every word begins a part
    starts = np.flatnonzero(cut)
    word = np.searchsorted(s, starts, "right") - 1
    odd = (kind == 3) | ((buf == 60) & (after == 124))
    if odd.any():
        whole = np.add.reduceat(odd, s) > 0
        keep = ~whole[word] | (s[word] == starts)
        starts, word = starts[keep], word[keep]
    ends = e[word]
    inner = np.flatnonzero(word[1:] == word[:-1])
    ends[inner] = starts[inner + 1]
    return starts, ends, d[word]


class WordIds:
    """Token ids of words.  The vocabulary drops white space and lowers case, and
    no id spans two parts of words (``word_parts``), so a text's ids are those of
    its parts in turn.

    Known parts lie sorted by a 64-bit hash, their bytes and ids end to end; a
    block of texts finds all of its parts at once.  Bytes are compared on every
    hit, so parts of equal hash cannot take each other's ids."""

    def __init__(self, path: str, most: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        empty = lambda t: np.zeros(0, t)
        self.hash, self.word = empty(U64), empty(np.int32)  # sorted hashes and the numbers of their words
        self.bytes, self.byte_at, self.byte_n = empty(np.uint8), empty(np.int64), empty(np.int32)
        self.ids, self.id_at, self.id_n = empty(np.uint32), empty(np.int64), empty(np.int32)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has.  Words go to the
        tokenizer in long rows, kept apart by a special token."""
        mark, mark_id = SPECIAL
        plain = [w for w in words if b"<|" not in w]
        ids, counts = [], []
        rows = [mark.join(plain[k : k + ROW_WORDS]).decode("utf-8") for k in range(0, len(plain), ROW_WORDS)]
        for r, got in enumerate(self.tok.encode_batch_fast(rows, add_special_tokens=False)):
            got = np.array(got.ids, np.uint32)
            at = np.flatnonzero(got == mark_id)
            ids.append(np.delete(got, at))
            counts.append(np.diff(np.concatenate(([-1], at, [len(got)]))) - 1)
            if len(counts[-1]) != len(plain[r * ROW_WORDS : (r + 1) * ROW_WORDS]):
                raise ValueError("the vocabulary's special token has another id")
        if len(plain) == len(words):
            return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(counts) if counts else np.zeros(0, np.int64)
        own = iter(np.split(np.concatenate(ids), np.cumsum(np.concatenate(counts))[:-1])) if plain else iter(())
        each = [self.tok.encode(w.decode("utf-8"), add_special_tokens=False).ids if b"<|" in w else next(own) for w in words]
        return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)

    def _remember(self, h: np.ndarray, buf: np.ndarray, s: np.ndarray, n: np.ndarray) -> None:
        ids, id_n = self._encoded([buf[a : a + k].tobytes() for a, k in zip(s.tolist(), n.tolist())])
        number = len(self.byte_at) + np.arange(len(h), dtype=np.int32)
        at = np.searchsorted(self.hash, h)
        self.hash, self.word = np.insert(self.hash, at, h), np.insert(self.word, at, number)
        self.byte_at = np.concatenate((self.byte_at, len(self.bytes) + np.cumsum(n) - n))
        self.id_at = np.concatenate((self.id_at, len(self.ids) + np.cumsum(id_n) - id_n))
        self.byte_n, self.id_n = np.concatenate((self.byte_n, n.astype(np.int32))), np.concatenate((self.id_n, id_n.astype(np.int32)))
        self.bytes, self.ids = np.concatenate((self.bytes, buf[_runs(s, n)])), np.concatenate((self.ids, ids))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words with these hashes; -1 where unknown."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.word[at], -1)

    def of(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts end to end, and the n+1 bounds of the texts in them."""
        low = LOWER[buf]
        marks = np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124)) if len(buf) else np.zeros(0, np.int64)
        for t in np.unique(np.searchsorted(offs, marks, "right") - 1):
            # a text with "<|": a special token's string in capitals is ordinary text, so its case stays
            low[offs[t] : offs[t + 1]] = buf[offs[t] : offs[t + 1]]
        s, e, d = word_parts(low, offs)
        n = e - s
        h, first, kind = np.unique(hash_words(low, s, e), return_index=True, return_inverse=True)
        word = self._find(h)
        new = first[word < 0]
        if len(new) and len(self.hash) + len(new) <= self.most:
            self._remember(h[word < 0], low, s[new], n[new])
            word, new = self._find(h), new[:0]
        known = word[kind] if len(self.hash) else np.full(len(s), -1)
        # every hit is compared byte by byte; what differs or is not kept is encoded here
        same = known >= 0
        same[same] = self.byte_n[known[same]] == n[same]
        hit = np.flatnonzero(same)
        alike = self.bytes[_runs(self.byte_at[known[hit]], n[hit])] == low[_runs(s[hit], n[hit])]
        wrong = np.add.reduceat(~alike, np.cumsum(n[hit]) - n[hit]) > 0 if len(hit) else np.zeros(0, bool)
        same[hit[wrong]] = False
        id_n = np.where(same, self.id_n[known] if len(self.id_n) else 0, 0)
        rest = np.flatnonzero(~same)
        if len(rest):
            texts = [low[a:b].tobytes() for a, b in zip(s[rest].tolist(), e[rest].tolist())]
            each = sorted(set(texts))
            ids, count = self._encoded(each)
            number = np.searchsorted(np.array(each, object), np.array(texts, object))
            id_n[rest] = count[number]
        at = np.cumsum(id_n) - id_n
        out = np.empty(int(id_n.sum()), np.uint32)
        keep = np.flatnonzero(same)
        out[_runs(at[keep], id_n[keep])] = self.ids[_runs(self.id_at[known[keep]], id_n[keep])]
        if len(rest):
            out[_runs(at[rest], id_n[rest])] = ids[_runs((np.cumsum(count) - count)[number], id_n[rest])]
        per_text = np.bincount(d, id_n, minlength=len(offs) - 1).astype(np.int64)
        return out, np.concatenate(([0], np.cumsum(per_text)))


@cache
def _word_ids(path: str) -> WordIds:
    """One table per Python worker."""
    return WordIds(path)


def pieces(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """One row per piece of every text: ids of the text, then ``END_ID``."""
    if size < 1:
        raise ValueError("size must be positive")
    path = path or vocabulary()

    def cut(batches):
        words, end = _word_ids(path), END_ID.to_bytes(4, "little")
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in blocks(offs):
                got, bound = words.of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                raw, rows = memoryview(got.astype("<u4", copy=False)).cast("B"), []
                for doc, b, e in zip(ids[i:j], bound[:-1].tolist(), bound[1:].tolist()):
                    n = e - b + 1  # with the end token
                    for k, at in enumerate(range(0, n, size)):
                        stop = min(at + size, n)
                        crc = zlib.crc32(raw[4 * (b + at) : 4 * min(b + stop, e)])
                        rows.append((doc, k, at, stop - at, zlib.crc32(end, crc) if stop == n else crc))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return id_text(docs).mapInArrow(tidy(cut), PIECE)


def plan_bins(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts.  Records ``(length, first, n, bin,
    per_bin, offset)``: items first..first+n-1 of that length go, per_bin each,
    into the bins from ``bin`` on, from ``offset``."""
    open_bins: dict[int, list[tuple[int, int]]] = {}  # free space -> runs (first bin, bins)
    out, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, first = counts[length], 0
        while left:
            free = min((f for f in open_bins if f >= length), default=None)
            if free is None:
                free, per = size, size // length
                run = (bins, -(-left // per))
                bins += run[1]
            else:
                run = open_bins[free].pop()
                if not open_bins[free]:
                    del open_bins[free]
                per = free // length
            start, n = run
            full = min(n, left // per)
            done = [(start, full, per)] if full else []
            if full < n and left - full * per:
                done.append((start + full, 1, left - full * per))
            for at, k, each in done:
                out.append((length, first, k * each, at, each, size - free))
                first, left = first + k * each, left - k * each
                if free - each * length:
                    open_bins.setdefault(free - each * length, []).append((at, k))
            used = sum(k for _, k, _ in done)
            if used < n:
                open_bins.setdefault(free, []).append((start + used, n - used))
    return out


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset`` (gapless from 0)."""
    spark = docs.sparkSession
    rows = materialize(pieces(docs, size, path))  # read three times; tokenised once
    spread = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(spread)))
    per = rows.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    counts = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("__n")).collect()}  # at most `size` rows
    plan = plan_bins(counts, size)
    # a record is filed under each stretch of ranks that it meets; a length's
    # stretches are as long as its records on average, so a piece meets few of them
    records: dict[int, int] = {}
    for length, *_ in plan:
        records[length] = records.get(length, 0) + 1
    strides = F.broadcast(spark.createDataFrame([(k, max(1, counts[k] // n)) for k, n in records.items()], "length long, __w long"))  # at most `size` rows
    slots = spark.createDataFrame(plan, "length long, __first long, __k long, __bin long, __per long, __off long").join(strides, "length")
    slots = slots.withColumn("__s", F.explode(F.expr("sequence(__first div __w, (__first + __k - 1) div __w)"))).drop("__w")
    if 2 * len(plan) <= PLAN_BROADCAST_ROWS:
        slots = F.broadcast(slots)
    inside = F.row_number().over(Window.partitionBy("length", "__b").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = rows.withColumn("__i", inside).join(base, ["length", "__b"]).withColumn("__r", F.col("__base") + F.col("__i") - 1)
    ranked = ranked.join(strides, "length").withColumn("__s", F.expr("__r div __w"))
    j = F.col("__r") - F.col("__first")
    return (
        ranked.join(slots, ["length", "__s"])
        .where((j >= 0) & (j < F.col("__k")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("__bin") + F.floor(j / F.col("__per"))).cast("long").alias("sequence_id"),
            (F.col("__off") + (j % F.col("__per")) * F.col("length")).cast("long").alias("offset"),
        )
    )
