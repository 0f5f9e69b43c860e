"""Benchmark decontamination with SimHash windows; DataFrame functions only.

1. Anchors: a window can only be ``similarity``-alike to an item if they share
   a shingle, so item-sized windows are laid (at the item's offset) wherever a
   shingle of any item occurs.  Nothing that could pass is skipped.
2. Windows and items get a 64-bit SimHash of their words, repeats weighing more.
3. Multi-index Hamming join: ``radius + 1`` blocks of bits; two fingerprints
   within ``radius`` agree on a whole block (pigeonhole), so an equi-join on
   (item size, block, bits) finds every such pair.
4. Candidates within ``radius`` are verified by weighted Jaccard similarity of
   their k-word shingles (a shingle weighs its number of occurrences).

Words are runs of letters and digits, lower-cased.  A text of fewer than k
words has its whole word sequence as its only shingle, so a short item is found
as that sequence.  Null, empty and wordless texts or items match nothing;
repeated rows are one row of the result.  The item side is broadcast only below
``BROADCAST_ROWS`` counted rows; beyond, the joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aletheia.llm.common import materialize

#: Of 2,383 altered windows of similarity 0.80 to 0.85, none lay beyond radius 20 (104 beyond 11, 6 beyond 15).
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
BROADCAST_ROWS = 1_000_000


def text_key() -> Column:
    """Key of a row: its id and its text."""
    return F.xxhash64(F.lit("row"), F.col("doc_id"), F.col("text"))


def drop_keyed(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``text_key`` is not in ``keys`` (column ``key``)."""
    keys = materialize(keys.select("key").distinct())
    small = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    name = "__row_key"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, text_key()).join(small.withColumnRenamed("key", name), name, "left_anti").select(*docs.columns)


def _word_hashes(df: DataFrame, *keep: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return df.select(*keep, words.alias("__w")).select(*keep, F.transform("__w", lambda w: F.xxhash64(w)).alias("wh"))


def _grams(wh: str, k: int) -> Column:
    """Hashes of the k-word runs of ``wh``; none if it is shorter."""
    all_at = F.transform(wh, lambda w, i: F.xxhash64(w, *(F.get(F.col(wh), i + F.lit(j)) for j in range(1, k))))
    return F.slice(all_at, F.lit(1), F.greatest(F.size(wh) - F.lit(k - 1), F.lit(0)))


def _shingles(wh: str, k: int) -> Column:
    out = _grams(wh, k)
    for short in range(1, k):
        out = F.when(F.size(wh) == short, _grams(wh, short)).otherwise(out)
    return out


_SIMHASH = """aggregate(sequence(0, 63), 0L, (a, b) -> a | if(
    2 * size(filter({0}, w -> (shiftright(w, b) & 1L) = 1L)) > size({0}), shiftleft(1L, b), 0L))"""


def _blocks(fingerprint: str, radius: int) -> Column:
    n = radius + 1
    cut = [64 * i // n for i in range(n + 1)]
    return F.explode(
        F.array(*(
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, cut[i]).bitwiseAND(F.lit((1 << (cut[i + 1] - cut[i])) - 1)).alias("bits"))
            for i in range(n)
        ))
    )


def find_leaks(
    docs: DataFrame, items: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """``key, doc_id, item_id, start_word, n_words, similarity``: the best
    window of every (document, item) pair at or above ``similarity``."""
    if not 0 <= radius < 64:
        raise ValueError("radius must be within 0..63")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key().alias("key"))
    items = items.select("item_id", F.col("text").alias("text")).where(F.col("text").isNotNull()).distinct()
    it = _word_hashes(items, "item_id").where(F.size("wh") > 0).select("item_id", "wh", F.size("wh").alias("n"))
    it = materialize(it.select("item_id", "wh", "n", _shingles("wh", k).alias("sh")).withColumn("fp", F.expr(_SIMHASH.format("wh"))))
    grams = it.select("item_id", "n", F.posexplode("sh").alias("at", "gram"))
    few = grams.count() <= BROADCAST_ROWS
    side = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    sizes = sorted(r[0] for r in it.select(F.least("n", F.lit(k)).alias("n")).distinct().collect())  # k values at most

    # 1. item-sized windows at anchors
    words = _word_hashes(docs, "key", "doc_id")
    found = None
    for size in sizes:
        hits = words.select("key", F.size("wh").alias("len"), F.posexplode(_grams("wh", size)).alias("pos", "gram"))
        mine = grams.where(F.least("n", F.lit(k)) == size).select("gram", "n", "at").distinct()
        hits = hits.join(side(mine), "gram")
        start = F.greatest(F.least(F.col("pos") - F.col("at"), F.col("len") - F.col("n")), F.lit(0))
        hits = hits.select("key", start.alias("start"), "n")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = words.select("key", F.lit(0).alias("start"), F.lit(0).alias("n")).where(F.lit(False))
    found = found.groupBy("key", "start", "n").agg(F.count(F.lit(1)).alias("hits"))
    per_doc = materialize(found.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("windows")))
    n_windows = per_doc.agg(F.sum(F.size("windows"))).first()[0] or 0
    near = F.broadcast(per_doc) if n_windows <= BROADCAST_ROWS else per_doc
    text = docs.join(near, "key")
    windows = (
        _word_hashes(text, "key", "doc_id", "windows")
        .select("key", "doc_id", "wh", F.explode("windows").alias("w"))
        .select("key", "doc_id", F.col("w.start").alias("start"), F.col("w.n").alias("n"), F.expr("slice(wh, w.start + 1, w.n)").alias("ww"))
        .dropDuplicates(["key", "start", "n"])
    )
    # 2. fingerprints; 3. multi-index Hamming join
    windows = materialize(windows.withColumn("fp", F.expr(_SIMHASH.format("ww"))))
    left = windows.select("key", "start", "n", "fp", _blocks("fp", radius).alias("b")).select("key", "start", "n", "fp", "b.*")
    right = it.select("item_id", "n", F.col("fp").alias("item_fp"), _blocks("fp", radius).alias("b")).select("item_id", "n", "item_fp", "b.*")
    close = (
        left.join(side(right), ["n", "block", "bits"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        .select("key", "start", "n", "item_id").distinct()
    )
    # 4. weighted-shingle similarity
    pair = ["key", "start", "n", "item_id"]
    own = close.join(windows, ["key", "start", "n"]).select(*pair, "doc_id", _shingles("ww", k).alias("sh"))
    own = own.select(*pair, "doc_id", F.size("sh").alias("n_own"), F.explode("sh").alias("gram"))
    own = own.groupBy(*pair, "doc_id", "n_own", "gram").agg(F.count(F.lit(1)).alias("c"))
    theirs = grams.groupBy("item_id", "gram").agg(F.count(F.lit(1)).alias("d"))
    both = own.join(side(theirs), ["item_id", "gram"], "left").groupBy(*pair, "doc_id", "n_own")
    both = both.agg(F.sum(F.least("c", F.coalesce("d", F.lit(0)))).alias("same"))
    both = both.join(side(it.select("item_id", F.size("sh").alias("n_item"))), "item_id")
    alike = both.withColumn("similarity", F.col("same") / (F.col("n_own") + F.col("n_item") - F.col("same")))
    best = F.max(F.struct("similarity", -F.col("start"), "n")).alias("best")
    return (
        alike.where(F.col("similarity") >= similarity).groupBy("key", "doc_id", "item_id").agg(best)
        .select("key", "doc_id", "item_id", (-F.col("best.col2")).cast("long").alias("start_word"), F.col("best.n").cast("long").alias("n_words"), "best.similarity")
    )


def leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``find_leaks`` without the row key, repeated rows once."""
    return find_leaks(docs, items, **how).drop("key").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Rows of ``docs`` (all columns) that hold no item."""
    return drop_keyed(docs, find_leaks(docs, items, **how))
