"""Sharding by proportional stratified interleaving (DataFrame functions only).

1. Rows are shuffled by a seeded digest of ``doc_id`` and ranked within their
   source (``range_rank``: a source of a third of all rows takes as many
   partitions as it fills).
2. A row's fractional rank is ``(rank - 1/2) / rows of its source``.  In the
   order of fractional ranks (ties: source, rank) every source is spread evenly.
3. The order is cut into equal runs: shard sizes are at most one row apart (law
   ``rows``), and a shard holds of each source its share within 1 + share x
   number of sources rows (ranks are rounded once per source at either cut).

A null source is a source of its own.  Null texts count as empty: size 8,
checksum 0.  A null doc_id is shuffled as ``-``.  Rows that repeat a doc_id stay,
ordered by checksum, size and place in the input.  Equal texts in several rows
are rows like others (this law deals rows, not groups).  An empty table gives an
empty result.  Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aletheia.llm.common import stored
from aletheia.operators.rank import range_rank

SHARDS = 24
SEED = 13
#: Bytes of a row besides its text.
ROW_BYTES = 8


def shuffled(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, stratum: str = "source") -> DataFrame:
    """``doc_id, stratum, size, text_crc32, law, shard, slot, grown_shard`` for
    every row of ``docs``; ``slot`` is the place in the shard, from 0."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    # the texts are read once; from here on rows are some 60 bytes
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col(stratum).cast("string").alias("stratum"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.monotonically_increasing_id().alias("place"),
        )
    ).withColumn("shuffled", shuffled(seed))
    ranked = range_rank(rows, ["stratum"], ["shuffled", "doc_id", "text_crc32", "size", "place"], "rank", "of")
    fraction = (F.col("rank") - F.lit(0.5)) / F.col("of")
    mixed = ranked.drop("shuffled", "place").withColumn("fraction", fraction)
    mixed = range_rank(mixed, [], ["fraction", "stratum", "rank"], "rank_of_all", "n")
    # whole-number division: shard s begins at the least place p with p * shards >= s * n
    dealt = mixed.withColumn("shard", F.expr(f"(rank_of_all - 1) * {shards}L div n"))
    first = F.expr(f"(shard * n + {shards - 1}L) div {shards}L")
    return dealt.select(
        "doc_id", "stratum", "size", "text_crc32", F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), (F.col("rank_of_all") - 1 - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
