"""Merkle manifest of a dataset, with an inclusion proof for every row.

Leaves are digests of the rows, in order within each partition of the dataset
(``lang``).  Every node carries the half-open interval of leaf ranks it covers.

1. Leaves: digests of whole rows, computed in the scan's stage and written once;
   from here on no text moves.  They are ranked within their tree by range
   (``range_rank``), so a tree of a third of all rows takes as many partitions
   as it fills.
2. Up, a band of levels at a time: nodes of one level meet by the ancestor
   ``levels`` above that contains their interval (its number is the interval's
   start divided by that level's width).  A group is at most ``arity ** levels``
   nodes.  In it every level is hashed, and a node's siblings are what the
   interval of its parent covers without its own.
3. Down, a band at a time: a node is attached to the ancestor that contains it,
   bucketed by tree, level and start, and its path is continued by that
   ancestor's path.  So a leaf carries no row for each of its ancestors: one
   join per band.
4. The roots of the trees, ordered by name, are the leaves of the top tree.

A single node at the end of a level becomes the digest of itself alone as long
as its level holds another node.  Nulls in any column are hashed as ``-``; rows
without a ``lang`` are a tree of their own, the first.  Rows without a doc_id
come first in their tree; rows that repeat a doc_id stay, ordered by digest (and
equal rows by place in the input, which changes no digest).  An empty table has
no rows and no root.  Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aletheia.llm.common import stored
from aletheia.operators.rank import range_rank

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
#: Levels hashed per shuffle: groups are of at most ARITY ** BAND nodes.
BAND = 5
#: Trees whose roots may be broadcast (some 2 KB each with their paths).
TREE_BROADCAST_ROWS = 20_000


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(fields=FIELDS, **changed: Column) -> Column:
    return F.sha2(F.concat(*(encoded(changed.get(f, F.col(f))) for f in fields)), 256)


def _step(parent: Column, own: Column, level: Column) -> Column:
    """Of one level of a path: the parent's interval, and the digests of the
    nodes that cover what its interval holds left and right of ``own``'s."""
    inside = F.filter(level, lambda x: (x["lo"] >= parent["lo"]) & (x["hi"] <= parent["hi"]))
    side = lambda keep: F.array_join(F.transform(F.filter(inside, keep), lambda x: x["digest"]), "")
    return F.struct(
        parent["lo"].alias("lo"), parent["hi"].alias("hi"),
        side(lambda x: x["hi"] <= own["lo"]).alias("left"), side(lambda x: x["lo"] >= own["hi"]).alias("right"),
    )


def _above(level: Column, arity: int) -> Column:
    """The next level: runs of ``arity`` consecutive nodes."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / arity).cast("int")), lambda i: F.slice(level, i * arity + 1, arity))
    return F.transform(
        runs,
        lambda run: F.struct(
            F.get(run, F.lit(0))["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"),
            F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), ""), 256).alias("digest"),
        ),
    )


def _band(nodes: DataFrame, below: int, arity: int, levels: int, carry: list[str]) -> DataFrame:
    """``nodes (tree, n, lo, hi, digest, carry...)`` of level ``below`` -> the
    same with ``up`` (number of the ancestor ``levels`` above that contains it),
    ``above`` (that ancestor) and ``path`` (the steps to it).  A tree that ends
    within the band ends with its root."""
    width = arity ** (below + levels)
    level = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest", *carry)))
    met = nodes.groupBy("tree", "n", F.expr(f"lo div {width}L").alias("up")).agg(level.alias("members"))
    # a level is hashed only if the one below it holds more than one node of the tree
    more = sum((F.when(F.col("n") > arity ** (below + k), 1).otherwise(0) for k in range(levels)), F.lit(0))
    bare = F.transform("members", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest")))
    tiers = F.aggregate(
        F.slice(F.sequence(F.lit(0), F.lit(levels)), F.lit(1), more),  # as many turns as levels to hash
        F.array(bare),
        lambda made, _: F.concat(made, F.array(_above(F.element_at(made, -1), arity))),
    )
    each = met.withColumn("tiers", tiers).select("tree", "n", "up", "tiers", F.explode("members").alias("own"))
    own = F.col("own")
    holder = lambda tier: F.get(F.filter(tier, lambda x: (x["lo"] <= own["lo"]) & (own["hi"] <= x["hi"])), F.lit(0))
    path = F.transform(
        F.slice("tiers", F.lit(2), F.size("tiers")),
        lambda tier, k: _step(holder(tier), holder(F.get("tiers", k)), F.get("tiers", k)),
    )
    return each.select("tree", "n", "up", "own.*", holder(F.element_at("tiers", -1)).alias("above"), path.alias("path"))


def climb(leaves: DataFrame, largest: int, arity: int = ARITY, levels: int = BAND, carry: list[str] | None = None) -> list[DataFrame]:
    """The written bands (``_band``) over ``leaves (tree, n, lo, hi, digest,
    carry...)`` of trees of at most ``largest`` leaves, lowest first."""
    nodes, below, bands, carry = leaves, 0, [], list(carry or [])
    while not bands or arity**below < largest:
        band = stored(_band(nodes, below, arity, levels, carry))
        bands.append(band)
        # one node of each group stands for the ancestor: the one that starts with it
        nodes = band.where(F.col("lo") == F.col("above.lo")).select("tree", "n", "above.*")
        below, carry = below + levels, []
    return bands


def roots(bands: list[DataFrame]) -> DataFrame:
    """``tree, root`` of climbed bands."""
    return bands[-1].where(F.col("lo") == 0).select("tree", F.col("above.digest").alias("root"))


def descend(bands: list[DataFrame], tops: DataFrame, arity: int = ARITY, levels: int = BAND) -> DataFrame:
    """The nodes of the lowest band with their paths up to the root of their tree and
    on along ``tops (tree, rest, ...)``, whose other columns every node gets."""
    extra = [c for c in tops.columns if c not in ("tree", "rest")]
    paths = bands[-1].join(tops, "tree").withColumn("path", F.concat("path", "rest")).drop("rest")
    for k in range(len(bands) - 1, 0, -1):
        # containment: the ancestor of this level that starts at up * width
        width = arity ** (k * levels)
        parents = paths.select("tree", F.expr(f"lo div {width}L").alias("up"), F.col("path").alias("rest"), *extra)
        paths = bands[k - 1].join(parents, ["tree", "up"]).withColumn("path", F.concat("path", "rest")).drop("rest")
    return paths.drop("up", "above")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def proof_text(path: Column) -> Column:
    """The siblings' digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(
    docs: DataFrame,
    partition: str = "lang",
    fields: tuple[str, ...] = FIELDS,
    altered: dict[str, Column] | None = None,
    arity: int = ARITY,
    levels: int = BAND,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, tree, lo, hi, leaf, altered, path,
    subroot, root``.  ``lo`` is the leaf's rank in its tree; ``path`` leads to the
    dataset's root.  ``altered`` is the digest of the row with some columns
    replaced, null where that changes nothing."""
    if arity < 2 or levels < 1:
        raise ValueError("arity >= 2 and levels >= 1")
    leaf = row_digest(fields)
    other = row_digest(fields, **altered) if altered else F.lit(None).cast("string")
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.concat(F.lit("="), F.col(partition).cast("string")), F.lit("-")).alias("tree"),  # null first
            leaf.alias("digest"), F.nullif(other, leaf).alias("altered"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    ranked = range_rank(rows, ["tree"], ["doc_id", "digest", "place"], "rank", "n")
    span = [(F.col("rank") - 1).alias("lo"), F.col("rank").alias("hi")]
    largest = ranked.agg(F.max("n")).first()[0] or 1  # one number
    bands = climb(ranked.select("tree", "n", *span, "digest", "doc_id", "altered"), largest, arity, levels, ["doc_id", "altered"])
    # the trees' roots are the leaves of one more tree
    subroots = range_rank(roots(bands), [], ["tree"], "rank", "n")
    over = subroots.select(F.lit("").alias("tree"), "n", *span, F.col("root").alias("digest"), F.col("tree").alias("name"))
    trees = over.count()
    bands_over = climb(over, max(trees, 1), arity, levels, ["name"])
    whole = roots(bands_over).withColumn("rest", F.expr("array()").cast("array<struct<lo:bigint,hi:bigint,left:string,right:string>>"))
    tops = descend(bands_over, whole, arity, levels).select(
        F.col("name").alias("tree"), F.col("path").alias("rest"), F.col("digest").alias("subroot"), "root"
    )
    tops = F.broadcast(tops) if trees <= TREE_BROADCAST_ROWS else tops
    return descend(bands, tops, arity, levels).select(
        "doc_id", "tree", "lo", "hi", F.col("digest").alias("leaf"), "altered", "path", "subroot", "root"
    )


def verify(proofs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: each
    row's (altered) digest folded along its path and held against the root."""
    out = proofs.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
        folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
