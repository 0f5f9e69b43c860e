"""N-gram Jaccard join with count-vector R-trees.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets
of distinct k-word shingles; the result is the components of all links.

1. Features: a document's set is hashed into ``GROUPS`` groups and the counts
   per group are its point.  The overlap of two sets is at most the sum of the
   smaller counts, coordinate by coordinate.
2. Equal sets are one class (grouped by a 128-bit digest), so copies never
   meet again.
3. Cells: under any fixed order of the shingles two linked sets share one of
   their first ``n - ceil(n * percent / 100) + 1``.  The order puts shingles of
   many documents last, so a passage that a third of all documents hold brings
   nobody together.  Documents with a common first shingle are a cell; cells of
   the same members are one.
4. In a cell an R-tree over the points (packed by size, then counts) joins with
   itself: pairs of boxes whose summed coordinate minima cannot reach the
   overlap their sizes ask for are left out with everything below them.
5. Rounds: each document with its best bounded partner in another component
   (in the first round also with the least document of each of its cells),
   verified on the exact sets, until a round adds no link; then every other pair
   that passes the bound and still lies in different components.  Boxes that hold
   one and the same component are left out too.  So a group of near copies costs
   a few verifications a member, and no component is split.  Links within a
   component already joined are not verified, so not every link is counted.

Words are runs of other than white space, A-Z lower-cased.  A text of fewer
than k words has its whole sequence as its one shingle; null, empty and blank
texts have no set and link with nothing.  Rows that repeat a doc_id are one
document (the largest set stands; other rows' sets are classes of their own); null ids get a null
component.  Texts are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aletheia.llm.common import LOWER, NOT_SPACE, U64, _BASE, blocks, find_words, hash_words, id_text, materialize, mix, shingles, stored, text_buffer, tidy
from aletheia.llm.components import components

SHINGLE, PERCENT = 5, 80
GROUPS = 64
#: Groups of the finer count vectors (a byte each) of documents that have a
#: candidate; a document with 255 or more in one group goes without.
FINE_GROUPS = 1024
#: Shingles that so many rows hold are ordered by their number of rows, behind the others.
FREQUENT = 3
#: Frequent shingles that may be broadcast (9 bytes each), the most frequent first.
FREQUENT_MOST = 2_000_000
#: Shingles that a task counts at once.
TALLY_ROWS = 1 << 18
LEAF = 32
ID_BROADCAST_ROWS = 2_000_000

BUCKETS_PER_PARTITION = 4
POSTING = np.dtype([("token", "<u8"), ("doc", "<i8")])
TALLY = np.dtype([("name", "<u4"), ("n", "<u2")])

SETS = "doc_id long, n long, d1 long, d2 long, counts binary, fine binary, first array<long>"


def doc_sets(col: pa.Array, k: int):
    """For runs of whole texts: (first text, texts, set members, their texts),
    members sorted within a text and distinct."""
    buf, offs = text_buffer(col)
    for i, j in blocks(offs):
        b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        s, e, d = find_words(b, o, NOT_SPACE)
        h, d = shingles(hash_words(LOWER[b], s, e), d, j - i, k)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        yield i, j - i, h[new], d[new]


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets whose sizes sum to ``n``."""
    return -(-n * percent // (100 + percent))


def shingle_keys(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit name of shingles; the names of two may meet, which
    moves both in the order alone."""
    return (h % U64(n_buckets)).astype(np.int64), (h >> U64(32)).astype(np.uint32)


def count_level(n: np.ndarray) -> np.ndarray:
    """Counts as levels of a byte, exact up to 16, then four to a doubling."""
    n = np.maximum(n, 1)
    return np.where(n <= 16, n, 16 + np.floor(4 * np.log2(n / 16))).astype(np.uint8)


def frequent_shingles(text: DataFrame, k: int, n_buckets: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (bucket << 32 | name, sorted) and levels of the shingles that
    ``FREQUENT`` or more rows hold: all, or the most frequent levels that make
    up ``FREQUENT_MOST`` at most.  Every shingle of every row is counted; which
    are returned changes the order, not the result."""

    def deal(batches):
        def packed(held):
            bucket, name = shingle_keys(np.concatenate(held), n_buckets)
            key, n = np.unique(bucket.astype(U64) << U64(32) | name, return_counts=True)
            r = np.empty(len(key), TALLY)
            r["name"], r["n"] = key & U64(0xFFFFFFFF), np.minimum(n, 65535)
            cut = np.searchsorted(key, np.arange(n_buckets + 1, dtype=U64) << U64(32))
            keep = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays(
                [pa.array(keep.astype(np.int32)), pa.array([r[cut[b] : cut[b + 1]].tobytes() for b in keep], pa.binary())], names=["bucket", "tally"]
            )

        held, size = [], 0
        for batch in batches:
            for _, _, h, _ in doc_sets(batch.column(1), k):
                held.append(h)
                size += len(h)
                if size >= TALLY_ROWS:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def add(batches):
        def levels(bucket, held):
            r = np.frombuffer(b"".join(held), TALLY)
            r = r[np.argsort(r["name"], kind="stable")]
            at = np.flatnonzero(np.concatenate(([True], r["name"][1:] != r["name"][:-1])))
            n = np.add.reduceat(r["n"].astype(np.int64), at)
            some = n >= FREQUENT
            key, level = U64(bucket) << U64(32) | r["name"][at][some].astype(U64), count_level(n[some])
            each = np.unique(level)
            blobs = [key[level == x].tobytes() for x in each]
            return pa.RecordBatch.from_arrays([pa.array(each.astype(np.int32)), pa.array([len(x) // 8 for x in blobs], pa.int64()), pa.array(blobs, pa.binary())], names=["level", "n", "keys"])

        at, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != at and held:
                    yield levels(at, held)
                    held = []
                at = bucket
                held.append(blob)
        if held:
            yield levels(at, held)

    tallies = text.mapInArrow(tidy(deal), "bucket int, tally binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = stored(tallies.mapInArrow(tidy(add), "level int, n long, keys binary"))
    least, total = 256, 0
    for level, n in sorted(((r.level, r.n) for r in found.groupBy("level").agg(F.sum("n").alias("n")).collect()), reverse=True):
        total += n
        if total > FREQUENT_MOST:
            break
        least = level
    rows = found.where(F.col("level") >= least).select("level", "keys").collect()
    key = np.concatenate([np.zeros(0, U64), *(np.frombuffer(r["keys"], U64) for r in rows)])
    level = np.concatenate([np.zeros(0, np.uint8), *(np.full(len(r["keys"]) // 8, r.level, np.uint8) for r in rows)])
    order = np.argsort(key)
    return key[order], level[order]


def level_lookup(keys: np.ndarray, levels: np.ndarray, n_buckets: int):
    """A function from shingles to their levels, 0 for those not frequent."""
    size = U64(1 << min(24, max(10, (8 * len(keys)).bit_length())))
    there = np.zeros(int(size), bool)  # most shingles are not frequent and need no search
    there[(mix(keys) % size).astype(np.int64)] = True

    def look(h):
        out = np.zeros(len(h), np.uint8)
        bucket, name = shingle_keys(h, n_buckets)
        key = bucket.astype(U64) << U64(32) | name
        some = np.flatnonzero(there[(mix(key) % size).astype(np.int64)])
        if len(some):
            key = key[some]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out[some] = np.where(keys[at] == key, levels[at], 0)
        return out

    return look


def features(text: DataFrame, k: int, percent: int, keys: np.ndarray, levels: np.ndarray, n_buckets: int) -> DataFrame:
    shared = text.sparkSession.sparkContext.broadcast((keys, levels))

    def build(batches):
        look = level_lookup(*shared.value, n_buckets)
        for batch in batches:
            for i, m, h, d in doc_sets(batch.column(1), k):
                n = np.bincount(d, minlength=m)
                counts = np.bincount(d * GROUPS + (mix(h) % U64(GROUPS)).astype(np.int64), minlength=m * GROUPS).astype(np.uint32).reshape(m, GROUPS)
                fine = np.bincount(d * FINE_GROUPS + (mix(h ^ U64(GROUPS)) % U64(FINE_GROUPS)).astype(np.int64), minlength=m * FINE_GROUPS)
                fine = np.minimum(fine, 255).astype(np.uint8).reshape(m, FINE_GROUPS)
                begin = np.concatenate(([0], np.cumsum(n)))
                total = lambda x: np.diff(np.concatenate((np.zeros(1, U64), np.cumsum(x, dtype=U64)))[begin])
                d1 = mix(total(mix(h ^ _BASE)) + n.astype(U64)).view(np.int64)
                d2 = mix(total(mix(h * _BASE + U64(7))) + n.astype(U64)).view(np.int64)
                # members are sorted within a text: stable, and least levels first
                order = np.argsort(d * 256 + look(h), kind="stable")
                take = n - -(-n * percent // 100) + 1
                rank = np.arange(len(h)) - begin[d]
                first = h[order][rank < take[d]]  # order keeps texts together
                ends = np.concatenate(([0], np.cumsum(np.minimum(take, n) * (n > 0))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, m), pa.array(n.astype(np.int64)), pa.array(d1), pa.array(d2),
                        pa.array([c.tobytes() for c in counts], pa.binary()),
                        pa.array([c.tobytes() if c.max() < 255 else b"" for c in fine], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(first.view(np.int64))),
                    ],
                    names=[x.split()[0] for x in SETS.split(", ")],
                )

    return text.mapInArrow(tidy(build), SETS)


# --- cells ---------------------------------------------------------------------


def _boxes(n, c, root):
    """Levels of an R-tree over points in their order, the points first: (least
    n, largest n, largest counts, least root, largest root)."""
    levels = [(n, n, c, root, root)]
    while len(levels) == 1 or len(levels[-1][0]) > LEAF:
        lo, hi, top, first, last = levels[-1]
        cut = np.arange(0, len(lo), LEAF)
        least, most = np.minimum.reduceat, np.maximum.reduceat
        levels.append((least(lo, cut), most(hi, cut), most(top, cut, axis=0), least(first, cut), most(last, cut)))
    return levels


def _may(boxes, x, y, percent):
    """Which pairs of boxes (or points) may hold a link between two components."""
    lo, hi, top, first, last = boxes
    ok = (100 * hi[y] >= percent * lo[x]) & (100 * hi[x] >= percent * lo[y])
    ok &= (first[x] != last[x]) | (first[y] != last[y]) | (first[x] != first[y])
    at = np.flatnonzero(ok)
    x, y = x[at], y[at]
    bound = np.minimum(top[x], top[y]).sum(axis=1, dtype=np.int64)
    ok[at] = bound >= need(lo[x] + lo[y], percent)
    return ok


def _fine_may(x, y, n, fine, known, percent):
    """The same bound on the finer counts, where both have them."""
    ok = np.ones(len(x), bool)
    for b in range(0, len(x), 4096):
        p, q = x[b : b + 4096], y[b : b + 4096]
        bound = np.minimum(fine[p], fine[q]).sum(axis=1, dtype=np.int64)
        ok[b : b + 4096] = ~(known[p] & known[q]) | (bound >= need(n[p] + n[q], percent))
    return ok


def cell_pairs(n: np.ndarray, c: np.ndarray, percent: int, root: np.ndarray | None = None):
    """Index pairs of a cell that pass the bound, of different roots if there
    are such, in bounded pieces."""
    root = np.arange(len(n)) if root is None else root
    _, at, size = np.unique(root, return_inverse=True, return_counts=True)
    large = np.where(size[at] >= LEAF, at, -1)  # members of a large component share boxes
    order = np.lexsort((*(c[:, g] for g in range(min(4, c.shape[1]))), n, large))
    levels = _boxes(n[order], c[order], root[order])

    def below(level, a, b):
        """Pairs of children of boxes (a, b) one level down."""
        size = len(levels[level - 1][0])
        ia = a[:, None] * LEAF + np.arange(LEAF)
        ib = b[:, None] * LEAF + np.arange(LEAF)
        x, y = np.broadcast_arrays(ia[:, :, None], ib[:, None, :])
        ok = (x < size) & (y < size) & (x <= y)
        return x[ok], y[ok]

    def walk(level, a, b):
        for k in range(0, len(a), 16):  # 16 * LEAF^2 pairs at once
            x, y = below(level, a[k : k + 16], b[k : k + 16])
            ok = _may(levels[level - 1], x, y, percent)
            if not ok.any():
                continue
            if level == 1:
                yield order[x[ok]], order[y[ok]]
            else:
                yield from walk(level - 1, x[ok], y[ok])

    a, b = np.triu_indices(len(levels[-1][0]))
    ok = _may(levels[-1], a, b, percent)
    yield from walk(len(levels) - 1, a[ok], b[ok])


def _cells(batches):
    """Cells (rows sorted by cell) one after another: cell, doc, n, counts, root
    and, if there is such a column, fine counts and which rows have them."""
    held = []

    def cut(table):
        cell = table.column("cell").to_numpy()
        ends = np.concatenate((np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]))
        n = table.column("n").to_numpy()
        doc, root = table.column("doc_id").to_numpy(), table.column("root").to_numpy()
        c = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32).reshape(len(cell), GROUPS)
        fine = known = None
        if "fine" in table.column_names:
            raw = table.column("fine").to_pylist()
            known = np.array([len(x) > 0 for x in raw])
            fine = np.frombuffer(b"".join(x or bytes(FINE_GROUPS) for x in raw), np.uint8).reshape(len(cell), FINE_GROUPS)
        b = 0
        for e in ends:
            yield cell[b], doc[b:e], n[b:e], c[b:e], root[b:e], None if fine is None else (fine[b:e], known[b:e])
            b = e

    for batch in batches:
        held.append(batch)
        whole = pa.Table.from_batches(held).combine_chunks()
        cell = whole.column("cell").to_numpy()
        last = int(np.searchsorted(cell, cell[-1], "left")) if len(cell) else 0
        if last:
            yield from cut(whole.slice(0, last))
            held = whole.slice(last).to_batches()
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        if whole.num_rows:
            yield from cut(whole)


def candidates(cells: DataFrame, percent: int, every: bool, stars: bool = False) -> DataFrame:
    """Pairs ``(a, b)`` of different components that pass the bound, with their
    cell: all of them, or only each member's best partner; with ``stars`` also
    each member with the least document of its cell (``star``, else null)."""

    def rows(found, star):
        a, b, score, cell = (np.concatenate(x) for x in zip(*found))
        centre = pa.array(b) if star else pa.nulls(len(b), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(a), pa.array(b), pa.array(score), centre], names=["cell", "a", "b", "score", "star"])

    def search(batches):
        found, held, near, n_near = [], 0, [], 0
        for cell, doc, n, c, root, fine in _cells(batches):
            best, partner = np.full(len(doc), -1.0), np.zeros(len(doc), np.int64)
            if stars:
                x, y = np.arange(len(doc)), np.full(len(doc), np.argmin(doc))
                ok = _may((n, n, c, root, root), x, y, percent)
                if ok.any():
                    near.append((doc[x[ok]], doc[y[ok]], np.zeros(ok.sum()), np.full(ok.sum(), cell)))
                    n_near += ok.sum()
                if n_near > 20_000:
                    yield rows(near, True)
                    near, n_near = [], 0
            for x, y in cell_pairs(n, c, percent, root):
                if fine is not None:
                    ok = _fine_may(x, y, n, *fine, percent)
                    x, y = x[ok], y[ok]
                score = np.minimum(c[x], c[y]).sum(axis=1) / (n[x] + n[y])
                if every:
                    found.append((np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y]), score, np.full(len(x), cell)))
                    held += len(x)
                else:
                    for p, q in ((x, y), (y, x)):
                        o = np.lexsort((-doc[q], score))  # the best is written last
                        p, q, v = p[o], q[o], score[o]
                        up = (v > best[p]) | ((v == best[p]) & (doc[q] < doc[partner[p]]))
                        best[p[up]], partner[p[up]] = v[up], q[up]
                if held > 100_000:
                    yield rows(found, False)
                    found, held = [], 0
            has = np.flatnonzero(best >= 0)
            if len(has):
                found.append((doc[has], doc[partner[has]], best[has], np.full(len(has), cell)))
                held += len(has)
        if held:
            yield rows(found, False)
        if n_near:
            yield rows(near, True)

    return cells.mapInArrow(tidy(search), "cell long, a long, b long, score double, star long")


def best_pairs(found: DataFrame, every: bool) -> DataFrame:
    """Distinct ``(a, b)``, a < b, of the candidates: all, or each member's best
    over all its cells and its stars."""
    if not every:
        found = found.groupBy("a", "star").agg(F.max(F.struct("score", -F.col("b"))).alias("s")).select("a", (-F.col("s.col2")).alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# --- verification ----------------------------------------------------------------


def verified(pairs: DataFrame, text: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs`` that link, on the exact sets of their texts: ``(u, v)``."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    side = F.broadcast(ids) if ids.count() <= ID_BROADCAST_ROWS else ids
    own = text.join(side, "doc_id", "left_semi")
    both = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def members(col):
        for _, m, h, d in doc_sets(col, k):
            cut = np.searchsorted(d, np.arange(m + 1))
            yield from (h[cut[i] : cut[i + 1]] for i in range(m))

    def test(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep = []
                for x, y in zip(members(part.column(2)), members(part.column(3))):
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * same >= percent * (len(x) + len(y) - same))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["u", "v"])

    return both.mapInArrow(tidy(test), "u long, v long").distinct()


def shared_cells(reps: DataFrame, n_buckets: int, parts: int) -> DataFrame:
    """``(cell, doc_id)``: the documents that share a first shingle, once for
    each set of members (``cell`` names the set).  Postings move packed."""

    def deal(batches):
        for batch in batches:
            first = batch.column(1)
            token = first.values.to_numpy()[first.offsets[0].as_py() : first.offsets[-1].as_py()].view(U64)
            r = np.empty(len(token), POSTING)
            r["token"] = token
            r["doc"] = np.repeat(batch.column(0).to_numpy(), np.diff(first.offsets.to_numpy()))
            bucket = (r["token"] % U64(n_buckets)).astype(np.int64)
            o = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[o], np.arange(n_buckets + 1))
            r = r[o]
            keep = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keep.astype(np.int32)), pa.array([r[cut[b] : cut[b + 1]].tobytes() for b in keep], pa.binary())], names=["bucket", "postings"]
            )

    def meet(batches):
        def cells(held):
            r = np.frombuffer(b"".join(held), POSTING)
            r = r[np.lexsort((r["doc"], r["token"]))]
            new = np.concatenate(([True], r["token"][1:] != r["token"][:-1]))
            at = np.flatnonzero(new)
            size = np.diff(np.concatenate((at, [len(r)])))
            name = mix(np.add.reduceat(mix(r["doc"].astype(U64) + _BASE), at) + size.astype(U64))
            some = np.flatnonzero(size > 1)
            some = some[np.unique(name[some], return_index=True)[1]]  # each member set once
            rows = np.repeat(at[some], size[some]) + np.arange(size[some].sum()) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
            cell = np.repeat(name[some], size[some]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(r["doc"][rows])], names=["cell", "doc_id"])

        at, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != at and held:
                    yield cells(held)
                    held = []
                at = bucket
                held.append(blob)
        if held:
            yield cells(held)

    packed = reps.select("doc_id", "first").mapInArrow(tidy(deal), "bucket int, postings binary")
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(meet), "cell long, doc_id long").distinct()


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links_verified`` for every row of ``docs``;
    ``n_links_verified`` counts the links found (a component's links suffice to join it,
    so pairs known to be together are not tried again)."""
    if k < 1 or not 0 < percent <= 100:
        raise ValueError("k >= 1 and 0 < percent <= 100")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = id_text(docs)
    known = text.where(F.col("doc_id").isNotNull())
    n_buckets = BUCKETS_PER_PARTITION * parts + 1
    every = stored(features(text, k, percent, *frequent_shingles(known, k, n_buckets, parts), n_buckets))
    # one row per document, one document per class
    one = every.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    own = one.groupBy("doc_id").agg(F.max(F.struct("n", "d1", "d2")).alias("s")).select("doc_id", "s.*")
    classes = materialize(own.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    copies = own.join(classes.where("copies > 1"), ["n", "d1", "d2"]).where(F.col("doc_id") != F.col("rep")).select("doc_id")
    copies = materialize(copies)
    side = F.broadcast(copies) if copies.count() <= ID_BROADCAST_ROWS else copies
    reps = one.join(side, "doc_id", "left_anti")
    cells = shared_cells(reps, n_buckets, parts)
    one_row = lambda df, *cols: df.groupBy("doc_id").agg(F.max(F.struct("n", "d1", "d2", *cols)).alias("s")).select("doc_id", "s.n", *(f"s.{x}" for x in cols))
    cells = stored(cells.join(one_row(reps, "counts"), "doc_id").select("cell", "doc_id", "n", "counts"))
    sort = lambda df: df.repartition(parts, "cell").sortWithinPartitions("cell")
    found = stored(candidates(sort(cells.withColumn("root", F.col("doc_id"))), percent, False, True))
    tried = stored(best_pairs(found, False))
    links = materialize(verified(tried, known, k, percent))
    # from here on only documents with any candidate, under the finer bound as well
    active = materialize(tried.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    near = F.broadcast(active) if active.count() <= ID_BROADCAST_ROWS else active
    points = stored(one_row(reps.join(near, "doc_id", "left_semi"), "counts", "fine"))
    # best partners in other components until they add no link, then all pairs
    # of different components that are left; a member without a candidate in a
    # cell has none there later either, since components only grow
    every_pair = False
    roots = components(links)
    while True:
        cells = found.where("star is null").select("cell", F.col("a").alias("doc_id"))
        at = cells.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        mixed = at.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cell")
        at = at.join(mixed, "cell").join(points, "doc_id").select("cell", "doc_id", "n", "counts", "root", "fine")
        pairs = stored(candidates(sort(at), percent, every_pair))
        if pairs.isEmpty():
            break
        fresh = stored(best_pairs(pairs, every_pair).join(tried, ["a", "b"], "left_anti"))
        more = materialize(verified(fresh, known, k, percent))
        new = more.count()
        links = links.unionByName(more)
        tried = tried.unionByName(fresh)
        if new:
            roots = components(roots.toDF("u", "v").unionByName(more))
        if every_pair:
            break
        found, every_pair = pairs, not new
    degree = links.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links_verified"))
    tree = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    tree = tree.select("n", "d1", "d2", F.coalesce("root", "rep").alias("component_id"), "n_links_verified")
    out = every.select("doc_id", "n", "d1", "d2").join(tree, ["n", "d1", "d2"], "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))).alias("component_id"),
        F.coalesce("n_links_verified", F.lit(0)).alias("n_links_verified"),
    )


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` whose document is the least of its component (rows
    without a doc_id all stay)."""
    roots = jaccard_components(docs, k, percent)
    gone = materialize(roots.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct())
    small = F.broadcast(gone) if gone.count() <= ID_BROADCAST_ROWS else gone
    return docs.join(small, docs["doc_id"].cast("long") == small["__gone"], "left_anti")
