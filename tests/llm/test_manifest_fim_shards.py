"""Merkle manifest, fill-in-the-middle and sharding against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aletheia.llm import catalog, fim, manifest, shards

DOC = "doc_id long, text string, lang string, source string, n_chars long, tree string, lo int, path string, digest string, shard int, size int"
CLASH = ("t", 1, "p", "d", 9, 9)  # extra columns named like internal ones


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], DOC)


def documents(rng, n, langs=("en", "en", "en", "fr", "é", None)):
    texts = ["", None, "a\nb", "ünï\ncödé 😀\n", "x" * 50]
    return [(i, rng.choice(texts), rng.choice(langs), rng.choice(["s", None]), rng.choice([0, 7, None])) for i in range(n)]


# --- manifest --------------------------------------------------------------------


def leaf_of(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_of(leaves, arity):
    """(root, for each leaf its (digests to the left, to the right) by level)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + arity])) for k in range(0, len(levels[-1]), arity)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = i // arity * arity
            path.append(("".join(level[run:i]), "".join(level[i + 1 : run + arity])))
            i //= arity
        paths.append(path)
    return levels[-1][0], paths


def brute_manifest(rows, arity=2):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs, got = [], []
    for lang in langs:
        members = sorted(by[lang], key=lambda x: x[:3])
        root, paths = tree_of([m[2] for m in members], arity)
        subs.append(root)
        got.append((members, paths))
    root, tops = tree_of(subs, arity)
    out = []
    for (members, paths), top, sub in zip(got, tops, subs):
        for (_, _, leaf, r), path in zip(members, paths):
            whole = path + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            digest = leaf_of(*r[:4], r[4] + 1) if bad else leaf
            for left, right in whole:
                digest = sha(left + digest + right)
            out.append((r[0], leaf, sub, root, sha("".join(a + b for a, b in whole)), digest, digest == root))
    return out


def tampered():
    at = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return {"n_chars": F.when(at, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))}


@pytest.mark.parametrize("n,arity,levels", [(1, 2, 5), (2, 2, 5), (70, 2, 2), (230, 2, 5), (90, 3, 2), (40, 2, 1)])
def test_manifest_equals_brute_force(spark, n, arity, levels):
    rng = random.Random(n)
    rows = documents(rng, n)
    if n > 2:  # rows without an id, repeated ids, repeated rows
        rows += [(None, "a", "fr", "s", 1), (None, "b", "fr", "s", 1), (3, "other", rows[3][2], "s", 5), rows[5], rows[5]]
    df = frame(spark, rows).repartition(5)
    got = manifest.verify(manifest.manifest(df, altered=tampered(), arity=arity, levels=levels))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_manifest(rows, arity)))


def test_manifest_nodes_carry_intervals_of_their_parents(spark):
    rows = [(i, "t", "en", "s", 1) for i in range(11)]
    got = {r.lo: r for r in manifest.manifest(frame(spark, rows), levels=2).collect()}
    # 11 leaves of one language, then the top tree of one leaf adds no step
    assert [(s.lo, s.hi) for s in got[10].path] == [(10, 11), (8, 11), (8, 11), (0, 11)]
    assert [(s.lo, s.hi) for s in got[3].path] == [(2, 4), (0, 4), (0, 8), (0, 11)]
    assert got[10].path[0].left == got[10].path[0].right == "" and got[3].path[0].left == got[2].leaf


def test_manifest_of_nothing_of_nulls_and_of_a_long_text(spark):
    df = frame(spark, [(1, "x", "en", "s", 1)])
    assert manifest.verify(manifest.manifest(df.limit(0), altered=tampered())).count() == 0
    rows = [(None, None, None, None, None)] * 3 + [(7, "lång " * 400_000, None, None, 2**63 - 1)]
    got = manifest.verify(manifest.manifest(frame(spark, rows), altered=tampered())).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_manifest(rows)))
    with pytest.raises(ValueError):
        manifest.manifest(df, arity=1)


def test_altered_rows_are_told_from_the_rest(spark):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(60)]
    wrong = {"text": F.when(F.col("doc_id").isin(4, 41), F.lit("forged")).otherwise(F.col("text"))}
    got = manifest.verify(manifest.manifest(frame(spark, rows), altered=wrong)).collect()
    assert {r.doc_id for r in got if not r.verified} == {4, 41}


# --- fill in the middle ------------------------------------------------------------


def brute_fim(doc_id, text, unit="line", rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    h = [int(sha(f"7:{doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = ["", None, "\n", "\n\n", "one line", "one line\n", "é", "😀\n漢字ü\n", "a<P", "x <M> y", "<S>", "<<P\n>M<", "tab\t\r\nend", "\x00\n\x00", "ﬁ́‍\n"]


@pytest.mark.parametrize("unit,rate,spm", [("line", 100, 50), ("char", 100, 50), ("line", 60, 0), ("char", 0, 50), ("line", 100, 100)])
def test_fim_equals_brute_force(spark, unit, rate, spm):
    rng = random.Random(rate + spm)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a row\nwithout an id\n"), (2, "\n"), (2, "\n")]
    rows += [(100 + i, "".join(rng.choice(["a", "b", "\n", "é", "漢", "😀", "<", "P", ">"]) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows.append((-9, "ein langer Text über zwei Blöcke 漢字\n" * 40_000))
    df = frame(spark, [(i, t, "en", "s", 1) for i, t in rows]).repartition(3)
    fmt = fim.FimFormat(unit=unit, rate=rate, spm=spm)
    want = sorted(map(str, (brute_fim(i, t, unit, rate, spm) for i, t in rows)))
    got = fim.restore(fim.fill_in_middle(df, fmt), fmt).collect()
    assert sorted(str(tuple(r)[:-1]) for r in got) == want
    assert sorted(map(str, ((r.doc_id, r.restored) for r in got))) == sorted(map(str, ((i, t or "") for i, t in rows)))


def test_fim_marks_and_empty_table(spark):
    fmt = fim.FimFormat(prefix="[pre]", suffix="[suf]", middle="[mid]", unit="char")
    df = frame(spark, [(i, "[pr" * i + "\\E [ü]", "en", "s", 1) for i in range(1, 9)])
    got = fim.restore(fim.fill_in_middle(df, fmt), fmt).collect()
    assert all(r.restored == "[pr" * r.doc_id + "\\E [ü]" and r.output.startswith(("[pre]", "[suf]")) for r in got)
    assert fim.digests(df.limit(0)).count() == 0
    for bad in ({"prefix": ""}, {"prefix": "aba"}, {"prefix": "<S>"}, {"prefix": "><"}, {"unit": "word"}):
        with pytest.raises(ValueError):
            fim.FimFormat(**bad)


def test_sparse_index_both_ways():
    text = "aé漢😀 plain ascii words 😀é"
    buf = np.frombuffer(text.encode(), np.uint8)
    index = fim.SparseIndex(buf)
    at = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert len(index.at) == 5 and (index.chars(at) == np.arange(len(text) + 1)).all() and (index.bytes(np.arange(len(text) + 1)) == at).all()
    plain = fim.SparseIndex(np.frombuffer(b"ascii", np.uint8))
    assert len(plain.at) == 0 and plain.chars(np.array([0, 5])).tolist() == [0, 5]


# --- sharding ----------------------------------------------------------------------


def check_shards(rows, got, k):
    n = len(rows)
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    by = {}
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < k
        by.setdefault(r.shard, []).append(r)
    sizes = [len(by.get(s, [])) for s in range(k)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    share = {}
    for r in got:
        share[r.stratum] = share.get(r.stratum, 0) + 1
    for s, part in by.items():
        for name, m in share.items():
            have = sum(r.stratum == name for r in part)
            assert abs(have - m * len(part) / n) <= 1 + m / n * len(share)


@pytest.mark.parametrize("n,k", [(2000, 24), (25, 24), (7, 24), (100, 1)])
def test_shards_match_the_mixture(spark, n, k):
    rng = random.Random(n)
    rows = [(i, rng.choice(TEXTS), "en", rng.choice(["hot"] * 6 + ["b", "c", None, "ü"]), 1) for i in range(n)]
    rows[-1] = (rows[0][0], "again", "en", "b", 1)  # a repeated id
    rows += [(None, "x", "en", "c", 1)] * 3
    df = frame(spark, rows)
    got = shards.shard(df.repartition(6), k).collect()
    check_shards(rows, got, k)
    again = shards.shard(df.repartition(2), k).collect()  # the same whatever the partitions
    assert sorted(map(str, got)) == sorted(map(str, again))
    other = shards.shard(df, k, seed=14).collect()
    assert k == 1 or sorted(map(str, got)) != sorted(map(str, other))


def test_shards_of_no_rows_are_native_and_checked(spark):
    df = frame(spark, [(1, "x", "en", "s", 1)])
    assert shards.shard(df.limit(0)).count() == 0
    out = shards.shard(df)
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
    with pytest.raises(ValueError):
        shards.shard(df, 0)


def test_queries_cover_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = catalog.QUERIES["op11_merkle_dataset_manifest"](spark, sf).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_manifest(docs)))
    assert {r.verified for r in got} == {True, False}
    check_shards(docs, catalog.QUERIES["op13_sharding"](spark, sf).collect(), 24)
