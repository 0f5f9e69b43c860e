"""Top-k search against brute force; oracle SQL; the pipeline end to end."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aletheia.llm import catalog, topk

SF = "/root/testdata/sf0.001"


def brute(rows, k=5):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = min(ok.get(i, v), v)
    w = {i: [math.floor(256 * x) for x in v] for i, v in ok.items()}
    out = []
    for q in (i for i in w if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(w[q], w[c])), c) for c in w if c != q and len(w[c]) == len(w[q]))[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("dims", [3, 40])
def test_top_k_equals_brute_force(spark, dims):
    import random

    rng = random.Random(dims)
    rows = [(i, [rng.choice([0.0, 0.5, rng.gauss(0, 1)]) for _ in range(dims)], 1) for i in range(300)]
    rows += [(300, None, 1), (301, [], 1), (350, [], 1), (302, [None] * dims, 1), (303, [float("nan")] * dims, 1), (304, [float("inf")] + [0.0] * (dims - 1), 1),
             (5, rows[5][1], 1), (None, rows[0][1], 1), (400, [1.0], 1), (401, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in topk.top_k_search(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute(rows)
    assert topk.top_k_search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalog.ORACLE[name])
    cols = sorted(want.columns)
    got = catalog.QUERIES[name](spark, SF).select(*cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.select(*cols).fetchall()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, seen = docs.count(), docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, seen, SF)
        assert after.schema.names == docs.schema.names
        after = after.checkpoint()
        gone = seen.join(after, "doc_id", "left_anti").count()
        assert gone == seen.count() - after.count()
        assert (gone == 0) == (name == "secret_scans")
        seen = after
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert packed.select("doc_id").distinct().count() == seen.count() < n
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
