import random

import pytest
from pyspark.sql import functions as F

from aletheia.operators import auc as A


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _data(n=600, groups=3, seed=3):
    rnd = random.Random(seed)
    return [(f"g{i % groups}", float(rnd.randint(0, 40)), rnd.randint(0, 1)) for i in range(n)]


def test_grouped_auc_matches_brute_force(spark):
    data = _data()
    df = spark.createDataFrame(data, "g string, score double, y int")
    got = {r.g: r.auc for r in A.grouped_auc(df, ["g"]).collect()}
    for g in {d[0] for d in data}:
        assert got[g] == pytest.approx(brute_auc([(s, y) for gg, s, y in data if gg == g]), abs=1e-12)
    glob = A.global_auc(df).first().auc
    assert glob == pytest.approx(brute_auc([(s, y) for _, s, y in data]), abs=1e-12)


@pytest.mark.parametrize("parts", [1, 2, 40])
def test_auc_does_not_depend_on_the_ranges(spark, parts):
    data = _data(3000, 2, seed=11)
    df = spark.createDataFrame(data, "g string, score double, y int").repartition(9)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: r.auc for r in A.grouped_auc(df, ["g"]).collect()}
        assert A.global_auc(df).first().auc == pytest.approx(brute_auc([(s, y) for _, s, y in data]), abs=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for g in got:
        assert got[g] == pytest.approx(brute_auc([(s, y) for gg, s, y in data if gg == g]), abs=1e-12)


def test_auc_of_null_groups_and_no_rows(spark):
    df = spark.createDataFrame([(None, 0.1, 0), (None, 0.2, 1), ("a", None, 1), ("a", 0.5, None)], "g string, score double, y int")
    assert [tuple(r) for r in A.grouped_auc(df, ["g"]).collect()] == [(None, 1, 1, 1.0)]
    assert A.grouped_auc(df.limit(0), ["g"]).count() == 0
    assert A.global_auc(df.limit(0)).first().auc is None


def test_auc_edge_cases(spark):
    one_class = spark.createDataFrame([("a", 0.1, 1), ("a", 0.2, 1)], "g string, score double, y int")
    assert A.grouped_auc(one_class, ["g"]).first().auc is None
    tied = spark.createDataFrame([("a", 0.3, 1), ("a", 0.3, 0), ("a", 0.3, 0)], "g string, score double, y int")
    assert A.grouped_auc(tied, ["g"]).first().auc == 0.5


def test_auc_monotone_invariance(spark):
    df = spark.createDataFrame(_data(400, 2, seed=5), "g string, score double, y int")
    a = {r.g: r.auc for r in A.grouped_auc(df, ["g"]).collect()}
    b = {r.g: r.auc for r in A.grouped_auc(df.withColumn("score", F.exp(F.col("score") / 10)), ["g"]).collect()}
    assert a == pytest.approx(b, abs=1e-12)
