import hashlib

import pytest

from tests.conftest import SF_SMALL
from pyspark.sql import functions as F

from aletheia.operators import prep
from aletheia.operators.rank import in_range_order, range_rank, rank_in_hash_order
from aletheia.operators.split import split_prefix, split_stratified, stratified_allocation


def test_dedup_first_keeps_smallest_id(spark):
    rows = [(5, "q", "a", "s5"), (2, "q", "a", "s2"), (9, "q", "a", "s9"), (3, None, None, "n3"), (1, None, None, "n1")]
    df = spark.createDataFrame(rows, "row_id long, Question string, Answer string, source string").repartition(3)
    got = sorted((r.row_id, r.source) for r in prep.dedup_first(df).collect())
    assert got == [(1, "n1"), (2, "s2")]  # NULL keys are equal to each other


def test_dedup_first_keeps_wide_columns_and_sorts_no_text(spark):
    df = spark.createDataFrame([(2, "q", "a", [2.0]), (1, "q", "a", [1.0]), (3, "q", None, [3.0]), (4, None, "q", [4.0]), (5, "q", None, [5.0])], "row_id long, Question string, Answer string, x array<double>")
    got = prep.dedup_first(df)
    assert sorted((r.row_id, r.x[0]) for r in got.collect()) == [(1, 1.0), (3, 3.0), (4, 4.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    sorts = [line for line in plan.split("\n") if "Sort [" in line]
    assert not any("Question" in line.split("Sort [")[1].split("]")[0] for line in sorts)


def test_keys_that_share_a_digest_are_told(spark, monkeypatch):
    honest = prep.key_digest
    monkeypatch.setattr(prep, "key_digest", lambda subset: [F.lit(1).cast("bigint"), F.lit(2).cast("bigint"), honest(subset)[2]])
    df = spark.createDataFrame([(1, "q", "a"), (2, "other", "a")], "row_id long, Question string, Answer string")
    with pytest.raises(Exception, match="share a digest"):
        prep.dedup_first(df).collect()


def test_sample_by_group_caps_and_keeps(spark):
    data = [(i, "big" if i < 100 else "small", "L") for i in range(110)] + [(200, None, "L")]
    df = spark.createDataFrame(data, "row_id long, source string, label string")
    out = prep.sample_by_group(df, ["source", "label"], 30, seed=0)
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert counts == {"big": 30, "small": 10}
    again = prep.sample_by_group(df.repartition(7), ["source", "label"], 30, seed=0)
    assert sorted(r.row_id for r in out.collect()) == sorted(r.row_id for r in again.collect())


def test_rank_is_exact_and_partition_invariant(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"))
    a = rank_in_hash_order(df, ["g"], seed=7).collect()
    b = rank_in_hash_order(df.repartition(13), ["g"], seed=7).collect()
    ra = {r.row_id: r.rn for r in a}
    assert ra == {r.row_id: r.rn for r in b}
    for g in range(3):
        ranks = sorted(r.rn for r in a if r.g == g)
        assert ranks == list(range(1, len(ranks) + 1))


def test_split_prefix_complete_disjoint(spark):
    data = [(i, f"s{i % 3}", "True" if i % 2 else "False") for i in range(101)] + [(500, "solo", "True")]
    df = spark.createDataFrame(data, "row_id long, source string, label string")
    out = split_prefix(df, ["source", "label"], seed=1).collect()
    assert len(out) == len(data) and len({r.row_id for r in out}) == len(data)
    assert [r.part for r in out if r.source == "solo"] == ["test"]  # n=1: int(0.8) = 0 train rows
    by = {}
    for r in out:
        by.setdefault((r.source, r.label), []).append(r.part)
    for parts in by.values():
        assert parts.count("train") == int(len(parts) * 0.8)


def test_stratified_allocation_rules(spark):
    def alloc(n0, n1):
        rows = [(i, "s", 0) for i in range(n0)] + [(1000 + i, "s", 1) for i in range(n1)]
        df = spark.createDataFrame(rows, "row_id long, source string, y int")
        a = {r.y: (r.n_fit, r.status) for r in stratified_allocation(df).collect()}
        return a[0][0], a[1][0], a[0][1]

    assert alloc(44, 13) == (35, 10, "ok")
    assert alloc(5, 5) == (4, 4, "ok")
    assert alloc(4, 3) == (3, 2, "ok")
    assert alloc(5, 1)[2] == "too_few"


def test_split_stratified_parts(spark):
    rows = [(i, "s", int(i % 4 == 0)) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id long, source string, y int")
    out = split_stratified(df, seed=42).collect()
    fit = [r for r in out if r.part == "fit"]
    assert len(out) == 50 and len(fit) == 50 - 10
    assert sum(r.y for r in fit) == 10  # 13 positives: 40*13/50 = 10.4 -> 10


def test_hot_group_is_dealt_over_ranges(spark):
    # one group holds ~90% of the rows: ranks stay exact, it takes several
    # partitions, and no window runs over its rows
    df = spark.range(20000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = in_range_order(df, ["g", "row_id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in placed.where("g = 'hot'").groupBy("__part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 6000
    r = rank_in_hash_order(df, ["g"], seed=3, limit=None)
    hot = sorted((x.rn, hashlib.md5(f"3|{x.row_id}".encode()).hexdigest()) for x in r.where("g = 'hot'").collect())
    assert [x[0] for x in hot] == list(range(1, 18001)) and [x[1] for x in hot] == sorted(x[1] for x in hot)
    assert "Window" not in r._jdf.queryExecution().executedPlan().toString()
    top = prep.sample_by_group(df.withColumn("label", F.lit("x")), ["g", "label"], 100, seed=3)
    assert {x.g: x["count"] for x in top.groupBy("g").count().collect()} == {"hot": 100, "cold": 100}


def test_top_n_takes_longer_prefixes_for_larger_groups(spark, monkeypatch):
    from aletheia.operators import rank

    df = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("g"))
    want = sorted(tuple(r) for r in rank_in_hash_order(df, ["g"], 5, limit=70).collect())
    monkeypatch.setattr(rank, "PREFIX_ROWS", 1)
    assert sorted(tuple(r) for r in rank_in_hash_order(df, ["g"], 5, limit=70).collect()) == want and len(want) == 140


def test_range_rank_of_null_groups_without_groups_and_empty(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(50)], "row_id long, g string").repartition(5)
    got = {r.row_id: (r.rn, r.n) for r in range_rank(df, ["g"], ["row_id"]).collect()}
    assert got[0] == (1, 17) and got[48] == (17, 17) and got[1] == (1, 33) and got[49] == (33, 33)
    assert sorted((r.rn, r.row_id) for r in range_rank(df, [], [F.desc("row_id")]).collect()) == [(i + 1, 49 - i) for i in range(50)]
    assert range_rank(df.limit(0), ["g"], ["row_id"]).count() == 0


def test_fit_bound_cuts_train_rows_only(spark):
    from aletheia import fixtures
    from aletheia.operators.probeset import select_rows

    df = fixtures.probe(spark, SF_SMALL)
    full = select_rows(df, None).groupBy("source", "label", "part").count().collect()
    cut = select_rows(df, 5).groupBy("source", "label", "part").count().collect()
    full, cut = ({tuple(r)[:3]: r["count"] for r in x} for x in (full, cut))
    assert any(n > 5 for (_, _, part), n in full.items() if part == "train")
    assert cut == {k: min(n, 5) if k[2] == "train" else n for k, n in full.items()}
