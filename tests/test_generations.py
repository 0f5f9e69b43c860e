import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aletheia import fixtures
from aletheia.operators import generations as G
from aletheia.operators import infer as I
from aletheia.sources.parquet import wide_generations, write_generations

import pytest

import standins
from conftest import SF_SMALL

EXAMPLE = [" a", "a ", "b", None, "", "b", None, " "]
EXPECTED = [" a", None, "b", None, "", None, None, None]


def test_dedup_in_row_wide(spark):
    cols = [f"Generation_{i}" for i in range(1, 9)]
    df = spark.createDataFrame([tuple([1] + EXAMPLE)], ", ".join(["row_id long"] + [f"{c} string" for c in cols]))
    r = G.dedup_in_row_wide(df, cols).first()
    assert [r[c] for c in cols] == EXPECTED


def test_dedup_in_row_long(spark):
    df = spark.createDataFrame([(1, i + 1, g) for i, g in enumerate(EXAMPLE)], "row_id long, gen_idx int, generation string")
    got = [r.generation for r in G.dedup_in_row(df).orderBy("gen_idx").collect()]
    assert got == EXPECTED


def test_pivot_roundtrip_and_partitioned_write(spark, tmp_path):
    g = fixtures.gens(spark, SF_SMALL, 20)
    wide = wide_generations(g, 20, key_cols=("row_id", "Question", "Answer"))
    assert wide.count() == g.select("row_id").distinct().count()
    out = str(tmp_path / "gens")
    write_generations(g, out)
    back = spark.read.parquet(out)
    assert back.count() == g.count() and "gen_idx" in back.columns
    # re-writing one generation replaces only that partition
    write_generations(g.where("gen_idx = 1").withColumn("generation", F.lit("x")), out)
    again = spark.read.parquet(out)
    assert again.count() == g.count() and {r[0] for r in again.where("gen_idx = 1").select("generation").collect()} == {"x"}


def test_batch_infer_isolates_failures(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "row_id long, prompt string")

    def make():
        def fn(b: pd.DataFrame) -> pd.DataFrame:
            if any(p == "p7" for p in b["prompt"]):
                raise RuntimeError("boom")
            return pd.DataFrame({"out": [p.upper() for p in b["prompt"]]})

        return fn

    res = I.batch_infer(df, make, T.StructType([T.StructField("out", T.StringType())]), keep=["row_id"], batch_size=16)
    r = {x.row_id: (x.out, x.error) for x in res.collect()}
    assert len(r) == 40 and r[7][0] is None and "boom" in r[7][1] and r[8] == ("P8", None)


def test_generate_then_annotate(spark):
    q = fixtures.questions(spark, SF_SMALL).limit(5)  # small input for a unit test of the plumbing
    gen = I.generate(q, standins.standin_generator, n_generations=3)
    rows = gen.collect()
    assert len(rows) == 15 and all(r.generation in standins.STANDIN_WORDS and len(r.hidden_states) == 8 for r in rows)
    long = gen.withColumn("Answer", F.lit("paris"))
    lab = G.write_back(long, I.annotate(G.judge_prompts(long), standins.standin_labeller))
    assert {r.label for r in lab.collect()} <= {"True", "False"}
    cs = G.classification_set(lab, gen)
    assert cs.count() == 15


def test_save_load_tables_roundtrip(spark, tmp_path):
    from aletheia.operators.mixture import init_params, params_table
    from aletheia.sources.parquet import load_table, save_table

    ptab = params_table(spark, {0: init_params(3, 2, 0, h=4)})
    path = str(tmp_path / "params")
    save_table(ptab, path)
    back = {r.name: (r.shape, r["values"]) for r in load_table(spark, path).collect()}
    assert back["We"][0] == [2, 2, 3] and len(back["We"][1]) == 12


def test_annotation_is_spread_and_shares_answers(spark, monkeypatch):
    monkeypatch.setattr(I, "PROMPTS_PER_TASK", 10)
    prompts = spark.range(300).selectExpr("id as row_id", "1 as gen_idx", "concat('p', cast(id % 150 as string)) as prompt").coalesce(1)

    def make():
        from pyspark import TaskContext

        return lambda b: pd.DataFrame({"response": [f"{p}@{TaskContext.get().partitionId()}" for p in b["prompt"]]})

    got = {r.row_id: r.response for r in I.annotate(prompts, make).collect()}
    assert all(got[i] == got[i + 150] and got[i].startswith(f"p{i}@") for i in range(150))
    assert len({v.split("@")[1] for v in got.values()}) >= 10  # not one task


@pytest.mark.parametrize("limit", [10**6, 10])
def test_vectors_are_joined_last(spark, monkeypatch, limit):
    """Broadcast ids, or (past the limit) a bitmap of the ids in the scan and
    a shuffle of the vectors that have a label only."""
    from aletheia.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", limit)
    labelled = spark.range(400).selectExpr("id as row_id", "1 as gen_idx", "if(id % 8 = 0, 'True', null) as label")
    acts = spark.range(4000).selectExpr("id as row_id", "1 as gen_idx", "array(array(cast(id as double))) as hidden_states", "0 as other")
    got = G.classification_set(labelled, acts)
    assert sorted((r.row_id, r.hidden_states[0][0]) for r in got.collect()) == [(i, float(i)) for i in range(0, 400, 8)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("bitmap_construct_agg" in plan) == (limit == 10)
    kept = joins.keep_members(acts, labelled.where("label is not null"), ["row_id", "gen_idx"], 50)
    assert 50 <= kept.count() < 1000 and kept.columns == acts.columns


def test_resumed_runs_compute_only_what_is_missing(spark, tmp_path):
    from aletheia.sources import resumable as RS

    path, calls = str(tmp_path / "run"), []
    ids = spark.range(100).withColumnRenamed("id", "row_id")

    def run(part, g):
        calls.append((g, part.count()))
        if g == 3 and len(calls) < 4:
            raise RuntimeError("killed")
        return part.withColumn("generation", F.concat(F.lit(f"g{g}-"), F.col("row_id").cast("string")))

    with pytest.raises(RuntimeError):
        RS.resume(ids, path, run, 4, buckets=4)
    assert {r.gen_idx for r in RS.finished(spark, path).collect()} == {1, 2}
    assert RS.resume(ids, path, run, 4, buckets=4) == 8 and [g for g, _ in calls] == [1, 2, 3, 3, 4]
    assert RS.resume(ids, path, run, 4, buckets=4) == 0
    RS.write_attempt(ids.selectExpr("row_id", "'late' as generation", "1 as gen_idx"), path, [], buckets=4, commit=False)
    got = sorted((r.gen_idx, r.row_id, r.generation) for r in RS.read(spark, path).collect())
    assert got == sorted((g, i, f"g{g}-{i}") for g in range(1, 5) for i in range(100))
    # of two attempts at one unit one counts, the same for every reader
    RS.write_attempt(ids.where(RS.bucket_of("row_id", 4) == 1).selectExpr("row_id", "'again' as generation", "2 as gen_idx"), path, [(2, 1)], buckets=4)
    assert RS.read(spark, path).where("gen_idx = 2").count() == 100
    assert RS.finished(spark, str(tmp_path / "none")).count() == 0


def test_runs_are_saved_whole(spark, tmp_path):
    from aletheia.sources import resumable as RS

    path = str(tmp_path / "runs")
    with pytest.raises(FileNotFoundError):
        RS.load_run(spark, path)
    first = RS.save_run(path, scores=spark.range(3), params=spark.range(2))
    RS.save_run(path, scores=spark.range(5))
    assert {k: v.count() for k, v in RS.load_run(spark, path, first).items()} == {"scores": 3, "params": 2}
    assert RS.load_run(spark, path)["scores"].count() == 5
    with pytest.raises(FileNotFoundError):
        RS.load_run(spark, path, "absent")
