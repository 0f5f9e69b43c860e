"""Registered queries: a Spark builder and, where SQL can express it, the
equivalent DuckDB SQL over the same Parquet tables.

Every query reads the driver tables (through ``fixtures``) over whole tables.
Vector outputs are returned in long form ``(row_id, dim, value)`` and floats
are rounded to 6 decimals in both engines so results hash equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aletheia import fixtures
from aletheia.functions.text import (
    GENERATION_SUFFIX,
    JUDGE_TEMPLATE,
    canonical_source,
    echo_answer,
    generation_prompt,
    json_content,
    label_binary,
)
from aletheia.functions.vectors import pool
from aletheia.operators import auc as A
from aletheia.operators import cluster as CL
from aletheia.operators import evaluate as E
from aletheia.operators import generations as G
from aletheia.operators import infer as I
from aletheia.operators import prep
from aletheia.operators import similarity as SIM
from aletheia.operators.linear import centroid_directions, score
from aletheia.operators.probeset import probe_set, select_rows
from aletheia.operators.split import split_prefix, split_stratified
from aletheia.plans import plans as P
from aletheia.sources.parquet import table, wide_generations

N_GEN = 20  # fixed value: generations per question
SAMPLE_CAP_TEST = 40  # cap used by the sampling query so that it samples
R = 6  # decimals kept for float outputs

# ---------------------------------------------------------------------------
# SQL building blocks (DuckDB dialect)
# ---------------------------------------------------------------------------


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CANON_SQL = (
    "CASE WHEN {c} LIKE '%train%' OR {c} LIKE '%dev%' OR {c} LIKE '%test%' "
    "THEN split_part({c}, '_', 1) ELSE {c} END"
)
STRIP_SQL = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"

PROBE_CTE = """probe AS (
  SELECT vec_id AS row_id,
    concat('q', CAST(k AS VARCHAR)) AS Question, concat('a', CAST(k % 7 AS VARCHAR)) AS Answer,
    CASE WHEN vec_id % 4 = 3 THEN 'src_3' ELSE concat('src', CAST(vec_id % 4 AS VARCHAR),
      CASE vec_id % 3 WHEN 0 THEN '_train' WHEN 1 THEN '_dev' ELSE '_test' END) END AS source,
    CASE WHEN label < 5 THEN 'False' WHEN vec_id % 20 = 0 THEN 'TRUE' ELSE 'True' END AS label,
    list_transform(range(CASE WHEN vec_id % 11 = 0 THEN 2 ELSE 8 END),
      lambda i: CAST(embedding AS DOUBLE[])[i*8+1 : i*8+8]) AS hidden_states
  FROM (SELECT *, CASE WHEN vec_id % 10 = 9 THEN vec_id - 1 ELSE vec_id END AS k FROM embeddings) e0)"""

POOL_SQL = {
    "max": "list_transform(range(1, len(hidden_states[1]) + 1), lambda i: list_max(list_transform(hidden_states[1:{n}], lambda h: h[i])))",
    "mean": "list_transform(range(1, len(hidden_states[1]) + 1), lambda i: list_reduce(list_transform(hidden_states[1:{n}], lambda h: h[i]), lambda a, b: a + b) / len(hidden_states[1:{n}]))",
    "first": "hidden_states[1]",
}


def prep_ctes(split: bool = True) -> str:
    """probe → canonical → keep-first → 80/20 → max-pool, over all rows."""
    canon = CANON_SQL.format(c="source")
    part = (
        ", CASE WHEN p_ <= CAST(floor(n_ * CAST(0.8 AS DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS part"
        if split
        else ""
    )
    return f"""{PROBE_CTE},
c AS (SELECT row_id, Question, Answer, {canon} AS source, label, hidden_states FROM probe),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Question, Answer ORDER BY row_id) AS r_ FROM c) d0 WHERE r_ = 1),
e AS (SELECT * FROM d WHERE source IS NOT NULL AND label IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY md5(concat('1|', CAST(row_id AS VARCHAR))), row_id) AS p_,
        count(*) OVER (PARTITION BY source, label) AS n_ FROM e),
prep AS (SELECT row_id, source, label, CASE WHEN lower(label) = 'true' THEN 1 ELSE 0 END AS y{part},
        {POOL_SQL['max'].format(n=3)} AS x FROM f)"""


def auc_sql(src: str, keys: list[str], score: str, y: str = "y") -> str:
    """Grouped AUC over relation ``src`` (same formula as operators.auc)."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    part = f"PARTITION BY {k} " if keys else ""
    grp = f"GROUP BY {k}" if keys else ""
    return f"""auc_a AS (SELECT {kc}{score} AS s_, sum({y}) AS p_, sum(1 - {y}) AS n_ FROM {src}
        WHERE {score} IS NOT NULL AND {y} IS NOT NULL GROUP BY {kc}{score}),
auc_b AS (SELECT *, coalesce(sum(n_) OVER ({part}ORDER BY s_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb_ FROM auc_a),
auc AS (SELECT {kc}CAST(sum(p_) AS BIGINT) AS n_pos, CAST(sum(n_) AS BIGINT) AS n_neg,
        sum(CAST(p_ AS DOUBLE) * (CAST(nb_ AS DOUBLE) + CAST(n_ AS DOUBLE) / 2.0)) / nullif(CAST(sum(p_) AS DOUBLE) * CAST(sum(n_) AS DOUBLE), 0) AS auc
        FROM auc_b {grp})"""


GENS_CTE = """gens AS (
  SELECT event_id // 20 AS row_id, concat('q', CAST(event_id // 20 AS VARCHAR)) AS Question,
    CASE (event_id // 20) % 3 WHEN 0 THEN ' Click ' WHEN 1 THEN 'VIEW' ELSE 'purchase' END AS Answer,
    CAST(event_id % 20 + 1 AS INTEGER) AS gen_idx,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 5 = 0 THEN concat('  ', event_type, ' ') ELSE event_type END AS generation
  FROM events)"""

GENS_DEDUP_CTE = GENS_CTE + """,
gd AS (SELECT row_id, Question, Answer, gen_idx,
    CASE WHEN generation IS NOT NULL AND row_number() OVER (PARTITION BY row_id, """ + STRIP_SQL.format(c="generation") + """ ORDER BY gen_idx) = 1
         THEN generation END AS generation FROM gens)"""


def _judge_sql(answer: str, generation: str) -> str:
    head, rest = JUDGE_TEMPLATE.split("{answer}")
    mid, tail = rest.split("{generation}")
    a = f"lower({STRIP_SQL.format(c=answer)})"
    g = f"lower({STRIP_SQL.format(c=generation)})"
    return f"concat({_sql_str(head)}, {a}, {_sql_str(mid)}, {g}, {_sql_str(tail)})"


# ---------------------------------------------------------------------------
# Spark builders
# ---------------------------------------------------------------------------


def _probe(spark, sf):
    return fixtures.probe(spark, sf)


def _canon_probe(spark, sf):
    return prep.with_canonical_source(_probe(spark, sf))


def _prepared(spark, sf):
    """All rows: nothing is capped, neither for fitting nor for evaluation."""
    return probe_set(_probe(spark, sf), sample_size=None)


def q_source_canonical(spark, sf):
    p = _probe(spark, sf)
    return p.select("row_id", F.col("source").alias("source_raw"), canonical_source("source").alias("source"))


def q_label_binary(spark, sf):
    return _probe(spark, sf).select("row_id", "label", label_binary("label").alias("y"))


def q_dedup_first(spark, sf):
    c = _canon_probe(spark, sf).drop("hidden_states")
    return prep.dedup_first(c, ["Question", "Answer"], "row_id")


def q_value_counts_source(spark, sf):
    return prep.value_counts(_canon_probe(spark, sf), "source", "n")


def q_value_counts_source_label(spark, sf):
    sel = select_rows(_probe(spark, sf), None, split_seed=None)
    return prep.value_counts(sel, ["source", "label"], "n")


def q_distinct_sources(spark, sf):
    sel = select_rows(_probe(spark, sf), None, split_seed=None)
    return prep.distinct_sorted(sel, "source")


def q_count_nonnull_generations(spark, sf):
    wide = wide_generations(fixtures.gens(spark, sf, N_GEN), N_GEN, key_cols=("row_id", "Question", "Answer"))
    cols = [f"Generation_{i}" for i in range(1, N_GEN + 1)]
    return prep.count_nonnull(G.dedup_in_row_wide(wide, cols), cols)


def q_sample_by_group(spark, sf):
    c = prep.dedup_first(_canon_probe(spark, sf).drop("hidden_states"), ["Question", "Answer"], "row_id")
    return prep.sample_by_group(c, ["source", "label"], SAMPLE_CAP_TEST, seed=0).select("row_id", "source", "label")


def q_split_prefix(spark, sf):
    sel = select_rows(_probe(spark, sf), None, split_seed=None)
    return split_prefix(sel, ["source", "label"], seed=1).select("row_id", "source", "label", "part")


def q_split_stratified(spark, sf):
    nat = fixtures.labelled(spark, sf).select("row_id", "source", label_binary("label").alias("y"))
    s = split_stratified(nat, "source", "y", seed=42, part_col="spart")
    return s.select("row_id", "source", "y", "spart", "split_status")


def q_gen_pivot(spark, sf):
    return wide_generations(fixtures.gens(spark, sf, N_GEN), N_GEN, key_cols=("row_id", "Question", "Answer"))


def q_gen_unpivot(spark, sf):
    wide = q_gen_pivot(spark, sf)
    cols = [f"Generation_{i}" for i in range(1, N_GEN + 1)]
    long = wide.unpivot(["row_id"], cols, "col", "generation")
    return long.select(
        "row_id",
        F.regexp_extract("col", r"(\d+)$", 1).cast("int").alias("gen_idx"),
        "generation",
    )


def q_gen_dedup_in_row(spark, sf):
    return G.dedup_in_row(fixtures.gens(spark, sf, N_GEN)).select("row_id", "gen_idx", "generation")


def q_gen_prompt(spark, sf):
    return fixtures.questions(spark, sf).select("row_id", generation_prompt("Question").alias("prompt"))


def q_judge_prompt(spark, sf):
    return G.judge_prompts(G.dedup_in_row(fixtures.gens(spark, sf, N_GEN)))


def q_echo_strip(spark, sf):
    g = fixtures.gens(spark, sf, N_GEN)
    p = generation_prompt("Question")
    decoded = F.concat(p, F.col("generation"))
    return g.select("row_id", "gen_idx", echo_answer(decoded, p).alias("answer"))


def q_json_content(spark, sf):
    ev = table(spark, sf, "events", ["event_id", "event_type"])
    resp = F.concat(F.lit('{"choices":[{"message":{"content":" '), F.col("event_type"), F.lit(' "}}]}'))
    return ev.select("event_id", json_content(resp).alias("content"))


def _labelled_gens(spark, sf):
    """De-duplicated generations with the given responses to their prompts."""
    d = G.dedup_in_row(fixtures.gens(spark, sf, N_GEN))
    asked = G.judge_prompts(d).select("row_id", "gen_idx")
    return G.write_back(d, fixtures.responses(spark, sf, N_GEN).join(asked, ["row_id", "gen_idx"], "left_semi"))


def q_label_writeback(spark, sf):
    return _labelled_gens(spark, sf).select("row_id", "gen_idx", "generation", "label")


def q_classification_set(spark, sf):
    """Labelled generations with their vectors, one row per element."""
    x = G.classification_set(_labelled_gens(spark, sf), fixtures.activations(spark, sf, N_GEN))
    steps = x.select("row_id", "gen_idx", "label", F.posexplode("hidden_states").alias("step", "h"))
    each = steps.select("row_id", "gen_idx", "label", "step", F.posexplode("h").alias("dim", "value"))
    return each.withColumn("value", F.round("value", R))


def _pool_query(method):
    def q(spark, sf):
        p = _probe(spark, sf)
        v = p.select("row_id", F.posexplode(pool("hidden_states", method, 3)).alias("dim", "value"))
        return v.select("row_id", "dim", F.round("value", R).alias("value"))

    return q


def _total(x):
    """Fixed score: the sum of all elements."""
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def q_auc_by_source(spark, sf):
    ps = _prepared(spark, sf).withColumn("score", _total("x"))
    a = A.grouped_auc(ps, ["source"], "score", "y")
    return a.select("source", "n_pos", "n_neg", F.round("auc", R).alias("auc"))


def _lineitem_scored(spark, sf):
    li = table(spark, sf, "lineitem", ["l_returnflag", "l_linestatus", "l_extendedprice"])
    return li.select(
        "l_returnflag",
        F.col("l_extendedprice").alias("score"),
        (F.col("l_linestatus") == "F").cast("int").alias("y"),
    )


def q_auc_by_returnflag(spark, sf):
    a = A.grouped_auc(_lineitem_scored(spark, sf), ["l_returnflag"], "score", "y")
    return a.select("l_returnflag", "n_pos", "n_neg", F.round("auc", R).alias("auc"))


def q_auc_global(spark, sf):
    a = A.global_auc(_lineitem_scored(spark, sf), "score", "y")
    return a.select("n_pos", "n_neg", F.round("auc", R).alias("auc"))


def _sources(spark, sf):
    return E.sources_of(select_rows(_probe(spark, sf), None, split_seed=None))


def q_plan_loo(spark, sf):
    return P.leave_one_out_table(q_distinct_sources(spark, sf))


def q_plan_incremental(spark, sf):
    return P.incremental_order_table(q_distinct_sources(spark, sf), 10)


def _fixed_source_auc(spark, sf):
    """AUC per source of the fixed score x[0] on the prepared set."""
    ps = _prepared(spark, sf).withColumn("score", _total("x"))
    return A.grouped_auc(ps, ["source"], "score", "y").select("source", "auc")


def q_curve_stats(spark, sf):
    sources = _sources(spark, sf)
    _, te, mapping = P.incremental_plans(spark, sources, 10)
    aucs = _fixed_source_auc(spark, sf)
    per_model = te.join(aucs, "source").groupBy("model_id").agg(F.avg("auc").alias("mean_auc"))
    per_run = mapping.join(per_model, "model_id").select("run", "train_size", "mean_auc")
    cs = E.curve_stats(per_run)
    return cs.select("train_size", *[F.round(c, R).alias(c) for c in ("mean", "std", "lower", "upper")])


def _fixed_coefs(ps, model_col="source"):
    """Data-derived 'fixed' probes: class-centroid difference on train rows."""
    return centroid_directions(ps.where(F.col("part") == "train"), model_col)


def q_score_fixed_coefs(spark, sf):
    ps = _prepared(spark, sf)
    coefs = _fixed_coefs(ps)
    s = score(ps.where(F.col("part") == "test").withColumn("model_id", F.col("source")), coefs)
    return s.select("row_id", "source", F.round("score", R).alias("score"))


def q_cosine_matrix_fixed(spark, sf):
    coefs = _fixed_coefs(_prepared(spark, sf))
    return SIM.cosine_matrix(coefs).select("a", "b", F.round("cosine", R).alias("cosine"))


def q_cluster_assign_fixed(spark, sf, k=3):
    ps = _prepared(spark, sf)
    centres = CL.first_rows_as_centres(ps.where(F.col("part") == "train"), k)
    return CL.nearest_centre(ps, centres).select("row_id", "cluster")


def q_cluster_routed_auc_fixed(spark, sf, k=3):
    ps = _prepared(spark, sf)
    train = ps.where(F.col("part") == "train")
    centres = CL.first_rows_as_centres(train, k)
    a = CL.nearest_centre(ps, centres).withColumn("model_id", F.concat(F.lit("c"), F.col("cluster").cast("string")))
    coefs = centroid_directions(a.where(F.col("part") == "train"), "model_id")
    scored = CL.routed_scores(a.select("part", "model_id", "x", "y"), coefs)
    r = A.grouped_auc(scored, ["part"], "score", "y")
    return r.select("part", "n_pos", "n_neg", F.round("auc", R).alias("auc"))


def _all_direction(spark, sf):
    """One given probe: the centroid direction over all train rows."""
    train = _prepared(spark, sf).where(F.col("part") == "train").withColumn("model_id", F.lit("all"))
    return [float(v) for v in centroid_directions(train, "model_id").first()["w"]]


def _probe_judge(w):
    """A judge whose model is a linear probe: prompts are vectors as JSON."""

    def make():
        import json

        import numpy as np
        import pandas as pd

        weights = np.array(w)

        def fn(batch):
            x = np.array([json.loads(p) for p in batch["prompt"]], float)
            return pd.DataFrame({"response": np.where(x @ weights >= 0, "True", "False")})

        return fn

    return make


def q_batch_annotate(spark, sf):
    """U3 over the test rows: the judge is a probe fitted on the train rows."""
    test = _prepared(spark, sf).where(F.col("part") == "test").select("row_id", F.lit(1).alias("gen_idx"), "x")
    prompts = test.select("row_id", "gen_idx", F.to_json("x").alias("prompt"))
    answers = I.annotate(prompts, _probe_judge(_all_direction(spark, sf)))
    return G.write_back(test.drop("x"), answers).select("row_id", "gen_idx", "label")


def _probe_generator(w):
    """A generator over vector questions: pass n answers by the probe's side of
    step n, and returns all steps as its activations."""

    def make():
        import json

        import numpy as np
        import pandas as pd

        weights = np.array(w)

        def fn(batch):
            decoded, steps = [], []
            for prompt, n in zip(batch["prompt"], batch["gen_idx"]):
                h = np.array(json.loads(prompt[: prompt.index("]") + 1]), float).reshape(-1, len(weights))
                decoded.append(prompt + ("True" if h[n - 1] @ weights >= 0 else "False"))
                steps.append(h.tolist())
            return pd.DataFrame({"decoded": decoded, "hidden_states": steps})

        return fn

    return make


def q_batch_generate(spark, sf):
    """U2 over all vectors: eight passes; a row per pass and step."""
    out = I.generate(fixtures.vector_questions(spark, sf), _probe_generator(_all_direction(spark, sf)), n_generations=8)
    each = out.select("row_id", "gen_idx", "generation", F.posexplode("hidden_states").alias("step", "h"))
    return each.select("row_id", "gen_idx", "generation", "step", F.round(_total("h"), R).alias("total"))


def _scratch(spark, name):
    from aletheia.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"


def q_gen_resumed(spark, sf):
    """S3: a generation run that is cut and taken up again.  The first attempt
    finishes some units, a second dies before it is recorded; the restart runs
    what is missing, and every generation is read back once."""
    from aletheia.sources import resumable as RS

    gens, path = fixtures.gens(spark, sf, N_GEN), _scratch(spark, "generations")
    one_pass = lambda part, g: gens.where(F.col("gen_idx") == g).drop("gen_idx").join(part, "row_id", "left_semi")
    ids = gens.select("row_id").distinct()
    some = [(g, b) for g in (1, 2) for b in range(0, 8, g)]
    first = gens.join(spark.createDataFrame(some, "gen_idx int, bucket int").withColumnRenamed("gen_idx", "g"),
                      (F.col("gen_idx") == F.col("g")) & (RS.bucket_of("row_id", 8) == F.col("bucket"))).drop("g", "bucket")
    RS.write_attempt(first, path, some, buckets=8)
    RS.write_attempt(gens.where("gen_idx <= 3"), path, [], buckets=8, commit=False)
    RS.resume(ids, path, one_pass, N_GEN, buckets=8)
    return RS.read(spark, path).select("row_id", "Question", "Answer", "gen_idx", "generation")


def q_scores_saved(spark, sf):
    """Scores and coefficients saved as one run and read back."""
    from aletheia.sources import resumable as RS

    path = _scratch(spark, "runs")
    ps = _prepared(spark, sf).withColumn("score", _total("x"))
    RS.save_run(path, scores=A.grouped_auc(ps, ["source"], "score", "y"), coefs=_fixed_coefs(ps))
    run = RS.load_run(spark, path)
    width = run["coefs"].select(F.col("model_id").alias("source"), F.size("w").alias("dim"))
    return run["scores"].join(width, "source").select("source", "n_pos", "n_neg", F.round("auc", R).alias("auc"), "dim")


# fitted models: the SQL side runs the probes' fixed-point map (see _fit_sql)


def _rounded_auc(df):
    return df.withColumn("auc", F.round("auc", R))


def q_eval_separate(spark, sf):
    return _rounded_auc(E.roc_auc_for_group(_prepared(spark, sf), "separate"))


def q_eval_all_vs_each(spark, sf):
    return _rounded_auc(E.roc_auc_for_group(_prepared(spark, sf), "all_vs_each"))


def q_eval_loo(spark, sf):
    return _rounded_auc(E.roc_auc_for_group(_prepared(spark, sf), "leave_one_out"))


def q_eval_matrix(spark, sf):
    return _rounded_auc(E.cross_source_matrix(_prepared(spark, sf))[0])


def q_eval_incremental(spark, sf):
    curve = E.incremental_curve(_prepared(spark, sf), 10)[1]
    return curve.select("train_size", *(F.round(c, R).alias(c) for c in ("mean", "std", "lower", "upper")))


def q_pca3(spark, sf):
    ps = _prepared(spark, sf).where(F.col("part") == "train")
    return _rounded_pcs(CL.pca3(ps, "x", ("row_id", "y")), "y")


def _rounded_pcs(df, *keep):
    return df.select("row_id", *keep, *(F.round(f"PC{j}", R).alias(f"PC{j}") for j in (1, 2, 3)))


def q_kmeans_sweep(spark, sf):
    t = CL.kmeans_sweep(_prepared(spark, sf))[0]
    return t.select("num_clusters", *(F.round(c, R).alias(c) for c in ("roc_auc_train", "roc_auc_test")))


def q_cluster_models(spark, sf):
    """The per-cluster probes of k = 3, one row per coefficient."""
    coefs = CL.kmeans_sweep(_prepared(spark, sf), ks=[3])[1]
    long = coefs.select("model_id", F.posexplode("w").alias("dim", "value"))
    return long.select("model_id", "dim", F.round("value", R).alias("value"))


def q_cluster_members(spark, sf):
    """Positions per cluster of k = 3 over the train rows, one list each."""
    rows = _prepared(spark, sf).where(F.col("part") == "train")
    _, assign = CL.kmeans_assign(rows, 3)
    return CL.cluster_members(assign(rows).select("row_id", "cluster"), 3)


def q_coef_similarity(spark, sf):
    _, coefs = E.cross_source_matrix(_prepared(spark, sf))
    # the solver stops within some 1e-6 of a coefficient: four decimals are kept
    return SIM.cosine_matrix(coefs).select("a", "b", F.round("cosine", 4).alias("cosine"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "source_canonical": q_source_canonical,
    "label_binary": q_label_binary,
    "dedup_first": q_dedup_first,
    "value_counts_source": q_value_counts_source,
    "value_counts_source_label": q_value_counts_source_label,
    "distinct_sources": q_distinct_sources,
    "count_nonnull_generations": q_count_nonnull_generations,
    "sample_by_group": q_sample_by_group,
    "split_prefix": q_split_prefix,
    "split_stratified": q_split_stratified,
    "gen_pivot": q_gen_pivot,
    "gen_unpivot": q_gen_unpivot,
    "gen_dedup_in_row": q_gen_dedup_in_row,
    "gen_prompt": q_gen_prompt,
    "judge_prompt": q_judge_prompt,
    "echo_strip": q_echo_strip,
    "json_content": q_json_content,
    "label_writeback": q_label_writeback,
    "classification_set": q_classification_set,
    "pool_max": _pool_query("max"),
    "pool_mean": _pool_query("mean"),
    "pool_first": _pool_query("first"),
    "auc_by_source": q_auc_by_source,
    "auc_by_returnflag": q_auc_by_returnflag,
    "auc_global": q_auc_global,
    "plan_loo": q_plan_loo,
    "plan_incremental": q_plan_incremental,
    "curve_stats": q_curve_stats,
    "score_fixed_coefs": q_score_fixed_coefs,
    "cosine_matrix_fixed": q_cosine_matrix_fixed,
    "cluster_assign_fixed": q_cluster_assign_fixed,
    "cluster_routed_auc_fixed": q_cluster_routed_auc_fixed,
    "batch_annotate": q_batch_annotate,
    "batch_generate": q_batch_generate,
    "gen_resumed": q_gen_resumed,
    "scores_saved": q_scores_saved,
    "eval_separate": q_eval_separate,
    "eval_all_vs_each": q_eval_all_vs_each,
    "eval_loo": q_eval_loo,
    "eval_matrix": q_eval_matrix,
    "eval_incremental": q_eval_incremental,
    "pca3": q_pca3,
    "kmeans_sweep": q_kmeans_sweep,
    "cluster_models": q_cluster_models,
    "cluster_members": q_cluster_members,
    "coef_similarity": q_coef_similarity,
}


# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB)
# ---------------------------------------------------------------------------

_SUFFIX = _sql_str(GENERATION_SUFFIX)
_CANON_C = "c AS (SELECT row_id, Question, Answer, " + CANON_SQL.format(c="source") + " AS source, label FROM probe)"
_DEDUP_D = "d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Question, Answer ORDER BY row_id) AS r_ FROM c) d0 WHERE r_ = 1)"
_NAT = """nat AS (SELECT dd.doc_id AS row_id, dd.source, CASE WHEN lb.quality = 1 THEN 1 ELSE 0 END AS y
  FROM documents dd JOIN labels lb ON dd.doc_id = lb.doc_id)"""
_SRCS = "srcs AS (SELECT DISTINCT source FROM e)"
_ORD = """ord AS (SELECT CAST(r.run AS INTEGER) AS run, s.source,
    CAST(row_number() OVER (PARTITION BY r.run ORDER BY md5(concat(CAST(r.run AS VARCHAR), '|', s.source)), s.source) AS INTEGER) AS pos
  FROM range(10) r(run) CROSS JOIN srcs s)"""
_DOT = "list_reduce(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]), lambda p, q: p + q)"
_SIG = "1.0 / (1.0 + exp(-(" + _DOT + ")))"
_CENTROID = """lg{s} AS (SELECT {m} AS m, y, unnest(range(len(x))) AS j, unnest(x) AS v FROM {src}),
wd{s} AS (SELECT m, j, avg(CASE WHEN y = 1 THEN v END) - avg(CASE WHEN y = 0 THEN v END) AS w FROM lg{s} GROUP BY m, j),
coef{s} AS (SELECT m, list(w ORDER BY j) AS w FROM wd{s} GROUP BY m HAVING count(w) = count(*))"""
_CEN = """cen AS (SELECT list(x ORDER BY row_id) AS cc FROM (SELECT row_id, x FROM prep WHERE part = 'train' ORDER BY row_id LIMIT 3) c0),
asg AS (SELECT p.*, list_transform(cen.cc, lambda c: list_reduce(list_transform(range(1, len(p.x) + 1),
          lambda j: (p.x[j] - c[j]) * (p.x[j] - c[j])), lambda a, b: a + b)) AS dists FROM prep p, cen)"""


def _pool_sql(method: str) -> str:
    x = POOL_SQL[method].format(n=3)
    return f"""WITH {PROBE_CTE},
v AS (SELECT row_id, {x} AS x FROM probe)
SELECT row_id, CAST(unnest(range(len(x))) AS INTEGER) AS dim, round(unnest(x), 6) AS value FROM v"""


def _gen_pivot_sql() -> str:
    cols = ",\n  ".join(f"max(CASE WHEN gen_idx = {i} THEN generation END) AS Generation_{i}" for i in range(1, N_GEN + 1))
    return f"SELECT row_id, Question, Answer,\n  {cols}\nFROM gens GROUP BY row_id, Question, Answer"


_LABELLED = GENS_DEDUP_CTE + f""",
rsp AS (SELECT doc_id // {N_GEN} AS row_id, CAST(doc_id % {N_GEN} + 1 AS INTEGER) AS gen_idx,
          CASE WHEN quality = 1 THEN 'True' ELSE 'False' END AS response FROM labels),
lab AS (SELECT gd.row_id, gd.gen_idx, gd.generation, CASE WHEN gd.generation IS NOT NULL AND gd.Answer IS NOT NULL THEN rsp.response END AS label
        FROM gd LEFT JOIN rsp ON rsp.row_id = gd.row_id AND rsp.gen_idx = gd.gen_idx)"""

ORACLE: dict[str, str] = {
    "source_canonical": f"WITH {PROBE_CTE}\nSELECT row_id, source AS source_raw, {CANON_SQL.format(c='source')} AS source FROM probe",
    "label_binary": f"WITH {PROBE_CTE}\nSELECT row_id, label, CASE WHEN label IS NULL THEN NULL WHEN lower(label) = 'true' THEN 1 ELSE 0 END AS y FROM probe",
    "dedup_first": f"WITH {PROBE_CTE}, {_CANON_C}, {_DEDUP_D}\nSELECT row_id, Question, Answer, source, label FROM d",
    "value_counts_source": f"WITH {PROBE_CTE}, {_CANON_C}\nSELECT source, count(*) AS n FROM c WHERE source IS NOT NULL GROUP BY source",
    "value_counts_source_label": f"WITH {prep_ctes(split=False)}\nSELECT source, label, count(*) AS n FROM e GROUP BY source, label",
    "distinct_sources": f"WITH {prep_ctes(split=False)}\nSELECT DISTINCT source FROM e",
    "count_nonnull_generations": f"WITH {GENS_DEDUP_CTE}\nSELECT count(DISTINCT row_id) AS n_rows, count(generation) AS n_nonnull FROM gd",
    "sample_by_group": f"""WITH {PROBE_CTE}, {_CANON_C}, {_DEDUP_D}
SELECT row_id, source, label FROM (SELECT *, row_number() OVER (PARTITION BY source, label
    ORDER BY md5(concat('0|', CAST(row_id AS VARCHAR))), row_id) AS rn FROM d
  WHERE source IS NOT NULL AND label IS NOT NULL) s0 WHERE rn <= {SAMPLE_CAP_TEST}""",
    "split_prefix": f"WITH {prep_ctes()}\nSELECT row_id, source, label, part FROM prep",
    "split_stratified": f"""WITH {_NAT},
cls AS (SELECT source, y, count(*) AS n_c FROM nat GROUP BY source, y),
g1 AS (SELECT *, sum(n_c) OVER (PARTITION BY source) AS n, count(*) OVER (PARTITION BY source) AS n_classes,
         min(n_c) OVER (PARTITION BY source) AS min_c FROM cls),
g2 AS (SELECT *, CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS n_test FROM g1),
g3 AS (SELECT *, n - n_test AS n_train, CAST(n_c AS DOUBLE) / n * (n - n_test) AS cont FROM g2),
g4 AS (SELECT *, CAST(floor(cont) AS BIGINT) AS base, cont - floor(cont) AS rem FROM g3),
g5 AS (SELECT *, n_train - sum(base) OVER (PARTITION BY source) AS need,
         row_number() OVER (PARTITION BY source ORDER BY rem DESC, y) AS rr FROM g4),
alloc AS (SELECT source, y, base + CASE WHEN rr <= need THEN 1 ELSE 0 END AS n_fit,
         CASE WHEN min_c < 2 OR n_train < n_classes OR n_test < n_classes THEN 'too_few' ELSE 'ok' END AS split_status FROM g5),
rk AS (SELECT *, row_number() OVER (PARTITION BY source, y ORDER BY md5(concat('42|', CAST(row_id AS VARCHAR))), row_id) AS rn FROM nat)
SELECT rk.row_id, rk.source, rk.y, CASE WHEN rk.rn <= alloc.n_fit THEN 'fit' ELSE 'eval' END AS spart, alloc.split_status
FROM rk JOIN alloc ON rk.source = alloc.source AND rk.y = alloc.y""",
    "gen_pivot": f"WITH {GENS_CTE}\n{_gen_pivot_sql()}",
    "gen_unpivot": f"""WITH {GENS_CTE}, wide AS ({_gen_pivot_sql()})
SELECT row_id, CAST(unnest(range(1, {N_GEN + 1})) AS INTEGER) AS gen_idx,
  unnest([{', '.join(f'Generation_{i}' for i in range(1, N_GEN + 1))}]) AS generation FROM wide""",
    "gen_dedup_in_row": f"WITH {GENS_DEDUP_CTE}\nSELECT row_id, gen_idx, generation FROM gd",
    "gen_prompt": f"SELECT doc_id AS row_id, text || {_SUFFIX} AS prompt FROM documents",
    "judge_prompt": f"WITH {GENS_DEDUP_CTE}\nSELECT row_id, gen_idx, {_judge_sql('Answer', 'generation')} AS prompt FROM gd WHERE generation IS NOT NULL AND Answer IS NOT NULL",
    "echo_strip": f"""WITH {GENS_CTE},
t AS (SELECT row_id, gen_idx, Question || {_SUFFIX} AS p, Question || {_SUFFIX} || generation AS d FROM gens)
SELECT row_id, gen_idx, CASE WHEN position(p IN d) > 0 THEN split_part(d, p, 2) END AS answer FROM t""",
    "json_content": """SELECT event_id, regexp_replace(json_extract_string('{"choices":[{"message":{"content":" ' || event_type || ' "}}]}',
  '$.choices[0].message.content'), '^\\s+|\\s+$', '', 'g') AS content FROM events""",
    "label_writeback": f"WITH {_LABELLED}\nSELECT row_id, gen_idx, generation, label FROM lab",
    "classification_set": f"""WITH {_LABELLED},
v AS (SELECT vec_id // {N_GEN} AS row_id, CAST(vec_id % {N_GEN} + 1 AS INTEGER) AS gen_idx, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT lab.row_id, lab.gen_idx, lab.label, unnest(range(64)) AS i, v.e FROM lab JOIN v USING (row_id, gen_idx) WHERE lab.label IS NOT NULL)
SELECT row_id, gen_idx, label, CAST(i // 8 AS INTEGER) AS step, CAST(i % 8 AS INTEGER) AS dim, round(e[i + 1], 6) AS value FROM u""",
    "gen_resumed": f"WITH {GENS_CTE}\nSELECT row_id, Question, Answer, gen_idx, generation FROM gens",
    "scores_saved": f"""WITH {prep_ctes()}, t AS (SELECT source, y, list_reduce(x, lambda a, b: a + b) AS sc FROM prep), {auc_sql('t', ['source'], 'sc')}
SELECT source, n_pos, n_neg, round(auc, 6) AS auc, 8 AS dim FROM auc""",
    "pool_max": _pool_sql("max"),
    "pool_mean": _pool_sql("mean"),
    "pool_first": _pool_sql("first"),
    "auc_by_source": f"""WITH {prep_ctes()}, t AS (SELECT source, y, list_reduce(x, lambda a, b: a + b) AS sc FROM prep), {auc_sql('t', ['source'], 'sc')}
SELECT source, n_pos, n_neg, round(auc, 6) AS auc FROM auc""",
    "auc_by_returnflag": f"""WITH li AS (SELECT l_returnflag, l_extendedprice AS sc, CAST(l_linestatus = 'F' AS INTEGER) AS y FROM lineitem),
{auc_sql('li', ['l_returnflag'], 'sc')}
SELECT l_returnflag, n_pos, n_neg, round(auc, 6) AS auc FROM auc""",
    "auc_global": f"""WITH li AS (SELECT l_extendedprice AS sc, CAST(l_linestatus = 'F' AS INTEGER) AS y FROM lineitem),
{auc_sql('li', [], 'sc')}
SELECT n_pos, n_neg, round(auc, 6) AS auc FROM auc""",
    "plan_loo": f"WITH {prep_ctes(split=False)}, {_SRCS}\nSELECT h.source AS model_id, s.source FROM srcs h JOIN srcs s ON h.source <> s.source",
    "plan_incremental": f"WITH {prep_ctes(split=False)}, {_SRCS}, {_ORD}\nSELECT run, source, pos FROM ord",
    "curve_stats": f"""WITH {prep_ctes()}, {_SRCS}, {_ORD},
t AS (SELECT source, y, list_reduce(x, lambda a, b: a + b) AS sc FROM prep), {auc_sql('t', ['source'], 'sc')},
sz AS (SELECT DISTINCT pos AS i FROM ord WHERE pos < (SELECT count(*) FROM srcs)),
pr AS (SELECT o.run, z.i AS train_size, avg(a.auc) AS mean_auc
       FROM ord o JOIN sz z ON o.pos > z.i JOIN auc a ON a.source = o.source GROUP BY o.run, z.i)
SELECT CAST(train_size AS INTEGER) AS train_size, round(avg(mean_auc), 6) AS mean, round(stddev_pop(mean_auc), 6) AS std,
  round(avg(mean_auc) - stddev_pop(mean_auc), 6) AS lower, round(avg(mean_auc) + stddev_pop(mean_auc), 6) AS upper
FROM pr GROUP BY train_size""",
    "score_fixed_coefs": f"""WITH {prep_ctes()},
{_CENTROID.format(s='', m='source', src="prep WHERE part = 'train'")}
SELECT p.row_id, p.source, round({_SIG.format(a='p.x', b='c.w')}, 6) AS score
FROM prep p JOIN coef c ON c.m = p.source WHERE p.part = 'test'""",
    "cosine_matrix_fixed": f"""WITH {prep_ctes()},
{_CENTROID.format(s='', m='source', src="prep WHERE part = 'train'")},
lw AS (SELECT m, unnest(range(len(w))) AS j, unnest(w) AS v FROM coef),
dots AS (SELECT a.m AS a, b.m AS b, sum(a.v * b.v) AS dot FROM lw a JOIN lw b ON a.j = b.j GROUP BY a.m, b.m),
nrm AS (SELECT a AS m, sqrt(dot) AS nrm FROM dots WHERE a = b)
SELECT d.a, d.b, round(coalesce(d.dot / nullif(na.nrm * nb.nrm, 0), 0), 6) AS cosine
FROM dots d JOIN nrm na ON na.m = d.a JOIN nrm nb ON nb.m = d.b""",
    "cluster_assign_fixed": f"""WITH {prep_ctes()}, {_CEN}
SELECT row_id, CAST(list_position(dists, list_min(dists)) - 1 AS INTEGER) AS cluster FROM asg""",
    "cluster_routed_auc_fixed": f"""WITH {prep_ctes()}, {_CEN},
asg2 AS (SELECT row_id, part, y, x, 'c' || CAST(list_position(dists, list_min(dists)) - 1 AS VARCHAR) AS model_id FROM asg),
{_CENTROID.format(s='2', m='model_id', src="asg2 WHERE part = 'train'")},
sc AS (SELECT a.part, a.y, CASE WHEN c.w IS NULL THEN 0.0 ELSE {_SIG.format(a='a.x', b='c.w')} END AS score
       FROM asg2 a LEFT JOIN coef2 c ON c.m = a.model_id),
{auc_sql('sc', ['part'], 'score')}
SELECT part, n_pos, n_neg, round(auc, 6) AS auc FROM auc""",
    "batch_annotate": f"""WITH {prep_ctes()},
{_CENTROID.format(s='', m="'all'", src="prep WHERE part = 'train'")}
SELECT row_id, 1 AS gen_idx, CASE WHEN {_DOT.format(a='p.x', b='c.w')} >= 0 THEN 'True' ELSE 'False' END AS label
FROM prep p, coef c WHERE p.part = 'test'""",
    "batch_generate": f"""WITH {prep_ctes()},
{_CENTROID.format(s='', m="'all'", src="prep WHERE part = 'train'")},
h AS (SELECT vec_id AS row_id, CAST(unnest(range(8)) AS INTEGER) AS step, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
st AS (SELECT row_id, step, e[step * 8 + 1 : step * 8 + 8] AS v FROM h),
an AS (SELECT st.row_id, st.step + 1 AS gen_idx, CASE WHEN {_DOT.format(a='st.v', b='c.w')} >= 0 THEN 'True' ELSE 'False' END AS generation FROM st, coef c)
SELECT an.row_id, an.gen_idx, an.generation, st.step, round(list_reduce(st.v, lambda p, q: p + q), 6) AS total
FROM an JOIN st ON st.row_id = an.row_id""",
}


# ---------------------------------------------------------------------------
# Mixture of classifiers (rows-only: trained models)
# ---------------------------------------------------------------------------


def q_moc_grid(spark, sf):
    """Mixture grid with the experiment's settings (500 epochs)."""
    from aletheia.operators import mixture as MX

    scores, _ = MX.mixture_grid(E.cached(_prepared(spark, sf)), epochs=MX.EPOCHS)
    return E.cached(scores)


def q_best_config(spark, sf):
    from aletheia.operators import report as RP

    return RP.best_config(q_moc_grid(spark, sf))


def q_table_best(spark, sf):
    from aletheia.operators import report as RP

    scores = q_moc_grid(spark, sf)
    return RP.best_table(scores, RP.best_config(scores))


def q_table_modes(spark, sf):
    from aletheia.operators import report as RP

    rows = E.cached(_prepared(spark, sf))
    t = RP.modes_table(E.all_modes(rows), rows.select("source").distinct())
    return t.select("source", *(F.round(m, R).alias(m) for m in E.MODES))


def q_table_matrix(spark, sf):
    from aletheia.operators import report as RP

    rows = E.cached(_prepared(spark, sf))
    m, _ = E.cross_source_matrix(rows)
    return RP.matrix_table(_rounded_auc(m), E.sources_of(rows))


def q_pca_clusters(spark, sf, k=3):
    """PCA scatter data of the k-means assignment (PC1..PC3, cluster)."""
    rows = E.cached(_prepared(spark, sf)).where(F.col("part") == "train")
    _, assign = CL.kmeans_assign(rows, k)
    return _rounded_pcs(CL.pca3(assign(rows), "x", ("row_id", "cluster")), "cluster")


# Pooling grid (U1 x A9/V4): which pooling of the activations separates the
# classes best, scored by the first pooled element, best top_n per method.
POOL_GRID = [(m, n) for m in ("max", "mean", "first") for n in (1, 2, 3)]


def _pool_grid_auc(spark, sf):
    from aletheia.operators.joins import checked_broadcast_join

    p = _probe(spark, sf)
    sel = select_rows(p, None, split_seed=None)
    j = checked_broadcast_join(p.select("row_id", "hidden_states"), sel, "row_id")
    cfg = F.array(
        *[
            F.struct(F.lit(m).alias("method"), F.lit(n).alias("top_n"), _total(pool("hidden_states", m, n)).alias("score"))
            for m, n in POOL_GRID
        ]
    )
    scored = j.select("source", "y", F.explode(cfg).alias("c")).select("source", "y", "c.*")
    return A.grouped_auc(scored, ["method", "top_n", "source"], "score", "y")


def q_best_pooling(spark, sf):
    from aletheia.operators import report as RP

    b = RP.best_config(E.cached(_pool_grid_auc(spark, sf)), "method", "top_n")
    return b.select("method", "top_n", F.round("mean_auc", R).alias("mean_auc"))


def q_table_best_pooling(spark, sf):
    from aletheia.operators import report as RP

    auc = E.cached(_pool_grid_auc(spark, sf))
    t = RP.best_table(auc, RP.best_config(auc, "method", "top_n"), "method", "top_n")
    return t.select("method", "top_n", "source", F.round("auc", R).alias("auc"))


QUERIES.update(
    {
        "best_pooling": q_best_pooling,
        "table_best_pooling": q_table_best_pooling,
        "pca_clusters": q_pca_clusters,
        "moc_grid": q_moc_grid,
        "best_config": q_best_config,
        "table_best": q_table_best,
        "table_modes": q_table_modes,
        "table_matrix": q_table_matrix,
    }
)


_POOL_GRID_SQL = f"""WITH {prep_ctes(split=False)},
sel AS (SELECT row_id, source, CASE WHEN lower(label) = 'true' THEN 1 ELSE 0 END AS y, hidden_states FROM e),
g AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {n})" for m, n in POOL_GRID)}) v(method, top_n)),
sc AS (SELECT s.source, s.y, g.method, g.top_n,
    list_reduce(CASE g.method WHEN 'max' THEN {POOL_SQL['max'].format(n='g.top_n')}
      WHEN 'mean' THEN {POOL_SQL['mean'].format(n='g.top_n')} ELSE hidden_states[1] END, lambda a, b: a + b) AS score
  FROM sel s CROSS JOIN g),
{auc_sql('sc', ['method', 'top_n', 'source'], 'score')},
means AS (SELECT method, top_n, avg(auc) AS mean_auc FROM auc GROUP BY method, top_n),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method
           ORDER BY round(mean_auc, 12) DESC NULLS LAST, top_n) AS r_ FROM means) b0 WHERE r_ = 1)"""

ORACLE.update(
    {
        "best_pooling": _POOL_GRID_SQL
        + "\nSELECT method, CAST(top_n AS INTEGER) AS top_n, round(mean_auc, 6) AS mean_auc FROM best",
        "table_best_pooling": _POOL_GRID_SQL
        + """,
sc2 AS (SELECT a.method, a.top_n, a.source, a.auc FROM auc a JOIN best b ON a.method = b.method AND a.top_n = b.top_n),
labels AS (SELECT DISTINCT source FROM sc2)
SELECT b.method, CAST(b.top_n AS INTEGER) AS top_n, l.source, round(CASE WHEN s.source IS NULL THEN 0.0 ELSE s.auc END, 6) AS auc
FROM best b CROSS JOIN labels l
LEFT JOIN sc2 s ON s.method = b.method AND s.top_n = b.top_n AND s.source = l.source""",
    }
)


# ---------------------------------------------------------------------------
# Mixture forward pass with given weights (M17 hard routing, T4, F13)
# ---------------------------------------------------------------------------

MOC_FIXED = {"d": 8, "experts": 3, "seed": 8, "hidden": 64}


def _moc_fixed_params():
    from aletheia.operators import mixture as MX

    p = MX.init_params(MOC_FIXED["d"], MOC_FIXED["experts"], MOC_FIXED["seed"], MOC_FIXED["hidden"])
    # Given weights: seeded init with the router's input layer scaled up and no
    # output bias, so the selected expert depends on x (all three get rows).
    p["W1"] = p["W1"] * 20.0
    p["b2"] = p["b2"] * 0.0
    return p


def q_moc_hard_fixed(spark, sf):
    """Hard routing of the prepared test rows through a mixture with seeded
    initial weights: selected expert (router argmax, first on ties) and the
    class-1 probability of that expert."""
    from aletheia.operators import mixture as MX

    rows = _prepared(spark, sf).where(F.col("part") == "test")
    s = MX.score_mixtures(rows, {0: _moc_fixed_params()}, route="hard")
    return s.select("row_id", "selected_expert", F.round("score", R).alias("score"))


def _sql_list(a) -> str:
    if hasattr(a, "tolist"):
        a = a.tolist()
    if isinstance(a, list):
        return "[" + ", ".join(_sql_list(v) for v in a) + "]"
    return repr(float(a))


def _moc_hard_sql() -> str:
    p = _moc_fixed_params()
    d, e, h = MOC_FIXED["d"], MOC_FIXED["experts"], MOC_FIXED["hidden"]
    return f"""WITH {prep_ctes()},
prm AS (SELECT CAST({_sql_list(p['W1'])} AS DOUBLE[][]) AS W1, CAST({_sql_list(p['b1'])} AS DOUBLE[]) AS b1,
               CAST({_sql_list(p['W2'])} AS DOUBLE[][]) AS W2, CAST({_sql_list(p['b2'])} AS DOUBLE[]) AS b2,
               CAST({_sql_list(p['We'])} AS DOUBLE[][][]) AS We, CAST({_sql_list(p['be'])} AS DOUBLE[][]) AS be),
hid AS (SELECT t.row_id, t.x, list_transform(range(1, {h + 1}), lambda i: greatest(list_reduce(list_transform(range(1, {d + 1}),
          lambda j: prm.W1[i][j] * t.x[j]), lambda a, b: a + b) + prm.b1[i], 0.0)) AS hv
        FROM prep t, prm WHERE t.part = 'test'),
rt AS (SELECT hid.row_id, hid.x, list_transform(range(1, {e + 1}), lambda k: list_reduce(list_transform(range(1, {h + 1}),
          lambda i: prm.W2[k][i] * hid.hv[i]), lambda a, b: a + b) + prm.b2[k]) AS r FROM hid, prm),
sl AS (SELECT row_id, x, list_position(r, list_max(r)) AS s1 FROM rt),
zz AS (SELECT sl.row_id, sl.s1 - 1 AS sel, list_transform(range(1, 3), lambda c: list_reduce(list_transform(range(1, {d + 1}),
          lambda j: prm.We[sl.s1][c][j] * sl.x[j]), lambda a, b: a + b) + prm.be[sl.s1][c]) AS z FROM sl, prm)
SELECT row_id, CAST(sel AS INTEGER) AS selected_expert, round(1.0 / (1.0 + exp(-(z[2] - z[1]))), 6) AS score FROM zz"""


QUERIES["moc_hard_fixed"] = q_moc_hard_fixed
ORACLE["moc_hard_fixed"] = _moc_hard_sql()


# ---------------------------------------------------------------------------
# Fitted probes
# ---------------------------------------------------------------------------

# A probe's minimum is the fixed point of w = C * sum((y - sigmoid(w.x)) * x).
# At C = 1e-4 the map is a strong contraction on these rows, so a few steps
# reach it to double precision.
FIT_STEPS = 10
PROBE_SOURCES = ("src0", "src1", "src2", "src_3")  # the fixture's canonical names


def _fit_sql(train: str, test: str, planned: str, s: str = "") -> str:
    """CTEs: probes of relation ``train (m, y, x)``, scored on ``test (m, source,
    y, x)``; ``res{s}(model_id, source, auc, status)`` per row of ``planned``."""
    steps = [
        f"tr{s} AS MATERIALIZED ({train})",
        f"st{s} AS (SELECT m, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN 'ok' ELSE 'one_class' END AS fit FROM tr{s} GROUP BY m)",
        f"ft{s} AS MATERIALIZED (SELECT tr{s}.* FROM tr{s} JOIN st{s} USING (m) WHERE fit = 'ok')",
        f"w{s}_0 AS MATERIALIZED (SELECT m, list_transform(any_value(x), lambda v: CAST(0 AS DOUBLE)) AS w FROM ft{s} GROUP BY m)",
    ]
    for k in range(FIT_STEPS):
        steps.append(
            f"r{s}_{k} AS (SELECT t.m, unnest(range(len(t.x))) AS j, (t.y - {_SIG.format(a='t.x', b='w.w')}) * unnest(t.x) AS g"
            f" FROM ft{s} t JOIN w{s}_{k} w ON t.m = w.m)"
        )
        steps.append(
            f"w{s}_{k + 1} AS MATERIALIZED (SELECT m, list(w ORDER BY j) AS w FROM"
            f" (SELECT m, j, 1e-4 * sum(g) AS w FROM r{s}_{k} GROUP BY m, j) GROUP BY m)"
        )
    scored = f"sc{s} AS (SELECT t.m, t.source, t.y, {_SIG.format(a='t.x', b='w.w')} AS score FROM ({test}) t JOIN w{s}_{FIT_STEPS} w ON t.m = w.m)"
    auc = auc_sql(f"sc{s}", ["m", "source"], "score")
    for name in ("auc_a", "auc_b", "auc AS"):
        auc = auc.replace(name, name.replace("auc", f"auc{s}"))
    steps += [scored, auc]
    steps.append(
        f"""res{s} AS (SELECT p.m AS model_id, p.source, CASE WHEN st{s}.fit = 'ok' THEN a.auc END AS auc,
  CASE WHEN st{s}.fit IS NULL THEN 'no_train_rows' WHEN st{s}.fit <> 'ok' THEN st{s}.fit
       WHEN a.auc IS NULL THEN 'one_class_test' ELSE 'ok' END AS status
  FROM ({planned}) p LEFT JOIN st{s} ON st{s}.m = p.m LEFT JOIN auc{s} a ON a.m = p.m AND a.source = p.source)"""
    )
    return ",\n".join(steps)


_HOLD = """cls AS (SELECT source, y, count(*) AS n_c FROM prep GROUP BY source, y),
g1 AS (SELECT *, sum(n_c) OVER (PARTITION BY source) AS n, count(*) OVER (PARTITION BY source) AS n_classes,
         min(n_c) OVER (PARTITION BY source) AS min_c FROM cls),
g2 AS (SELECT *, CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS n_test FROM g1),
g3 AS (SELECT *, n - n_test AS n_train, CAST(n_c AS DOUBLE) / n * (n - n_test) AS cont FROM g2),
g4 AS (SELECT *, CAST(floor(cont) AS BIGINT) AS base, cont - floor(cont) AS rem FROM g3),
g5 AS (SELECT *, n_train - sum(base) OVER (PARTITION BY source) AS need,
         row_number() OVER (PARTITION BY source ORDER BY rem DESC, y) AS rr FROM g4),
alloc AS (SELECT source, y, base + CASE WHEN rr <= need THEN 1 ELSE 0 END AS n_fit,
         min_c >= 2 AND n_train >= n_classes AND n_test >= n_classes AS enough FROM g5),
rk AS (SELECT *, row_number() OVER (PARTITION BY source, y ORDER BY md5(concat('42|', CAST(row_id AS VARCHAR))), row_id) AS rn FROM prep),
hold AS MATERIALIZED (SELECT rk.*, alloc.enough, rk.rn <= alloc.n_fit AS fit FROM rk JOIN alloc ON rk.source = alloc.source AND rk.y = alloc.y),
few AS (SELECT DISTINCT source FROM hold WHERE NOT enough)"""
_START = f"WITH {prep_ctes().replace('prep AS (', 'prep AS MATERIALIZED (')}, {_SRCS}"
_FIT_ROWS = "SELECT source AS m, y, x FROM hold WHERE fit AND enough"
_ALL = _fit_sql(
    "SELECT 'all' AS m, y, x FROM prep WHERE part = 'train'",
    "SELECT 'all' AS m, source, y, x FROM prep WHERE part = 'test'",
    "SELECT 'all' AS m, source FROM srcs", "_a",
)
_LOO = _fit_sql(
    "SELECT h.source AS m, p.y, p.x FROM prep p JOIN srcs h ON h.source <> p.source",
    "SELECT source AS m, source, y, x FROM prep",
    "SELECT source AS m, source FROM srcs", "_l",
)
_SEP = _fit_sql(_FIT_ROWS, "SELECT source AS m, source, y, x FROM hold WHERE NOT fit", "SELECT source AS m, source FROM srcs", "_s")
_MATRIX = _fit_sql(
    _FIT_ROWS,
    "SELECT h.source AS m, p.source, p.y, p.x FROM hold p JOIN srcs h ON h.source <> p.source OR NOT p.fit",
    "SELECT a.source AS m, b.source FROM srcs a CROSS JOIN srcs b", "_m",
)
_INC = _fit_sql(
    "SELECT o.run * 1000 + z.i AS m, p.y, p.x FROM ord o JOIN sz z ON o.pos <= z.i JOIN prep p ON p.source = o.source",
    "SELECT o.run * 1000 + z.i AS m, p.source, p.y, p.x FROM ord o JOIN sz z ON o.pos > z.i JOIN prep p ON p.source = o.source",
    "SELECT o.run * 1000 + z.i AS m, o.source FROM ord o JOIN sz z ON o.pos > z.i", "_i",
)
_SEP_STATUS = "CASE WHEN {c} IN (SELECT source FROM few) THEN 'too_few' ELSE status END AS status"

ORACLE.update(
    {
        "eval_separate": f"""{_START}, {_HOLD},
{_SEP}
SELECT 'separate' AS mode, source, round(auc, 6) AS auc, {_SEP_STATUS.format(c='source')} FROM res_s""",
        "eval_all_vs_each": f"{_START},\n{_ALL}\nSELECT 'all_vs_each' AS mode, source, round(auc, 6) AS auc, status FROM res_a",
        "eval_loo": f"{_START},\n{_LOO}\nSELECT 'leave_one_out' AS mode, source, round(auc, 6) AS auc, status FROM res_l",
        "eval_matrix": f"""{_START}, {_HOLD},
{_MATRIX}
SELECT model_id AS train_source, source AS test_source, round(auc, 6) AS auc, {_SEP_STATUS.format(c='model_id')} FROM res_m""",
        "eval_incremental": f"""{_START}, {_ORD},
sz AS (SELECT DISTINCT pos AS i FROM ord WHERE pos < (SELECT count(*) FROM srcs)),
{_INC},
pr AS (SELECT model_id % 1000 AS train_size, avg(auc) AS mean_auc FROM res_i GROUP BY model_id)
SELECT CAST(train_size AS INTEGER) AS train_size, round(avg(mean_auc), 6) AS mean, round(stddev_pop(mean_auc), 6) AS std,
  round(avg(mean_auc) - stddev_pop(mean_auc), 6) AS lower, round(avg(mean_auc) + stddev_pop(mean_auc), 6) AS upper
FROM pr GROUP BY train_size""",
        "coef_similarity": f"""{_START}, {_HOLD},
{_MATRIX},
lw AS (SELECT m, unnest(range(len(w))) AS j, unnest(w) AS v FROM w_m_{FIT_STEPS}),
dots AS (SELECT a.m AS a, b.m AS b, sum(a.v * b.v) AS dot FROM lw a JOIN lw b ON a.j = b.j GROUP BY a.m, b.m),
nrm AS (SELECT a AS m, sqrt(dot) AS nrm FROM dots WHERE a = b)
SELECT d.a, d.b, round(coalesce(d.dot / nullif(na.nrm * nb.nrm, 0), 0), 4) AS cosine
FROM dots d JOIN nrm na ON na.m = d.a JOIN nrm nb ON nb.m = d.b""",
        "table_modes": f"""{_START}, {_HOLD},
{_SEP},
{_ALL},
{_LOO}
SELECT srcs.source, round(s.auc, 6) AS separate, round(a.auc, 6) AS all_vs_each, round(l.auc, 6) AS leave_one_out
FROM srcs LEFT JOIN res_s s ON s.source = srcs.source LEFT JOIN res_a a ON a.source = srcs.source LEFT JOIN res_l l ON l.source = srcs.source""",
        "table_matrix": f"""{_START}, {_HOLD},
{_MATRIX}
SELECT model_id AS train_source, {', '.join(f"round(max(CASE WHEN source = '{c}' THEN auc END), 6) AS {c}" for c in PROBE_SOURCES)}
FROM res_m GROUP BY model_id""",
    }
)


# ---------------------------------------------------------------------------
# PCA and k-means
# ---------------------------------------------------------------------------

# A covariance squared again and again (over its trace) tends to the projection
# on its first eigenvector; 24 squarings are its power of 16 million.
SQUARINGS = 24
_D2 = "list_reduce(list_transform(range(1, len({a}) + 1), lambda j_: ({a}[j_] - {b}[j_]) * ({a}[j_] - {b}[j_])), lambda p_, q_: p_ + q_)"
_LUCK = "-ln((('0x' || substr(md5({parts}), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def _pca_ctes(points: str, k: int = 3) -> str:
    """CTEs: ``pcs(row_id, PC1..)`` of relation ``points(row_id, x)``."""
    steps = [
        f"ln_ AS MATERIALIZED (SELECT row_id, unnest(range(len(x))) AS j, unnest(x) AS v FROM {points})",
        "mu_ AS (SELECT j, avg(v) AS m FROM ln_ GROUP BY j)",
        "cx_ AS MATERIALIZED (SELECT ln_.row_id, ln_.j, ln_.v - mu_.m AS v FROM ln_ JOIN mu_ USING (j))",
        "cov_0 AS MATERIALIZED (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM cx_ a JOIN cx_ b USING (row_id) GROUP BY a.j, b.j)",
    ]
    for p in range(k):
        last = f"cov_{p}"
        for t in range(SQUARINGS):
            steps.append(f"sq_{p}_{t} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY a.i, b.j)")
            last = f"pw_{p}_{t}"
            steps.append(f"{last} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM sq_{p}_{t} WHERE i = j) AS v FROM sq_{p}_{t})")
        steps += [
            f"dg_{p} AS (SELECT arg_max(i, v) AS i, max(v) AS v FROM {last} WHERE i = j)",
            f"un_{p} AS (SELECT m.i, m.v / sqrt(d.v) AS v FROM {last} m JOIN dg_{p} d ON m.j = d.i)",
            f"ev_{p} AS MATERIALIZED (SELECT i, v * (SELECT CASE WHEN arg_max(v, abs(v)) >= 0 THEN 1 ELSE -1 END FROM un_{p}) AS v FROM un_{p})",
            f"la_{p} AS (SELECT sum(c.v * a.v * b.v) AS v FROM cov_{p} c JOIN ev_{p} a ON a.i = c.i JOIN ev_{p} b ON b.i = c.j)",
            f"cov_{p + 1} AS MATERIALIZED (SELECT c.i, c.j, c.v - (SELECT v FROM la_{p}) * a.v * b.v AS v FROM cov_{p} c JOIN ev_{p} a ON a.i = c.i JOIN ev_{p} b ON b.i = c.j)",
        ]
    pcs = ", ".join(f"round(sum(cx_.v * e{p}.v), 6) AS PC{p + 1}" for p in range(k))
    joins = " ".join(f"JOIN ev_{p} e{p} ON e{p}.i = cx_.j" for p in range(k))
    return ",\n".join(steps) + f",\npcs AS (SELECT cx_.row_id, {pcs} FROM cx_ {joins} GROUP BY cx_.row_id)"


def _kmeans_ctes(points: str, ks: list[int]) -> str:
    """CTEs: ``fin(k, cc)``, the centres for every k over ``points(row_id, x)``."""
    seed, draw = CL.KMEANS_SEED, 2 * max(ks)
    steps = [f"ch_0 AS MATERIALIZED (SELECT row_id, x, 0 AS pos FROM {points} ORDER BY {_LUCK.format(parts=f"'{seed}|0|' || row_id")}, row_id LIMIT 1)"]
    for r in range(1, CL.ROUNDS + 1):
        luck = _LUCK.format(parts=f"'{seed}|{r}|' || row_id")
        steps += [
            f"far_{r} AS (SELECT t.row_id, any_value(t.x) AS x, min({_D2.format(a='t.x', b='c.x')}) AS far FROM {points} t, ch_{r - 1} c GROUP BY t.row_id)",
            f"dr_{r} AS (SELECT row_id, x, row_number() OVER (ORDER BY {luck} / far, row_id) AS o FROM far_{r} WHERE far > 0)",
            f"ch_{r} AS MATERIALIZED (SELECT * FROM ch_{r - 1} UNION ALL SELECT row_id, x, {1 + (r - 1) * draw} + o - 1 FROM dr_{r} WHERE o <= {draw})",
        ]
    last = f"ch_{CL.ROUNDS}"
    near = f"min(struct_pack(d := {_D2.format(a='t.x', b='c.x')}, p := c.pos)).p"
    cc_far = f"coalesce(list_min(list_transform(p.cc, lambda z: {_D2.format(a='c.x', b='z')})), 1)"
    luck = _LUCK.format(parts=f"'{seed}|' || p.k || '|' || p.t || '|' || c.row_id")
    steps += [
        f"nr_ AS (SELECT t.row_id, {near} AS pos FROM {points} t, {last} c GROUP BY t.row_id)",
        f"cand AS MATERIALIZED (SELECT c.*, w.w FROM {last} c JOIN (SELECT pos, count(*) AS w FROM nr_ GROUP BY pos) w USING (pos))",
        f"""pick AS (SELECT k, 0 AS t, []::DOUBLE[][] AS cc FROM (VALUES {', '.join(f'({k})' for k in ks)}) v(k)
  UNION ALL SELECT p.k, p.t + 1, list_append(any_value(p.cc), min(struct_pack(key := {luck} / (c.w * {cc_far}), pos := c.pos, x := c.x)).x)
  FROM pick p, cand c WHERE p.t < p.k AND {cc_far} > 0 GROUP BY p.k, p.t)""",
        f"""st_ AS (SELECT {CL.KMEANS_TOL} * avg(v) AS stop FROM (SELECT j, var_pop(v) AS v
  FROM (SELECT unnest(range(len(x))) AS j, unnest(x) AS v FROM {points}) GROUP BY j))""",
        f"""lloyd AS (SELECT k, 0 AS step, cc, 1e300::DOUBLE AS moved FROM pick WHERE t = k
  UNION ALL SELECT k, step + 1, cc2, list_sum(list_transform(range(1, k + 1), lambda i: {_D2.format(a='cc2[i]', b='cc[i]')})) FROM (
    SELECT k, step, cc, list_transform(range(1, k + 1), lambda i: coalesce(mp[i], cc[i])) AS cc2 FROM (
      SELECT k, step, cc, map(list(ci), list(m)) AS mp FROM (
        SELECT k, step, cc, ci, list(m ORDER BY j) AS m FROM (
          SELECT k, step, cc, ci, j, avg(v) AS m FROM (
            SELECT k, step, cc, list_position(ds, list_min(ds)) AS ci, unnest(range(len(x))) AS j, unnest(x) AS v FROM (
              SELECT l.k, l.step, l.cc, t.x, list_transform(l.cc, lambda c: {_D2.format(a='t.x', b='c')}) AS ds
              FROM lloyd l, {points} t WHERE l.moved > (SELECT stop FROM st_) AND l.step < {CL.KMEANS_MAX_ITER}))
          GROUP BY k, step, cc, ci, j) GROUP BY k, step, cc, ci) GROUP BY k, step, cc)))""",
        "fin AS MATERIALIZED (SELECT k, arg_max(cc, step) AS cc FROM lloyd GROUP BY k)",
    ]
    return ",\n".join(steps)


_NEAREST = f"list_position(list_transform(fin.cc, lambda c: {_D2.format(a='p.x', b='c')}), list_min(list_transform(fin.cc, lambda c: {_D2.format(a='p.x', b='c')}))) - 1"
_TRAIN_POINTS = "tp AS MATERIALIZED (SELECT row_id, y, x FROM prep WHERE part = 'train')"
_PREP_R = f"WITH RECURSIVE {prep_ctes().replace('prep AS (', 'prep AS MATERIALIZED (')}, {_TRAIN_POINTS}"


def _swept(ks: list[int]) -> str:
    return f"""{_PREP_R},
{_kmeans_ctes("tp", ks)},
asg AS MATERIALIZED (SELECT p.part, p.y, p.x, fin.k, 'k' || fin.k || ':c' || ({_NEAREST}) AS m FROM prep p, fin),
{_fit_sql("SELECT m, y, x FROM asg WHERE part = 'train'", "SELECT m, '' AS source, y, x FROM asg", "SELECT DISTINCT m, '' AS source FROM asg", "_k")}"""


ORACLE.update(
    {
        "pca3": f"{_PREP_R},\n{_pca_ctes('tp')}\nSELECT pcs.*, tp.y FROM pcs JOIN tp USING (row_id)",
        "pca_clusters": f"""{_PREP_R},
{_kmeans_ctes('tp', [3])},
{_pca_ctes('tp')}
SELECT pcs.*, CAST({_NEAREST} AS INTEGER) AS cluster FROM pcs JOIN tp p USING (row_id), fin""",
        "cluster_members": f"""{_PREP_R},
{_kmeans_ctes('tp', [3])},
a AS (SELECT p.row_id, CAST({_NEAREST} AS INTEGER) AS cluster FROM tp p, fin)
SELECT CAST(c.cluster AS INTEGER) AS cluster, count(a.row_id) AS n, coalesce(list(a.row_id ORDER BY a.row_id) FILTER (a.row_id IS NOT NULL), []) AS row_ids
FROM range(3) c(cluster) LEFT JOIN a ON a.cluster = c.cluster GROUP BY c.cluster""",
        "cluster_models": f"{_swept([3])}\nSELECT m AS model_id, CAST(unnest(range(len(w))) AS INTEGER) AS dim, round(unnest(w), 6) AS value FROM w_k_{FIT_STEPS}",
        "kmeans_sweep": f"""{_swept([1, 2, 3, 4, 5, 6])},
rs AS (SELECT a.k, a.part, a.y, CASE WHEN w.w IS NULL THEN 0.0 ELSE {_SIG.format(a='a.x', b='w.w')} END AS score
       FROM asg a LEFT JOIN w_k_{FIT_STEPS} w ON w.m = a.m),
{auc_sql('rs', ['k', 'part'], 'score').replace('auc_a', 'auc_ra').replace('auc_b', 'auc_rb').replace('auc AS', 'auc_r AS')}
SELECT k AS num_clusters, round(max(CASE WHEN part = 'train' THEN auc END), 6) AS roc_auc_train,
  round(max(CASE WHEN part = 'test' THEN auc END), 6) AS roc_auc_test FROM auc_r GROUP BY k""",
    }
)


# ---------------------------------------------------------------------------
# Mixture: soft forward with noise (F14, M16), mini-batch training
# ---------------------------------------------------------------------------


def q_moc_soft_fixed(spark, sf):
    """The Gumbel-soft forward of the given mixture, as column expressions."""
    from aletheia.operators import mixture as MX

    rows = _prepared(spark, sf).where(F.col("part") == "test")
    s = MX.score_mixtures_sql(rows, {0: _moc_fixed_params()}, route="gumbel")
    return s.select("row_id", F.round("score", R).alias("score"))


def _noise_ctes(rows: str, experts: int) -> str:
    """CTEs: ``noise(row_id, g)``, the Gumbel draws of a scoring pass."""
    from aletheia.functions import noise as N

    word = "18446744073709551616::UHUGEINT"
    base = (7919 * N.SEED_STEP) % (1 << 64)  # epoch -1 adds nothing

    def mix(s, source, keep):
        half = lambda k, c: f"(xor(z::UBIGINT, (z // {1 << k})::UBIGINT)::UHUGEINT * {c}::UHUGEINT) % {word}"
        return [
            f"{s}_1 AS (SELECT {keep}, {half(30, N.MIX_1)} AS z FROM {source})",
            f"{s}_2 AS (SELECT {keep}, {half(27, N.MIX_2)} AS z FROM {s}_1)",
            f"{s}_3 AS (SELECT {keep}, xor(z::UBIGINT, (z // {1 << 31})::UBIGINT)::UHUGEINT AS z FROM {s}_2)",
        ]

    eps = f"{N.EPS}::DOUBLE"
    return ",\n".join([
        f"nr_0 AS (SELECT row_id, ({base}::UHUGEINT + (row_id::UHUGEINT * {N.ROW_STEP}::UHUGEINT) % {word}) % {word} AS z FROM {rows})",
        *mix("nr", "nr_0", "row_id"),
        f"ne_0 AS (SELECT row_id, k, (z + (k::UHUGEINT * {N.EXPERT_STEP}::UHUGEINT) % {word}) % {word} AS z FROM nr_3, range({experts}) t(k))",
        *mix("ne", "ne_0", "row_id, k"),
        "nu AS (SELECT row_id, k, (z // 2048)::UBIGINT::DOUBLE / 9007199254740992::DOUBLE AS u FROM ne_3)",
        f"noise AS (SELECT row_id, list(-ln(-ln(u + {eps}) + {eps}) ORDER BY k) AS g FROM nu GROUP BY row_id)",
    ])


def _moc_soft_sql() -> str:
    d, e = MOC_FIXED["d"], MOC_FIXED["experts"]
    head = _moc_hard_sql().split(",\nsl AS (")[0]  # up to the router's logits
    return f"""{head},
{_noise_ctes("(SELECT row_id FROM prep WHERE part = 'test')", e)},
sf AS (SELECT rt.row_id, rt.x, list_transform(range(1, {e + 1}), lambda k: rt.r[k] + noise.g[k]) AS s FROM rt JOIN noise USING (row_id)),
sw AS (SELECT row_id, x, list_transform(s, lambda v: exp(v - list_max(s))) AS ex FROM sf),
zz AS (SELECT sw.row_id, list_transform(range(1, 3), lambda c: list_reduce(list_transform(range(1, {e + 1}), lambda k:
          ex[k] / list_sum(ex) * (list_reduce(list_transform(range(1, {d + 1}), lambda j: prm.We[k][c][j] * sw.x[j]), lambda a, b: a + b) + prm.be[k][c])),
          lambda a, b: a + b)) AS z FROM sw, prm)
SELECT row_id, round(1.0 / (1.0 + exp(-(z[2] - z[1]))), 6) AS score FROM zz"""


MOC_TRAIN = {"epochs": 3, "batch_size": 64, "lr": 0.5, "weight_decay": 1e-2, "seed": 4}


def q_moc_train_fixed(spark, sf):
    """Mini-batch training of a mixture of one expert (the router's weight is 1,
    so SQL can follow): the expert's weights, one row per element."""
    from aletheia.operators import mixture as MX

    rows = _prepared(spark, sf).where(F.col("part") == "train")
    t = MOC_TRAIN
    params, _ = MX.train_mixtures(rows, [(0, 1, t["weight_decay"], t["lr"])], epochs=t["epochs"], seed=t["seed"], batch_size=t["batch_size"])
    expert = MX.params_table(spark, {0: {k: params[0][k] for k in ("We", "be")}})
    return expert.select("name", F.posexplode("values").alias("pos", "value")).withColumn("value", F.round("value", R))


#: Batches that the SQL is written out for; more rows than that give would need more.
_TRAIN_BATCHES = 64


def _moc_train_sql() -> str:
    from aletheia.operators import mixture as MX

    t, d = MOC_TRAIN, 8
    p = MX.init_params(d, 1, t["seed"])
    start = [[*p["We"][0][c], p["be"][0][c]] for c in (0, 1)]
    steps = [
        f"n_ AS (SELECT count(*) AS n, CAST(ceil(count(*) / {t['batch_size']}.0) AS BIGINT) AS nb FROM prep WHERE part = 'train')",
        "tr AS MATERIALIZED (SELECT row_id, y, list_append(x, 1::DOUBLE) AS v FROM prep WHERE part = 'train')",
        f"p_0 AS (SELECT CAST({_sql_list(start[0])} AS DOUBLE[]) AS a, CAST({_sql_list(start[1])} AS DOUBLE[]) AS b)",
    ]
    k = 0
    for epoch in range(t["epochs"]):
        lr = MX.cosine_lr(t["lr"], epoch, t["epochs"])
        steps.append(
            f"e_{epoch} AS MATERIALIZED (SELECT y, v, ('0x' || substr(md5('{t['seed']}|{epoch}|' || row_id), 1, 13))::BIGINT % nb AS batch FROM tr, n_)"
        )
        for batch in range(_TRAIN_BATCHES):
            dots = [_DOT.format(a=f"p_{k}.{w}", b="e.v") for w in ("b", "a")]
            steps.append(
                f"g_{k} AS (SELECT list(g ORDER BY j) AS g FROM (SELECT j, avg(r * x) AS g FROM (SELECT unnest(range({d + 1})) AS j, unnest(e.v) AS x,"
                f" 1.0 / (1.0 + exp(-({dots[0]} - {dots[1]}))) - e.y AS r FROM e_{epoch} e, p_{k} WHERE e.batch = {batch}) GROUP BY j))"
            )
            move = lambda w, sign: (
                f"CASE WHEN g IS NULL THEN {w} ELSE list_transform(range(1, {d + 2}), lambda i: {w}[i] - {lr!r}::DOUBLE * ({sign}g[i] + {t['weight_decay']}::DOUBLE * {w}[i])) END AS {w}"
            )
            steps.append(f"p_{k + 1} AS MATERIALIZED (SELECT {move('a', '-')}, {move('b', '')} FROM p_{k}, g_{k})")
            k += 1
    return f"""WITH {prep_ctes().replace('prep AS (', 'prep AS MATERIALIZED (')},
{', '.join(steps)}
SELECT 'We' AS name, CAST(unnest(range({2 * d})) AS INTEGER) AS pos, round(unnest(list_concat(a[1:{d}], b[1:{d}])), 6) AS value FROM p_{k}
UNION ALL SELECT 'be', CAST(unnest(range(2)) AS INTEGER), round(unnest([a[{d + 1}], b[{d + 1}]]), 6) FROM p_{k}"""


QUERIES.update({"moc_soft_fixed": q_moc_soft_fixed, "moc_train_fixed": q_moc_train_fixed})
ORACLE.update({"moc_soft_fixed": _moc_soft_sql(), "moc_train_fixed": _moc_train_sql()})


# ---------------------------------------------------------------------------
# The evaluators over real sources: classes of one kind, sources too small
# ---------------------------------------------------------------------------

NATURAL_CTE = """probe AS (
  SELECT d.doc_id AS row_id, concat('d', CAST(d.doc_id AS VARCHAR)) AS Question, 'a' AS Answer, d.source,
    CASE WHEN l.toxic = 1 THEN 'True' ELSE 'False' END AS label,
    list_transform(range(8), lambda i: CAST(e.embedding AS DOUBLE[])[i*8+1 : i*8+8]) AS hidden_states
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN embeddings e ON d.doc_id = e.vec_id)"""


def _natural(spark, sf):
    return E.cached(probe_set(fixtures.natural(spark, sf, "toxic"), sample_size=None))


def _natural_query(mode):
    def q(spark, sf):
        return _rounded_auc(E.roc_auc_for_group(_natural(spark, sf), mode))

    return q


def q_auc_by_natural_source(spark, sf):
    a = A.grouped_auc(_natural(spark, sf).withColumn("score", _total("x")), ["source"], "score", "y")
    return a.select("source", "n_pos", "n_neg", F.round("auc", R).alias("auc"))


QUERIES.update({
    "eval_separate_natural": _natural_query("separate"),
    "eval_all_vs_each_natural": _natural_query("all_vs_each"),
    "eval_loo_natural": _natural_query("leave_one_out"),
    "auc_by_natural_source": q_auc_by_natural_source,
})
ORACLE.update({
    f"{name}_natural": ORACLE[name].replace(PROBE_CTE, NATURAL_CTE) for name in ("eval_separate", "eval_all_vs_each", "eval_loo")
})
ORACLE["auc_by_natural_source"] = ORACLE["auc_by_source"].replace(PROBE_CTE, NATURAL_CTE)
