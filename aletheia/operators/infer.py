"""Batch inference over partitions (U2 generation, U3 annotation).

``batch_infer`` runs a user-supplied batch function with ``mapInPandas``:
Arrow batches in, the function called on chunks of ``batch_size`` rows, its
result columns out.  The function is built once per task by ``make_fn`` (load
a model or open a client there), never shipped per row.  A chunk that raises
is retried row by row so one bad input gives a NULL output plus an ``error``
text while the rest of the run continues (the reference recorded None for a
failed call).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aletheia.functions.text import echo_answer, generation_prompt
from aletheia.session import materialize

BatchFn = Callable[[pd.DataFrame], pd.DataFrame]


def freeze(df: DataFrame) -> DataFrame:
    """Materialise model outputs once.

    Generators and judges are expensive and usually non-deterministic
    (sampling, remote calls): re-running them on a second action or after a
    lost executor could change answers.  A reliable checkpoint writes the
    outputs to the shared checkpoint folder; a cluster session without one
    raises (a lost block must not ask a paid model again)."""
    return materialize(df)


def batch_infer(
    df: DataFrame,
    make_fn: Callable[[], BatchFn],
    output: T.StructType,
    keep: Sequence[str] = ("row_id", "gen_idx"),
    batch_size: int = 16,
) -> DataFrame:
    """Apply ``make_fn()`` to chunks of ``df``; output = ``keep`` columns +
    ``output`` fields + ``error`` string."""
    keep = [c for c in keep if c in df.columns]
    in_fields = {f.name: f for f in df.schema.fields}
    out_schema = T.StructType([in_fields[c] for c in keep] + list(output.fields) + [T.StructField("error", T.StringType())])
    out_names = [f.name for f in output.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_fn()
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start : start + batch_size].reset_index(drop=True)
                try:
                    res = fn(chunk).reset_index(drop=True)
                    res["error"] = None
                except Exception:  # isolate the failing rows
                    parts = []
                    for i in range(len(chunk)):
                        one = chunk.iloc[[i]].reset_index(drop=True)
                        try:
                            r = fn(one).reset_index(drop=True)
                            r["error"] = None
                        except Exception as exc:  # noqa: BLE001 - recorded per row
                            r = pd.DataFrame({n: [None] for n in out_names})
                            r["error"] = [f"{type(exc).__name__}: {exc}"]
                        parts.append(r)
                    res = pd.concat(parts, ignore_index=True)
                out = chunk[keep].copy()
                for n in out_names + ["error"]:
                    out[n] = res[n].values
                yield out

    return df.mapInPandas(run, out_schema)


def generate(
    questions: DataFrame,
    make_generator: Callable[[], BatchFn],
    n_generations: int = 20,
    batch_size: int = 16,
    keep: Sequence[str] = ("row_id", "Question", "Answer", "source"),
) -> DataFrame:
    """N generations per question.  The generator receives ``prompt`` and
    ``gen_idx`` and returns ``decoded`` (prompt + answer text) and
    ``hidden_states`` (steps × dim); the answer is the text after the echoed
    prompt (F7).  Output: long ``(keep..., gen_idx, generation, hidden_states, error)``."""
    keep = [c for c in keep if c in questions.columns]
    long_q = questions.select(
        *keep, F.explode(F.sequence(F.lit(1), F.lit(n_generations))).alias("gen_idx")
    ).withColumn("prompt", generation_prompt("Question"))
    out = T.StructType(
        [
            T.StructField("decoded", T.StringType()),
            T.StructField("hidden_states", T.ArrayType(T.ArrayType(T.DoubleType()))),
        ]
    )
    res = freeze(batch_infer(long_q, make_generator, out, keep=[*keep, "gen_idx", "prompt"], batch_size=batch_size))
    return res.withColumn("generation", echo_answer("decoded", "prompt")).select(
        *keep, "gen_idx", "generation", "hidden_states", "error"
    )


# Prompts that one task of an annotation asks about.
PROMPTS_PER_TASK = 512


def annotate(
    prompts: DataFrame,
    make_labeller: Callable[[], BatchFn],
    batch_size: int = 16,
) -> DataFrame:
    """One call per distinct prompt text (duplicates share the answer),
    joined back to every ``(row_id, gen_idx)``: ``(row_id, gen_idx, response, error)``.

    Prompts are told apart and joined by a 256-bit digest, so the join moves no
    texts; the calls are spread by the number of distinct prompts, not by the
    partitions that the ``distinct`` happens to leave."""
    keyed = prompts.withColumn("__key", F.sha2("prompt", 256))
    distinct = materialize(keyed.where(F.col("__key").isNotNull()).groupBy("__key").agg(F.min("prompt").alias("prompt")))
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // PROMPTS_PER_TASK))
    out = T.StructType([T.StructField("response", T.StringType())])
    answered = freeze(batch_infer(distinct.repartition(tasks, "__key"), make_labeller, out, keep=["__key"], batch_size=batch_size))
    return keyed.join(answered, "__key", "left").select("row_id", "gen_idx", "response", "error")
