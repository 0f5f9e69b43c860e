"""Generation tables: in-row de-duplication, judge prompts, label write-back
and the classification set (W5, F6, J1, J2, X1).

The reference keeps N generations as wide columns ``Generation_1..N``.  Here
the table at rest is long, ``(row_id, gen_idx, generation, ...)``, so the
schema does not depend on N; ``sources.parquet.wide_generations`` pivots for
output.  A row's generations are at most N (20), so grouping by row_id is
never skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aletheia.functions.text import judge_prompt, strip_ws


# Bytes of a labelled row without its vectors, for the broadcast check.
LABELLED_ROW_BYTES = 256


def dedup_in_row(long_df: DataFrame, id_col: str = "row_id", col: str = "generation") -> DataFrame:
    """W5 (long form): within a row, a generation whose stripped text already
    appeared at a smaller gen_idx becomes NULL; the first keeps its original
    text.  Empty strings are values; NULLs stay NULL."""
    key = strip_ws(col)
    w = Window.partitionBy(id_col, key).orderBy("gen_idx")
    first = F.row_number().over(w) == 1
    return long_df.withColumn(col, F.when(F.col(col).isNotNull() & first, F.col(col)))


def dedup_in_row_wide(wide_df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """W5 (wide form): same rule on ``Generation_1..N`` columns of one row,
    with array functions only (no shuffle)."""
    g = F.array(*[F.col(c) for c in cols])
    t = F.transform(g, lambda x: strip_ws(x))
    kept = F.transform(g, lambda x, i: F.when(F.array_position(t, F.get(t, i)) == i + 1, x))
    cols = list(cols)
    tmp = wide_df.withColumn("__kept", kept)
    return tmp.select(*[F.col("__kept")[cols.index(c)].alias(c) if c in cols else F.col(c) for c in wide_df.columns])


def judge_prompts(long_df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """``(row_id, gen_idx, prompt)`` for every non-NULL generation whose
    Answer is not NULL (the reference raises on a NULL Answer)."""
    return long_df.where(F.col("generation").isNotNull() & F.col("Answer").isNotNull()).select(
        id_col, "gen_idx", judge_prompt("Answer", "generation").alias("prompt")
    )


def write_back(long_df: DataFrame, responses: DataFrame, id_col: str = "row_id", label_col: str = "label") -> DataFrame:
    """Attach responses by (row_id, gen_idx); rows without one keep NULL."""
    r = responses.select(id_col, "gen_idx", F.col("response").alias(label_col))
    return long_df.join(r, [id_col, "gen_idx"], "left")


def classification_set(labelled: DataFrame, activations: DataFrame, id_col: str = "row_id") -> DataFrame:
    """X1 (inferred bridge): labelled generations joined to their own
    activations by (row_id, gen_idx), keeping rows with a label.

    Late materialisation: the labelled ids are found first (written once, without
    vectors) and counted.  A small set is broadcast into the scan of the
    activations; a large one sends its bitmap there (``joins.keep_members``), so
    that only vectors that have a label are shuffled, in the last join."""
    from aletheia.operators import joins
    from aletheia.session import materialize

    keys = [id_col, "gen_idx"]
    lab = materialize(labelled.where(F.col("label").isNotNull()).drop("hidden_states"))
    acts = activations.select(*keys, "hidden_states")
    n = lab.count()
    if n <= joins.BROADCAST_MAX_ROWS and n * LABELLED_ROW_BYTES <= joins.BROADCAST_MAX_BYTES:
        out = acts.join(F.broadcast(lab), keys)
    else:
        out = joins.keep_members(acts, lab.select(*keys), keys, n).join(lab, keys)
    return out.select(*lab.columns, "hidden_states")
