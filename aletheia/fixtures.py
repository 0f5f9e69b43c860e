"""Datasets in the reference's shapes, derived by Spark from the driver tables.

The reference ships no data; these builders turn the generated tables into
the inputs its code expects (schemas in FIXTURES.md).  Every derivation is a
plain projection/join over whole tables, so the work grows with the data.

* ``probe``     — the classification set (Question, Answer, source, label,
                  hidden_states) from ``embeddings``.
* ``natural``   — a probe set with 20 real source names and single-class
                  sources, from ``documents ⋈ labels ⋈ embeddings``.
* ``gens``      — long generations from ``events`` (NULLs, stray spaces,
                  many in-row repeats).
* ``questions`` — question table for batch generation, from ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from aletheia.sources.parquet import table


def _hidden_states_from_embedding(emb: str, n_steps) -> F.Column:
    """64 floats -> ``n_steps`` steps of 8 dims (array<array<double>>)."""
    e = F.col(emb).cast("array<double>")
    return F.transform(F.sequence(F.lit(0), n_steps - 1), lambda i: F.slice(e, i * 8 + 1, 8))


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    k = F.when(F.col("vec_id") % 10 == 9, F.col("vec_id") - 1).otherwise(F.col("vec_id"))
    split_word = F.when(F.col("vec_id") % 3 == 0, "_train").when(F.col("vec_id") % 3 == 1, "_dev").otherwise("_test")
    source = F.when(F.col("vec_id") % 4 == 3, F.lit("src_3")).otherwise(
        F.concat(F.lit("src"), (F.col("vec_id") % 4).cast("string"), split_word)
    )
    label = (
        F.when(F.col("label") < 5, "False").when(F.col("vec_id") % 20 == 0, "TRUE").otherwise("True")
    )
    n_steps = F.when(F.col("vec_id") % 11 == 0, F.lit(2)).otherwise(F.lit(8))
    return e.select(
        F.col("vec_id").alias("row_id"),
        F.concat(F.lit("q"), k.cast("string")).alias("Question"),
        F.concat(F.lit("a"), (k % 7).cast("string")).alias("Answer"),
        source.alias("source"),
        label.alias("label"),
        _hidden_states_from_embedding("embedding", n_steps).alias("hidden_states"),
    )


def natural(spark: SparkSession, sf_dir: str, target: str = "quality") -> DataFrame:
    """documents ⋈ labels ⋈ embeddings: 20 sources, y from ``quality``/``toxic``."""
    d = table(spark, sf_dir, "documents", ["doc_id", "source"])
    lab = table(spark, sf_dir, "labels", ["doc_id", target])
    e = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    j = d.join(lab, "doc_id").join(e, F.col("doc_id") == F.col("vec_id"))
    return j.select(
        F.col("doc_id").alias("row_id"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("Question"),
        F.lit("a").alias("Answer"),
        F.col("source"),
        F.when(F.col(target) == 1, "True").otherwise("False").alias("label"),
        _hidden_states_from_embedding("embedding", F.lit(8)).alias("hidden_states"),
    )


def labelled(spark: SparkSession, sf_dir: str, target: str = "quality") -> DataFrame:
    """documents ⋈ labels: every labelled document, no vectors."""
    d = table(spark, sf_dir, "documents", ["doc_id", "source"])
    j = d.join(table(spark, sf_dir, "labels", ["doc_id", target]), "doc_id")
    return j.select(F.col("doc_id").alias("row_id"), "source", F.when(F.col(target) == 1, "True").otherwise("False").alias("label"))


def gens(spark: SparkSession, sf_dir: str, n_generations: int = 20) -> DataFrame:
    """Long generations ``(row_id, Question, Answer, gen_idx, generation)``.

    Every event is one generation: blocks of ``n_generations`` consecutive
    event ids form one question (row_id = event_id div N, gen_idx = event_id
    mod N + 1), so the whole table is used and no per-user window is needed.
    Generations carry NULLs and stray spaces; answers vary in case/spacing.
    """
    ev = table(spark, sf_dir, "events", ["event_id", "event_type"])
    row_id = F.floor(F.col("event_id") / F.lit(n_generations)).cast("long")
    answer = F.when(row_id % 3 == 0, " Click ").when(row_id % 3 == 1, "VIEW").otherwise("purchase")
    generation = (
        F.when(F.col("event_id") % 17 == 0, F.lit(None).cast("string"))
        .when(F.col("event_id") % 5 == 0, F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")))
        .otherwise(F.col("event_type"))
    )
    return ev.select(
        row_id.alias("row_id"),
        F.concat(F.lit("q"), row_id.cast("string")).alias("Question"),
        answer.alias("Answer"),
        (F.col("event_id") % n_generations + 1).cast("int").alias("gen_idx"),
        generation.alias("generation"),
    )


def activations(spark: SparkSession, sf_dir: str, n_generations: int = 20) -> DataFrame:
    """Activations of the generations of ``gens``: vector ``vec_id`` belongs to the
    event of the same number, ``(row_id, gen_idx, hidden_states)``."""
    e = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return e.select(
        F.floor(F.col("vec_id") / F.lit(n_generations)).cast("long").alias("row_id"),
        (F.col("vec_id") % n_generations + 1).cast("int").alias("gen_idx"),
        _hidden_states_from_embedding("embedding", F.lit(8)).alias("hidden_states"),
    )


def responses(spark: SparkSession, sf_dir: str, n_generations: int = 20) -> DataFrame:
    """Given answers of a judge: the labelled documents' marks, document
    ``doc_id`` standing for the event of the same number."""
    lab = table(spark, sf_dir, "labels", ["doc_id", "quality"])
    return lab.select(
        F.floor(F.col("doc_id") / F.lit(n_generations)).cast("long").alias("row_id"),
        (F.col("doc_id") % n_generations + 1).cast("int").alias("gen_idx"),
        F.when(F.col("quality") == 1, "True").otherwise("False").alias("response"),
    )


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose text is a vector as JSON: ``(row_id, Question)``."""
    e = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return e.select(F.col("vec_id").alias("row_id"), F.to_json(F.col("embedding").cast("array<double>")).alias("Question"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question table ``(row_id, Question, Answer, source)`` from documents (whole texts)."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return d.select(
        F.col("doc_id").alias("row_id"),
        F.col("text").alias("Question"),
        F.col("lang").alias("Answer"),
        F.col("source"),
    )
