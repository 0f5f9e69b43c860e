"""Corpus pipeline: five stages over ``documents``, each written and read again.

toxicity -> n-gram Jaccard join -> benchmark decontamination -> secret scans ->
best-fit packing.  The first four return the columns of ``documents``; toxic
documents, all but one document of each near-duplicate group and documents that
hold a benchmark item go, secrets are replaced in place; the last returns the
packed pieces.  No SQL equivalent: a fitted model, components and packing.

Null and empty texts are clean, alike to none, leak nothing and are packed as one
end token each.  Rows that repeat a doc_id are judged each by its own text, but
for the near-duplicate stage, which keeps or drops a doc_id as a whole; rows
without a doc_id all pass it.  Other columns stay up to the last stage.  Without
labels nothing is toxic; an empty table gives an empty result.
"""

from aletheia.llm import decontaminate, jaccard, packing, secrets, toxicity
from aletheia.llm.common import stored, table

ORACLE_SQL = None


def reject_toxic(spark, docs, sf_dir):
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def keep_one_of_group(spark, docs, sf_dir):
    """Five-word shingles, similarity 0.8 or more."""
    return jaccard.keep_one(docs)


def drop_benchmark_leaks(spark, docs, sf_dir):
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark, docs, sf_dir):
    return secrets.redact(docs)


def pack_sequences(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_group),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
