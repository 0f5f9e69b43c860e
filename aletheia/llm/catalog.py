"""Queries of the operators over whole tables, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aletheia.llm import chat, decontaminate, fim, jaccard, licenses, manifest, packing, quality, secrets, shards, suffix_dedup, topk, toxicity
from aletheia.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts imitate the marks."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return chat.digests(rows.unionByName(extra))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("n_lines", "bad_lines")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op9_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85).drop("n_links_verified")


def op11_merkle_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's leaf and proof; rows of every seventh id checksum are folded
    with ``n_chars`` one too high."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(tampered, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))
    return manifest.verify(manifest.manifest(table(spark, sf_dir, "documents"), altered={"n_chars": n_chars}))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_suffix_array_dedup, op3_chat_formatting, op4_toxicity, op5_quality_classifier, op6_license_scans,
    op7_benchmark_decontamination, op8_secret_scans, op9_exact_top_k_search,
    op10_ngram_jaccard_join, op11_merkle_dataset_manifest, op12_fill_in_middle, op13_sharding,
)}

#: crc32 as SQL: the byte table of the reflected polynomial, and its use on a text.
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
          CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS tab)"""


def _crc32(text: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def _encoded(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _row_digest(n_chars: str = "n_chars") -> str:
    return "sha256(" + " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _merkle(s: str, leaves: str, walkers: str) -> str:
    """CTEs: every node over ``leaves(tree, i, m, d)``, and the walk of each of
    ``walkers(tree, i, m, id, folded)`` up to the root (proof, folded digest)."""
    return f"""node{s} AS (
          SELECT tree, 0 AS level, i, m, d FROM {leaves}
          UNION ALL
          SELECT tree, level + 1, i // 2, (m + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM node{s} WHERE m > 1 GROUP BY tree, level, i // 2, m),
        walk{s} AS (
          SELECT tree, id, 0 AS level, i, m, '' AS proof, folded FROM {walkers}
          UNION ALL
          SELECT w.tree, w.id, w.level + 1, w.i // 2, (w.m + 1) // 2, w.proof || coalesce(n.d, ''),
                 sha256(CASE WHEN w.i % 2 = 0 THEN w.folded || coalesce(n.d, '') ELSE n.d || w.folded END)
          FROM walk{s} w LEFT JOIN node{s} n ON n.tree = w.tree AND n.level = w.level AND n.i = xor(w.i, 1::BIGINT) WHERE w.m > 1)"""


ORACLE = {
    "op3_chat_formatting": """
        WITH rows AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        marked AS (
          SELECT *, length(text) + length(text) - length(translate(text, '~<|[', '')) + length(role)
                 + length(role) - length(translate(role, '~<|[', '')) + 8 AS formatted,
            lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM rows),
        ordered AS (
          SELECT *, CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                    WHEN 'assistant' THEN coalesce(before = 'user', false) ELSE false END AS legal FROM marked)
        SELECT conv_id, count(*) AS n_turns, bool_and(legal) AS valid, min(turn) FILTER (NOT legal) AS first_bad_turn,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
          sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
          sum(formatted)::BIGINT AS formatted_chars
        FROM ordered GROUP BY conv_id""",
    "op9_exact_top_k_search": """
        WITH v AS (
          SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
        w AS (SELECT vec_id, list_transform(e, lambda x: floor(256 * x)) AS e FROM v),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM w q JOIN w c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op11_merkle_dataset_manifest": f"""
        WITH RECURSIVE {_CRC_TABLE},
        l AS (SELECT *, row_number() OVER () AS id, coalesce('=' || lang, '-') AS tree, {_row_digest()} AS d,
                CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_row_digest("(n_chars + 1)")} END AS other FROM documents, crc),
        leaf AS (SELECT id, doc_id, tree, d, coalesce(other, d) AS folded,
                   row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY tree) AS m FROM l),
        {_merkle("", "leaf", "leaf")},
        sub AS (SELECT '' AS tree, tree AS name, d, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS m FROM node WHERE m = 1),
        inner_ AS (SELECT sub.tree, sub.i, sub.m, walk.id, walk.folded FROM walk JOIN sub ON sub.name = walk.tree WHERE walk.m = 1),
        {_merkle("_top", "sub", "inner_")}
        SELECT leaf.doc_id, leaf.d AS leaf, sub.d AS subroot, r.d AS root, sha256(w.proof || t.proof) AS proof_sha256,
          t.folded AS folded_root, t.folded = r.d AS verified
        FROM leaf JOIN sub ON sub.name = leaf.tree JOIN walk w ON w.id = leaf.id AND w.m = 1 JOIN walk_top t ON t.id = leaf.id AND t.m = 1
        JOIN node_top r ON r.m = 1""",
    "op12_fill_in_middle": """
        WITH t AS (
          SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || doc_id) AS h,
                 regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units FROM documents),
        g AS (SELECT *, len(units) AS n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS d FROM t),
        c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b FROM g),
        p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf,
                CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') THEN 'plain'
                     WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
        SELECT doc_id, n::BIGINT AS n, form,
          CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                 ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
          sha256(x) AS restored_sha256 FROM p""",
    "op13_sharding": f"""
        WITH {_CRC_TABLE},
        t AS (SELECT doc_id, source AS stratum, (strlen(coalesce(text, '')) + 8)::BIGINT AS size, {_crc32("coalesce(text, '')")}::BIGINT AS text_crc32
              FROM documents, crc),
        r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('13:' || coalesce(doc_id::VARCHAR, '-')), doc_id, text_crc32, size) AS k,
                count(*) OVER (PARTITION BY stratum) AS of FROM t),
        o AS (SELECT *, row_number() OVER (ORDER BY (k - 0.5::DOUBLE) / of::DOUBLE, stratum NULLS FIRST, k) - 1 AS p, count(*) OVER () AS n FROM r),
        s AS (SELECT *, p * 24 // n AS shard FROM o)
        SELECT doc_id, stratum, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, (p - (shard * n + 23) // 24)::BIGINT AS slot,
          NULL::INTEGER AS grown_shard FROM s""",
}
