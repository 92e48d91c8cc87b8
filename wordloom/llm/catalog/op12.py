"""Merkle proofs of all documents, and whether some changed leaves still give the root."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import read_table
from wordloom.llm.merkle import fold, manifest, siblings_hash

TAMPERED = 7


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("id").cast("string").cast("binary")) % TAMPERED == 0
    found = manifest(read_table(spark, sf_dir, "documents"), changed)
    folded = fold(F.coalesce("other_leaf", "leaf"), F.col("path"))
    rows = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", siblings_hash(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = """
WITH RECURSIVE h AS (
    SELECT doc_id, lang, n_chars, text, source FROM documents
), f AS (
    SELECT doc_id, lang, n_chars,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
             || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
           coalesce(strlen(text) || ':' || text, '-') AS tail
    FROM h
), leaves AS MATERIALIZED (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || tail) AS leaf,
           sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') || tail) AS changed
    FROM f
), bits AS (
    SELECT doc_id, list_reduce([4294967295] || list_transform(range(0, length(CAST(doc_id AS VARCHAR))), lambda k: CAST(ascii(CAST(doc_id AS VARCHAR)[k + 1]) AS BIGINT)),
        lambda c, b: list_reduce([xor(c, b)] || range(0, 8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
    FROM documents
), tampered AS MATERIALIZED (
    SELECT DISTINCT doc_id FROM bits WHERE (4294967295 - crc) % 7 = 0
), ranked AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos FROM leaves
), level AS MATERIALIZED (
    SELECT lang, 0 AS depth, list(leaf ORDER BY pos) AS nodes FROM ranked GROUP BY lang
    UNION ALL
    SELECT lang, depth + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
    FROM level WHERE len(nodes) > 1
), subroots AS MATERIALIZED (
    SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM level WHERE len(nodes) = 1
), top AS MATERIALIZED (
    SELECT 0 AS depth, list(subroot ORDER BY pos) AS nodes FROM subroots
    UNION ALL
    SELECT depth + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM top WHERE len(nodes) > 1
), steps AS (
    SELECT r.doc_id, r.leaf, l.depth, (r.pos >> l.depth) % 2 AS side, coalesce(l.nodes[xor(r.pos >> l.depth, 1) + 1], '') AS sibling
    FROM ranked r JOIN level l ON l.lang IS NOT DISTINCT FROM r.lang WHERE len(l.nodes) > 1
    UNION ALL
    SELECT r.doc_id, r.leaf, 1000 + t.depth, (s.pos >> t.depth) % 2, coalesce(t.nodes[xor(s.pos >> t.depth, 1) + 1], '')
    FROM ranked r JOIN subroots s ON s.lang IS NOT DISTINCT FROM r.lang, top t WHERE len(t.nodes) > 1
), paths AS MATERIALIZED (
    SELECT doc_id, leaf, list(CASE WHEN side = 1 THEN '1' ELSE '0' END || sibling ORDER BY depth) AS path FROM steps GROUP BY doc_id, leaf
), joined AS (
    SELECT r.doc_id, r.leaf, r.lang, coalesce(p.path, []) AS path, CASE WHEN t.doc_id IS NULL THEN r.leaf ELSE r.changed END AS start
    FROM ranked r LEFT JOIN paths p ON p.doc_id = r.doc_id AND p.leaf = r.leaf LEFT JOIN tampered t ON t.doc_id = r.doc_id
), folded AS (
    SELECT *, list_reduce([start] || path,
        lambda a, x: sha256(CASE WHEN x[1] = '1' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
    FROM joined
)
SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root,
       sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) AS proof_sha256, folded_root,
       folded_root = (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS verified
FROM folded f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang
"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": SQL}
