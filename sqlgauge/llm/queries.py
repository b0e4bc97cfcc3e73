"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sqlgauge.llm import embedding_dedup, exact_dedup, merkle, mixing, packing, quality, repair, simhash
from sqlgauge.llm import substring_dedup, suffix_dedup, tokens, topk, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        quality.op1_quality_classifier, url_filter.op2_url_filter, packing.op3_best_fit_packing,
        tokens.op4_token_counts, mixing.op5_mixing, exact_dedup.op6_exact_dedup, simhash.op7_simhash_near_dedup,
        embedding_dedup.op8_embedding_near_dedup, substring_dedup.op9_substring_dedup, suffix_dedup.op10_suffix_dedup,
        topk.op11_exact_topk, repair.op12_conversation_repair, merkle.op13_merkle_manifest,
    )
}

_EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id)
SELECT m.vec_id, (SELECT count(*) FROM l WHERE l.a = m.vec_id) AS n_links, component_id, m.vec_id = component_id AS kept
FROM m
"""

_WORDS = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t),
g AS (SELECT doc_id, i, word, count(*) OVER f AS n, md5(string_agg(word, ' ') OVER f) AS h FROM w
      WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
o AS (SELECT doc_id, i, word, n = 50 AND min(doc_id) OVER (PARTITION BY h, n) < doc_id AS gone FROM g),
c AS (SELECT doc_id, i, word, bool_or(gone) OVER (PARTITION BY doc_id ORDER BY i
             ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS covered FROM o),
k AS (SELECT doc_id, count(*) FILTER (covered) AS n_removed,
             string_agg(word, ' ' ORDER BY i) FILTER (NOT covered) AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, len(t.ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op2_url_filter": url_filter.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op8_embedding_near_dedup": _EMBEDDINGS,
    "op9_substring_dedup": _WORDS,
    "op11_exact_topk": topk.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
