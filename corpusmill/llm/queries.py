"""Registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from corpusmill.llm.decontaminate import op5_decontaminate
from corpusmill.llm.embeddings import op3_embeddings
from corpusmill.llm.html_extract import op7_html
from corpusmill.llm.langid import op10_langid
from corpusmill.llm.licenses import op8_licenses
from corpusmill.llm.packing import op4_packing
from corpusmill.llm.quality import op1_quality
from corpusmill.llm.simhash import op6_simhash
from corpusmill.llm.substring import op9_substring
from corpusmill.llm.urls import op2_urls

QUERIES = {
    "op1_quality": op1_quality,
    "op2_urls": op2_urls,
    "op3_embeddings": op3_embeddings,
    "op4_packing": op4_packing,
    "op5_decontaminate": op5_decontaminate,
    "op6_simhash": op6_simhash,
    "op7_html": op7_html,
    "op8_licenses": op8_licenses,
    "op9_substring": op9_substring,
    "op10_langid": op10_langid,
}

_OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), good AS (
  SELECT vec_id, label, x FROM v
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len([c for c in x if c IS NULL OR NOT isfinite(c)]) = 0 AND len([c for c in x if c <> 0]) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reach AS (
  SELECT vec_id AS u, vec_id AS v FROM good
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), part AS (
  SELECT u, min(v) AS component_id FROM reach GROUP BY u
), degree AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT v.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, coalesce(p.component_id, v.vec_id) AS component_id,
       coalesce(p.component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN part p ON p.u = v.vec_id LEFT JOIN degree d ON d.u = v.vec_id
"""

_OP9 = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, unnest([sha256(array_to_string(ws[s:s + 19], ' ')) for s in range(1, len(ws) - 18)]) AS k
  FROM docs WHERE len(ws) >= 20
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1
), words AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM docs
), judged AS (
  SELECT w.doc_id, i, word, coalesce(i - max(l.s) OVER (PARTITION BY w.doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) < 20, false) AS removed
  FROM words w LEFT JOIN later l ON l.doc_id = w.doc_id AND l.s = w.i
), counted AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS kept
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(c.n_words, 0) AS n_words, coalesce(c.n_removed, 0) AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN counted c ON c.doc_id = d.doc_id
"""

#: The other operators can't be put in SQL: they hash with XXH64, tokenize, align, or learn a model.
ORACLES: dict[str, str] = {"op3_embeddings": _OP3, "op9_substring": _OP9}
