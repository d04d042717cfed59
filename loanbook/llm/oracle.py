"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

WARC_AUDIT = r"""
WITH made AS (
  SELECT page_id, CAST(floor(page_id / 1000) AS BIGINT) AS file, coalesce(html, '') AS body,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
         || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) AS head,
         substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS drawn
  FROM pages
), records AS (
  SELECT page_id, file, drawn, head || body || chr(13) || chr(10) || chr(13) || chr(10) AS record,
         head || '~' || substr(body || chr(13) || chr(10) || chr(13) || chr(10), 2) AS changed
  FROM made
), placed AS (
  SELECT page_id, file, drawn, changed, octet_length(encode(record)) AS length, sha256(record) AS digest,
         coalesce(sum(octet_length(encode(record))) OVER (
           PARTITION BY file ORDER BY page_id, sha256(record) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset"
  FROM records
)
SELECT page_id, file, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length,
       CASE WHEN drawn < '04' THEN 'missing' ELSE 'altered' END AS fault, digest,
       CASE WHEN drawn < '04' THEN NULL ELSE sha256(changed) END AS copy_digest
FROM placed
WHERE drawn IN ('00', '01', '02', '03', '10', '11', '12', '13')
"""

HARD_NEGATIVES = r"""
WITH taken AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), anchors AS (
  SELECT * FROM taken WHERE vec_id % 50 = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM anchors a JOIN taken r ON a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""

SQL = {"op8_warc_audit": WARC_AUDIT, "op11_hard_negatives": HARD_NEGATIVES}
