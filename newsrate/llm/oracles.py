"""The queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS digest, sha256(body) AS k FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY k) AS first_id FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id
    THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM m
"""

#: The mix of the table or query in braces.
MIX = r"""
WITH w AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('7:' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM w GROUP BY source),
r AS (
  SELECT source, source_size, (source_size * 2)::DOUBLE AS cap,
    [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE
      AS weight
  FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (
      ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
    ), 0)) / sum(weight) OVER (
      ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING
    ) AS level
  FROM r),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
p AS (
  SELECT w.doc_id, w.size, t.source_size, t.target,
    least(floor(t.target / 16 + 0.5)::BIGINT * 16, t.source_size * 2) AS wanted,
    sum(w.size) OVER (PARTITION BY w.source ORDER BY place, w.doc_id, w.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w.size AS start
  FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, wanted - start))
    + greatest(0, least(size, wanted - start - source_size)))::BIGINT AS taken
FROM p
"""

ORACLES = {
    "op1_warc": OP1,
    "op4_mixing": MIX.format(docs="documents"),
}
