"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .op1_token_output import op1_token_output
from .op2_ppm import op2_ppm
from .op3_token_counts import op3_token_counts
from .op4_bpe import op4_bpe
from .op5_media import op5_media
from .op6_minhash import op6_minhash
from .op7_decontamination import op7_decontamination
from .op8_html import op8_html
from .op9_toxicity import op9_toxicity
from .op10_quality import op10_quality

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_output,
        op2_ppm,
        op3_token_counts,
        op4_bpe,
        op5_media,
        op6_minhash,
        op7_decontamination,
        op8_html,
        op9_toxicity,
        op10_quality,
    )
}

#: Decontamination is plain relational work and cheap enough for SQL on whole tables.
ORACLE_SQL = {
    "op7_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT s.doc_id, s.i, s.m, p.item_id FROM s JOIN p USING (m, k)),
n AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + m - 1)) AS j FROM h) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
""",
}
