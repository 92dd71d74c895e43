"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from .decontam import op5
from .media import op3
from .packing import op8
from .pagediff import op7
from .quality import op9
from .simhash import op10
from .suffixdedup import op2
from .toxicity import op1
from .transducer import op6
from .warc import op4

QUERIES = {
    "op1_convolutional_toxicity": op1,
    "op2_suffix_array_dedup": op2,
    "op3_interleaved_media": op3,
    "op4_warc_archives": op4,
    "op5_fm_index_decontamination": op5,
    "op6_transducer_token_counts": op6,
    "op7_page_differencing": op7,
    "op8_hilbert_packing": op8,
    "op9_additive_quality": op9,
    "op10_simhash_near_duplicates": op10,
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: SQL for those queries that it can express in full.
ORACLES: dict[str, str] = {
    "op4_warc_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
g AS (SELECT h, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN page_id < m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < m THEN m END AS refers_to FROM p LEFT JOIN g ON g.h = p.h AND n >= 1000""",
    "op5_fm_index_decontamination": f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, w[k:k + least(len(w), 8) - 1] AS g, least(len(w), 8) AS m FROM bw, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM iw),
dg AS (SELECT doc_id, k, m, w[k:k + m - 1] AS g FROM dw, sizes, unnest(range(1, len(w) - m + 2)) AS u(k)),
hits AS (SELECT doc_id, k, dg.m, item FROM dg JOIN iw ON dg.g = iw.g),
hw AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS x FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM dw LEFT JOIN hw ON dw.doc_id = hw.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id""",
}
