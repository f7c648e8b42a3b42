"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""
from __future__ import annotations

from stringloom.llm.bpe import op10_bpe
from stringloom.llm.decontamination import op9_decontamination
from stringloom.llm.embedding_dedup import op7_embedding_dedup
from stringloom.llm.lm import op8_lm_scoring
from stringloom.llm.minhash import op2_minhash
from stringloom.llm.pii import op1_pii
from stringloom.llm.sharding import op4_sharding
from stringloom.llm.token_counts import op3_token_counts
from stringloom.llm.toxicity import op6_toxicity
from stringloom.llm.url_filter import LISTED_HOSTS, RULES, op5_url_filter


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_minhash, op3_token_counts, op4_sharding, op5_url_filter, op6_toxicity, op7_embedding_dedup, op8_lm_scoring, op9_decontamination, op10_bpe)}


def _op5_sql() -> str:
    rule = "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}|{h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    ) + " END"
    listed = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in LISTED_HOSTS)
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), {letters}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
v AS (SELECT *, {rule} AS found FROM s)
SELECT page_id, host, path, split_part(found, '|', 2) AS rule, split_part(found, '|', 1) AS verdict FROM v WHERE found IS NOT NULL
UNION ALL
SELECT page_id, host, path, NULL AS rule, CASE WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM v WHERE found IS NULL
"""


def oracle_sql() -> dict:
    return {"op5_url_filter": _op5_sql()}
