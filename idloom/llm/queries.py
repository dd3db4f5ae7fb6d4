"""The queries of this subpackage and their SQL."""

from idloom.llm import bpe, decontaminate, lang_id, lm_score, pii, simhash, token_count, topk, toxicity, url_filter

MODULES = (lang_id, decontaminate, lm_score, pii, token_count, url_filter, bpe, simhash, topk, toxicity)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
