"""Queries of this subpackage and their SQL."""

from . import bpe, chat, exact_dedup, factorisation, hard_negatives, jaccard, line_dedup, mixing, pii, quality_rules, rp_forest, toxicity, whitening

_MODULES = (bpe, chat, exact_dedup, factorisation, hard_negatives, jaccard, line_dedup, mixing, pii, quality_rules, rp_forest, toxicity, whitening)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
