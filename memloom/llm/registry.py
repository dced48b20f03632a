"""All queries of this subpackage."""

from __future__ import annotations

from memloom.llm import (
    queries_bpe,
    queries_clusters,
    queries_labels,
    queries_mix,
    queries_neardup,
    queries_packing,
    queries_pii,
    queries_secrets,
    queries_spotsigs,
    queries_topk,
    queries_whitening,
    queries_wordpiece,
)

_MODULES = (
    queries_bpe, queries_mix, queries_wordpiece, queries_neardup, queries_labels, queries_pii, queries_secrets, queries_spotsigs, queries_topk,
    queries_packing, queries_clusters, queries_whitening,
)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
