"""All registered memory queries, gathered from the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memloom.plans import cascade, dedup, extraction, graph, longterm, mentions, merging, mining, nearest, provenance, reasoning, resolution, shortterm, streams, upkeep, vectors

_MODULES = (shortterm, longterm, provenance, reasoning, vectors, graph, resolution, cascade, extraction, mining, mentions, merging, dedup, nearest, upkeep, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
