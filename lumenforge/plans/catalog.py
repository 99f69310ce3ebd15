"""All queries of the engine by name, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .registry import ORACLES, QUERIES

FLAGSHIP = "flagship_shadow_rank"


def _load() -> None:
    from . import audit_queries, cohort_queries, contract_queries, cue_queries, detector_queries, experiment_queries, exploration_queries, ingest_queries, interval_queries, label_queries, lf_queries, media_queries, relational_queries, release_queries, review_queries, sampling_queries, stage_queries, stream_queries, text_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
