"""Registered queries of the reweighting library."""

from __future__ import annotations

from .plans import check_features, check_files, check_manifest, check_models, check_runs

_PARTS = [check_features, check_runs, check_manifest, check_files, check_models]


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.SQL.items()}
