"""Named query plans over the test tables."""

from __future__ import annotations


def _modules() -> list:
    from sightline.plans import clustering, data, errors, evaluation, failures, files, release, resampling

    return [evaluation, errors, data, failures, files, release, resampling, clustering]


def queries() -> dict:
    return {k: q for m in _modules() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in m.SQL.items()}
