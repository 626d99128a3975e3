"""All registered queries."""

from __future__ import annotations

from dwellmatch.plans import q_extract, q_functions, q_match, q_more, q_serve, q_stream, q_upsert  # noqa: F401
from dwellmatch.plans.q_match import matches_per_profile  # noqa: F401
from dwellmatch.plans.registry import CHECKS, RUNS, Run


def queries() -> dict[str, Run]:
    return dict(RUNS)


def oracle_sql() -> dict[str, str]:
    return dict(CHECKS)
