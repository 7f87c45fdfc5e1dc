"""All named queries of the engine and their SQL twins."""

from __future__ import annotations

from fragmenta.plans import q_calls, q_dedup, q_filters, q_formats, q_intervals, q_kernels, q_stats, q_text  # noqa: F401  they register themselves
from fragmenta.plans.core import ORACLES, QUERIES, Query

FLAGSHIP = q_dedup.pass_somatic


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
