"""All queries by name, with the SQL that states the same result."""

from __future__ import annotations

from lattica.plans import color, geometry, kernels, pixels, resume, text  # noqa: F401 - they register their queries
from lattica.plans.registry import ORACLES, QUERIES, Query

FLAGSHIP = "merge_report"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
