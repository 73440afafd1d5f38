"""Imports every plan module so that its queries are registered."""

from gitstrata.plans import (  # noqa: F401
    block_plans,
    commit_plans,
    deps_plans,
    health_plans,
    incremental_plans,
    model_plans,
    occurrence_plans,
    quality_plans,
    report_plans,
    scan_plans,
    streaming_plans,
    structure_plans,
)
from gitstrata.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
