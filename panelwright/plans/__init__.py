"""End-to-end plans and the registered queries with their SQL checks."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "panel_queries", "asof_queries", "area_queries", "forecast_queries",
    "score_queries", "replay_queries", "learning_queries",
    "source_queries", "head_queries", "layer_queries",
)


def all_queries():
    """(plans, sql) of every query module."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from panelwright.plans.catalog import PLANS, SQL

    return PLANS, SQL
