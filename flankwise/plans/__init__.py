"""Whole queries: operators composed over a set of tables."""

from importlib import import_module

MODULES = [
    "evidence_queries", "ranking_queries", "similarity_queries", "metric_queries", "literature_queries", "table_queries",
    "audit_queries", "evaluation_queries", "record_queries",
]


def load_queries():
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from .registry import registry

    return registry
