"""Operators bound to the driver tables."""

from importlib import import_module

MODULES = ["intake_queries", "text_queries", "entity_queries", "evidence_queries", "job_queries",
           "research_queries", "review_queries", "delivery_queries", "document_queries", "stream_queries"]


def load_all():
    from . import registry
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.ORACLES
