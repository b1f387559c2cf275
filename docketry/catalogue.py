"""All queries of the core library."""

from __future__ import annotations

from importlib import import_module

from docketry import registry

MODULES = [
    *("docketry.operators." + m for m in ("skew", "nested_queries", "graph", "ranking", "terms", "retrieval", "insider", "facts", "content", "structure")),
    "docketry.sources.feeds",
    "docketry.streaming.events",
    "docketry.plans.questions",
    "docketry.plans.ingest",
    "docketry.plans.engine_queries",
]


def _load() -> None:
    for name in MODULES:
        import_module(name)


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
