"""Registry of the queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from .queries import code, flows, graphs, registry, repairs, reports, sources, web  # noqa: F401  (they register themselves)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
