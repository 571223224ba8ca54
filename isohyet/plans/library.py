"""All named queries of the library but those of the text subpackage."""

from __future__ import annotations

from isohyet.plans import gridding, network, rain, records, registry, series  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
