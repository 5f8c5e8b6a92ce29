"""The named queries of the repository and their SQL counterparts."""

from __future__ import annotations

from . import registry


def _load() -> None:
    from . import audits, depths, formats, scenes, sequences, streams, surfaces  # noqa: F401  (importing registers the queries)


def all_queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
