"""All registered queries, in inventory order."""

from __future__ import annotations

from importlib import import_module

from docketry.plans import registry

MODULES = (
    "filings",
    "changes",
    "titles",
    "financials",
    "coverage",
    "digests",
    "corpus",
    "archive",
    "sources",
    "streams",
)


def _load() -> None:
    for name in MODULES:
        import_module(f"docketry.plans.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracles():
    _load()
    return dict(registry.ORACLES)
