"""Registered queries, each beside its SQL twin."""

from __future__ import annotations


def load() -> dict:
    """Import every catalogue module and return ``{name: Query}``."""
    from tidemeter.catalog import (  # noqa: F401
        almanac, comparisons, entities, ingest, live, milestones, records, reports, rhythms, sequences, titles,
    )
    from tidemeter.catalog.registry import CATALOG

    return CATALOG
