"""Registered queries: a Spark callable and, where SQL can say it, an oracle text."""

from __future__ import annotations

import importlib

from tidegauge.catalog.base import REGISTRY, Query

TOPICS = (
    "flagship",
    "sources",
    "quality",
    "joins",
    "bars",
    "windows",
    "recursive",
    "positions",
    "ledger",
    "scoring",
    "statistics",
    "resampling",
    "models",
    "accounts",
    "studies",
    "live",
)


def load() -> dict[str, Query]:
    for topic in TOPICS:
        try:
            importlib.import_module(f"tidegauge.catalog.{topic}")
        except ModuleNotFoundError as e:
            if e.name != f"tidegauge.catalog.{topic}":
                raise
    return REGISTRY
