"""Every registered query; importing the family modules fills the registry."""

from __future__ import annotations

import importlib

FAMILIES = ["bars", "relational", "market_days", "ranking", "entries", "panels", "checks", "learning"]


def all_queries():
    from barlab.plans.registry import QUERIES

    for family in FAMILIES:
        importlib.import_module(f"barlab.plans.{family}")
    return QUERIES
