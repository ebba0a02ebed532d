"""Registered queries and their SQL twins, gathered from the modules of this package."""

from __future__ import annotations

from barwright.plans import market, study, trading
from barwright.plans.market import flagship

QUERIES: dict = {}
ORACLES: dict = {}
for module in (market, trading, study):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)

__all__ = ["ORACLES", "QUERIES", "flagship"]
