"""Queries over the driver's tables and the SQL that says the same."""

from __future__ import annotations

from tessera.plans import drawings, inventory, joins, reports, rules, totals

MODULES = (inventory, rules, joins, drawings, totals, reports)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
