"""Named queries over the test set, each with the SQL that must give the same rows."""

from __future__ import annotations

from tidemill.registry import changes, inventory, loads, profiles, sales, synth
from tidemill.registry.query import Query

QUERIES: dict[str, Query] = {}
for _module in (inventory, sales, profiles, changes, loads, synth):
    for _name, _query in _module.QUERIES.items():
        if _name in QUERIES:
            raise ValueError(f"two queries are called {_name}")
        QUERIES[_name] = _query

__all__ = ["QUERIES", "Query"]
