"""All registered queries of the library, by name."""

from __future__ import annotations

from headwater.plans import datasets, network, relational, terrain, zonal

_MODULES = (relational, network, zonal, terrain, datasets)

QUERIES = {name: query for module in _MODULES for name, (query, _) in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
