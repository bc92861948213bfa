"""Registered queries: each applies an operator to tables projected from the given data, beside its SQL."""

from . import catalogue, claims, clustering, graph, intelligence, merges, movements, rosters, scalars, sources

_MODULES = [scalars, sources, merges, movements, rosters, clustering, claims, graph, intelligence, catalogue]
QUERIES = {k: f for m in _MODULES for k, f in m.REGISTRY.queries.items()}
SQL = {k: s for m in _MODULES for k, s in m.REGISTRY.sql.items()}
