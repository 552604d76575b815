"""All registered queries and their SQL."""

from perfcap.plans import queries_rules, queries_runs, queries_sources

_MODULES = [queries_rules, queries_runs, queries_sources]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
