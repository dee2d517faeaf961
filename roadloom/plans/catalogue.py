"""All named queries of the analytics, and their SQL."""

from roadloom.plans import fleet, learning, payloads, service, streams, telemetry

_MODULES = (telemetry, fleet, learning, payloads, service, streams)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
