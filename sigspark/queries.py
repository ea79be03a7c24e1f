"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("features", "relational", "scoring", "monthly", "storage")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _family in FAMILIES:
    for _name, (_query, _sql) in import_module(f"sigspark.catalog.{_family}").QUERIES.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLE_SQL[_name] = _sql

ENTRY = "daily_net_sentiment"
