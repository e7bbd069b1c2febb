"""All queries of the reference's operators, and their SQL."""

from importlib import import_module

FAMILIES = ["texts", "curation", "analytics", "evaluation", "records", "models"]

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in FAMILIES:
    _family = import_module(f"siltstone.plans.{_name}").REGISTRY
    QUERIES |= _family.queries
    ORACLE_SQL |= _family.sql
