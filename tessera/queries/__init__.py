"""Queries by operator id, each with the DuckDB SQL that must give the same rows."""

from tessera.queries import audits, features, labels, more, views

MODULES = (features, views, audits, more, labels)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
