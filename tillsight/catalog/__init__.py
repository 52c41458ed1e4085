"""The registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from tillsight.catalog import adaptive, forecasts, ingest, profiles, reports, sales, texts

MODULES = (sales, ingest, adaptive, profiles, texts, forecasts, reports)


def _merged(kind: str) -> dict:
    merged = {}
    for module in MODULES:
        for name, entry in getattr(module.CATALOG, kind).items():
            if name in merged:
                raise ValueError(f"query {name} is registered twice")
            merged[name] = entry
    return merged


def queries() -> dict:
    return _merged("queries")


def oracle_sql() -> dict:
    return _merged("oracles")
