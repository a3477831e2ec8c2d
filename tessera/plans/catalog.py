"""Every query of the library by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from tessera.plans import analytics, changes, companies, dossiers, filings, texts  # noqa: F401  they register their queries
from tessera.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "market_map"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
