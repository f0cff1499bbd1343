"""Every registered query and its DuckDB SQL.

A query module registers with `query(name, sql, views)`: sql is the DuckDB text after the WITH clause of the named views.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from cellscape.plans.fixtures import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] | str = (), recursive: bool = False):
    """Register the decorated (spark, sf_dir) function."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            head = with_views(*((views,) if isinstance(views, str) else views)) if views else ""
            more = sql.lstrip().startswith("__")  # further named subqueries of the query itself
            text = head + (", " if head else "WITH ") * more + sql
            ORACLES[name] = text.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else text
        return f

    return keep


# Importing a query module registers its queries.
for _module in ("cells", "catalog", "spatial", "series", "focal", "summaries", "spectral", "regions", "learning", "streams"):
    importlib.import_module(f"cellscape.plans.{_module}")
