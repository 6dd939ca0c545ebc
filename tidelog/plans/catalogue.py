"""All registered queries of logs, runs, graphs, sketches and texts, with their SQL."""

from __future__ import annotations

from tidelog.operators import formats, graphs, hashing, keyvalue, ordering, reports, runs, sketches, texts
from tidelog.plans.registry import QUERIES, SQL, Query

_MODULES = (formats, graphs, hashing, keyvalue, ordering, reports, runs, sketches, texts)


def queries() -> dict[str, Query]:
    """Name -> (spark, sf_dir) -> DataFrame."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    return dict(SQL)
