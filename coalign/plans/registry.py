"""All registered queries of the linkage engine and the SQL that checks them."""

from __future__ import annotations

from .queries import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
