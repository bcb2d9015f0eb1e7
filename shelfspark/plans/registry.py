"""All registered queries of the catalog library."""

from __future__ import annotations

from . import base
from . import audit, facets, normalize, offers, paging, quality, ranking, search, streams, sync  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
