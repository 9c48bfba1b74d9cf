"""The engine's queries: name -> (spark, folder) -> DataFrame, each beside its SQL."""

from __future__ import annotations

from .plans import evaluation, files, making, more, preparation, space  # noqa: F401  (they register their queries)
from .plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
