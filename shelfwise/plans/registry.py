"""Named queries: an operator applied to the test tables under a fixed filter.

Each entry maps a key to ``(spark, sf_dir) -> DataFrame`` and, where the query is
expressible in SQL, to its DuckDB oracle text (``shelfwise.plans.oracle``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfwise.functions.filters import Filters
from shelfwise.plans import oracle as O
from shelfwise.sources.catalog import RetailTables, load_driver_tables

# Filter presets used by the registered queries.
OPEN = Filters()
NARROW = Filters(region="ASIA", warehouse="NATION_2", category="PROMO",
                 start_date="1996-01-01", end_date="1997-12-31")
CATEGORY_ONLY = Filters(category="PROMO", start_date="1996-01-01", end_date="1997-12-31")
THREE_DAYS = Filters(start_date="1996-01-01", end_date="1996-01-03")


@dataclass(frozen=True)
class NamedQuery:
    key: str
    run: Callable[[RetailTables], DataFrame] | None
    oracle: str | None = None
    # Queries that read the test folder themselves (streams) instead of the tables.
    run_raw: Callable[[SparkSession, str], DataFrame] | None = None


_REGISTRY: dict[str, NamedQuery] = {}


def register(key: str, run: Callable[[RetailTables], DataFrame], oracle: str | None = None) -> None:
    if key in _REGISTRY:
        raise ValueError(f"duplicate query key {key!r}")
    _REGISTRY[key] = NamedQuery(key, run, oracle)


def register_raw(key: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    if key in _REGISTRY:
        raise ValueError(f"duplicate query key {key!r}")
    _REGISTRY[key] = NamedQuery(key, None, oracle, run)


def _ensure_loaded() -> None:
    if not _REGISTRY:
        from shelfwise.plans import catalog_queries  # noqa: F401  (registers on import)


def named_queries() -> dict[str, NamedQuery]:
    _ensure_loaded()
    return dict(_REGISTRY)


def spark_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: NamedQuery):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if q.run_raw is not None:
                return q.run_raw(spark, sf_dir)
            return q.run(load_driver_tables(spark, sf_dir))
        run.__name__ = q.key
        return run
    return {k: bind(q) for k, q in named_queries().items()}


def oracle_texts() -> dict[str, str]:
    return {k: q.oracle for k, q in named_queries().items() if q.oracle is not None}


__all__ = ["OPEN", "NARROW", "CATEGORY_ONLY", "THREE_DAYS", "register", "register_raw", "named_queries", "spark_callables",
           "oracle_texts", "O"]
