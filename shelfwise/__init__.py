"""shelfwise: retail sales and inventory analytics as Spark DataFrame operators.

Every operator is a function ``(tables, filters) -> DataFrame`` that builds a
lazy plan; nothing is collected until the caller asks for the (small, final)
result.
"""

from shelfwise.functions.filters import Filters
from shelfwise.sources.catalog import RetailTables, load_driver_tables, load_stored_tables

__all__ = ["Filters", "RetailTables", "load_driver_tables", "load_stored_tables"]
