"""Column expressions shared by the operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Labels, thresholds and patterns of the reports (they must equal
# the original's for equal results).
# ---------------------------------------------------------------------------
OUT_OF_STOCK = "Out of Stock"
RESTOCK_NOW = "Restock Now"
MONITOR_CLOSELY = "Monitor Closely"
HEALTHY = "Healthy"
MONITOR_BAND = 5                      # stock <= reorder + 5 is "near" the reorder level

OVERSTOCK = "Overstock: Run Promotion"
SEASONAL = "Seasonal Clearance"
HEALTHY_INVENTORY = "Healthy Inventory"
OVERSTOCK_MIN_STOCK = 50              # stock > 50 ...
OVERSTOCK_MAX_UNITS = 5               # ... and fewer than 5 units sold
SEASONAL_PATTERN = "%Winter%"         # ILIKE on the product details text

SLOW_MOVER_RATIO = Decimal("0.05")    # units sold < stock * 0.05 is a slow mover

MONEY_OUT = "double"                  # money leaves every operator as DOUBLE


def inventory_status(stock: Column, reorder: Column) -> Column:
    """Out of Stock / Restock Now / Monitor Closely / Healthy."""
    return (F.when(stock == 0, F.lit(OUT_OF_STOCK))
            .when(stock < reorder, F.lit(RESTOCK_NOW))
            .when(stock <= reorder + MONITOR_BAND, F.lit(MONITOR_CLOSELY))
            .otherwise(F.lit(HEALTHY)))


def near_reorder(stock: Column, reorder: Column) -> Column:
    return stock <= reorder + MONITOR_BAND


def urgency(stock: Column, reorder: Column) -> Column:
    """Sort key of the low-stock list: 1 out of stock, 2 under the level, 3 else."""
    return F.when(stock == 0, F.lit(1)).when(stock < reorder, F.lit(2)).otherwise(F.lit(3))


def promotion_recommendation(stock: Column, reorder: Column, units_sold: Column,
                             details: Column) -> Column:
    return (F.when((stock > OVERSTOCK_MIN_STOCK) & (units_sold < OVERSTOCK_MAX_UNITS), F.lit(OVERSTOCK))
            .when(details.ilike(SEASONAL_PATTERN) & (stock > reorder), F.lit(SEASONAL))
            .otherwise(F.lit(HEALTHY_INVENTORY)))


def cents(amount: Column) -> Column:
    """A ``decimal(12,2)`` amount as a whole number of cents (``long``).

    Sums of ``decimal(12,2)`` are ``decimal(22,2)``, whose aggregation buffer is a
    boxed big decimal; sums of cents stay in primitive longs inside generated code
    and are just as exact (overflow raises under ANSI mode instead of wrapping).
    ``decimal(12,2) * 100`` is ``decimal(16,2)``, still a compact decimal.
    """
    return (amount * F.lit(Decimal(100))).cast("long")


def money(total_cents: Column, exact: bool = False) -> Column:
    """Whole cents as an amount: an exact decimal, or the double nearest to it.

    Equal to ``ROUND(SUM(amount), 2)``: the sum of cent amounts has no third decimal, so the
    rounding changes nothing.  The decimal becomes a double once, here, and only at the outer edge.
    """
    amount = total_cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))
    return amount if exact else amount.cast(MONEY_OUT)


def escape_like(text: str) -> str:
    """Escape a user's text for use inside a LIKE pattern (escape character ``\\``)."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(column: Column, text: str) -> Column:
    """``column ILIKE '%text%'`` with the user's text taken literally."""
    return column.ilike(f"%{escape_like(text)}%")
