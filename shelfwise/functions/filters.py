"""The dashboard's filter tuple as one value object.

Region, warehouse and category are a name or the sentinel ``"All"``; the dates
bound an inclusive range of calendar days.  A missing bound means the data's own
minimum or maximum date, which is the dashboard's default range.  Since every
non-NULL date lies between the data's minimum and maximum, an open bound needs no
look-up: with both bounds open the range test reduces to ``date IS NOT NULL``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the sentinel that switches a filter off.
ALL = "All"


def _as_date(value) -> dt.date | None:
    if value is None or isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.datetime):
        return value.date()
    return dt.date.fromisoformat(str(value))


@dataclass(frozen=True)
class Filters:
    region: str = ALL
    warehouse: str = ALL
    category: str = ALL
    start_date: dt.date | str | None = None
    end_date: dt.date | str | None = None

    def __post_init__(self):
        object.__setattr__(self, "start_date", _as_date(self.start_date))
        object.__setattr__(self, "end_date", _as_date(self.end_date))
        for name in ("region", "warehouse", "category"):
            if getattr(self, name) is None:
                raise ValueError(f"{name} must be a name or {ALL!r}, not None")
        if self.start_date and self.end_date and self.start_date > self.end_date:
            raise ValueError(f"the range ends on {self.end_date}, before it starts on {self.start_date}")

    # -- which filters are on -------------------------------------------------
    @property
    def by_region(self) -> bool:
        return self.region != ALL

    @property
    def by_warehouse(self) -> bool:
        return self.warehouse != ALL

    @property
    def by_category(self) -> bool:
        return self.category != ALL

    def as_params(self) -> dict:
        """The five named parameters, as the SQL reports take them."""
        return {"region": self.region, "warehouse": self.warehouse, "category": self.category,
                "start_date": self.start_date, "end_date": self.end_date}

    # -- predicates -----------------------------------------------------------
    def date_in_range(self, ts: Column) -> Column:
        """``ts::date BETWEEN start AND end``: NULL dates fail, the last day counts whole.

        The cast to date on the column side is unwrapped by the optimizer into a
        plain range on the timestamp, which reaches the Parquet scan.
        """
        day = ts.cast("date")
        cond = ts.isNotNull()
        if self.start_date is not None:
            cond = cond & (day >= F.lit(self.start_date))
        if self.end_date is not None:
            cond = cond & (day <= F.lit(self.end_date))
        return cond

    def date_null_or_in_range(self, ts: Column) -> Column:
        """``ts IS NULL OR ts::date BETWEEN start AND end``."""
        return ts.isNull() | self.date_in_range(ts)

    @property
    def open_dates(self) -> bool:
        return self.start_date is None and self.end_date is None


def equals_unless_all(column: Column, value: str) -> Column | None:
    """``(:p = 'All' OR column = :p)`` with the constant part folded away."""
    return None if value == ALL else column == F.lit(value)


def where_all(df, *conditions):
    """Apply the conditions that are not ``None``."""
    for cond in conditions:
        if cond is not None:
            df = df.where(cond)
    return df
